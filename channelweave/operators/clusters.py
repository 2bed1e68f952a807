"""Many k-means models in shared scans.

A sweep over k, seeds and starts, or a bootstrap that refits its codebook a thousand
times, is one matrix of centres: every pass over the rows moves the centres of all
models at once. A task multiplies its rows with that matrix, picks each model's nearest
centre, and leaves sums; the driver gets a few numbers for each centre. A model that
has settled is out of the next pass.

Rows are standardised per model: a resample has its own means and deviations, which are
linear maps of the same columns and so go into the matrix. Starts are those of k-means||:
its candidates are drawn by distance from all rows and weighed by all rows, and each model
draws its centres from them by k-means++. Then every round reads all rows, however many
there are: in the first ``ROUNDS`` centres move after each of some parts that together are
all rows, and from then on after all rows at once, until the model settles there."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.functions.sums import array_sums, poisson_counts, summed, uniform
from channelweave.sources.tables import scratch

#: Draws of candidates for starts, and how many each takes for a centre of the largest model.
DRAWS, OVER = 4, 8
#: Rows of a part on average while there are fewer than so many parts.
BATCH_ROWS, SLOTS = 1 << 14, 16
#: Rounds over all rows in which centres move after each part.
ROUNDS = 2
#: A model has settled when a pass lowers its inertia by less than this share.
TOLERANCE, MAX_PASSES = 1e-4, 100
#: Numbers of a block of distances (rows x centres).
BLOCK = 1 << 21
#: Rows and models of a block of sums.
ROWS, TILE = 256, 128
SUMS = "model int, sums array<double>"


class Block(NamedTuple):
    """Columns that are clustered together. Values that equal the sentinel are missing:
    they count as the mean, and each column says in another whether it was there."""

    columns: list[str]
    sentinel: float | None = None


class Spec(NamedTuple):
    """A model to fit. Replicates other than -1 weigh rows by Poisson counts; k is the
    number of centres, ``start`` tells apart the tries of one (k, seed)."""

    block: str
    k: int
    seed: int
    start: int = 0
    replicate: int = -1


@dataclass(frozen=True)
class Fit:
    """Centres in standardised space (k x columns, then flags), with the map into it."""

    spec: Spec
    centres: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    sizes: np.ndarray
    inertia: float

    def linear(self, flags: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of distances: the matrix for [columns, there] and what is added."""
        d = len(self.mean)
        slope = self.centres[:, :d] / self.scale
        there = -slope * self.mean
        there = there + self.centres[:, d:] if flags else there.sum(1, keepdims=True)
        return np.hstack([slope, there]), (self.centres**2).sum(1)


class Points(NamedTuple):
    """Rows written for the passes: h, slot, an array of each block, and targets."""

    rows: DataFrame
    n: int
    slots: int
    blocks: dict[str, Block]
    centre: dict[str, np.ndarray]
    targets: list[str]
    levels: int


def prepare(rows: DataFrame, key: list[str], blocks: dict[str, Block], targets: tuple[str, ...] = (), batch_rows: int = BATCH_ROWS) -> Points:
    """The rows as the passes read them: their plan runs once, for means and the table.

    Rows with a null in a block are an error; targets may be null, else they are small
    whole numbers from 0. The keys should tell rows apart: equal keys are drawn alike."""
    rows = rows.select(*dict.fromkeys([*key, *(c for block in blocks.values() for c in block.columns), *targets])).persist()
    real = {(b, i): F.col(c) if block.sentinel is None else F.when(F.col(c) != block.sentinel, F.col(c)) for b, block in blocks.items() for i, c in enumerate(block.columns)}
    known = [F.count(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1)) for block in blocks.values() for c in block.columns]
    about = [F.count("*").alias("n"), *(F.avg(x).alias(f"{b}_{i}") for (b, i), x in real.items()), *(F.max(t).alias(f"top_{t}") for t in targets)]
    stats = rows.agg(*about, sum(known, F.lit(0)).alias("unknown")).first()
    if stats["unknown"]:
        rows.unpersist()
        raise ValueError("columns to cluster have nulls or NaN")
    slots = min(max(1, -(-stats["n"] // batch_rows)), SLOTS)
    slot = F.pmod(F.xxhash64(F.lit("slot"), *key), F.lit(slots)).cast("int")
    arrays = [F.array(*(F.col(c).cast("double") for c in block.columns)).alias(b) for b, block in blocks.items()]
    path = scratch(rows.sparkSession)
    made = rows.select(F.xxhash64(*key).alias("h"), slot.alias("slot"), *arrays, F.array(*(F.col(t).cast("int") for t in targets)).cast("array<int>").alias("y"))
    made.write.parquet(path)
    rows.unpersist()
    centre = {b: np.array([stats[f"{b}_{i}"] or 0.0 for i in range(len(block.columns))]) for b, block in blocks.items()}
    levels = 1 + max((int(stats[f"top_{t}"] or 0) for t in targets), default=0)
    schema = "h long, slot int, " + "".join(f"`{b}` array<double>, " for b in blocks) + "y array<int>"
    return Points(rows.sparkSession.read.schema(schema).parquet(path), stats["n"], slots, blocks, centre, list(targets), levels)


def base(points: Points, block: str, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's columns, 0 where missing and else about their mean, and flags."""
    there = np.ones(values.shape) if points.blocks[block].sentinel is None else (values != points.blocks[block].sentinel).astype(float)
    return np.where(there > 0, values - points.centre[block], 0.0), there


class Stack:
    """Models of one block and one k: what a task needs to move their centres."""

    def __init__(self, points: Points, block: str, fits: dict[int, Fit]):
        self.block, self.names, self.flags = block, list(fits), points.blocks[block].sentinel is not None
        found = [f.linear(self.flags) for f in fits.values()]
        self.k, self.many = len(found[0][1]), len(found)
        self.matrix, self.norms = np.vstack([m for m, _ in found]).T, np.concatenate([n for _, n in found])
        mean, self.scale = np.array([f.mean for f in fits.values()]), np.array([f.scale for f in fits.values()])
        self.own = [(1 / self.scale**2).T, (-2 * mean / self.scale**2).T, (mean**2 / self.scale**2).T]
        self.replicates = np.array([f.spec.replicate for f in fits.values()])

    def features(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.hstack([x, there if self.flags else there[:, :1]])

    def nearest(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x models): the nearest centre, and its distance less the row's norm."""
        d = (self.norms - 2 * (f @ self.matrix)).reshape(len(f), self.many, self.k)
        at = d.argmin(2)
        return at, np.take_along_axis(d, at[:, :, None], 2)[:, :, 0]

    def norm(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        return (x**2) @ self.own[0] + x @ self.own[1] + there @ self.own[2] + (there.sum(1, keepdims=True) if self.flags else 0)

    def sums(self, x: np.ndarray, there: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(models, k * (features + 1) + 1): sums and sizes by centre, and the inertia.

        Some models at a time, so that their distances stay in a core's cache."""
        f = np.hstack([self.features(x, there), np.ones((len(x), 1))])
        wide = f.shape[1]
        norm, total, inertia = self.norm(x, there), np.empty((self.many, self.k, wide)), np.empty((self.many, 1))
        moves = np.vstack([-2 * self.matrix, self.norms]).reshape(wide, self.many, self.k).transpose(0, 2, 1)
        for a in range(0, self.many, TILE):
            w = np.ascontiguousarray(weights[:, a : a + TILE])
            move = np.ascontiguousarray(moves[:, :, a : a + TILE]).reshape(wide, -1)
            d = (f @ move).reshape(len(f), self.k, -1)
            least = d.min(1)
            near = d == least[:, None]
            found = f.T @ np.multiply(near, w[:, None], out=d).reshape(len(f), -1)
            if found[-1].sum() != w.sum():  # some rows are as near to other centres: they go to the first
                near &= np.cumsum(near, 1) == 1
                found = f.T @ np.multiply(near, w[:, None], out=d).reshape(len(f), -1)
            total[a : a + TILE] = found.reshape(wide, self.k, -1).transpose(2, 1, 0)
            inertia[a : a + TILE, 0] = (w * (least + norm[:, a : a + TILE])).sum(0)
        return np.hstack([total.reshape(self.many, -1), inertia])


def batch_arrays(points: Points, batch: pa.RecordBatch, rows: int) -> Iterator[tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """Slices of a batch as (h, columns and flags of each block, targets with -1 for null)."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        matrix = lambda name: part[name].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)  # noqa: E731, B023
        y = part["y"].flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) if points.targets else np.zeros((part.num_rows, 0), int)
        yield part["h"].to_numpy(), {b: base(points, b, matrix(b)) for b in points.blocks}, y


def weighed(h: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Rows' weights (rows x models); equal replicates are drawn once."""
    drawn, at = np.unique(replicates, return_inverse=True)
    if (drawn >= 0).all():
        found = poisson_counts(h, drawn, seed)
    else:
        found = np.ones((len(h), len(drawn)))
        found[:, drawn >= 0] = poisson_counts(h, drawn[drawn >= 0], seed)
    return found if np.array_equal(drawn, replicates) else found[:, at]


def weighed_once(h: np.ndarray, replicates: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """``weighed`` of each; equal lists of replicates share one result."""
    made: dict[bytes, np.ndarray] = {}
    return [made[r.tobytes()] if r.tobytes() in made else made.setdefault(r.tobytes(), weighed(h, r, seed)) for r in replicates]


def stacks(points: Points, fits: dict[int, Fit]) -> list[Stack]:
    groups: dict[tuple[str, int], dict[int, Fit]] = defaultdict(dict)
    for name, fit in fits.items():
        groups[fit.spec.block, fit.spec.k][name] = fit
    return [Stack(points, block, some) for (block, _), some in groups.items()]


def light(points: Points) -> Points:
    """Without the frame, for tasks."""
    return points._replace(rows=None)


def one_pass(points: Points, rows: DataFrame, fits: dict[int, Fit], seed: int) -> dict[int, np.ndarray]:
    """The sums of every model over the rows: a few numbers for each centre reach the
    driver, whatever the number of rows."""
    shared = rows.sparkSession.sparkContext.broadcast((light(points), stacks(points, fits)))

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        about, models = shared.value
        total: list | None = None
        for batch in batches:
            for h, blocks, _ in batch_arrays(about, batch, ROWS):
                weights = weighed_once(h, [s.replicates for s in models], seed)
                found = [s.sums(*blocks[s.block], w) for s, w in zip(models, weights, strict=True)]
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        return None if total is None else np.concatenate([x.ravel() for x in total])

    total, at, out = summed(rows.select("h", *points.blocks, "y"), add), 0, {}
    for s in stacks(points, fits) if total is not None else ():
        wide = s.k * (s.matrix.shape[0] + 1) + 1
        out |= dict(zip(s.names, total[at : at + wide * s.many].reshape(s.many, wide), strict=True))
        at += wide * s.many
    shared.unpersist()
    return out


def moved(fit: Fit, sums: np.ndarray, flags: bool) -> Fit:
    """The centres at the means of what was nearest to them; empty ones stay."""
    k, d = len(fit.centres), len(fit.mean)
    total, inertia = sums[:-1].reshape(k, -1), sums[-1]
    n = np.rint(total[:, -1])
    held = np.maximum(n, 1)[:, None]
    there = total[:, d:-1] if flags else np.repeat(total[:, d : d + 1], d, 1)
    z = (total[:, :d] - there * fit.mean) / fit.scale / held
    centres = np.hstack([z, there / held]) if flags else z
    return replace(fit, centres=np.where(n[:, None] > 0, centres, fit.centres), sizes=n, inertia=float(inertia))


def standards(points: Points, specs: list[Spec], seed: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """(block, replicate) -> mean and deviation of each column (of what is there), by one
    pass over all rows; a constant column is only centred. -1 is always among them."""
    wanted = sorted({(s.block, r) for s in specs for r in (s.replicate, -1)})
    about = light(points)
    names = {b: np.array([r for x, r in wanted if x == b]) for b in points.blocks}

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for h, blocks, _ in batch_arrays(about, batch, max(16, BLOCK // max(1, *(len(r) for r in names.values())))):
                weights = weighed_once(h, [names[b] for b in blocks], seed)
                found = [w.T @ np.hstack([there, x, x * x]) for w, (x, there) in zip(weights, blocks.values(), strict=True)]
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        return None if total is None else np.concatenate([x.ravel() for x in total])

    total, at, out = summed(points.rows.select("h", *points.blocks, "y"), add), 0, {}
    for b, draws in names.items() if total is not None else ():
        d = len(points.centre[b])
        for r in draws.tolist():
            n, one, square = np.split(total[at : at + 3 * d], 3)
            at += 3 * d
            mean = one / np.maximum(n, 1)
            var = square / np.maximum(n, 1) - mean**2
            out[b, r] = mean, np.where(var > 1e-12 * np.maximum(mean**2, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0)
    return out


def plus_plus(z: np.ndarray, w: np.ndarray, k: int, tries: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by k-means++ among weighted rows: the best of some tries, all drawn at once."""
    norm, centres = (z**2).sum(1)[:, None], np.zeros((tries, k, z.shape[1]))
    near = np.ones((len(z), tries))
    for i in range(k):
        chance = np.cumsum(w[:, None] * near, 0)
        at = rng.random(tries) * chance[-1]
        pick = np.minimum((chance <= at).sum(0), len(z) - 1)
        centres[:, i] = z[pick]
        d = np.maximum(norm - 2 * z @ z[pick].T + norm[pick].T, 0)
        near = d if i == 0 else np.minimum(near, d)
    return centres[int((w @ near).argmin())]


def standardised(points: Points, block: str, x: np.ndarray, there: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.where(there > 0, (x - mean) / scale, 0.0)
    return z if points.blocks[block].sentinel is None else np.hstack([z, there])


def distances(z: np.ndarray, among: np.ndarray) -> np.ndarray:
    """(rows x among): squared distances; 0 where no more than rounding is left of them."""
    norms = (z**2).sum(1)[:, None] + (among**2).sum(1)
    d = norms - 2 * z @ among.T
    return np.where(d > 1e-12 * norms, d, 0.0)


def candidates(points: Points, block: str, known: tuple[np.ndarray, np.ndarray], each: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's candidates for starts, by k-means|| over all rows: a row, and then in each
    of ``DRAWS`` passes ``each`` more with chances by their squared distance from those so far.

    A row's number is an exponential draw over that distance; the smallest of all rows are
    taken, so no row is drawn twice and rows that equal a candidate are not drawn at all."""
    about, rows = light(points), points.rows.select("h", *points.blocks, "y")
    d = len(points.centre[block])
    x, there = np.zeros((0, d)), np.zeros((0, d))
    for draw in range(DRAWS + 1):
        so_far, most = standardised(points, block, x, there, *known), each if draw else 1

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((0, 1 + 2 * d))
            for batch in batches:
                for h, blocks, _ in batch_arrays(about, batch, max(16, BLOCK // max(1, len(so_far)))):  # noqa: B023
                    far = distances(standardised(about, block, *blocks[block], *known), so_far).min(1) if len(so_far) else np.ones(len(h))  # noqa: B023
                    some = np.flatnonzero(far > 0)
                    number = -np.log1p(-uniform(h[some], np.array([(1 << 40) + draw]), seed)[:, 0]) / far[some]  # noqa: B023
                    held = np.vstack([held, np.column_stack([number, *(part[some] for part in blocks[block])])])
                    held = held[np.argsort(held[:, 0], kind="stable")[:most]]  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(list(held[:, 1:]), pa.list_(pa.float64()))], ["number", "x"])

        found = rows.mapInArrow(least, "number double, x array<double>").orderBy("number", "x").limit(most).collect()  # as many as are asked
        if not found:
            break
        more = np.array([r["x"] for r in found])
        x, there = np.vstack([x, more[:, :d]]), np.vstack([there, more[:, d:]])
    return x, there


def candidate_weights(points: Points, found: dict[str, tuple[np.ndarray, np.ndarray]], known: dict, names: dict[str, np.ndarray], seed: int) -> dict[str, np.ndarray]:
    """block -> (candidates x replicates): the weight of the rows that are nearest to each
    candidate, by one pass over all rows."""
    about = light(points)
    among = {b: standardised(points, b, *c, *known[b, -1]) for b, c in found.items()}
    widest = max(max(len(among[b]), len(names[b])) for b in among)

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = {b: np.zeros((len(z), len(names[b]))) for b, z in among.items()}
        for batch in batches:
            for h, blocks, _ in batch_arrays(about, batch, max(16, BLOCK // widest)):
                weights = weighed_once(h, [names[b] for b in among], seed)
                for (b, z), w in zip(among.items(), weights, strict=True):
                    at = distances(standardised(about, b, *blocks[b], *known[b, -1]), z).argmin(1)
                    order = np.argsort(at, kind="stable")
                    which, first = np.unique(at[order], return_index=True)
                    total[b][which] += np.add.reduceat(w[order], first, 0)
        return np.concatenate([t.ravel() for t in total.values()])

    flat, at, out = summed(points.rows.select("h", *points.blocks, "y"), add), 0, {}
    for b, z in among.items():
        size = len(z) * len(names[b])
        out[b] = flat[at : at + size].reshape(len(z), -1)
        at += size
    return out


def starts(points: Points, specs: list[Spec], known: dict, tries: int, seed: int) -> dict[int, Fit]:
    """First centres: the best of some k-means++ draws among the candidates, weighed as the
    model's rows are; a task for each few models."""
    spark = points.rows.sparkSession
    names = {b: np.array(sorted({s.replicate for s in specs if s.block == b})) for b in sorted({s.block for s in specs})}
    arrays = {b: candidates(points, b, known[b, -1], OVER * max(s.k for s in specs if s.block == b), seed) for b in names}
    weights = candidate_weights(points, arrays, known, names, seed)
    shared = spark.sparkContext.broadcast((light(points), names, arrays, weights, specs, known))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        about, drawn, blocks, heavy, wanted, maps = shared.value
        for batch in batches:
            out = []
            for m in batch["id"]:
                spec = wanted[m]
                z = standardised(about, spec.block, *blocks[spec.block], *maps[spec.block, spec.replicate])
                w = heavy[spec.block][:, np.searchsorted(drawn[spec.block], spec.replicate)]
                rng = np.random.default_rng([spec.seed, spec.start, spec.replicate + 1, spec.k, len(spec.block)])
                out.append((int(m), plus_plus(z, w, spec.k, tries, rng).ravel()))
            yield pd.DataFrame(out, columns=["model", "sums"])

    tasks = max(1, min(len(specs), 4 * spark.sparkContext.defaultParallelism))
    found = {}
    for r in spark.range(0, len(specs), 1, tasks).mapInPandas(draw, SUMS).collect():
        spec = specs[r["model"]]
        mean, scale = known[spec.block, spec.replicate]
        found[r["model"]] = Fit(spec, np.array(r["sums"]).reshape(spec.k, -1), mean, scale, np.zeros(spec.k), np.inf)
    shared.unpersist()
    return found


def as_they_are(points: Points, specs: list[Spec]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """In place of ``standards``: only the shift of ``base``, and no scale."""
    return {(s.block, r): (np.zeros(len(points.centre[s.block])), np.ones(len(points.centre[s.block]))) for s in specs for r in (s.replicate, -1)}


def fit_many(points: Points, specs: list[Spec], tries: int = 1, tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES, seed: int = 0, standardise: bool = True) -> list[Fit]:
    """All models, in the order of their specs. ``tries`` starts are drawn for each and
    the best by the candidates' weights is run. Reruns agree, however the rows are dealt.

    Every round reads all rows. In the first ``ROUNDS``, where the rows have parts, centres
    move after each part, so few rounds are left in which they move by all rows at once: a
    model has settled when such a round lowers its inertia by no more than ``tolerance``."""
    if not points.n:
        raise ValueError("there are no rows to cluster")
    fits = starts(points, specs, standards(points, specs, seed) if standardise else as_they_are(points, specs), tries, seed)
    flags = {b: x.sentinel is not None for b, x in points.blocks.items()}
    for p in range(ROUNDS * points.slots if points.slots > 1 else 0):
        part = points.rows.where(F.col("slot") == p % points.slots)
        fits |= {m: moved(fits[m], sums, flags[fits[m].spec.block]) for m, sums in one_pass(points, part, fits, seed).items()}
    active = set(fits)
    for _ in range(max_passes):
        if not active:
            break
        for m, sums in one_pass(points, points.rows, {m: fits[m] for m in active}, seed).items():
            old, fits[m] = fits[m], moved(fits[m], sums, flags[fits[m].spec.block])
            gain = (fits[m].sizes[:, None] * (fits[m].centres - old.centres) ** 2).sum()
            if gain <= tolerance * max(fits[m].inertia, 0):
                active.discard(m)
    return [fits[m] for m in range(len(specs))]


def best_starts(fits: list[Fit]) -> list[Fit]:
    """Of the starts of one (block, k, seed, replicate) the one with the least inertia."""
    best: dict[Spec, Fit] = {}
    for fit in fits:
        name = fit.spec._replace(start=0)
        if name not in best or fit.inertia < best[name].inertia:
            best[name] = fit
    return list(best.values())


def by_size(points: Points, fits: list[Fit], seed: int = 0) -> list[Fit]:
    """The models with inertia and sizes over all rows, centres by falling size."""
    found = one_pass(points, points.rows, dict(enumerate(fits)), seed)
    out = []
    for m, fit in enumerate(fits):
        now = moved(fit, found[m], points.blocks[fit.spec.block].sentinel is not None)
        order = np.argsort(-now.sizes, kind="stable")
        out.append(replace(fit, centres=fit.centres[order], sizes=now.sizes[order], inertia=now.inertia))
    return out


def pairs_of(fits: list[Fit], first: str, second: str) -> list[tuple[Fit, Fit]]:
    """The best models of two blocks that share k, seed and replicate."""
    found = {(f.spec.block, f.spec.k, f.spec.seed, f.spec.replicate): f for f in fits}
    return [(f, found[second, *name[1:]]) for name, f in found.items() if name[0] == first]


def with_level(rows: DataFrame, block: Block, centre: np.ndarray, fit: Fit, into: str) -> DataFrame:
    """rows with the number of the nearest centre."""
    about = Points(None, 0, 1, {fit.spec.block: block}, {fit.spec.block: centre}, [], 1)
    stack = Stack(about, fit.spec.block, {0: fit})

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype="int32")
        return pd.Series(stack.nearest(stack.features(*base(about, fit.spec.block, np.stack(x.to_numpy()))))[0][:, 0])

    return rows.withColumn(into, nearest(F.array(*(F.col(c).cast("double") for c in block.columns))))


def joint_tables(points: Points, pairs: list[tuple[Fit, Fit]], seed: int = 0) -> DataFrame:
    """(model, target, v, s, y, n): for each pair of models (their place in the list) and
    each target, how often levels meet, by one pass over all rows. Rows without the
    target are left out of its table; the pair's replicate weighs them."""
    shared = points.rows.sparkSession.sparkContext.broadcast((light(points), pairs))
    targets, levels = points.targets, points.levels

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, models = shared.value
        sides = [{m: p[i] for m, p in enumerate(models)} for i in (0, 1)]
        grouped = [stacks(about, s) for s in sides]
        widest = max(s.many * s.k for side in grouped for s in side)
        replicates = np.array([p[0].spec.replicate for p in models])
        total = [np.zeros((len(targets), p[0].spec.k, p[1].spec.k, levels)) for p in models]
        for batch in batches:
            for h, blocks, y in batch_arrays(about, batch, max(16, BLOCK // widest)):
                at = np.zeros((2, len(models), len(h)), np.int64)
                for i, side in enumerate(grouped):
                    for s in side:
                        at[i, s.names] = s.nearest(s.features(*blocks[s.block]))[0].T
                w = weighed(h, replicates, seed)
                for m, table in enumerate(total):
                    _, a, b, c = table.shape
                    cell = (at[0, m] * b + at[1, m]) * c
                    for t in range(len(targets)):
                        known = y[:, t] >= 0
                        table[t] += np.bincount(cell[known] + y[known, t], w[known, m], a * b * c).reshape(a, b, c)
        for m, table in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([table.ravel()], pa.list_(pa.float64()))], ["model", "sums"])

    summed = array_sums(points.rows.select("h", *points.blocks, "y").mapInArrow(add, SUMS), ["model"], "sums")
    spark = points.rows.sparkSession
    sizes = spark.createDataFrame([(m, a.spec.k, b.spec.k) for m, (a, b) in enumerate(pairs)], "model int, n_v int, n_s int")
    cells = summed.join(F.broadcast(sizes), "model").select("model", "n_v", "n_s", F.posexplode("sums").alias("i", "n"))  # a row for each pair
    place = lambda by, size: F.floor(F.col("i") / by) % size
    target = F.element_at(F.array(*map(F.lit, targets)), (F.floor(F.col("i") / (F.col("n_v") * F.col("n_s") * levels)) + 1).cast("int"))
    out = cells.select("model", target.alias("target"), place(F.col("n_s") * levels, F.col("n_v")).cast("int").alias("v"), place(F.lit(levels), F.col("n_s")).cast("int").alias("s"), (F.col("i") % levels).cast("int").alias("y"), F.round("n").cast("long").alias("n"))
    return out.where("n > 0")
