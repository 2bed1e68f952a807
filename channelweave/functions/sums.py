"""Arrays that tasks add up, and weights of resamples from a row's key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of the Poisson distribution with mean 1, by which a uniform number is a count.
POISSON_ENDS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def array_sums(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and the element-wise sum of an array column, added up in the JVM with partial
    sums before the shuffle; the arrays of a key have one length."""
    total = Summarizer.metrics("sum").summary(array_to_vector(column))["sum"]
    return parts.groupBy(*keys).agg(vector_to_array(total).alias(column))


#: Bits of a mixed number that are dropped; the others fit a double.
BITS = 11
#: Numbers of a row of partial sums.
PIECE = 1 << 15
PIECES = "piece int, sums array<double>"


def pieces(total: np.ndarray) -> pa.RecordBatch:
    """A task's sums as rows of one length, so that the JVM adds few, long arrays."""
    parts = [total[k : k + PIECE] for k in range(0, len(total), PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["piece", "sums"])


def summed(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum over tasks of a flat array that each makes of its batches (None: nothing).
    Only the total reaches the driver; its length must not depend on the rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = add(batches)
        if total is not None:
            yield pieces(total)

    found = array_sums(rows.mapInArrow(task, PIECES), ["piece"], "sums").collect()
    return np.concatenate([np.array(r["sums"]) for r in sorted(found, key=lambda r: r["piece"])]) if found else None


def mixed(keys: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """A whole number of 53 bits for each key and draw (keys x draws), by SplitMix64: it
    depends on nothing else, so a resample is the same however rows are dealt."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)[:, None] + (draw.astype(np.uint64) * np.uint64(2) + np.uint64(1))[None] * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) >> np.uint64(BITS)


def uniform(keys: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key and draw."""
    return mixed(keys, draw, seed).astype(float) / 2.0**53


def thresholds(rows: DataFrame, key: str, draws: int, n: int, seed: int, step: int = 14) -> np.ndarray:
    """For each draw the bound below which exactly n of the rows' numbers (``mixed``) lie.

    Found by counting and without a sort: a pass counts, for each draw, the rows in each
    range of ``step`` more bits below the bound's bits so far. It ends when no range has
    to be parted, after three or four passes for a billion rows. ``key`` is a column of
    longs; rows with equal keys have equal numbers and go together, so there the number
    of rows below may be short of n by some of them."""
    low, short, left = np.zeros(draws, np.int64), np.full(draws, n, np.int64), 53
    open_ = np.full(draws, n > 0)
    while left and open_.any():
        bits = min(step, left)
        at, now = np.flatnonzero(open_), left

        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((len(at), 1 << bits))  # noqa: B023
            for batch in batches:
                value = mixed(batch.column(0).to_numpy(), at, seed).astype(np.int64)  # noqa: B023
                inside = value >> now == low[at] >> now  # noqa: B023
                place = (value >> (now - bits)) & ((1 << bits) - 1)  # noqa: B023
                for k in range(len(at)):  # noqa: B023
                    total[k] += np.bincount(place[inside[:, k], k], minlength=1 << bits)  # noqa: B023
            return total.ravel()

        found = summed(rows.select(key), count)
        left -= bits
        if found is None:
            break
        for k, counts in zip(at, np.cumsum(np.rint(found).astype(np.int64).reshape(len(at), -1), 1), strict=True):
            before = int(np.searchsorted(counts, short[k], "right"))  # ranges that go whole
            low[k] += before << left
            short[k] -= counts[before - 1] if before else 0
            open_[k] = short[k] > 0 and before < len(counts)
    return low


#: By the first 16 bits of a mixed number: its count, or -1 where an end lies among them.
_FIRST, _LAST = (np.searchsorted(POISSON_ENDS, (np.arange(1 << 16) + i) / 65536.0, "right") for i in (0, 1))
POISSON_BY_BITS = np.where(_FIRST == _LAST, _FIRST, -1).astype(np.int8)


def poisson_counts(keys: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """How often each key is in each resample."""
    z = mixed(keys, draw, seed)
    out = POISSON_BY_BITS[(z >> np.uint64(64 - BITS - 16)).view(np.int64)].astype(float)
    at = np.nonzero(out < 0)
    out[at] = np.searchsorted(POISSON_ENDS, z[at].astype(float) / 2.0**53, "right")
    return out


def packed(x: np.ndarray) -> np.ndarray:
    """Of each row: 1, the row, and the upper triangle of its outer product."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def symmetric(triangle: np.ndarray, d: int) -> np.ndarray:
    """The matrix of an upper triangle; leading axes stay."""
    i, j = np.triu_indices(d)
    out = np.zeros((*triangle.shape[:-1], d, d))
    out[..., i, j] = out[..., j, i] = triangle
    return out
