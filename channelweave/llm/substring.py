"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are taken at anchors only: of the short word sequences in a window the one
with the least hash, so that equal windows have equal anchors. An anchor is a prefix
that says which group a suffix belongs to. Prefixes that occur once are dropped. Of
stretches of words that are copies of each other (told by two hashes of 64 bits, of the
anchor and of all words) the first alone goes on, the others are repeats already; a
prefix with one such stretch needs no tree.

Prefixes have variable length: one that is too frequent is lengthened by some words to
its right, again and again, until its suffixes fit into a tree. A window that ends before
the longer prefix does is settled by its whole sequence, which is the longest prefix there
can be and needs no tree, only the first that has it. So every tree is complete by itself.

In a group the tree grows from the top: a node is a set of windows with the same first
words, and every step splits the nodes by one word more; what stands alone is a leaf
and drops out. Nodes that are left at a window's depth are repeats."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelweave.llm.shared import drop_table, release, slices, write_table

WINDOW, PREFIX = 20, 6
#: Suffixes in a group, about, and occurrences of a prefix beyond which it is lengthened.
GROUP_ROWS, PREFIX_ROWS = 1 << 15, 1 << 14
#: Steps in which a prefix grows to a window's length, and suffixes that a worker takes apart at a time.
STEPS, STEP_ROWS = 4, 1 << 13
#: Words whose hashes a worker remembers.
MEMO = 1 << 19
SEED = 42


class Codes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word, SEED)
        return code


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def coded(texts: list[str | None], memo: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The words' codes of all texts in one array, and where each text ends."""
    parts = []
    for t in texts:
        words = (t or "").encode("utf-8", "replace").split()
        parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
    ends = np.cumsum([len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), ends


def sequence_hash(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive codes."""
    total = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for j, w in enumerate(np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64)):
        total += mix(codes[j : j + len(total)] + np.uint64(j)) * (w | np.uint64(1))
    return mix(total)


def anchors(codes: np.ndarray, ends: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window within a text: where it starts, its text, and its anchor."""
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    if len(codes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    h = sequence_hash(codes, prefix)
    n = len(codes) - window + 1
    least = h[:n].copy()
    for s in range(1, window - prefix + 1):
        np.minimum(least, h[s : s + n], out=least)
    at = np.zeros(n, np.int64)
    for s in range(window - prefix, -1, -1):
        at[h[s : s + n] == least] = s
    starts = np.flatnonzero(doc[:n] == doc[window - 1 :])
    at = starts + at[starts]
    return starts, doc[starts], np.stack([at, h[at].view(np.int64)])


def runs(anchor: np.ndarray) -> np.ndarray:
    """Where runs of consecutive windows with the same anchor begin."""
    return np.flatnonzero(np.r_[True, np.diff(anchor) != 0]) if len(anchor) else np.zeros(0, np.int64)


def restored(content: pa.Array, ahead: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes' words with zeros in the anchors' place, all in one array; where each begins, and its size."""
    blank = bytes(8 * prefix)
    raw = [r[:p] + blank + r[p:] for r, p in zip(content.to_pylist(), (8 * ahead).tolist(), strict=True)]
    sizes = np.array([len(r) // 8 for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint64), np.cumsum(sizes) - sizes, sizes


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For numbers n: each row n times, and 0 .. n - 1 along with it."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def repeats(codes: np.ndarray, starts: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (by number) in nodes at the window's depth, and their nodes.

    ``first`` is what is known to be a prefix of each already."""
    at, node = np.arange(len(starts)), first
    for depth in range(window + 1):
        _, node, size = np.unique(node, return_inverse=True, return_counts=True)
        branch = size[node] > 1
        at, node = at[branch], node[branch]
        if depth == window or not len(at):
            return at, node
        node = (node.astype(np.uint64) << np.uint64(32)) | (codes[starts[at] + depth].astype(np.uint64))
    raise AssertionError


def ranked(ids: pa.ChunkedArray) -> np.ndarray:
    """Ids as values that sort alike, with null first."""
    if pa.types.is_string(ids.type):
        return np.array(["" if i is None else "s" + i for i in ids.to_pylist()])
    return pc.fill_null(ids, np.iinfo(np.int64).min if pa.types.is_int64(ids.type) else np.iinfo(np.int32).min).to_numpy()


def doc_key(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")]


def same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def repeated_spans(rows: DataFrame, window: int = WINDOW, prefix: int = PREFIX, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(id, th, start, n): n consecutive windows from word ``start`` on, all of which
    start earlier too, in a smaller id or in the same id at an earlier word."""
    id_type = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Codes()
        for batch in slices(batches):
            codes, ends = coded(batch.column("text").to_pylist(), memo)
            starts, doc, (at, h) = anchors(codes, ends, window, prefix)
            k = runs(at)
            n = np.diff(np.r_[k, len(at)])
            first, ahead = starts[k], at[k] - starts[k]
            raw, upto = memoryview(codes.tobytes()), first + n + window - 1
            c = np.fromiter((xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip((8 * first).tolist(), (8 * upto).tolist(), strict=True)), np.uint64, len(k))
            c = mix(c + ahead.astype(np.uint64)).view(np.int64)
            keys = batch.select(["id", "th"]).take(pa.array(doc[k]))
            small = [pa.array(x.astype(np.int32)) for x in (first - np.r_[0, ends][doc[k]], ahead, n)]
            yield pa.RecordBatch.from_arrays([*keys.columns, *small, pa.array(h[k]), pa.array(c)], ["id", "th", "start", "ahead", "n", "h", "c"])

    key = F.struct(F.col("id").isNotNull(), "id", "start")
    found = write_table(rows.mapInArrow(find, f"id {id_type}, th long, start int, ahead int, n int, h long, c long"), "anchors", codec="zstd")
    counts = write_table(found.groupBy("h").count().where("count > 1").select("h"), "prefixes")
    release(rows.sparkSession)
    shared = write_table(found.join(counts, "h"), "anchors-shared", codec="zstd")
    drop_table(found)
    release(rows.sparkSession)
    # stretches that are copies of others: all but the first go as they are, and only the first is compared with other stretches
    stretches = write_table(shared.groupBy("h", "c").agg(F.min(key).alias("least")), "stretches", codec="zstd")
    variants = write_table(stretches.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1"), "variants")
    total, most = variants.agg(F.sum("variants"), F.max("variants")).first()
    groups = max(1, -(-(total or 0) // GROUP_ROWS))
    told = stretches.join(variants, "h", "left")
    told = shared.join(told, ["h", "c"]).select("id", "th", "start", "ahead", "n", "variants", (key != F.col("least")).alias("later"))
    told = write_table(told, "anchors-told", codec="zstd")
    drop_table(shared)
    drop_table(stretches)
    release(rows.sparkSession)
    kept = told.where("NOT later AND variants > 1").select("id", "th", F.struct((F.col("start") + F.col("ahead")).alias("at"), (F.col("variants") > prefix_rows).alias("crowded")).alias("anchor"))
    # no more rows than a text has words
    kept = write_table(kept.groupBy("id", "th").agg(F.sort_array(F.collect_set("anchor")).alias("anchors")), "kept")
    release(rows.sparkSession)
    texts = rows.alias("d").join(kept.alias("k"), same_doc("d", "k")).select("d.id", "d.th", "d.text", "k.anchors")
    kind = f"id {id_type}, th long, start int"
    suffix = f"{kind}, ahead int, h long, codes binary"

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Codes()
        for batch in slices(batches):
            codes, ends = coded(batch.column("text").to_pylist(), memo)
            base = np.r_[0, ends]
            starts, doc, (at, h) = anchors(codes, ends, window, prefix)
            lists = batch.column("anchors")
            want = lists.flatten()
            wanted = base[np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))] + want.field("at").to_numpy()
            k = runs(at)
            n = np.diff(np.r_[k, len(at)])
            mine = np.isin(at[k], wanted)
            k, n = k[mine], n[mine]
            order = np.argsort(wanted)
            crowded = want.field("crowded").take(pa.array(order[np.searchsorted(wanted, at[k], sorter=order)]))
            # the anchor's own words stay here: its hash says what they are
            content = [
                codes[i:a].tobytes() + codes[a + prefix : i + m + window - 1].tobytes() for i, a, m in zip(starts[k].tolist(), at[k].tolist(), n.tolist(), strict=True)
            ]
            keys = batch.select(["id", "th"]).take(pa.array(doc[k]))
            yield pa.RecordBatch.from_arrays(
                [*keys.columns, pa.array((starts[k] - base[doc[k]]).astype(np.int32)), pa.array((at[k] - starts[k]).astype(np.int32)), pa.array(h[k]), pa.array(content, pa.binary()), crowded],
                ["id", "th", "start", "ahead", "h", "codes", "crowded"],
            )

    def lengthen(batches: Iterator[pa.RecordBatch], known: int, length: int) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "start", "ahead", "h", "codes", "w1", "w2"]
        for batch in slices(batches, STEP_ROWS):
            start, ahead, h = (batch.column(c).to_numpy() for c in ("start", "ahead", "h"))
            h = h.view(np.uint64)
            codes, base, sizes = restored(batch.column("codes"), ahead, prefix)
            windows = sizes - window + 1
            ended = np.clip(ahead + length - window, 0, windows)
            row, step = counted(ended)
            w = [pa.array((sequence_hash(codes, window, seed)[base[row] + step] ^ mix(h + np.uint64(1))[row]).view(np.int64)) for seed in (1, 2)]
            keys = batch.select(["id", "th"])
            none = (pa.nulls(len(row), t) for t in (pa.int32(), pa.int64(), pa.binary()))
            yield pa.RecordBatch.from_arrays([*keys.take(pa.array(row)).columns, pa.array((start[row] + step).astype(np.int32)), *none, *w], names)
            on = np.flatnonzero(ended < windows)
            longer = h[on]
            for i in range(known, length if len(on) else known):
                longer = mix(longer * np.uint64(0x9E3779B97F4A7C15) + mix(codes[base[on] + ahead[on] + i] + np.uint64(i)))
            gone = ended[on]
            content = [c[p:] for c, p in zip(batch.column("codes").take(pa.array(on)).to_pylist(), (8 * gone).tolist(), strict=True)]
            moved = [pa.array((x[on] + sign * gone).astype(np.int32)) for x, sign in ((start, 1), (ahead, -1))]
            none = (pa.nulls(len(on), pa.int64()) for _ in w)
            yield pa.RecordBatch.from_arrays([*keys.take(pa.array(on)).columns, *moved, pa.array(longer.view(np.int64)), pa.array(content, pa.binary()), *none], names)

    def tree(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # in the anchor's place are zeros: windows of one node have the same anchor there
        ahead = table.column("ahead").to_numpy()
        codes, base, sizes = restored(table.column("codes"), ahead, prefix)
        _, codes = np.unique(codes, return_inverse=True)
        row, step = counted(sizes - window + 1)
        starts = base[row] + step
        # known so far: the prefix, and how far ahead of the window's start it is
        _, known = np.unique(table.column("h").to_numpy(), return_inverse=True)
        at, node = repeats(codes, starts, known[row] * np.int64(window) + ahead[row] - step, window)
        _, ids = np.unique(ranked(table.column("id")), return_inverse=True)
        begin = table.column("start").to_numpy()[row] + step
        order = np.lexsort((begin[at], ids[row[at]], node))
        at, node = at[order], node[order]
        top = np.diff(node, prepend=-1) != 0
        lead = np.flatnonzero(top)[np.cumsum(top) - 1]
        later = (ids[row[at]] != ids[row[at[lead]]]) | (begin[at] != begin[at[lead]])
        gone = np.sort(at[later])
        cut = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(row[gone], prepend=-1) != 0))
        length = np.diff(np.r_[cut, len(gone)])
        some = table.select(["id", "th"]).take(pa.array(row[gone[cut]]))
        return pa.Table.from_arrays([*some.columns, pa.array(begin[gone[cut]].astype(np.int32)), pa.array(length.astype(np.int32))], names=["id", "th", "start", "n"])

    cuts = write_table(texts.mapInArrow(suffixes, f"{suffix}, crowded boolean"), "suffixes", codec="zstd")
    drop_table(kept)
    release(rows.sparkSession)
    fitting, settled, written = cuts.drop("crowded"), [], [cuts, told]
    if (most or 0) > prefix_rows:
        fitting, large, known = cuts.where("NOT crowded").drop("crowded"), cuts.where("crowded").drop("crowded"), prefix
        for length in [*sorted({prefix + -(-(window - prefix) * i // STEPS) for i in range(1, STEPS + 1)} - {prefix}), window + 1]:
            grow = partial(lengthen, known=known, length=length)
            step = write_table(large.mapInArrow(grow, f"{suffix}, w1 long, w2 long"), "suffixes-longer", codec="zstd")
            settled.append(step.where("codes IS NULL").select("id", "th", "start", "w1", "w2"))
            written.append(step)
            if length > window:
                break
            step = step.where("codes IS NOT NULL").drop("w1", "w2")
            sizes = write_table(step.groupBy("h").count().where("count > 1"), "prefixes")
            met, known = step.join(sizes, "h").select(*step.columns, "count"), length
            fitting = fitting.unionByName(met.where(F.col("count") <= prefix_rows).drop("count"))
            large = met.where(F.col("count") > prefix_rows).drop("count")
            if sizes.where(F.col("count") > prefix_rows).isEmpty():
                break
    grown = fitting.groupBy(F.pmod("h", F.lit(groups)).alias("group")).applyInArrow(tree, f"{kind}, n int")
    if settled:
        ended = reduce(DataFrame.unionByName, settled)
        least = ended.groupBy("w1", "w2").agg(F.min(key).alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
        later = ended.join(least, ["w1", "w2"]).where(key != F.col("least"))
        grown = grown.unionByName(later.select("id", "th", "start", F.lit(1).alias("n")))
    grown = write_table(grown.unionByName(told.where("later").select("id", "th", "start", "n")), "repeats")
    for table in written:
        drop_table(table)
    release(rows.sparkSession)
    return grown


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """One row per row of docs: the id, ``n_words``, ``n_removed``, ``kept`` (the text's
    other words, joined by a space) and ``spans``, the removed stretches of words
    (maximal repeats): structs of start and n.

    A word goes if a window of ``window`` words over it also starts earlier: in a row
    with a smaller id, or the same id and an earlier word. A null id is smaller than all
    others; repeated rows of one id do not count as earlier than each other. Null and
    empty texts have no words, and texts shorter than a window lose none. Other columns
    are not read; an empty table gives an empty result."""
    rows = docs.select(*doc_key(doc_id, text))
    gone = repeated_spans(rows, window, prefix, prefix_rows).groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    joined = rows.alias("d").join(gone.alias("g"), same_doc("d", "g"), "left").select("d.id", "d.text", "g.gone")

    @F.pandas_udf("n_words long, n_removed long, kept string, spans array<struct<start:int,n:int>>")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(texts, gone, strict=True):
            words = (t or "").encode("utf-8", "replace").split()
            if found is None or not len(found):
                out.append((len(words), 0, b" ".join(words).decode("utf-8", "replace"), []))
                continue
            change = np.zeros(len(words) + 1, np.int64)
            for s in found:
                change[s["start"]] += 1
                change[s["start"] + s["n"] + window - 1] -= 1
            removed = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.r_[0, removed.astype(np.int8), 0])).reshape(-1, 2)
            kept = b" ".join([words[i] for i in np.flatnonzero(~removed)])
            out.append((len(words), int(removed.sum()), kept.decode("utf-8", "replace"), [{"start": int(a), "n": int(b - a)} for a, b in edges]))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "spans"])

    return joined.withColumn("r", cut(F.col("text"), F.col("gone"))).select(F.col("id").alias(doc_id), "r.*")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its words, those removed, and a digest of the others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS g, hash(array_to_string(w[i : i + {WINDOW - 1}], '|')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
firsts AS (SELECT g, h, min((doc_id, i)) AS f, count(*) AS n FROM win GROUP BY g, h HAVING count(*) > 1),
later AS (SELECT doc_id, i FROM win JOIN firsts USING (g, h) WHERE (doc_id, i) > f),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM later) GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS s FROM (
           SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) p
         ANTI JOIN (SELECT doc_id, unnest(ks) AS k FROM gone) q USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
