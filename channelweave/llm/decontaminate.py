"""Benchmark decontamination: a broadcast hash set of the test items' word n-grams,
looked up for every token window of the training texts; hits are verified word by word.

The set is broadcast only up to ``block_words`` item words. A larger benchmark is cut
into blocks of items; each block is one pass, and the spans found so far travel with
the rows, so a worker's memory is bounded whatever the benchmark's size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelweave.llm.shared import drop_table, write_table

WINDOW = 10
#: Item words that one broadcast holds: about 100 MB of a worker's memory at most.
BLOCK_WORDS = 1_000_000
#: A-Z to a-z; what belongs to no word to a space; digits, a-z and bytes from 0x80 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words and what stands between them, of texts as characters.
PIECE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + PIECE_WORD + r"|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOUND = "starts array<int>, ends array<int>, items array<string>, n_words long"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class WindowSet:
    """Windows of benchmark items: vocabulary, and for each length sorted hashes with
    the windows themselves and the items they are from."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        rng = np.random.default_rng(0)
        self.weights = rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1)
        windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for k, (_, found) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1) if ids else ():
                windows.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(k)
        self.by_size = {}
        for size, those in windows.items():
            grams = np.array(list(those), np.int32).reshape(len(those), size)
            hashes = self.hashed(grams)
            order = np.argsort(hashes, kind="stable")
            owners = list(those.values())
            self.by_size[size] = (hashes[order], grams[order], [sorted(owners[i]) for i in order])

    def hashed(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) + np.uint64(1)) * self.weights[: grams.shape[1]]).sum(1, dtype=np.uint64)

    def find(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans (start, end) inside occurrences, and names of their items."""
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int32, len(found))
        known = np.r_[0, np.cumsum(ids >= 0)]
        hit, names = np.zeros(len(ids) + 1, np.int32), set()
        for size, (hashes, grams, owners) in self.by_size.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            mine = ids[at[:, None] + np.arange(size)]
            h = self.hashed(mine)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(lo < hi):
                for w in range(lo[k], hi[k]):
                    if np.array_equal(mine[k], grams[w]):
                        hit[at[k]] += 1
                        hit[at[k] + size] -= 1
                        names.update(self.names[i] for i in owners[w])
        covered = np.r_[0, (np.cumsum(hit[:-1]) > 0).astype(np.int8), 0]
        edges = np.diff(covered)
        return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[tuple[bool, list[tuple[str, list[bytes]]]]]:
    """Items dealt into blocks by hash, with the number of blocks from a sum of bytes, an
    upper bound of their words; the driver has one block of bounded size at a time. Each
    comes with whether there are more blocks than one."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    block = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    for i in range(n):
        yield n > 1, [(r["name"], words(r["text"])) for r in rows.where(block == i).toLocalIterator()]


def find_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, into: str = "found"
) -> DataFrame:
    """docs with a struct column: ``starts``/``ends`` (spans of hit words, merged, end
    exclusive), ``items`` (ids as sorted strings), ``n_words``.

    A null or empty text has no words and no hit. Items that are null or without words
    are no windows; a null item id reads "null". Rows may repeat. An empty benchmark
    hits nothing. A column named as ``into`` is replaced; all others stay."""
    spark, written = docs.sparkSession, None
    for k, (several, block) in enumerate(item_blocks(items, item_id, item_text, block_words)):
        shared = spark.sparkContext.broadcast(WindowSet(block, window))

        docs = docs.withColumn(into, lookup_after(shared)(F.col(text), F.col(into)) if k else lookup(shared)(F.col(text)))
        if several:
            found = write_table(docs, "decontaminate")
            if k:
                drop_table(written)
            docs = written = found
    return docs


def lookup(shared):
    @F.pandas_udf(FOUND)
    def look(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([found_in(t, shared.value, None) for t in texts], columns=["starts", "ends", "items", "n_words"])

    return look.asNondeterministic()  # it is not, but a filter on its result must not have it run twice


def lookup_after(shared):
    """As lookup, for a later block: adds to what the blocks before have found."""

    @F.pandas_udf(FOUND)
    def look(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([found_in(t, shared.value, b) for t, b in zip(texts, before.itertuples(index=False), strict=True)], columns=["starts", "ends", "items", "n_words"])

    return look.asNondeterministic()


def found_in(text: str | None, windows: WindowSet, before) -> tuple[list[int], list[int], list[str], int]:
    found = words(text)
    spans, names = windows.find(found)
    if before is not None:
        spans = merged([*spans, *zip(before.starts, before.ends, strict=True)])
        names |= set(before.items)
    return [a for a, _ in spans], [b for _, b in spans], sorted(names), len(found)


def remove_spans(docs: DataFrame, text: str = "text", found: str = "found") -> DataFrame:
    """docs with hit words cut from the text (each span from its first word's first
    character to its last word's last); texts without a hit stay as they are.

    Column functions only, so that no second Python worker runs beside that of the
    search. A text is taken apart into pieces, each a word with what stands before it."""
    spans = F.col(f"{found}.starts"), F.col(f"{found}.ends")
    hit = F.size(spans[0]) > 0
    name = "_pieces"
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    rows = docs.withColumn(name, F.when(hit, F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0))))
    starts, ends, pieces = *spans, F.col(name)

    def before(a, k):
        at = F.when(k > 0, F.get(ends, k - 1)).otherwise(0)  # what lies between the last span and this one
        return F.concat(F.slice(pieces, at + 1, a - at), F.array(F.regexp_replace(F.get(pieces, a), PIECE_WORD, "")))

    last = F.element_at(ends, -1)
    kept = F.concat(F.flatten(F.transform(starts, before)), F.slice(pieces, last + 1, F.size(pieces) - last))
    return rows.withColumn(text, F.when(hit, F.array_join(kept, "")).otherwise(F.col(text))).drop(name)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: words, hit words, items that occur, digest of their ids, verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    n_hit = F.aggregate(F.zip_with("found.ends", "found.starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, size, i, item_id FROM dw JOIN win USING (size, gram)),
nh AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY 1),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
