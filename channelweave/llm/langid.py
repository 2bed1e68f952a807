"""Language identification by a byte convolutional network: filters of several widths
over byte windows of a fixed length, max pooling, and a softmax; trained in numpy.

A filter over one-hot bytes is a table of 256 rows for each offset, so a convolution is
a sum of looked-up rows, and only the winning positions get a gradient."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from channelweave.llm.shared import slices

#: Bytes of a window, widths of the filters, and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
REACH = max(WIDTHS) - 1
#: The bounded sample to learn from: documents of a language, documents in all, and
#: windows of a document at most.
DOCS_PER_LANG, DOCS, WINDOWS_PER_DOC = 1000, 30_000, 4
STEPS, BATCH, RATE, SEED = 900, 96, 0.02, 7
#: Windows that go through the network at a time, and bytes of texts cut up at a time
#: (a longer text by itself).
CHUNK, CUT_BYTES = 128, 1 << 18
UNKNOWN = "und"
#: Value that keeps positions behind a text's end from being a maximum.
NEVER = np.float32(-1e4)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, each with the first bytes of the next one, and the
    number of windows of each text. A text's last window is filled up with zeros."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    out, at = np.zeros((int(counts.sum()), WINDOW + REACH), np.uint8), 0
    for t, n in zip(texts, counts, strict=True):
        flat = np.zeros(n * WINDOW + REACH, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.as_strided(flat, (n, WINDOW + REACH), (WINDOW, 1))
        at += n
    return out, counts


class ByteNet:
    """Tables for each offset (all filters that reach it, side by side) and the softmax."""

    def __init__(self, langs: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.n = FILTERS * len(WIDTHS)
        # widest filters come first, so those that reach an offset are the first columns
        self.reach = [FILTERS * sum(w > j for w in WIDTHS) for j in range(REACH + 1)]
        self.tables = [rng.normal(0, 0.1, (256, r)).astype(np.float32) for r in self.reach]
        self.out = rng.normal(0, 0.1, (self.n, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        first = self.tables[0].copy()
        first[0] = NEVER
        total = first[x[:, :WINDOW]]
        for j in range(1, REACH + 1):
            total[:, :, : self.reach[j]] += self.tables[j][x[:, j : j + WINDOW]]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), CHUNK):
            z = np.maximum(self.convolve(x[i : i + CHUNK]).max(1), 0) @ self.out + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy: tables, softmax, bias."""
        total = self.convolve(x)
        where = total.argmax(1)
        top = np.take_along_axis(total, where[:, None, :], 1)[:, 0]
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (top > 0)
        grads = [np.zeros_like(t) for t in self.tables]
        rows = np.arange(len(x))[:, None]
        for j, r in enumerate(self.reach):
            np.add.at(grads[j], (x[rows, where[:, :r] + j], np.arange(r)[None]), back[:, :r])
        return [*grads, hidden.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        """Adam on balanced batches; windows are cut to random lengths, so short texts
        are known as well."""
        rng = np.random.default_rng(seed)
        by_lang = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        params = [*self.tables, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, STEPS + 1):
            label = rng.integers(0, len(by_lang), BATCH)
            batch = x[[by_lang[k][rng.integers(len(by_lang[k]))] for k in label]]
            length = np.exp(rng.uniform(np.log(12), np.log(WINDOW + REACH), BATCH)).astype(int)
            batch = np.where(np.arange(WINDOW + REACH) < length[:, None], batch, 0)
            rate = RATE * (1 - t / (STEPS + 1))
            for p, g, m, v in zip(params, self.step(batch, label), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> ByteNet | None:
    """A network for the languages of the labelled rows; None if there are none.

    It is fitted on a bounded sample: ``DOCS_PER_LANG`` different texts of each language
    (the smallest hashes), fewer where languages are many, and a few windows of each,
    which are all that the driver gets. Rows with a null text or language are left out;
    rows that repeat a text and language count once, and a text under two languages is
    learned for both. Only texts and languages are looked at: other columns, ids among
    them, change nothing. Of long texts all windows are as likely to be learned."""
    place = F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 52))
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), place.alias("h"))
    counts = dict(map(tuple, rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect()))
    langs = sorted(counts)
    if not langs:
        return None
    each = max(1, min(DOCS_PER_LANG, DOCS // len(langs)))
    # of a language's hashes the smallest are looked at, some more than are needed
    below = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (3 * each + 100) / max(1, n)) * (1 << 52)))))
    rows = rows.where(F.col("h") <= below[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)

    def cut(batches):
        for batch in slices(batches):
            found = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            out = []
            for t, name, h in zip(found, batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True):
                last = max(0, len(t) - WINDOW)
                starts = {(h >> (16 * i)) % (last + 1) for i in range(WINDOWS_PER_DOC)}
                out += [(name, h, t[a : a + WINDOW + REACH]) for a in sorted(starts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "bytes"])

    sample = sorted((r["lang"], r["h"], bytes(r["bytes"])) for r in rows.select("text", "lang", "h").mapInArrow(cut, "lang string, h long, bytes binary").toLocalIterator())
    x = np.zeros((len(sample), WINDOW + REACH), np.uint8)
    for row, (_, _, b) in zip(x, sample, strict=True):
        row[: len(b)] = np.frombuffer(b, np.uint8)
    net = ByteNet(langs)
    net.train(x, np.array([langs.index(s[0]) for s in sample]))
    return net


def predict(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the probability (0 to 1) of that language.

    Every window of the whole text is read, with the first bytes of the next one, and
    their probabilities are averaged by the windows' lengths, so a text in two languages
    has that of the longer part; of equal probabilities the first language by name.
    ``und`` with score 0: a null text, one without a letter, or no network. Repeated
    rows get the same; an empty table gives an empty result. Columns of these names are
    replaced, all others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def look(texts: pd.Series) -> pd.DataFrame:
        net = shared.value
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        part: list[tuple[int, bytes]] = []

        def tell() -> None:
            if part:
                for (i, _), total in zip(part, summed(net, [t for _, t in part]), strict=True):
                    langs[i], scores[i] = verdict(net, total)
                part.clear()

        size = 0
        for i, t in enumerate(texts):
            if net is None or t is None or not any(map(str.isalpha, t)):
                continue
            raw = t.encode("utf-8", "replace")
            if size + len(raw) > CUT_BYTES:
                tell()
                size = 0
            part.append((i, raw))
            size += len(raw)
        tell()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("_found", look(F.col(text))).withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def summed(net: ByteNet, texts: list[bytes]) -> np.ndarray:
    """Of each text, the probabilities of its windows summed by their lengths."""
    x, counts = windows_of(texts)
    weight = np.full(len(x), WINDOW, np.float64)
    ends = np.cumsum(counts) - 1
    weight[ends] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts, strict=True)]
    return np.add.reduceat(net.probabilities(x) * weight[:, None], ends - counts + 1, axis=0)


def verdict(net: ByteNet, total: np.ndarray) -> tuple[str, float]:
    return net.langs[int(total.argmax())], float(min(1.0, total.max() / total.sum()))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: a third, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language and its score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")
