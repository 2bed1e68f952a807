"""Quality rules: counts that need no model, and the divergence of a document's
histograms of character classes and common words from those of languages.

The references come from all documents whose language is told: one pass adds up each
language's character classes and words (a task's counts leave it as partial sums), and
the commonest words of each are chosen by their counts over the corpus. A second pass
reads each text whole and compares it with every language by Jensen-Shannon distance
(base 2, so 0 to 1). A histogram of few words is far from its own language by chance:
with k commonest words and n words read the squared distance is k / (8 n ln 2) on
average, which is taken off, and texts below a least length get no verdict."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from channelweave.llm.shared import slices

#: Commonest words of a language in its histogram; the rest is one bin.
COMMON = 50
#: Words that a language must have in the corpus to be a reference.
REFERENCE_WORDS = 1000
#: Languages at most; their histograms are sent to every task.
MOST_LANGUAGES = 10_000
#: Greatest distances (after what is due to length) from the closest language.
CLASS_DISTANCE, WORD_DISTANCE = 0.3, 0.2
#: A text with fewer characters or words is not judged by that histogram.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Base rules: fewest words, and greatest share of words in repeated windows (percent).
BASE_WORDS, BASE_REPEATS = 50, 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
#: Character classes: small, capital, digit, white space, punctuation, other ASCII;
#: then code points from each of these on (Latin with marks; other alphabets; general
#: punctuation and signs; East Asian scripts; private use and above).
CLASS_SETS = ["a-z", "A-Z", "0-9", "\\x09-\\x0D ", ".,;:!?'\"()\\-"]
CLASS_BOUNDS = [0x80, 0x250, 0x2000, 0x3000, 0xE000]
#: Distinct words of a task's partial counts that are held at a time.
HELD_WORDS = 300_000
COUNTS = "lang string, class int, word string, n long"
RULES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, closest_lang string, class_distance double, word_distance double, kept boolean"
)


def class_table() -> np.ndarray:
    """The class of each ASCII character."""
    table = np.full(128, 5, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    return table


ASCII = class_table()
CLASSES = 6 + len(CLASS_BOUNDS)
#: Bytes of terms stay, capitals become small, all others are spaces; bytes of longer
#: UTF-8 sequences are terms' too.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = np.where(points < 128, ASCII[np.minimum(points, 127)], 5 + np.searchsorted(CLASS_BOUNDS, points, "right"))
    return np.bincount(kind, minlength=CLASSES)


def terms(data: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all beyond ASCII, with A-Z lower-cased."""
    return data.translate(TERM_BYTES).split()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows whose sequence is there twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    run = ids[:n]
    for k in range(1, window):  # names of longer and longer sequences stay below n
        run = np.unique(run * len(known) + ids[k : k + n], return_inverse=True)[1]
    hit = np.bincount(run)[run] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= hit
    return int(covered.sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines that repeat, words in repeated windows."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> sums of classes (class -1: words), and of words, by language."""
    schema = pa.schema([("lang", pa.string()), ("class", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, k in classes.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(range(-1, len(k) - 1), pa.int32()), pa.nulls(len(k), pa.string()), pa.array(k)], schema=schema)
        for lang, found in words.items():
            names = pa.array([w.decode() for w in found], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.nulls(len(found), pa.int32()), names, pa.array(found.values(), pa.int64())], schema=schema)
        words.clear()
        classes.clear()

    for part in slices(batches):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            found = terms(text.encode())
            words.setdefault(lang, Counter()).update(found)
            classes[lang] = classes.get(lang, 0) + np.r_[len(found), class_counts(text)]
        if sum(map(len, words.values())) > HELD_WORDS:
            yield from flush()
    yield from flush()


class References(NamedTuple):
    """Histograms of languages: names, classes (language x class), words (language x
    common words and the rest) and each word's row and bin."""

    langs: list[str]
    classes: np.ndarray
    words: np.ndarray
    bins: dict[bytes, list[tuple[int, int]]]


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON, least_words: int = REFERENCE_WORDS) -> References:
    """The references of all languages with at least ``least_words`` words in docs.

    Documents with a null text or language are not counted. Of words that are as common
    as each other the least goes first. An empty table has no reference."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(partial_counts, COUNTS).groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", F.col("word").isNull()).orderBy(F.desc("n"), "word")
    ranked = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(common, CLASSES + 1))
    found: dict[str, tuple[dict[int, int], list[tuple[str, int]]]] = {}
    for r in ranked.toLocalIterator():
        counts, words = found.setdefault(r["lang"], ({}, []))
        if r["word"] is None:
            counts[r["class"]] = r["n"]
        else:
            words.append((r["word"], r["n"]))
        if len(found) > MOST_LANGUAGES:
            raise ValueError(f"over {MOST_LANGUAGES} languages")
    langs = sorted(x for x, (counts, _) in found.items() if counts[-1] >= least_words)
    bins: dict[bytes, list[tuple[int, int]]] = {}
    classes, shares = np.zeros((len(langs), CLASSES)), np.zeros((len(langs), common + 1))
    for i, name in enumerate(langs):
        counts, words = found[name]
        classes[i] = [counts[k] for k in range(CLASSES)]
        for j, (word, n) in enumerate(sorted(words, key=lambda w: (-w[1], w[0].encode()))[:common]):
            bins.setdefault(word.encode(), []).append((i, j))
            shares[i, j] = n
        shares[i, common] = counts[-1] - shares[i].sum()
    return References(langs, classes / classes.sum(1, keepdims=True), shares / shares.sum(1, keepdims=True), bins)


def js_squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared Jensen-Shannon distance of distributions along the last axis, in bits."""
    p, q = np.broadcast_arrays(p, q)
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)
    return np.maximum(each.sum(-1) / 2, 0)


def divergence(text: str, data: bytes, refs: References) -> tuple[float | None, float | None, str | None]:
    """Distances of classes and words from the closest language, after what is due to
    length; None where the text is too short or there is no language. With its name."""
    found = terms(data)
    by_class = by_word = closest = None
    if not refs.langs:
        return None, None, None
    if len(text) >= LEAST_CHARS:
        d = js_squared(class_counts(text) / len(text), refs.classes).min() - (CLASSES - 1) / (8 * len(text) * np.log(2))
        by_class = float(np.sqrt(max(d, 0)))
    if len(found) >= LEAST_WORDS:
        counts, last = np.zeros(refs.words.shape), refs.words.shape[1] - 1
        for word, n in Counter(found).items():
            for i, j in refs.bins.get(word, ()):
                counts[i, j] = n
        counts[:, last] = len(found) - counts.sum(1)
        d = js_squared(counts / len(found), refs.words)
        closest = refs.langs[int(d.argmin())]
        by_word = float(np.sqrt(max(d.min() - last / (8 * len(found) * np.log(2)), 0)))
    return by_class, by_word, closest


def judge(text: str | None, refs: References, class_distance: float, word_distance: float) -> tuple:
    if text is None:
        return 0, 0, 0, 0, 0, True, None, None, None, False
    data = text.encode()
    counts = base_counts(text, data)
    failed = counts[0] < BASE_WORDS or 100 * counts[4] > BASE_REPEATS * counts[0]
    by_class, by_word, closest = divergence(text, data, refs)
    far = (by_class is not None and by_class > class_distance) or (by_word is not None and by_word > word_distance)
    return *counts, failed, closest, by_class, by_word, not failed and not far


def apply_rules(docs: DataFrame, refs: References, text: str = "text", into: str = "rules", class_distance: float = CLASS_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """docs with a struct column of the counts, the distances and the verdict.

    A null text has no words and fails, as does an empty one. Equal texts are judged
    alike, and rows may repeat. Without references only the base rules decide. Texts are
    read whole. A column named as ``into`` is replaced; all others stay. Empty in, empty
    out."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    names = [x.split()[0] for x in RULES.split(", ")]

    @F.pandas_udf(RULES)
    def rules(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([judge(t, shared.value, class_distance, word_distance) for t in texts], columns=names)
        return out.astype({"class_distance": float, "word_distance": float})

    return docs.withColumn(into, rules(F.col(text)))


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict, against references of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return apply_rules(docs.select("doc_id", "text"), language_references(docs)).select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words", "rules.base_failed", "rules.kept")


def _js(p: str, q: str) -> str:
    side = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"greatest(sum({side(p, q)} + {side(q, p)}) / 2, 0)"


def _classes() -> str:
    ranges = [*(f"[^{x}]" for x in CLASS_SETS)]
    ends = [*CLASS_BOUNDS[1:], 0x110000]
    ranges += [f"[^\\x{{{a:X}}}-\\x{{{b - 1:X}}}]" for a, b in zip(CLASS_BOUNDS, ends, strict=True)]
    counts = [f"length(regexp_replace(text, '{x.replace(chr(39), chr(39) * 2)}', '', 'g'))" for x in ranges]
    known = ", ".join(counts[:5]), ", ".join(counts[5:])
    return f"[{known[0]}, length(text) - {' - '.join(counts)}, {known[1]}]"


OP12_SQL = f"""
WITH d AS (SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS tri FROM w, range(1, 1 + (SELECT max(len(ws)) FROM w)) r(i) WHERE i <= len(ws) - 2),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM p) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(0, 3) k(k) GROUP BY 1),
line AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
base AS (SELECT documents.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 0) AS word_chars,
         coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols, coalesce(line.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
         FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed FROM base),
t AS (SELECT doc_id, lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM d),
tl AS (SELECT lang, count(*) AS total FROM t WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) >= {REFERENCE_WORDS}),
top AS (SELECT lang, term, n FROM (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS k FROM t WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE k <= {COMMON}),
tn AS (SELECT doc_id, count(*) AS total FROM t GROUP BY 1 HAVING count(*) >= {LEAST_WORDS}),
dt AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2),
cell AS (SELECT tn.doc_id, top.lang, coalesce(dt.n, 0) AS dn, tn.total AS dtotal, top.n AS ln, tl.total AS ltotal FROM tn CROSS JOIN top JOIN tl ON tl.lang = top.lang LEFT JOIN dt ON dt.doc_id = tn.doc_id AND dt.term = top.term),
wbins AS (SELECT doc_id, lang, dtotal, dn / dtotal AS p, ln / ltotal AS q FROM cell
          UNION ALL SELECT doc_id, lang, any_value(dtotal), (any_value(dtotal) - sum(dn)) / any_value(dtotal), (any_value(ltotal) - sum(ln)) / any_value(ltotal) FROM cell GROUP BY 1, 2),
wd AS (SELECT doc_id, sqrt(greatest(min(d) - {COMMON} / (8 * any_value(dtotal) * ln(2)), 0)) AS by_word FROM (SELECT doc_id, lang, any_value(dtotal) AS dtotal, {_js("p", "q")} AS d FROM wbins GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT doc_id, lang, length(text) AS total, {_classes()} AS k FROM d),
cu AS (SELECT doc_id, lang, total, unnest(range(0, {CLASSES})) AS i, unnest(k) AS n FROM c),
cl AS (SELECT lang, i, n / sum(n) OVER (PARTITION BY lang) AS q FROM (SELECT lang, i, sum(n) AS n FROM cu JOIN tl USING (lang) GROUP BY 1, 2)),
cd AS (SELECT doc_id, sqrt(greatest(min(d) - {CLASSES - 1} / (8 * any_value(total) * ln(2)), 0)) AS by_class
       FROM (SELECT doc_id, cl.lang, any_value(total) AS total, {_js("(n / total)", "q")} AS d FROM cu JOIN cl USING (i) WHERE total >= {LEAST_CHARS} GROUP BY 1, 2) GROUP BY 1)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(by_class <= {CLASS_DISTANCE}, true) AND coalesce(by_word <= {WORD_DISTANCE}, true) AS kept
FROM b LEFT JOIN wd USING (doc_id) LEFT JOIN cd USING (doc_id)
"""
