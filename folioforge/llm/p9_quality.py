"""Problem 9: per-document text quality statistics, and telling prose from lists, tables and junk.

One narrow Arrow pass computes the statistics of whole texts. A bounded sample gets weak
labels from structural rules and trains gradient-boosted trees on the driver; a hand-checked
holdout calibrates the probabilities; a second narrow pass scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.boosting import BoostedTrees
from folioforge.llm.p9_holdout import HOLDOUT
from folioforge.llm.sampling import hash_sample
from folioforge.session import table

KINDS = ("prose", "list", "table", "junk")
#: Bound of the training sample (documents, before weak labelling), whatever the corpus size.
TRAIN_ROWS = 12_000

FEATURES = (
    "n_chars", "n_words", "mean_word_len", "longest_word", "symbol_ratio", "digit_ratio", "letter_ratio", "upper_ratio",
    "n_lines", "mean_line_len", "end_punct_share", "common_share", "marker_share", "cell_share", "cells_alike", "number_cells",
    "bare_share", "index_share", "prose_chars", "distinct_words", "top_word", "distinct_chars", "vowel_share", "single_share",
    "odd_ratio", "mojibake_ratio", "stop_rate", "case_flips",
)
#: Statistics that ``p9_stats`` reports.
REPORTED = ("n_chars", "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "n_lines", "mean_line_len", "end_punct_share", "common_share", "distinct_words", "prose_chars")

_CLOSERS = "\"'”’»›」』)]*_"
_STOPS = frozenset(".?!。？！…")
_MARKER = re.compile(r"^(?:[•·□■▪◦●○☐☑✓*+–—-]\s|#\S|\[\d+\]|\(?\d{1,3}[.)]\s|[①-⑳]|0\d\s)")
_INDEX = re.compile(r"(?:\.{3,}|(?:· ){2,}·|…+)\s*\d+$|,\s*\d+(?:\s*[,–-]\s*\d+)+$|,\s(?:1[89]|20)\d\d$|^\d{1,3}\s\D{3,60}$")
_CELLS = re.compile(r"\t|\s{3,}|\s*\|\s*|;")
_NUMBER = re.compile(r"^(?:n/a|[-+]?\d[\d.,%–-]*)$")
_WORD = re.compile(r"[^\W\d_]+")
_VOWEL = re.compile("[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ]")
_FLIP = re.compile(r"[a-z][A-Z]|[a-zA-Z]\d|\d[a-zA-Z]")

# Character classes by code point: 0 other symbol, 1 blank, 2 digit, 3 lower Latin, 4 upper Latin, 5 Hangul,
# 6 Hangul letters alone, 7 kana, 8 Han, 9 Latin-1 and extended letters, 10 C1 controls and Latin-1 signs, 11 boxes and replacements
_CLASS = np.zeros(65536, dtype=np.uint8)
for _c in (9, 10, 11, 12, 13, 32, 0xA0, 0x3000, 0x200B, 0xFEFF):
    _CLASS[_c] = 1
_CLASS[48:58] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[0xAC00:0xD7A4] = 5
_CLASS[0x3131:0x318F] = 6
_CLASS[0x1100:0x1200] = 6
_CLASS[0x3041:0x30FF] = 7
_CLASS[0x4E00:0xA000] = 8
_CLASS[0xC0:0x250] = 9
_CLASS[0x80:0xA0] = 10
_CLASS[0xA1:0xC0] = 10
_CLASS[0xAB] = _CLASS[0xBB] = _CLASS[0xBF] = _CLASS[0xA1] = _CLASS[0xB7] = 0
_CLASS[0x25A0:0x25FF] = 11
_CLASS[0xFFFD] = 11


def _cells(line: str) -> int:
    """Cells of a line, 1 if it isn't a row."""
    if "|" in line or "\t" in line or ";" in line or "   " in line:
        n = len([c for c in _CELLS.split(line.strip("| \t")) if c])
        if "|" in line or "\t" in line or "   " in line:
            return n
        return n if n >= 3 or (n == 2 and any(_NUMBER.match(c) for c in line.split(";"))) else 1
    if "," in line and ", " not in line:
        cells = line.split(",")
        return len(cells) if sum(1 for c in cells[1:] if _NUMBER.match(c)) * 2 >= len(cells) - 1 > 0 else 1
    return 1


def statistics(text: str, common: frozenset[str], common_ja: frozenset[str]) -> list[float]:
    """The values of ``FEATURES`` of a text that isn't blank; the whole text counts."""
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.bincount(_CLASS[np.minimum(code, 65535)], minlength=12)
    inked = max(1, n - int(kind[1]))
    letters = int(kind[3] + kind[4] + kind[5] + kind[7] + kind[8] + kind[9])
    tokens = text.split()
    lowered = text.lower()
    words = _WORD.findall(lowered)
    n_words = max(1, len(words))
    counts = Counter(words)
    hits = sum(c for w, c in counts.items() if w in common)
    ja = int(kind[7])
    share = hits / n_words
    if ja * 10 > inked:
        share = max(share, min(1.0, 2.5 * sum(lowered.count(w) for w in common_ja) / max(1, ja + int(kind[8]))))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    n_lines = len(lines)
    boxes = sum(1 for x in lines if x[0] in "□■▪●○◦" and x[1:2] == " ")
    ends = marked = rows = bare = indexed = prose = numbers = cells_seen = 0
    widths: Counter[int] = Counter()
    for x in lines:
        size = len(x)
        bared = x.rstrip(_CLOSERS)
        end = bared[-1:] in _STOPS or (bared[-1:] == "다" and bared != x)
        ends += end
        cells = _cells(x)
        if cells >= 2:
            rows += 1
            widths[cells] += 1
            parts = [c for c in re.split(r"[|\t;,]|\s{3,}", x) if c.strip()]
            cells_seen += len(parts)
            numbers += sum(1 for c in parts if _NUMBER.match(c.strip()))
        mark = _MARKER.match(x) is not None
        marked += mark and not (end and size > 45)
        index = not end and (x[-1].isdigit() or x[0].isdigit()) and _INDEX.search(x) is not None
        indexed += index
        if not end and size < 36 and cells < 2:
            bare += 1
        if cells < 2 and not index and (end and size > 12 or not mark and size > 36):
            prose += size
    latin = [w for w in counts if w.isascii()]
    n_latin = sum(counts[w] for w in latin)
    vowels = sum(counts[w] for w in latin if _VOWEL.search(w)) / n_latin if n_latin else 1.0
    single = sum(counts[w] for w in latin if len(w) == 1) / n_words
    top = max(counts.values()) / n_words if counts else 1.0
    return [
        float(n), float(len(tokens)), sum(map(len, tokens)) / max(1, len(tokens)), float(max(map(len, tokens), default=0)),
        (inked - letters - int(kind[2]) - int(kind[6])) / inked, int(kind[2]) / inked, letters / inked, int(kind[4]) / max(1, int(kind[3] + kind[4])),
        float(n_lines), sum(map(len, lines)) / max(1, n_lines), ends / max(1, n_lines), share, marked / max(1, n_lines), rows / max(1, n_lines),
        max(widths.values(), default=0) / max(1, n_lines), numbers / max(1, cells_seen), bare / max(1, n_lines), indexed / max(1, n_lines),
        prose / max(1, sum(map(len, lines))), len(counts) / n_words, top, len(set(text)) / min(n, 200), vowels, single,
        (int(kind[11] + kind[6]) - boxes) / inked, int(kind[10]) / inked, 100 * sum(map(text.count, ".?!。？！")) / n, sum(len(_FLIP.findall(w)) for w in tokens if len(w) > 16) / inked,
    ]


_AT = {f: i for i, f in enumerate(FEATURES)}


def weak_label(v: list[float]) -> int:
    """A class where the structure is plain, else -1. Rules look at form only, never at known texts."""
    f = lambda k: v[_AT[k]]
    if f("odd_ratio") > 0.15 or f("mojibake_ratio") > 0.12 or f("symbol_ratio") > 0.6:
        return 3
    if f("symbol_ratio") > 0.35 and f("common_share") < 0.02 and f("number_cells") < 0.3:
        return 3
    few = f("distinct_words") * f("n_words")
    if f("n_words") >= 6 and f("single_share") > 0.6 and f("number_cells") < 0.2:
        return 3
    if f("n_words") >= 6 and f("cell_share") < 0.3 and (f("top_word") > 0.7 or (f("vowel_share") < 0.5 and f("common_share") < 0.1 and f("letter_ratio") > 0.5)):
        return 3
    if f("n_words") >= 12 and few <= 4 and f("n_lines") < 3:
        return 3
    if f("longest_word") > 80 and f("case_flips") > 0.08:
        return 3
    if f("n_lines") >= 3 and f("cell_share") > 0.65 and f("cells_alike") > 0.6:
        return 2
    if f("cell_share") > 0.3 or f("odd_ratio") > 0.02:
        return -1
    if f("n_lines") >= 4 and f("end_punct_share") < 0.3 and f("prose_chars") < 0.5 and f("marker_share") + f("index_share") + f("bare_share") > 0.75:
        return 1
    reads = f("common_share") > 0.02 and f("stop_rate") > 0.3
    if reads and f("prose_chars") > 0.7 and (f("end_punct_share") > 0.15 or f("stop_rate") > 0.6) and f("marker_share") < 0.35:
        return 0
    if reads and f("n_lines") <= 4 and f("prose_chars") > 0.5 and f("end_punct_share") >= 0.3:
        return 0
    if f("prose_chars") > 0.9 and f("end_punct_share") > 0.8 and f("symbol_ratio") < 0.15:
        return 0
    return -1


def _common(spark: SparkSession, sf_dir: str) -> tuple[frozenset[str], frozenset[str]]:
    """The fixed list of frequent words (a few hundred rows)."""
    rows = table(spark, sf_dir, "common_words").select("lang", "word").collect()
    return frozenset(r.word for r in rows if r.lang != "ja" and r.word), frozenset(r.word for r in rows if r.lang == "ja" and r.word)


def document_statistics(df: DataFrame, common: tuple[frozenset[str], frozenset[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and one double a statistic of ``FEATURES``.

    Null, empty and blank texts have null statistics but ``n_chars`` (null, 0 or the
    count) and ``n_words`` (null or 0). Repeated rows stay repeated; other columns are not
    read. A narrow map over whole texts.
    """
    plain, ja = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[float | None]] = []
            for t in batch.column(1).to_pylist():
                if t is None:
                    out.append([None] * len(FEATURES))
                elif not t.strip():
                    out.append([float(len(t)), 0.0, *[None] * (len(FEATURES) - 2)])
                else:
                    out.append(statistics(t, plain, ja))
            cols = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64()) for _ in FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *FEATURES])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def train(df: DataFrame, common: tuple[frozenset[str], frozenset[str]], id_col: str = "doc_id", text_col: str = "text") -> BoostedTrees:
    """Trees from at most about ``TRAIN_ROWS`` documents, chosen by a hash of their id, and the hand-checked holdout."""
    plain, ja = common
    texts = df.filter(F.length(F.trim(text_col)) > 0)
    texts = hash_sample(texts, id_col, TRAIN_ROWS / max(1, df.count()))
    sample = document_statistics(texts, common, id_col, text_col).drop(id_col).toPandas().dropna().to_numpy(dtype=float)
    label = np.array([weak_label(list(v)) for v in sample], dtype=int) if len(sample) else np.zeros(0, dtype=int)
    held_x = np.array([statistics(t, plain, ja) for _, t in HOLDOUT])
    held_y = np.array([KINDS.index(k) for k, _ in HOLDOUT])
    x, y = (sample[label >= 0], label[label >= 0]) if len(sample) else (np.zeros((0, len(FEATURES))), label)
    if len(np.unique(y)) < len(KINDS):  # a tiny corpus may lack a class
        x, y = np.concatenate([x, held_x]), np.concatenate([y, held_y])
    n = np.bincount(y, minlength=len(KINDS)).astype(float)
    weight = (len(y) / (len(KINDS) * np.maximum(n, 1)))[y] ** 0.5
    return BoostedTrees(len(KINDS)).fit(x, y, weight).calibrate(held_x, held_y)


def score_documents(df: DataFrame, model: BoostedTrees, common: tuple[frozenset[str], frozenset[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``kind`` and ``confidence`` (calibrated) of each text that isn't null, empty or blank."""
    plain, ja = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t and t.strip():
                    keep.append(i)
                    rows.append(statistics(t, plain, ja))
            p = model.proba(np.array(rows)) if rows else np.zeros((0, len(KINDS)))
            best = p.argmax(axis=1) if rows else np.zeros(0, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([KINDS[k] for k in best], pa.string()), pa.array(p.max(axis=1) if rows else [], pa.float64())],
                names=[id_col, "kind", "confidence"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, kind string, confidence double")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text: its kind and the calibrated probability of that kind."""
    docs, common = table(spark, sf_dir, "documents"), _common(spark, sf_dir)
    return score_documents(docs, train(docs, common), common).withColumn("confidence", F.round("confidence", 4))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly no prose."""
    return p9_kinds(spark, sf_dir).filter(F.col("kind") != "prose").select("doc_id", "kind")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported statistics of every document."""
    stats = document_statistics(table(spark, sf_dir, "documents"), _common(spark, sf_dir))
    return stats.select("doc_id", *[F.round(c, 4).alias(c) for c in REPORTED])


def p9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document that are plain counts; those of null and blank texts are 0."""
    stats = document_statistics(table(spark, sf_dir, "documents"), _common(spark, sf_dir))
    whole = lambda c: F.coalesce(c, F.lit(0.0)).cast("long").alias(c)
    return stats.select("doc_id", *[whole(c) for c in ("n_chars", "n_words", "longest_word", "n_lines")], F.round(F.coalesce("mean_word_len", F.lit(0.0)), 4).alias("mean_word_len"))


QUERIES = {"p9_counts": p9_counts, "p9_found": p9_found, "p9_kinds": p9_kinds, "p9_stats": p9_stats}

_BLANK = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL = {
    "p9_counts": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^' || '{_BLANK[1:-1]}' || ']')) AS l FROM d)
        SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest_word, CAST(len(l) AS BIGINT) AS n_lines,
            round(coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / nullif(len(w), 0), 0), 4) AS mean_word_len FROM w""",
}
