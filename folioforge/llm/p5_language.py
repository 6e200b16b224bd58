"""Problem 5: missing or wrong document language labels.

Character n-grams of each language go into Bloom filters that are stored bit-sliced: a
slot of the table is a byte whose bits are the languages, so one look-up (the AND of a
few slots) returns all languages that contain an n-gram. Per-language popcounts over a
paragraph, corrected for each filter's false positives, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.sampling import hash_sample
from folioforge.session import table

LANGS = ("en", "ko", "de", "fr", "es", "ja")
#: Bound of the training sample: files, paragraphs of a file, and characters of a paragraph that may be drawn.
TRAIN_FILES, TRAIN_PARAGRAPHS, TRAIN_CHARS = 2_000, 6, 4_000
#: Slots (a byte each, a power of two) and hash functions of the filters.
SLOTS, HASHES = 1 << 20, 3
#: An n-gram belongs to a language if its share there is at least this part of its largest share anywhere.
SHARE_OF_MOST = 0.02
#: Least corrected share of known n-grams for a paragraph to be in a language.
LEAST_SHARE = 0.35

#: Notations of the six languages, in lower case; a region or script after - or _ is cut off before.
NOTATIONS = {
    "en": "en eng english englisch anglais inglés ingles 영어 英語 us gb uk",
    "ko": "ko kor korean koreanisch coréen coreano 한국어 한글 국어 韓国語 kr",
    "de": "de deu ger german deutsch allemand alemán aleman 독일어 ドイツ語",
    "fr": "fr fra fre french französisch français francais francés frances 프랑스어 불어 フランス語",
    "es": "es spa spanish spanisch espagnol español espanol castellano 스페인어 スペイン語",
    "ja": "ja jpn jap japanese japanisch japonais japonés japones 일본어 日本語 jp",
}
_NAMED = {w: k for k, v in NOTATIONS.items() for w in v.split()}


def label_language(label: str | None) -> str | None:
    """The language that a label names, or None if it is absent or says nothing."""
    if not label:
        return None
    text = label.strip().lower()
    return _NAMED.get(text) or _NAMED.get(re.split(r"[-_.\s(/,;]", text, maxsplit=1)[0])


def label_column(label: Column) -> Column:
    """``label_language`` as an expression."""
    names = F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv])
    text = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(names, text), F.try_element_at(names, F.split(text, r"[-_.\s(/,;]")[0]))


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Offsets of the paragraphs: runs of lines that aren't empty and don't hold only spaces and tabs."""
    out, begin, at = [], None, 0
    for line in text.split("\n"):
        if line.strip(" \t"):
            if begin is None:
                begin = at
            end = at + len(line)
        elif begin is not None:
            out.append((begin, end))
            begin = None
        at += len(line) + 1
    if begin is not None:
        out.append((begin, end))
    return out


_LETTER = np.fromiter((chr(c).isalpha() for c in range(65536)), dtype=bool, count=65536)
_LOWER = np.arange(65536, dtype=np.uint32)
for _c in range(65536):
    _l = chr(_c).lower()
    if len(_l) == 1 and ord(_l) < 65536:
        _LOWER[_c] = ord(_l)
_LOWER = np.where(_LETTER, _LOWER, 0).astype(np.uint64)


def codes(text: str) -> np.ndarray:
    """Lower-case letters by code point, 0 for all else."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _LOWER[np.minimum(raw, 65535)]


def ngrams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 3- and 4-grams around letters, and the offset of each key's letter. Words are padded by one blank."""
    padded = np.concatenate([[0], code, [0, 0]]).astype(np.uint64)
    n = len(code)
    a, b, c, d = padded[:n], padded[1 : n + 1], padded[2 : n + 2], padded[3 : n + 3]
    three = np.flatnonzero(b)
    four = np.flatnonzero((b > 0) & (c > 0))
    k3 = (a[three] << np.uint64(32)) | (b[three] << np.uint64(16)) | c[three]
    k4 = (a[four] << np.uint64(48)) ^ (b[four] << np.uint64(32)) ^ (c[four] << np.uint64(16)) ^ d[four] ^ np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate([k3, k4]), np.concatenate([three, four])


def _slots(keys: np.ndarray) -> Iterator[np.ndarray]:
    """The slots of keys, one array a hash function (double hashing over a 64-bit mix)."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(40)) | np.uint64(1)
        for i in range(HASHES):
            yield ((x + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


class LanguageFilters:
    """Bit-sliced Bloom filters of the languages."""

    def __init__(self) -> None:
        self.table = np.zeros(SLOTS, dtype=np.uint8)
        self.false = np.zeros(len(LANGS))

    def add(self, lang: int, keys: np.ndarray) -> None:
        for s in _slots(keys):
            self.table[s] |= np.uint8(1 << lang)

    def close(self) -> "LanguageFilters":
        """Each filter's rate of false positives, from how full it is."""
        fill = np.array([np.count_nonzero(self.table & np.uint8(1 << i)) / SLOTS for i in range(len(LANGS))])
        self.false = fill**HASHES
        return self

    def languages(self, keys: np.ndarray) -> np.ndarray:
        """The bitmask of all languages that contain each key."""
        mask = np.full(len(keys), 255, dtype=np.uint8)
        for s in _slots(keys):
            mask &= self.table[s]
        return mask

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> "LanguageFilters":
        """Filters from (language, text) rows: an n-gram joins every language in which its share is near its largest."""
        keys, counts, lang = [], [], []
        for i, name in enumerate(LANGS):
            own = [ngrams(codes(t))[0] for k, t in rows if k == name and t]
            if own:
                k, n = np.unique(np.concatenate(own), return_counts=True)
                keys.append(k), counts.append(n / n.sum()), lang.append(np.full(len(k), i))
        out = cls()
        if keys:
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            share, which = np.concatenate(counts), np.concatenate(lang)
            most = np.zeros(len(every))
            np.maximum.at(most, at, share)
            keep = share >= SHARE_OF_MOST * most[at]
            for i in range(len(LANGS)):
                out.add(i, every[at[keep & (which == i)]])
        return out.close()


#: What is bracketed or quoted within a line, which may be foreign, of any length.
_INSET = re.compile(r"""\([^()\n]+\)|[“„][^“”„"\n]+[”“"]|"[^"\n]+"|«[^«»\n]+»|「[^「」\n]+」|『[^『』\n]+』""")


def _shares(text: str, ends: np.ndarray, filters: LanguageFilters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each paragraph: corrected shares of its n-grams by language, n-grams and letters."""
    code, m = codes(text), len(ends)
    keys, at = ngrams(code)
    mask = filters.languages(keys)
    own = np.searchsorted(ends, at, side="right")
    n = np.bincount(own, minlength=m)[:m]
    letters = np.bincount(np.searchsorted(ends, np.flatnonzero(code), side="right"), minlength=m)[:m]
    counts = np.stack([np.bincount(own, (mask >> i) & 1, m)[:m] for i in range(len(LANGS))], axis=1)
    share = np.maximum(0, counts - n[:, None] * filters.false) / (1 - filters.false) / np.maximum(1, n)[:, None]
    return share, n, letters


def classify(text: str, filters: LanguageFilters) -> list[tuple[int, int, str | None, float]]:
    """Each paragraph's number, characters, language (None without words of any) and confidence.

    Bracketed and quoted passages count only where they are most of a paragraph.
    """
    spans = paragraphs(text)
    if not spans:
        return []
    ends = np.array([e for _, e in spans])
    bare = _INSET.sub(lambda m: " " * len(m.group()), text)
    share, n, letters = _shares(bare, ends, filters)
    if bare != text:
        own = np.searchsorted(ends, np.flatnonzero(codes(text)), side="right")
        every = np.bincount(own, minlength=len(spans))[: len(spans)]
        for i in np.flatnonzero(letters < np.maximum(6, every / 10)):
            b, e = spans[i]
            if every[i] > letters[i]:
                one = _shares(text[b:e], np.array([e - b]), filters)
                share[i], n[i], letters[i] = one[0][0], one[1][0], one[2][0]
    out = []
    for i, (b, e) in enumerate(spans):
        order = np.argsort(-share[i], kind="stable")
        best, second = share[i][order[0]], share[i][order[1]]
        if letters[i] < 2 or best < LEAST_SHARE:
            out.append((i + 1, e - b, None, 0.0))
        else:
            out.append((i + 1, e - b, LANGS[order[0]], float(1 - np.exp(-n[i] * (best - second) / 4))))
    return out


_HANGUL, _KANA, _WORD = re.compile("[가-힣]"), re.compile("[ぁ-ヿ]"), re.compile(r"[^\W\d_]+")


def weak_language(text: str, common: dict[str, frozenset[str]]) -> str | None:
    """A training label from script and frequent words, None where they don't agree clearly."""
    letters = sum(map(len, _WORD.findall(text)))
    if letters < 12:
        return None
    if len(_HANGUL.findall(text)) > 0.6 * letters:
        return "ko"
    if len(_KANA.findall(text)) > 0.25 * letters:
        return "ja"
    words = _WORD.findall(text.lower())
    hits = sorted(((sum(w in s for w in words), k) for k, s in common.items() if k not in ("ko", "ja")), reverse=True)
    return hits[0][1] if hits and hits[0][0] >= 3 and hits[0][0] >= 1.5 * hits[1][0] else None


def train_filters(files: DataFrame, common: dict[str, frozenset[str]], id_col: str = "file_id", text_col: str = "txt") -> LanguageFilters:
    """Filters from at most about ``TRAIN_FILES`` x ``TRAIN_PARAGRAPHS`` weakly labelled paragraphs and the frequent words."""
    sample = hash_sample(files.select(id_col, text_col), id_col, TRAIN_FILES / max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                spans = [(i, e) for i, e in paragraphs(t) if e - i <= TRAIN_CHARS] if t else []
                for i, e in spans[:: max(1, len(spans) // TRAIN_PARAGRAPHS)][:TRAIN_PARAGRAPHS]:
                    if (k := weak_language(t[i:e], common)) is not None:
                        out.append({"lang": k, "text": t[i:e]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("text", pa.string())]))

    rows = [(r.lang, r.text) for r in sample.mapInArrow(run, "lang string, text string").collect()]
    return LanguageFilters.train(rows + [(k, " ".join(sorted(v))) for k, v in common.items() if k in LANGS])


_SEGMENTS = "seg_no int, lang string, confidence double, n_chars long, main string, main_confidence double"


def language_segments(files: DataFrame, filters: LanguageFilters, id_col: str = "file_id", text_col: str = "txt", label_col: str = "lang") -> DataFrame:
    """Every paragraph with words of a language, beside its file's main language and label.

    Columns: ``id_col``, ``label``, ``seg_no`` (from 1), ``lang``, ``confidence``, ``n_chars``, ``main``
    (the language with the most characters; ties go to the first in ``LANGS``) and
    ``main_confidence`` (mean over its characters). Null, empty and blank texts, and texts
    without words of a language, have no row. Repeated rows come back repeated. A narrow map.
    """
    slots, false = filters.table, filters.false

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageFilters.__new__(LanguageFilters)
        own.table, own.false = slots, false
        for b in batches:
            rows, cols = [], {c: [] for c in ("seg_no", "lang", "confidence", "n_chars", "main", "main_confidence")}
            for i, t in enumerate(b.column(2).to_pylist()):
                found = [x for x in classify(t, own) if x[2]] if t else []
                if not found:
                    continue
                size = {k: sum(n for _, n, l, _ in found if l == k) for k in LANGS}
                main = max(LANGS, key=lambda k: size[k])
                sure = sum(n * c for _, n, l, c in found if l == main) / max(1, size[main])
                for no, n, l, c in found:
                    rows.append(i)
                    for name, v in zip(cols, (no, l, c, n, main, sure)):
                        cols[name].append(v)
            at = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(v, k) for v, k in zip(cols.values(), kinds))], names=[id_col, "label", *cols])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, F.col(label_col).alias("label"), text_col).mapInArrow(run, f"`{id_col}` {kind}, label string, {_SEGMENTS}")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "common_words").collect()  # a fixed table of a few hundred rows
    common = {k: frozenset(r.word for r in words if r.lang == k) for k in LANGS}
    files = table(spark, sf_dir, "txt_files")
    return language_segments(files, train_filters(files, common))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's language, confidence, delivered label and the language that label names."""
    one = _segments(spark, sf_dir).select("file_id", F.col("main").alias("lang"), F.round("main_confidence", 4).alias("confidence"), "label").distinct()
    return one.withColumn("label_lang", label_column(F.col("label")))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph in another language than its file's main one."""
    seg = _segments(spark, sf_dir).filter("lang <> main")
    return seg.select("file_id", "seg_no", "lang", "main", F.round("confidence", 4).alias("confidence"), "n_chars").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose label is absent, says nothing or is wrong (seg_no 0), and paragraphs in another language."""
    seg = _segments(spark, sf_dir)
    # A file's row and its foreign paragraphs come from one pass: the first paragraph stands for the file.
    first = F.struct(F.lit(0).alias("seg_no"), F.col("main").alias("lang"), F.lit(True).alias("file"))
    other = F.struct(F.col("seg_no"), F.col("lang"), F.lit(False).alias("file"))
    rows = seg.select("file_id", "label", F.explode(F.array_compact(F.array(first, F.when(F.col("lang") != F.col("main"), other)))).alias("r"))
    rows = rows.select("file_id", "label", "r.*").distinct()
    bad = ~F.col("file") | ~F.col("lang").eqNullSafe(label_column(F.col("label")))
    return rows.filter(bad).select("file_id", F.col("seg_no").cast("long").alias("seg_no"), "lang").distinct()


QUERIES = {"p5_found": p5_found, "p5_files": p5_files, "p5_segments": p5_segments}
