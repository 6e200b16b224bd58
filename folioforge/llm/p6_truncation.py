"""Problem 6: text cut off by field limits.

Two sources of evidence. A value that ends openly is looked for in near-copies: its longest
head and the heads of all values are min-hashed and banded, candidate pairs are aligned at
the words the value ends in, and it is cut if the other text goes on there and the two are
alike up to there. Records without a longer copy are judged by how they close: plain signs
first (an open delimiter, half a character, half a row), and else by closing-word
terminality, that is how often the corpus ends a sentence or line after the last word in
its context, goes on after it, or has a longer word where it stands. A length at which many
values of a model end openly is a field limit and tips the undecided.

Texts are read twice: a look at endings and contexts, and heads against a Bloom filter of
the open values' bands. Only counts, open values and texts that hit the filter are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.llm import bloom, minhash
from folioforge.session import cut_lineage, table

#: Similarity, on word shingles, of a cut copy and the whole text up to the cut.
SIMILAR = 0.8
#: Open ends of a model at one length, how many times those of the lengths beside it, and the least length, for a field limit.
LIMIT_COUNT, LIMIT_PEAK, LIMIT_LEAST = 5, 4, 60
#: Occurrences from which a word's context decides, not the word alone.
CONTEXT = 8
#: Share of sentence ends after a word in its context from which it may close a value.
MAY_CLOSE = 0.15
#: Letters from which a last word that is only known as the stem of longer ones is no word of its own, however often it closes a value.
LONG_STEM = 12
#: Different contexts that a task counts before it passes them on, and characters that are hashed at a time.
HELD, CHUNK = 400_000, 4_000_000

_STOPS = ".?!。？！"
_CLOSERS = "\"'”’»›」』)]*_`"
_OPENERS = "\"'“„‘«‹「『([*_"
_ADDED = re.compile(r"(?:\s*(?:\.\.\.+|…+|\[\s*(?:\.\.\.|…|more)?\s*\]?|\(\s*(?:계속|continued|cont\.?|more|\.\.\.|…)\s*\)?|<\s*(?:계속|more)\s*>?|—|더\s*보기|read more))+\s*$", re.I)
#: Last characters of what ``_ADDED`` finds.
_ADDED_ENDS = frozenset(".…[])(><—기eEdDtT속")
_FENCE = re.compile(r"\s*```\s*$")
_CITED = re.compile(r"^>\s*—\s*\S.*,\s*p{1,2}\.\s*\d+(?:\s*[–-]\s*\d+)?\.?$")
_DIGITS = re.compile(r"\d+")
#: Stands behind the last word of a line while words are counted.
_EOL = "\x00"


def without_additions(text: str) -> str:
    """The text without what may have been put behind a cut: a closing fence, dots, a note that it goes on."""
    t = text.rstrip()
    if t.endswith("```"):
        t = _FENCE.sub("", t).rstrip()
    if t[-1:] not in _ADDED_ENDS or t[-1:] == "." and not t.lower().endswith(("..", "cont.")):
        return t
    # Additions are short: the search starts near the end, and anew further back where they fill all of that.
    size = 200
    while True:
        m = _ADDED.search(t[-size:])
        if m is None:
            return t
        if m.start() > 20 or size >= len(t):
            return t[: max(0, len(t) - size) + m.start()].rstrip()
        size *= 4


def _is_tag(word: str) -> bool:
    """A hash tag stands for itself, whatever tags are around it."""
    return word[:1] == "#" and word[1:2] not in ("", "#")


def bare_word(raw: str) -> tuple[str, bool]:
    """A word without marks around it, digits as 0, and whether a sentence stops after it."""
    bare = raw.rstrip(_CLOSERS)
    word = bare.rstrip(_STOPS + ",;:").lstrip(_OPENERS) or raw
    return _DIGITS.sub("0", word), bare[-1:] in _STOPS and bare != ""


def ending(text: str) -> tuple[str, str, str]:
    """How a value that isn't blank closes: ``whole``, ``cut`` or ``open``, the word before the last, and the last word."""
    t = text.rstrip()
    if t.endswith("�"):
        return "cut", "", ""
    bare = without_additions(t)
    added = len(bare) < len(_FENCE.sub("", t).rstrip() if t.endswith("```") else t)
    t = bare
    if not t:
        return "whole", "", ""
    line = t[t.rfind("\n") + 1 :].strip()
    raw = line.split()
    last = raw[-1]
    word = bare_word(last)[0]
    before = "#" if _is_tag(last) else bare_word(raw[-2])[0] if len(raw) > 1 else "^"
    if line.startswith("|"):
        return ("whole" if line.endswith("|") and len(line) > 1 else "cut"), before, word
    if t.rfind("[[") > t.rfind("]]") or re.search(r"\]\([^)\s]*$", line):
        return "cut", before, word
    if line.endswith("]]") or re.search(r"\]\([^)\s]+\)$", line):
        return "whole", before, word
    if line.startswith("> —") or line.startswith(">—"):
        return ("whole" if _CITED.match(line) else "cut"), before, word
    if line.count("**") % 2:
        return "cut", before, word
    bared = last.rstrip(_CLOSERS)
    if bared[-1:] in _STOPS and bared:
        return "whole", before, word
    if line.count('"') % 2 or line.count("“") > line.count("”") + line.count("„") or line.count("(") > line.count(")"):
        return "cut", before, word
    if added and not last.endswith(("다", "까", "요")):
        return "cut", before, word
    return "open", before, word


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields as rows, without null and blank values. Exact copies of a note stay; results are distinct."""
    notes = table(spark, sf_dir, "wiki_notes").select("note_id", "model", "summary", "body")
    both = notes.select("note_id", "model", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("summary", "body")])).alias("v"))
    return both.select("note_id", "model", "v.field", "v.text").filter(F.col("text").rlike(r"\S"))


def _without_end(text: str) -> str:
    """The text without the last two words of its last line."""
    begin = text.rfind("\n") + 1
    return text[:begin] + " ".join(text[begin:].split()[:-2])


def _pairs_of(texts: list[tuple[str, bool]]) -> dict[tuple[str, str], int]:
    """Neighbouring words of the texts as they stand; the second of a pair is never a text's begin. A text that ends openly leaves out the place of its end."""
    words = []
    for t, whole in texts:
        words.append(_EOL)
        for line in t.replace(_EOL, " ").split("\n") if whole else _without_end(t.replace(_EOL, " ").rstrip()).split("\n"):
            if own := line.split():
                own[-1] += _EOL
                words += own
    # Pairs are counted as numbers: a sort of integers is cheaper than a hash of string pairs.
    no = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(no.__getitem__, words), dtype=np.int64, count=len(words))
    pairs, n = np.unique(ids[:-1] * len(no) + ids[1:], return_counts=True)
    word = list(no)
    return {(word[a], word[b]): k for a, b, k in zip((pairs // max(1, len(no))).tolist(), (pairs % max(1, len(no))).tolist(), n.tolist())}


class Contexts:
    """Counts of (before, word): how often the corpus goes on after the word, and how often a sentence or line ends."""

    def __init__(self) -> None:
        self.inner: Counter[tuple[str, str]] = Counter()
        self.stop: Counter[tuple[str, str]] = Counter()

    def add(self, texts: list[tuple[str, bool]]) -> None:
        known: dict[str, tuple[str, bool]] = {}

        def look(raw: str) -> tuple[str, bool]:
            if raw not in known:
                known[raw] = bare_word(raw)
            return known[raw]

        for (a, b), n in _pairs_of(texts).items():
            if b == _EOL:
                continue
            word, stops = look(b.rstrip(_EOL))
            before = "#" if _is_tag(word) else "^" if a.endswith(_EOL) else look(a)[0]
            (self.stop if stops or b.endswith(_EOL) else self.inner)[before, word] += n

    def flush(self) -> dict[str, pa.Array]:
        keys = list(self.inner.keys() | self.stop.keys())
        out = {"before": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string())}
        out |= {"inner": pa.array([self.inner.get(k, 0) for k in keys], pa.int64()), "stop": pa.array([self.stop.get(k, 0) for k in keys], pa.int64())}
        self.inner.clear(), self.stop.clear()
        return out


def _look_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("note_id", id_type), ("model", pa.string()), ("field", pa.string()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("state", pa.string()), ("before", pa.string()), ("word", pa.string()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("inner", pa.int64()), ("stop", pa.int64())]
    )


def look(values: DataFrame) -> DataFrame:
    """One pass over whole texts with two kinds of rows: values that don't close whole, and counts of words in their contexts.

    ``note_id, model, field, n_chars, n_bytes, state, before, word`` of each such value, for
    open ends with the bands of their longest head; ``before, word, inner, stop`` of the
    corpus (``state`` is null), added up within a task as far as they fit.
    """
    names = [f.name for f in _look_schema(pa.int64())]

    def rows(cols: dict[str, pa.Array], n: int, kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = Contexts(), None
        for b in batches:
            kinds = _look_schema(b.schema.field(0).type)
            texts = b.column(3).to_pylist()
            found = [ending(t) if t.strip() else ("whole", "", "") for t in texts]
            seen.add([(without_additions(t), e[0] == "whole") for t, e in zip(texts, found)])
            bad = [i for i, e in enumerate(found) if e[0] != "whole"]
            if bad:
                at = pa.array(bad, pa.int64())
                loose = [texts[i] if found[i][0] == "open" else "" for i in bad]
                of, last, keys = minhash.head_bands(*minhash.word_hashes(loose))
                bands: list[list[int] | None] = [None] * len(bad)
                for i, k in zip(of[last].tolist(), keys[last].tolist()):
                    bands[i] = k
                cols = dict(zip(("note_id", "model", "field", "fp"), (b.column(i).take(at) for i in (0, 1, 2, 4))))
                cols |= {"n_chars": pa.array([len(texts[i]) for i in bad], pa.int64()), "n_bytes": pa.array([len(texts[i].encode("utf-8", "replace")) for i in bad], pa.int64())}
                cols |= {c: pa.array([found[i][k] for i in bad], pa.string()) for k, c in enumerate(("state", "before", "word"))} | {"bands": pa.array(bands, pa.list_(pa.int64()))}
                yield rows(cols, len(bad), kinds)
            if len(seen.inner) + len(seen.stop) > HELD:
                cols = seen.flush()
                yield rows(cols, len(cols["word"]), kinds)
        if kinds is not None:
            cols = seen.flush()
            yield rows(cols, len(cols["word"]), kinds)

    kind = values.schema["note_id"].dataType.simpleString()
    schema = f"note_id {kind}, model string, field string, n_chars long, n_bytes long, state string, before string, word string, fp long, bands array<long>, inner long, stop long"
    return values.select("note_id", "model", "field", "text", F.xxhash64("text").alias("fp")).mapInArrow(run, schema).select(*names)


def longer_words(counts: DataFrame, keys: DataFrame, by: list[str], head: int) -> DataFrame:
    """``by, word, inner, stop, longer`` of each (by, word) of ``keys``: its own counts, and those of longer words that begin with it.

    ``counts`` may hold a key in several rows. Words that share a beginning follow each other in order, so
    ``longer`` is the difference of a running sum at the word and behind the last of them: no
    word is expanded into its beginnings. The sums run within (by, first ``head`` letters);
    keys of fewer letters have ``longer`` 0.
    """
    rows = counts.select(*by, "word", "inner", "stop", F.lit(False).alias("asked")).unionByName(keys.select(*by, "word", F.lit(0).cast("long").alias("inner"), F.lit(0).cast("long").alias("stop"), F.lit(True).alias("asked")))
    rows = rows.groupBy(*by, "word").agg(F.sum("inner").alias("inner"), F.sum("stop").alias("stop"), F.max("asked").alias("asked"))
    here = rows.select(*by, "word", F.when(F.col("asked"), F.col("word")).alias("of"), "inner", "stop")
    behind = keys.filter(F.length("word") >= head).select(*by, F.concat("word", F.lit("\U0010ffff")).alias("word"), F.col("word").alias("of"), F.lit(0).cast("long").alias("inner"), F.lit(0).cast("long").alias("stop"))
    w = W.partitionBy(*by, "head").orderBy("word", "of").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = here.unionByName(behind).withColumn("head", F.substring("word", 1, head)).withColumn("sum", F.sum(F.col("inner") + F.col("stop")).over(w))
    asked = summed.filter("of is not null").groupBy(*by, "head", F.col("of").alias("word"))
    return asked.agg(F.sum("inner").alias("inner"), F.sum("stop").alias("stop"), (F.max("sum") - F.min("sum")).alias("longer")).drop("head")


def terminality(contexts: DataFrame, keys: DataFrame) -> DataFrame:
    """For each (before, word) of ``keys``: counts in its context and of the word anywhere, and of longer words in its place.

    Steps go through the checkpoint folder: each is planned for itself, so the driver never
    holds one plan of them all.
    """
    pairs = keys.select("before", "word").distinct()
    here = cut_lineage(longer_words(contexts, pairs, ["before"], 1))
    anywhere = cut_lineage(contexts.groupBy("word").agg(F.sum("inner").alias("inner"), F.sum("stop").alias("stop")))
    every = longer_words(anywhere, keys.select("word").distinct(), [], 2)
    # Words of one letter: all longer words with that letter, a row a letter.
    one = anywhere.filter(F.length("word") > 1).groupBy(F.substring("word", 1, 1).alias("word")).agg(F.sum(F.col("inner") + F.col("stop")).alias("longer"))
    every = every.unionByName(one.select("word", F.lit(0).cast("long").alias("inner"), F.lit(0).cast("long").alias("stop"), "longer"))
    every = cut_lineage(every.groupBy("word").agg(F.sum("inner").alias("inner_any"), F.sum("stop").alias("stop_any"), F.sum("longer").alias("longer_any")))
    out = keys.join(here.hint("merge"), ["before", "word"], "left").join(every.hint("merge"), "word", "left")
    return out.fillna(0, ["inner", "stop", "longer", "inner_any", "stop_any", "longer_any"])


def with_limits(bad: DataFrame) -> DataFrame:
    """``note_id, field, before, word, limited`` of open values: is one of a length, in characters or bytes, at which many values of its model end openly?"""
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("size")))
    sizes = bad.select("note_id", "field", "state", "before", "word", F.coalesce("model", F.lit("")).alias("model"), F.explode(units).alias("s")).select("*", "s.unit", "s.size").drop("s")
    by = sizes.groupBy("model", "field", "unit", "size").agg(F.count("*").alias("n"))
    # A row a different length: a window over them is small, however many values a model has.
    w = W.partitionBy("model", "field", "unit").orderBy("size")
    near = [F.when(F.abs(step("size").over(w) - F.col("size")) == 1, step("n").over(w)).otherwise(F.lit(0)) for step in (F.lag, F.lead)]
    at = by.withColumn("beside", F.coalesce(F.greatest(*near), F.lit(0)))
    limits = at.filter((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_PEAK * F.col("beside")) & (F.col("size") >= LIMIT_LEAST)).select("model", "field", "unit", "size", F.lit(True).alias("at"))
    loose = sizes.filter("state = 'open'").join(limits.hint("merge"), ["model", "field", "unit", "size"], "left")
    return loose.groupBy("note_id", "field", "before", "word").agg(F.max(F.coalesce("at", F.lit(False))).alias("limited"))


def _verdict(limited: Column) -> Column:
    """Is an open end a cut? The context decides where the corpus knows it, else the word alone."""
    context = F.col("inner") + F.col("stop") + F.col("longer")
    anywhere = F.col("inner_any") + F.col("stop_any") + F.col("longer_any")

    def judge(inner: str, stop: str, longer: str) -> Column:
        i, s, g = F.col(inner), F.col(stop), F.col(longer)
        return (
            F.when((s > 0) & (s >= i), F.lit(False))
            .when((i + s == 0) & (g > 0), F.lit(True))
            .when((s == 0) & (i > 0), F.lit(True))
            .when(g > 3 * (i + s), F.lit(True))
            .otherwise(limited | (s < MAY_CLOSE * (i + s)))
        )

    sentence = F.col("word").rlike("[다까요죠]$")
    # Values that close alike don't speak for a whole text if their last word is long and only known as the stem of longer ones: the larger the data, the more often a stem is repeated. A short one may be a word (outline, outlined).
    stem = (F.length("word") > LONG_STEM) & (F.col("inner_any") + F.col("stop_any") == 0) & (F.col("longer_any") > 0)
    tag = (F.col("inner") + F.col("stop") == 0) & (F.col("longer") > 0)
    return (
        F.when(F.col("before") == "#", tag)
        .when(context >= CONTEXT, judge("inner", "stop", "longer"))
        .when((context == 0) & (F.col("closing") >= 3) & ~limited & ~stem, F.lit(False))
        .when(anywhere > 0, judge("inner_any", "stop_any", "longer_any"))
        .otherwise(~sentence)
    )


def open_cuts(seen: DataFrame) -> DataFrame:
    """(note_id, field) of values that close with a plain sign of a cut, or openly and by terminality in a cut."""
    bad = cut_lineage(seen.filter("state is not null").select("note_id", "model", "field", "n_chars", "n_bytes", "state", "before", "word").distinct())
    loose = cut_lineage(with_limits(bad))
    keys = loose.groupBy("before", "word", "limited").agg(F.count("*").alias("closing"))
    keys = keys.withColumn("closing", F.when(F.col("limited"), F.lit(0)).otherwise(F.col("closing")))
    contexts = seen.filter("state is null").select("before", "word", "inner", "stop")
    judged = terminality(contexts, keys).select("before", "word", "limited", _verdict(F.col("limited")).alias("is_cut"))
    # One verdict a context: a context that very many values share is one row here, and AQE splits its rows in the join.
    hit = loose.join(judged.filter("is_cut").hint("merge"), ["before", "word", "limited"], "left_semi")
    return cut_lineage(bad.filter("state = 'cut'").select("note_id", "field").unionByName(hit.select("note_id", "field")))


def ends_early(short: str, long: str) -> bool:
    """Does the first text stop where the second goes on, and are the two near-copies up to there?

    The four words before the last one, which may be half a word, must stand in the second
    text with the last word's beginning behind them; the shingles up to there must be alike.
    """
    x, y = (minhash.word_hashes([t])[0] for t in (short, long))
    if len(x) < minhash.SHORTEST or len(y) < minhash.SHORTEST:
        return False
    tail = minhash.runs(x[-minhash.SHINGLE : -1], minhash.SHINGLE - 1)[0]
    places = np.flatnonzero(minhash.runs(y, minhash.SHINGLE - 1)[:-1] == tail)
    if not len(places):
        return False
    own = np.unique(minhash.runs(x[:-1], minhash.SHINGLE))
    other = minhash.runs(y, minhash.SHINGLE)
    new = np.zeros(len(other), dtype=bool)
    new[np.unique(other, return_index=True)[1]] = True
    known = np.cumsum(np.concatenate([[0], new]))
    common = np.cumsum(np.concatenate([[0], new & np.isin(other, own)]))
    last, words = short.split()[-1], long.split()
    part = last.rstrip(_STOPS + "…")
    for i in places[::-1].tolist():  # the words i .. i+3 are the tail, those before i+4 the part up to the cut
        nxt = words[i + minhash.SHINGLE - 1]
        if nxt.startswith(part) and (i + minhash.SHINGLE < len(words) or len(nxt) > len(last)):
            if common[i] >= SIMILAR * (len(own) + known[i] - common[i]):
                return True
    return False


_CLASS = ["field", "fp", "n_chars"]


def near_texts(values: DataFrame, filter_bits: np.ndarray) -> DataFrame:
    """``field, fp, n_chars, text, buckets`` of values that have a head in a bucket of the filter. A narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            begin, hit, buckets = 0, [], []
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                of, _, keys = minhash.head_bands(*minhash.word_hashes(texts[begin:end]))
                ok = bloom.holds(filter_bits, keys.reshape(-1)).reshape(keys.shape)
                rows = np.flatnonzero(ok.any(axis=1))
                cuts = np.flatnonzero(np.diff(of[rows], prepend=-1))
                for r in np.split(rows, cuts[1:]) if len(rows) else []:
                    hit.append(begin + int(of[r[0]]))
                    buckets.append(keys[r][ok[r]].tolist())
                begin = end
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array([len(texts[i]) for i in hit], pa.int64()), b.column(1).take(at), pa.array(buckets, pa.list_(pa.int64()))], names=[*_CLASS, "text", "buckets"])

    return values.select("field", "text", F.xxhash64("text").alias("fp")).mapInArrow(run, "field string, fp long, n_chars long, text string, buckets array<long>")


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``field, fp, n_chars, run``: hash of the four words before a text's last one."""
    for b in batches:
        every = [minhash.word_hashes([t])[0] for t in b.column(3).to_pylist()]
        at = [i for i, w in enumerate(every) if len(w) >= minhash.SHINGLE]
        found = [int(minhash.runs(every[i][-minhash.SHINGLE : -1], minhash.SHINGLE - 1).view(np.int64)[0]) for i in at]
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at, pa.int64())) for i in range(3)), pa.array(found, pa.int64())], names=[*_CLASS, "run"])


def _inner_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``field, fp, n_chars, run``: each run of four words of a text that goes on behind it."""
    for b in batches:
        every = [np.unique(minhash.runs(minhash.word_hashes([t])[0], minhash.SHINGLE - 1)[:-1]) for t in b.column(3).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(every)), [len(r) for r in every]))
        found = np.concatenate(every).view(np.int64) if every else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(found, pa.int64())], names=[*_CLASS, "run"])


def early_copies(values: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(note_id, field) of open values that are near-copies of a longer one and end early.

    Exact copies are one class (field, hash and length). In a bucket every open value is
    first held against the longest text only, so a bucket that very many copies share isn't
    expanded into pairs. Those that are left are held against every other text of their
    buckets that has the words they end in and goes on behind them, which all copies that
    end early must meet, so no pair of a bucket stays undecided.
    """
    seen = cut_lineage(look(values)) if seen is None else seen
    asked = seen.filter("state = 'open' and bands is not null").select("note_id", *_CLASS, "bands")
    keys = asked.select(F.explode("bands").alias("bucket"))
    near = cut_lineage(near_texts(values, bloom.build(keys, "bucket")).distinct())
    short = asked.select(*_CLASS, F.explode("bands").alias("bucket")).distinct()
    long = near.select(F.col("field"), F.col("fp").alias("long_fp"), F.col("n_chars").alias("long_chars"), F.explode("buckets").alias("bucket"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = [ends_early(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(flags, pa.bool_())], names=[*_CLASS, "early"])

    def early(pairs: DataFrame) -> DataFrame:
        """Classes of the pairs (``_CLASS``, long_fp, long_chars) that end early."""
        two = pairs.join(near.select(*_CLASS, F.col("text").alias("a")).hint("merge"), _CLASS)
        other = near.select("field", F.col("fp").alias("long_fp"), F.col("n_chars").alias("long_chars"), F.col("text").alias("b"))
        two = two.join(other.hint("merge"), ["field", "long_fp", "long_chars"])
        checked = two.select(*_CLASS, "a", "b").mapInArrow(check, "field string, fp long, n_chars long, early boolean")
        return cut_lineage(checked.filter("early").select(*_CLASS).distinct())

    heads = long.groupBy("field", "bucket").agg(F.max(F.struct("long_chars", "long_fp")).alias("head"), F.count("*").alias("n"))
    pairs = short.join(heads.filter("n > 1").hint("merge"), ["field", "bucket"])
    pairs = pairs.filter("head.long_chars > n_chars or head.long_chars = n_chars and head.long_fp > fp")
    pairs = cut_lineage(pairs.select(*_CLASS, "bucket", F.col("head.long_fp").alias("long_fp"), F.col("head.long_chars").alias("long_chars"), "n"))
    if pairs.isEmpty():
        return asked.select("note_id", "field").limit(0)
    found = early(pairs.select(*_CLASS, "long_fp", "long_chars").distinct())

    # Only buckets of three texts or more have a pair without the longest one.
    left = pairs.filter("n > 2").select(*_CLASS, "bucket").distinct().join(found.hint("merge"), _CLASS, "left_anti")
    left = cut_lineage(left)
    if not left.isEmpty():
        texts = near.select(*_CLASS, "text")
        tails = texts.join(left.select(*_CLASS).distinct().hint("merge"), _CLASS, "left_semi").mapInArrow(_tails, "field string, fp long, n_chars long, run long")
        members = long.join(left.select("field", "bucket").distinct().hint("merge"), ["field", "bucket"], "left_semi")
        others = members.select("field", F.col("long_fp").alias("fp"), F.col("long_chars").alias("n_chars")).distinct()
        inner = texts.join(others.hint("merge"), _CLASS, "left_semi").mapInArrow(_inner_runs, "field string, fp long, n_chars long, run long")
        inner = inner.select("field", F.col("fp").alias("long_fp"), F.col("n_chars").alias("long_chars"), "run")
        both = tails.join(inner.hint("merge"), ["field", "run"]).filter("long_chars > n_chars or long_chars = n_chars and long_fp > fp").drop("run")
        mine = left.groupBy(*_CLASS).agg(F.collect_list("bucket").alias("own"))
        theirs = near.select("field", F.col("fp").alias("long_fp"), F.col("n_chars").alias("long_chars"), "buckets")
        both = both.join(mine.hint("merge"), _CLASS).join(theirs.hint("merge"), ["field", "long_fp", "long_chars"]).filter(F.arrays_overlap("own", "buckets"))
        found = found.unionByName(early(both.select(*_CLASS, "long_fp", "long_chars").distinct())).distinct()
    return asked.select("note_id", *_CLASS).join(found.hint("merge"), _CLASS, "left_semi").select("note_id", "field")


def cut_values(values: DataFrame) -> DataFrame:
    """(note_id, field) of every cut value, once."""
    seen = cut_lineage(look(values))
    return open_cuts(seen).unionByName(early_copies(values, seen)).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were cut off inside a word or a sentence."""
    return cut_values(_values(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model: values that aren't blank, cut ones, and their share. A null model is the empty one."""
    values = _values(spark, sf_dir)
    one = values.select("note_id", "field", F.coalesce("model", F.lit("")).alias("model"), F.lit(0).alias("cut"))
    cut = cut_values(values).select("note_id", "field", F.lit(None).cast("string").alias("model"), F.lit(1).alias("cut"))
    # A value's rows meet in one aggregation, its cut among them: no join.
    both = one.unionByName(cut).groupBy("note_id", "field").agg(F.max("model").alias("model"), F.max("cut").alias("cut"))
    by = both.groupBy("model").agg(F.count("*").alias("n_values"), F.sum("cut").cast("long").alias("n_cut"))
    return by.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_values"), 6))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
