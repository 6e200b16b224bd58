"""Problem 1: noise in text from scanned pages.

Edge lines that repeat within a file are running headers, edge lines that are only a
number are page numbers. What is left is body: words cut at line ends are joined where
the corpus knows the joined word better than the hyphenated one. Rare words are joined
with frequent confusable variants in SQL: a word's anagram hash is the sum of its
characters' fifth powers, so one confusion shifts the hash by a known difference,
whatever the word; candidates of that equi-join are verified and ranked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.llm import bloom
from folioforge.session import cut_lineage, table

#: What is printed and what is read instead.
CONFUSIONS = (
    ("a", "@"), ("b", "6"), ("d", "cl"), ("e", "c"), ("g", "9"), ("h", "b"), ("i", "!"), ("i", "l"), ("i", "1"), ("l", "1"), ("l", "i"), ("m", "rn"),
    ("n", "ri"), ("o", "0"), ("ri", "n"), ("rn", "m"), ("s", "5"), ("t", "f"), ("u", "ii"), ("w", "vv"), ("z", "2"), ("q", "g"), ("c", "e"), ("l", "|"), ("cl", "d"),
    ("다", "디"), ("한", "힌"), ("를", "틀"), ("는", "눈"), ("은", "온"), ("을", "올"), ("의", "익"), ("에", "메"), ("고", "ㅗ"), ("기", "7l"), ("기", "7|"), ("이", "0|"), ("이", "01"),
    ("가", "기"), ("서", "시"), ("로", "르"), ("지", "자"), ("된", "뒨"), ("해", "헤"), ("하", "히"), ("리", "러"), ("으", "오"), ("도", "드"), ("사", "시"), ("대", "데"), ("비", "바"),
    ("り", "リ"), ("べ", "ベ"), ("へ", "ヘ"), ("ソ", "ン"), ("シ", "ツ"), ("ー", "一"), ("口", "ロ"), ("力", "カ"), ("二", "ニ"), ("土", "士"), ("未", "末"), ("日", "曰"), ("る", "ろ"), ("は", "ほ"), ("ね", "れ"), ("き", "さ"),
)
#: A frequent variant occurs at least so often, and so many times as often as the rare word.
FREQUENT, RATIO = 10, 8
#: Longest running header, in characters; edge lines looked at on either side.
HEADER_CHARS, EDGE = 90, 3
#: Different words that a task counts before it passes them on.
HELD = 400_000

HYPHENS = "-‐­¬"
_HYPHEN_END = re.compile(r"([^\W\d_]+)[-‐­¬]$")
_HYPHENED = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_WORD = re.compile(r"[@!]?[^\W_](?:[^\W_]|[@!|](?=[^\W_]))*@?")
_FIRST = re.compile(r"^[^\w]*([^\W\d_](?:[^\W_]|[@!|](?=[^\W_]))*)")
_MARKS = re.compile(r"^[\s#>*_|]+|[\s*_|]+$")
_BLANK = " \t\r\f\v\u00a0\u3000"
_ROMAN = re.compile(r"^(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_PAGE = re.compile(r"^(?:[-–—·•~(\[<]\s*)?(?:(?:p|pp|page|s|seite|pág|pag|página|쪽|페이지)\.?\s*)?([0-9lIOoSB]{1,4}|[ivxlc]{1,9}|[IVXLC]{1,9})(?:\s*(?:/|of|von|sur|de)\s*[0-9lIOoSB]{1,4})?(?:\s*(?:쪽|페이지|頁|ページ))?(?:\s*[-–—·•~)\]>])?\.?$", re.I)
_NUMBER_TOKEN = re.compile(r"^\s*(?:[-–—|·\[(]?\s*[0-9lIO]{1,4}\s*[-–—|·\])]?\s+)|(?:\s+[-–—|·\[(]?\s*[0-9lIO]{1,4}\s*[-–—|·\])]?)\s*$")
_MISREAD_SIGNS = str.maketrans("", "", "0156978@!")
_SPECIAL = re.compile(r"[=/\\<>{}]|\d")

_SKELETON = str.maketrans({"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "6": "b", "9": "g", "@": "a", "e": "c", "h": "b", "f": "t", "디": "다", "힌": "한", "틀": "를", "눈": "는", "온": "은", "올": "을", "익": "의", "메": "에", "ㅗ": "고"})


def page_number(line: str) -> bool:
    """Is the line only a printed page number, in any usual dress, misread digits included?"""
    # The pattern has eight parts at most, so most lines need no look at it.
    if len(line.split()) > 8:
        return False
    m = _PAGE.match(_MARKS.sub("", line))
    if not m:
        return False
    core = m.group(1)
    if core.isdigit():
        return True
    if _ROMAN.match(core.lower()) and (core.islower() or core.isupper()):
        return True
    return any(c.isdigit() for c in core) or (len(core) >= 2 and set(core) <= set("lIO"))


def skeleton(line: str) -> str:
    """A key of a title line that misread characters, case, marks and a page number beside it don't change."""
    s = _NUMBER_TOKEN.sub("", _MARKS.sub("", line))
    if not s or _SPECIAL.search(s.translate(_MISREAD_SIGNS)):
        return ""
    s = re.sub(r"[\W_]+", "", s.lower().replace("7l", "기"))
    for wrong, right in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n")):
        s = s.replace(wrong, right)
    return s.translate(_SKELETON).replace("ii", "u")


@lru_cache(maxsize=10_000)
def title_skeleton(stem: str | None) -> str:
    """The skeleton of the title in a file name: without upload prefix and serial."""
    return skeleton(re.sub(r"^(?:add_pdf_|\d+[_. -]+)|_[^_]*$", "", stem or ""))


def edge_lines(text: str) -> list[tuple[int, str, int, bool, str]]:
    """(line_no, side, rank, is_number, skeleton) of lines that may be furniture.

    A header stands at the very edge or beside a page number; a Markdown heading and a line
    that ends a sentence or cuts a word are content.
    """
    lines = text.split("\n")
    order = range(len(lines))
    top = [*islice((i for i in order if lines[i].strip()), EDGE)]
    bottom = [*islice((i for i in reversed(order) if lines[i].strip()), EDGE)]
    out: dict[int, tuple[int, str, int, bool, str]] = {}
    for side, order in (("T", top), ("B", bottom)):
        for rank, i in enumerate(order):
            line = lines[i].strip()
            if page_number(line):
                out.setdefault(i, (i + 1, side, rank, True, ""))
                continue
            before_is_number = rank == 1 and page_number(lines[order[0]])
            if rank == 0 or before_is_number:
                plain = not line.startswith("#") and len(line) <= HEADER_CHARS and line[-1] not in ".?!。？！;,:”\"»“」" + HYPHENS
                key = skeleton(line) if plain else ""
                if len(key) >= 2 and i not in out:
                    out[i] = (i + 1, side, rank, False, key)
    return list(out.values())


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields as rows; copies of a page are the same rows and come out once at the end."""
    pages = table(spark, sf_dir, "txt_pages").select("page_id", "file_id", "stem", "page_no", "txt", "md")
    rows = pages.select("page_id", "file_id", "stem", "page_no", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("txt", "md")])).alias("v"))
    return rows.select("page_id", "file_id", "stem", "page_no", "v.field", "v.text").filter(F.length("text") > 0)


def furniture(pages: DataFrame) -> DataFrame:
    """(page_id, field, line_no, kind) of running headers and page numbers.

    A header's skeleton stands at its side on two pages of the file or more, or is the title
    in the file's name. Counts are by file and skeleton, so a file of any size is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], {c: [] for c in ("line_no", "side", "rank", "is_number", "key", "titled")}
            for i, (text, stem) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                title = title_skeleton(stem)
                for e in edge_lines(text):
                    rows.append(i)
                    for c, v in zip(cols, (*e, e[4] != "" and e[4] == title)):
                        cols[c].append(v)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.bool_())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), *(pa.array(v, k) for v, k in zip(cols.values(), kinds))], names=["page_id", "file_id", "page_no", "field", *cols])

    schema = "page_id long, file_id long, page_no int, field string, line_no long, side string, rank int, is_number boolean, key string, titled boolean"
    edges = cut_lineage(pages.select("page_id", "file_id", "page_no", "field", "text", "stem").mapInArrow(run, schema).distinct())
    numbers = edges.filter("is_number").select("page_id", "field", "line_no", F.lit("page_number").alias("kind"))
    titles = edges.filter("not is_number and not (page_no = 1 and side = 'T' and rank = 0)")
    per_page = titles.groupBy("file_id", "key", "side", "page_no").agg(F.max("titled").alias("titled"))
    sides = per_page.groupBy("file_id", "key", "side").agg(F.count("*").alias("n"), F.max("titled").alias("titled"))
    most = sides.groupBy("file_id", "key").agg(F.max("n").alias("most"))
    running = sides.join(most, ["file_id", "key"]).filter("(n >= 2 or titled) and n * 2 >= most").select("file_id", "key", "side")
    headers = titles.join(running, ["file_id", "key", "side"], "left_semi").select("page_id", "field", "line_no", F.lit("header").alias("kind"))
    return cut_lineage(numbers.unionByName(headers))


def body_of(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with ``skip``: the numbers of their furniture lines. Texts move once, to the checkpoint folder, for the two passes over them."""
    skip = found.groupBy("page_id", "field").agg(F.collect_set("line_no").alias("skip"))
    return cut_lineage(pages.join(skip, ["page_id", "field"], "left"))


_EDGE_MARKS = ".,;:\"'()“”‘’?…«»"


def words_of(line: str) -> list[str]:
    """The words of a line: letters and digits, with signs that may be misread ones inside. Most words need no pattern."""
    out = []
    for raw in line.split():
        if raw.isalnum():
            out.append(raw)
            continue
        token = raw.rstrip(_EDGE_MARKS + "!|").lstrip(_EDGE_MARKS)
        if token.isalnum():
            out.append(token)
        elif token:
            out += _WORD.findall(token)
    return out


def _bare(line: str) -> str:
    """A line without blanks and Markdown marks at its ends."""
    return line.lstrip(_BLANK + "#>*_|").rstrip(_BLANK + "*_|")


def page_words(text: str, skip: list[int] | None) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, str, str]], tuple[int, str] | None, tuple[int, str, str] | None]:
    """Of a page's body: words with line numbers, cut words (line, next line, head, tail, sign), the first word, and a cut word at the end."""
    gone = set(skip or ())
    lines = [(i + 1, x) for i, x in enumerate(text.split("\n")) if x.strip() and i + 1 not in gone]
    words: list[tuple[int, str]] = []
    cuts: list[tuple[int, int, str, str, str]] = []
    first, last = None, None
    eaten = False  # this line's first word belongs to the line before
    for k, (no, line) in enumerate(lines):
        s = _bare(line).lower()
        if not s:
            eaten = False
            continue
        if k == 0 and (m := _FIRST.match(s)):
            first = (no, m.group(1))
        found = words_of(s)
        if eaten and found:
            found = found[1:]
        eaten = False
        if s[-1] in HYPHENS and (m := _HYPHEN_END.search(s)):
            head, sign = m.group(1), s[-1]
            whole = (words_of(s[:-1]) or [head])[-1]
            if k + 1 < len(lines):
                nxt = _bare(lines[k + 1][1]).lower()
                t = _FIRST.match(nxt)
                if t and not nxt[:1].isdigit():
                    cuts.append((no, lines[k + 1][0], whole, t.group(1), sign))
                    eaten = True
            else:
                last = (no, whole, sign)
            if found and found[-1] == whole:
                found.pop()
        words += [(no, w) for w in found]
    return words, cuts, first, last


def anagram(word: str) -> int:
    """Sum of the characters' fifth powers, in 64 bits."""
    return sum((ord(c) ** 5) for c in word) & 0x7FFFFFFFFFFFFFFF


_SCAN = "page_id long, file_id long, page_no int, field string, line_no long, head string, tail string, sign string, role string, word string, hash long, n long, hyphened long"


def scan_words(body: DataFrame) -> DataFrame:
    """One pass over all bodies with two kinds of rows: counts of words (``word, hash, n, hyphened``), added up within a task as far as they fit, and cut words.

    ``hyphened`` counts words written with an inner hyphen. Cut words are ``page_id, file_id,
    page_no, field, line_no, head, tail, sign, role``: ``cut`` with both parts, ``last`` at a
    page's end, and the ``first`` word of a page, which may complete one.
    """
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ["page_id", "file_id", "page_no", "field", "line_no", "head", "tail", "sign", "role", "word", "hash", "n", "hyphened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        pair: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            rows = list(n.items()) + [(k, 0) for k in pair if k not in n]
            cols = [pa.array([w for w, _ in rows], pa.string()), pa.array([anagram(w) for w, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.int64()), pa.array([pair.get(w, 0) for w, _ in rows], pa.int64())]
            blank = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.string(), *kinds)]
            n.clear(), pair.clear()
            return pa.RecordBatch.from_arrays([*blank, *cols], names=names)

        for b in batches:
            rows, cols = [], [[] for _ in kinds]
            for i, (text, skip) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                words, cuts, first, last = page_words(text, skip)
                n.update([w for _, w in words])
                n.update([h + t for _, _, h, t, _ in cuts])
                if "-" in text:
                    pair.update(x.lower() for w in text.split() if "-" in w[1:-1] for x in _HYPHENED.findall(w))
                found = [(a, h, tail, sign, "cut") for a, _, h, tail, sign in cuts]
                if first:
                    found.append((first[0], "", first[1], "", "first"))
                if last:
                    found.append((last[0], last[1], "", last[2], "last"))
                for r in found:
                    rows.append(i)
                    for c, v in zip(cols, r):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            blank = [pa.nulls(len(rows), k) for k in (pa.string(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), *(pa.array(v, k) for v, k in zip(cols, kinds)), *blank], names=names)
            if len(n) > HELD:
                yield counted()
        yield counted()

    return cut_lineage(body.select("page_id", "file_id", "page_no", "field", "text", "skip").mapInArrow(run, _SCAN))


def word_counts(scanned: DataFrame) -> DataFrame:
    """``word, hash, n, hyphened`` of the corpus."""
    rows = scanned.filter("word is not null").select("word", "hash", "n", "hyphened")
    return cut_lineage(rows.groupBy("word", "hash").agg(F.sum("n").alias("n"), F.sum("hyphened").alias("hyphened")))


def corrections(vocab: DataFrame) -> DataFrame:
    """``word, fix, at, wrong_len``: the best frequent variant of each rare word, one confusion away.

    Anagram hashes join the two; the confusion must then turn the one word into the other in
    one place. Ranked by the variant's frequency, then by the word.
    """
    mask = (1 << 63) - 1
    rules = F.array(*[F.struct(F.lit(r).alias("fix_part"), F.lit(w).alias("wrong"), F.lit((anagram(w) - anagram(r)) & mask).alias("delta")) for r, w in CONFUSIONS])
    rare = vocab.filter((F.length("word") >= 2) & (F.col("n") > 0)).select("word", "hash", F.col("n").alias("n_word"))
    tries = rare.select("word", "hash", "n_word", F.explode(F.filter(rules, lambda r: F.col("word").contains(r["wrong"]))).alias("r")).select("word", "hash", "n_word", "r.*")
    tries = tries.withColumn("hash", (F.col("hash") - F.col("delta")).bitwiseAND(F.lit(mask)))
    often = vocab.filter(F.col("n") >= FREQUENT).select(F.col("word").alias("fix"), "hash", F.col("n").alias("n_fix"))
    pairs = tries.join(often, "hash").filter((F.col("n_fix") >= RATIO * F.col("n_word")) & (F.col("word") != F.col("fix")))
    place = F.filter(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.col("fix_part"), F.substring(F.col("word"), i + F.length("wrong"), F.length("word"))) == F.col("fix"),
    )
    pairs = pairs.withColumn("place", place).filter((F.size("place") > 0) & (F.substring(F.col("word"), F.col("place")[0], F.length("wrong")) == F.col("wrong")))
    best = W.partitionBy("word").orderBy(F.desc("n_fix"), "fix", "wrong")
    out = pairs.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return cut_lineage(out.select("word", "fix", (F.col("place")[0] - 1).alias("at"), F.length("wrong").alias("wrong_len")))


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64)


def word_filter(words: DataFrame) -> np.ndarray:
    """A Bloom filter over ``word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column(0).to_pylist()).view(np.int64), pa.int64())], names=["key"])

    return bloom.build(words.select("word").mapInArrow(run, "key long"), "key")


#: Letters with a digit or sign inside are misread even where no variant is known, unless they look like a formula or code.
_ALIEN = re.compile(r"[a-zà-ÿ]{2}[0156@!|9][a-zà-ÿ]|[a-zà-ÿ][0156@!|9][a-zà-ÿ]{2}|^[a-zà-ÿ]{4,}[0156@9]$|^[@!0156][a-zà-ÿ]{3,}$")


def suspects(body: DataFrame, filter_bits: np.ndarray) -> DataFrame:
    """(page_id, field, line_no, next_line, word, split, alien): words that may have a correction, and cut words with where they are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            rows, cols = [], {c: [] for c in ("line_no", "next_line", "word", "split", "alien")}
            out = list(cols.values())
            pages = [page_words(t, s) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            fresh = list({w for words, cuts, _, _ in pages for w in [*(w for _, w in words), *(h + t for _, _, h, t, _ in cuts)] if w not in known})
            if fresh:
                hit = bloom.holds(filter_bits, _hashes(fresh)).tolist()
                # Bit 1: may have a correction; bit 2: letters with a digit or sign inside.
                known.update((w, x | 2 * (_ALIEN.search(w) is not None)) for w, x in zip(fresh, hit))
            for i, (words, cuts, _, _) in enumerate(pages):
                for no, w in words:
                    if k := known[w]:
                        rows.append(i)
                        for c, v in zip(out, (no, no, w, len(w), k > 1)):
                            c.append(v)
                for a, z, h, t, _ in cuts:
                    if k := known[h + t]:
                        rows.append(i)
                        for c, v in zip(out, (a, z, h + t, len(h), k > 1)):
                            c.append(v)
            if len(known) > 400_000:
                known.clear()
            at = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(v, k) for v, k in zip(cols.values(), kinds))], names=["page_id", "field", *cols])

    return body.select("page_id", "field", "text", "skip").mapInArrow(run, "page_id long, field string, line_no long, next_line long, word string, split int, alien boolean")


def misread_words(body: DataFrame, fixes: DataFrame) -> DataFrame:
    """(page_id, field, line_no, word, fix): misread words where they stand; ``fix`` is null where no variant is known."""
    seen = suspects(body, word_filter(fixes))
    hit = seen.join(fixes, "word", "left").filter(F.col("fix").isNotNull() | F.col("alien"))
    alien_at = F.regexp_instr("word", F.lit("[0156@!|9]")) - 1
    at, size = F.coalesce("at", alien_at), F.coalesce("wrong_len", F.lit(1))
    line = F.when(at + size <= F.col("split"), F.array("line_no")).when(at >= F.col("split"), F.array("next_line")).otherwise(F.array("line_no", "next_line"))
    return hit.select("page_id", "field", F.explode(line).alias("line_no"), "word", "fix", F.col("line_no").alias("word_line"), "split")


def cut_words(scanned: DataFrame, vocab: DataFrame) -> DataFrame:
    """(page_id, field, line_no, head, tail, is_cut): line ends with a hyphen sign, and whether the sign was added.

    The joined word's count against the hyphenated one's decides; where the corpus knows
    neither, two known words are a compound. A word cut at a page's end is completed from
    the next page by an equi-join on file and page number. The four counts of a cut come
    from one join on the word asked for.
    """
    rows = scanned.filter("role is not null").drop("word", "hash", "n", "hyphened").distinct()
    nxt = rows.filter("role = 'first'").groupBy("file_id", (F.col("page_no") - 1).alias("page_no"), "field").agg(F.min("tail").alias("next_tail"))
    last = rows.filter("role = 'last'").join(nxt, ["file_id", "page_no", "field"], "left")
    last = last.withColumn("tail", F.coalesce("next_tail", F.lit(""))).drop("next_tail")
    every = rows.filter("role = 'cut'").unionByName(last.select(*rows.columns))
    key = ["page_id", "field", "line_no", "head", "tail", "sign"]
    asked = F.array(*[F.struct(F.lit(name).alias("what"), word.alias("word")) for name, word in (("n_joined", F.concat("head", "tail")), ("n_dashed", F.concat_ws("-", "head", "tail")), ("n_head", F.col("head")), ("n_tail", F.col("tail")))])
    asked = every.select(*key, F.explode(asked).alias("a")).select(*key, "a.*")
    known = asked.join(vocab.select("word", "n", "hyphened").hint("merge"), "word", "left")
    told = F.coalesce(F.when(F.col("what") == "n_dashed", F.col("hyphened")).otherwise(F.col("n")), F.lit(0))
    names = ("n_joined", "n_dashed", "n_head", "n_tail")
    every = known.groupBy(*key).agg(*[F.max(F.when(F.col("what") == c, told)).alias(c) for c in names])
    n = {c: F.col(c) for c in names}
    both_words = (n["n_head"] >= FREQUENT) & (n["n_tail"] >= FREQUENT)
    # The cut itself counts once in n_joined, so a single joined count is no evidence.
    is_cut = (
        F.when(~F.col("sign").isin("-", "‐"), F.lit(True))
        .when((n["n_dashed"] >= 2) | (n["n_joined"] >= 2), n["n_joined"] > n["n_dashed"])
        .otherwise(~both_words)
    )
    return every.select("page_id", "field", "line_no", "head", "tail", is_cut.alias("is_cut"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with running headers, page numbers, cut words and misread words."""
    pages = _pages(spark, sf_dir)
    edges = furniture(pages)
    body = body_of(pages, edges)
    scanned = scan_words(body)
    vocab = word_counts(scanned)
    cuts = cut_words(scanned, vocab).filter("is_cut").select("page_id", "field", "line_no", F.lit("hyphen").alias("kind"))
    misread = misread_words(body, corrections(vocab)).select("page_id", "field", "line_no", F.lit("misread").alias("kind"))
    return edges.unionByName(cuts).unionByName(misread).distinct()


def repair(text: str, skip: list[int] | None, cut: list[int] | None, fixes: list[tuple[str, str]] | None, tail: str | None, eat: bool) -> str:
    """A page as paragraphs: furniture gone, cut words joined, misread words replaced, lines of a paragraph in one."""
    gone, joins = set(skip or ()), set(cut or ())
    swap = {w: f for w, f in fixes or () if f}
    kept = [(i + 1, x.strip()) for i, x in enumerate(text.split("\n")) if i + 1 not in gone]
    while kept and not kept[-1][1]:
        kept.pop()
    out, fresh = "", True
    for k, (no, line) in enumerate(kept):
        if not line:
            out, fresh = (out.rstrip() + "\n\n" if out.strip() else out), True
            continue
        if eat and not out:
            line = re.sub(r"^[^\w]*[^\W\d_][\w@!|]*[^\s\w]*\s?", "", line, count=1)
        if line.startswith(("#", ">", "|", "- ", "* ")) and not fresh:
            out = out.rstrip() + "\n"
        if no in joins:
            out += line[:-1] + (tail or "" if k == len(kept) - 1 else "")
        else:
            out += line + ("" if line.endswith(tuple(HYPHENS)) else " ")
        fresh = False
    text = re.sub(r"\n{3,}", "\n\n", out).strip()

    def put(m: re.Match) -> str:
        w = m.group()
        f = swap.get(w.lower())
        return w if f is None else f.capitalize() if w[:1].isupper() else f

    return _WORD.sub(put, text) if swap else text


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text in continuous paragraphs: a word cut at its end is completed there and left out on the next page."""
    pages = _pages(spark, sf_dir)
    edges = furniture(pages)
    body = body_of(pages, edges)
    scanned = scan_words(body)
    vocab = word_counts(scanned)
    key = ["page_id", "field"]
    cuts = cut_lineage(cut_words(scanned, vocab).filter("is_cut"))
    fixes = misread_words(body, corrections(vocab)).groupBy(*key).agg(F.collect_set(F.struct("word", "fix")).alias("fixes"))
    cut = cuts.groupBy(*key).agg(F.collect_set("line_no").alias("cut"), F.max_by("tail", "line_no").alias("tail"))
    every = body.join(cut, key, "left").join(fixes, key, "left").dropDuplicates(key)
    last = F.element_at(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when((F.trim(x) != "") & ~F.array_contains(F.coalesce("skip", F.array().cast("array<long>")), (i + 1).cast("long")), i + 1)), lambda x: x.isNotNull()), -1)
    ends = every.select("file_id", "field", (F.col("page_no") + 1).alias("page_no"), F.array_contains(F.coalesce("cut", F.array().cast("array<long>")), last.cast("long")).alias("eat"))
    ends = ends.filter("eat").dropDuplicates(["file_id", "field", "page_no"])
    every = every.join(ends, ["file_id", "field", "page_no"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                repair(t, s, c, [(x["word"], x["fix"]) for x in f or ()], tail, bool(eat))
                for t, s, c, f, tail, eat in zip(*(b.column(i).to_pylist() for i in range(2, 8)))
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "field", "text"])

    return every.select("page_id", "field", "text", "skip", "cut", "fixes", "tail", "eat").mapInArrow(run, "page_id long, field string, text string")


def p1_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked correction of each misread word of the corpus."""
    pages = _pages(spark, sf_dir)
    return corrections(word_counts(scan_words(body_of(pages, furniture(pages))))).select("word", "fix")


QUERIES = {"p1_found": p1_found, "p1_pages": p1_pages, "p1_corrections": p1_corrections}
