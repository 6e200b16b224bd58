"""Problem 2: splitting oversized items at natural boundaries.

An item is read as byte ranges with halos and never decoded as a whole: ``text_ranges``
takes the bytes of a column's values as they lie in the Arrow buffer, ``file_ranges`` lets
workers seek in files; both read ranges by the same rule. Neighbouring ranges see the
same text around their common edge and so agree on the boundary there (the anchor) without
talking to each other; between two anchors a worker cuts pieces greedily, each of which
begins ``overlap`` characters before the end of the one before. Lengths and piece
numbers come from two-level prefix sums over the small table of ranges.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.session import table

#: Bytes of a range, in pieces' limits; an item of fewer than twice as many bytes is one range.
RANGE_LIMITS = 64
#: Characters of ranges that are passed on together.
HELD = 4_000_000
#: Ranges in a block of the two-level prefix sums.
BLOCK = 1024

#: Characters at which a text can be broken.
BREAKS = " \t\n\r\f 　.!?。！？"
_BREAK = re.compile("[" + re.escape(BREAKS) + "]")
#: Natural boundaries, best first: after a blank line, a line, a sentence, a clause, a blank.
_LEVELS = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"""(?:[.!?…]["'”’»)\]]*(?=\s)\s*|[。！？]["'”’»」』)\]]*\s*)"""),
    re.compile(r"""(?:[,;:](?=\s)\s*|[、，；：])"""),
    re.compile(r"[\s 　]+"),
)


def best_cut(text: str, low: int, high: int) -> int:
    """The best boundary of ``text`` in (low, high]: the last of the best level there; else a cut at ``high`` that parts no character from its marks."""
    window = text[low:high]
    for level in _LEVELS:
        last = 0
        for m in level.finditer(window):
            if m.end() > 0:
                last = m.end()
        if last:
            return low + last
    cut = high
    while cut > low + 1 and cut < len(text) and (unicodedata.combining(text[cut]) or text[cut] in "‍️" or text[cut - 1] == "‍"):
        cut -= 1
    return cut


def cut_between(text: str, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of ``text[begin:end]`` as offsets; ``begin`` is the first piece's start, overlap included.

    Every piece but the last ends at the best boundary in the last half of its room; a
    piece that follows begins ``overlap`` characters before the end of the one before.
    """
    out, start = [], begin
    while end - start > limit:
        low = start + overlap + (limit - overlap) // 2
        cut = best_cut(text, max(low, start + overlap), start + limit)
        out.append((start, cut))
        start = cut - overlap
    out.append((start, end))
    return out


def halo_of(limit: int, overlap: int) -> int:
    """Characters a range must see beyond its edges: an anchor's reach, the overlap, and one more to tell whether a cut parts a character from its marks."""
    return max(1, (limit - overlap) // 4) + overlap + 1


def read_range(fetch: Callable[[int, int], bytes], n: int, lo: int, hi: int, halo: int) -> tuple[str, str, str]:
    """Left halo, core and right halo of the bytes lo..hi of n, each halo of up to ``halo`` characters. A character belongs to the range that holds its first byte."""
    a = max(0, lo - 4 * halo - 3)
    raw = fetch(a, min(n, hi + 4 * halo + 3))
    begin = lambda i: next((j for j in range(i, min(i + 4, len(raw))) if raw[j] & 0xC0 != 0x80), min(i, len(raw)))
    l, c, r, e = begin(max(0, lo - 4 * halo - a)), begin(lo - a), begin(min(hi, n) - a), begin(min(n, hi + 4 * halo) - a)
    left, core, right = (str(raw[i:j], "utf-8", "replace") for i, j in ((l, c), (c, r), (r, e)))
    return left[-halo:], core, right[:halo]


def text_ranges(items: DataFrame) -> DataFrame:
    """Ranges of ``items`` (item_kind, item_id, text, max_chars, overlap_chars), in one narrow pass over the values' bytes.

    A row a range: its number, the count of ranges, the offset of its first character and
    ``chunk`` with a halo at either side where there is text. Only a range is decoded and
    copied at a time, and rows are passed on by ``HELD`` characters. Null and empty texts
    have no range. The limit is at least 1 and the overlap at most half of it.
    """
    limit = F.greatest(F.lit(1), F.coalesce("max_chars", F.lit(2**31 - 1)).cast("long"))
    overlap = F.least(F.greatest(F.lit(0), F.coalesce("overlap_chars", F.lit(0)).cast("long")), F.floor(limit / 2)).cast("long")
    df = items.select("item_kind", F.col("item_id").cast("long").alias("item_id"), "text", limit.alias("max_chars"), overlap.alias("overlap_chars")).filter("text <> ''")

    def ranges(b: pa.RecordBatch) -> Iterator[dict]:
        kinds, ids, limits, overlaps = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
        for kind, item, value, limit, overlap in zip(kinds, ids, b.column(2), limits, overlaps):
            view = memoryview(value.as_buffer())
            n, span, at = len(view), limit * RANGE_LIMITS, 0
            count = max(1, n // span)  # the last range takes the rest, so that none is shorter than an anchor's reach
            for k in range(count):
                stop = n if k + 1 == count else (k + 1) * span
                left, core, right = read_range(lambda x, y: view[x:y], n, k * span, stop, halo_of(limit, overlap))
                yield {"item_kind": kind, "item_id": item, "range_no": k, "n_ranges": count, "max_chars": limit, "overlap_chars": overlap, "span": len(core), "at": at, "chunk_at": at - len(left), "chunk": left + core + right}
                at += len(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batched(ranges(b))

    return df.mapInArrow(run, _RANGE_SCHEMA)


def _batched(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """Range rows as batches of about ``HELD`` characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["chunk"])
        if size >= HELD:
            yield pa.RecordBatch.from_pylist(held, schema=_RANGE_ARROW)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=_RANGE_ARROW)


def file_ranges(spark: SparkSession, files: list[tuple[str, int, int]], limit: int, overlap: int, kind: str = "file") -> DataFrame:
    """The same ranges of UTF-8 files too large to load: ``files`` has (path, item_id, bytes).

    Ranges are cut in bytes; a worker opens the file, seeks to its range and reads the halo
    with it. A first pass counts the characters of each range, prefix sums give each range
    its character offset, and the second pass reads the chunks. Characters belong to the
    range that holds their first byte. The paths must be readable by every worker.
    """
    span, halo = limit * RANGE_LIMITS, halo_of(limit, overlap)
    plan = spark.createDataFrame(files, "path string, item_id long, n_bytes long").filter("n_bytes > 0")
    plan = plan.withColumn("n_ranges", F.greatest(F.lit(1), F.floor(F.col("n_bytes") / span)).cast("long"))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ranges") - 1)).alias("range_no"))
    plan = plan.repartition(F.xxhash64("item_id", "range_no"))

    def read(x: dict, reach: int) -> tuple[str, str, str]:
        def fetch(a: int, b: int) -> bytes:
            with open(x["path"], "rb") as f:
                f.seek(a)
                return f.read(b - a)

        stop = x["n_bytes"] if x["range_no"] + 1 == x["n_ranges"] else (x["range_no"] + 1) * span
        return read_range(fetch, x["n_bytes"], x["range_no"] * span, stop, reach)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(read(x, 1)[1]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "core"])

    counted = plan.mapInArrow(count, "path string, item_id long, n_bytes long, n_ranges long, range_no long, core long")
    counted = prefix_sum(counted, ["item_id"], "range_no", "core", "at")

    def ranges(b: pa.RecordBatch) -> Iterator[dict]:
        for x in b.to_pylist():
            left, core, right = read(x, halo)
            yield {"item_kind": kind, "item_id": x["item_id"], "range_no": x["range_no"], "n_ranges": x["n_ranges"], "max_chars": limit, "overlap_chars": overlap, "span": len(core), "at": x["at"], "chunk_at": x["at"] - len(left), "chunk": left + core + right}

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batched(ranges(b))

    return counted.mapInArrow(load, _RANGE_SCHEMA)


_RANGE_SCHEMA = "item_kind string, item_id long, range_no long, n_ranges long, max_chars long, overlap_chars long, span long, at long, chunk_at long, chunk string"
_RANGE_ARROW = pa.schema([("item_kind", pa.string()), *((c, pa.int64()) for c in ("item_id", "range_no", "n_ranges", "max_chars", "overlap_chars", "span", "at", "chunk_at")), ("chunk", pa.string())])


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before, by ``keys``: within blocks of ``BLOCK``, then over blocks, so no task holds a whole group."""
    df = df.withColumn("__block", F.floor(F.col(order) / BLOCK))
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*keys, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(blocks, [*keys, "__block"]).withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__block", "__in", "__before")


def range_pieces(ranges: DataFrame) -> DataFrame:
    """Pieces of each range: number within the range, offsets in the item, and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("item_kind", "item_id", "range_no", "n_ranges", "k", "start", "end", "text")}
            for x in b.to_pylist():
                chunk, base, limit, overlap = x["chunk"], x["chunk_at"], x["max_chars"], x["overlap_chars"]
                reach = max(1, (limit - overlap) // 4)
                edge = lambda pos: best_cut(chunk, pos - reach, min(len(chunk), pos + reach))
                first, last = x["at"] - base, x["at"] - base + x["span"]
                begin = max(0, edge(first) - overlap) if x["range_no"] else 0
                end = edge(last) if x["range_no"] + 1 < x["n_ranges"] else len(chunk)
                for k, (s, e) in enumerate(cut_between(chunk, begin, end, limit, overlap)):
                    for c, v in zip(out, (x["item_kind"], x["item_id"], x["range_no"], x["n_ranges"], k, base + s, base + e, chunk[s:e])):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_PIECE_ARROW)

    return ranges.select(*[f.name for f in _RANGE_ARROW]).mapInArrow(run, "item_kind string, item_id long, range_no long, n_ranges long, k long, start long, end long, text string")


_PIECE_ARROW = pa.schema([("item_kind", pa.string()), *((c, pa.int64()) for c in ("item_id", "range_no", "n_ranges", "k", "start", "end")), ("text", pa.string())])


def split_items(ranges: DataFrame) -> DataFrame:
    """Pieces (item_kind, item_id, piece_no from 0, start, end, text) of the items behind ``ranges``.

    Items of one range, nearly all, are numbered in place; only the others join the prefix
    sums of their piece counts.
    """
    pieces = range_pieces(ranges)
    keys = ["item_kind", "item_id"]
    plain = pieces.filter("n_ranges = 1").withColumn("piece_no", F.col("k"))
    many = pieces.filter("n_ranges > 1")
    counts = many.groupBy(*keys, "range_no").agg(F.countDistinct("k").alias("n"))
    numbered = many.join(prefix_sum(counts, keys, "range_no", "n", "before").drop("n"), [*keys, "range_no"]).withColumn("piece_no", F.col("before") + F.col("k"))
    cols = [*keys, "piece_no", "start", "end", "text"]
    return plain.select(*cols).unionByName(numbered.select(*cols))


def range_table(ranges: DataFrame) -> DataFrame:
    """Of each range, without its halo: characters, whether it has a break, the unbroken runs at its begin and end, the longest inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, has, pre, post, best = [], [], [], [], []
            for x in b.to_pylist():
                at = x["at"] - x["chunk_at"]
                core = x["chunk"][at : at + x["span"]]
                runs = [len(r) for r in _BREAK.split(core)]
                n.append(len(core)), has.append(len(runs) > 1), pre.append(runs[0]), post.append(runs[-1]), best.append(max(runs))
            cols = [b.column(b.schema.names.index(c)) for c in ("item_kind", "item_id", "range_no", "max_chars")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, pa.int64()) for v in (n,)), pa.array(has, pa.bool_()), *(pa.array(v, pa.int64()) for v in (pre, post, best))], names=["item_kind", "item_id", "range_no", "max_chars", "n", "has", "pre", "post", "best"])

    return ranges.select(*[f.name for f in _RANGE_ARROW]).mapInArrow(run, "item_kind string, item_id long, range_no long, max_chars long, n long, has boolean, pre long, post long, best long")


def stitch(ranges: DataFrame) -> DataFrame:
    """Length and longest unbroken run of each item, from its ranges' tables: folded in blocks, then over the blocks."""
    parts = range_table(ranges).dropDuplicates(["item_kind", "item_id", "range_no"])
    keys = ["item_kind", "item_id", "max_chars"]
    level = parts.withColumn("block", F.floor(F.col("range_no") / BLOCK))
    level = level.groupBy(*keys, "block").agg(_fold("range_no").alias("m")).select(*keys, "block", "m.*")
    return level.groupBy(*keys).agg(_fold("block").alias("m")).select(*keys, F.col("m.n").alias("n_chars"), F.col("m.best").alias("longest_run"))


def _fold(order: str) -> Column:
    """Join neighbouring tables in order: a run may go on over an edge."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), "n", "has", "pre", "post", "best")))
    zero = F.struct(*[F.lit(0).cast("long").alias("n"), F.lit(False).alias("has"), *[F.lit(0).cast("long").alias(c) for c in ("pre", "post", "best")]])

    def join(a: Column, b: Column) -> Column:
        return F.struct(
            (a["n"] + b["n"]).alias("n"),
            (a["has"] | b["has"]).alias("has"),
            F.when(a["has"], a["pre"]).otherwise(a["n"] + b["pre"]).alias("pre"),
            F.when(b["has"], b["post"]).otherwise(a["post"] + b["n"]).alias("post"),
            F.greatest(a["best"], b["best"], a["post"] + b["pre"]).alias("best"),
        )

    return F.aggregate(rows, zero, join)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of both kinds with the limits of their kind (two fixed rows, so a broadcast)."""
    txt = table(spark, sf_dir, "txt_files").select(F.lit("txt").alias("item_kind"), F.col("file_id").alias("item_id"), F.col("txt").alias("text"))
    chapter = table(spark, sf_dir, "chapters").select(F.lit("chapter").alias("item_kind"), F.col("chapter_id").alias("item_id"), F.col("body").alias("text"))
    limits = table(spark, sf_dir, "split_limits").select("item_kind", "max_chars", "overlap_chars")
    return txt.unionByName(chapter).join(F.broadcast(limits), "item_kind")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized items, and those of them with an unbroken run beyond the limit."""
    big = stitch(text_ranges(_items(spark, sf_dir))).filter(F.col("n_chars") > F.col("max_chars"))
    reasons = F.array_compact(F.array(F.lit("oversized"), F.when(F.col("longest_run") > F.col("max_chars"), F.lit("unbroken"))))
    return big.select("item_kind", "item_id", F.explode(reasons).alias("reason"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every item, items within the limit as one piece (exact copies of a row once)."""
    return split_items(text_ranges(_items(spark, sf_dir))).dropDuplicates(["item_kind", "item_id", "piece_no"])


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and longest unbroken run of every item that isn't null or empty."""
    return stitch(text_ranges(_items(spark, sf_dir))).drop("max_chars")


def p2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item put together from its pieces without what they share, and whether every piece keeps the limit."""
    limits = table(spark, sf_dir, "split_limits").select("item_kind", "max_chars", "overlap_chars")
    pieces = p2_pieces(spark, sf_dir).join(F.broadcast(limits), "item_kind")  # two fixed rows
    own = F.when(F.col("piece_no") == 0, F.col("text")).otherwise(F.substring("text", F.col("overlap_chars") + 1, F.length("text")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda x: x["own"])
    return pieces.groupBy("item_kind", "item_id").agg(F.md5(F.array_join(rows, "")).alias("text"), F.min(F.length("text") <= F.col("max_chars")).alias("within"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_sizes": p2_sizes, "p2_roundtrip": p2_roundtrip}

_SIZES = """
    WITH items AS (
        SELECT DISTINCT 'txt' AS item_kind, file_id AS item_id, txt AS body FROM txt_files WHERE txt <> ''
        UNION ALL SELECT DISTINCT 'chapter', chapter_id, body FROM chapters WHERE body <> ''),
    sizes AS (
        SELECT item_kind, item_id, CAST(length(body) AS BIGINT) AS n_chars,
            list_max(list_transform(regexp_split_to_array(body, '[ \\t\\n\\r\\f 　.!?。！？]'), lambda x: CAST(length(x) AS BIGINT))) AS longest_run
        FROM items)
"""
SQL = {
    "p2_roundtrip": """SELECT DISTINCT 'txt' AS item_kind, file_id AS item_id, md5(txt) AS text, true AS within FROM txt_files WHERE txt <> ''
        UNION ALL SELECT DISTINCT 'chapter', chapter_id, md5(body), true FROM chapters WHERE body <> ''""",
    "p2_sizes": _SIZES + "SELECT * FROM sizes",
    "p2_found": _SIZES
    + """
    SELECT item_kind, item_id, 'oversized' AS reason FROM sizes JOIN split_limits USING (item_kind) WHERE n_chars > max_chars
    UNION ALL
    SELECT item_kind, item_id, 'unbroken' FROM sizes JOIN split_limits USING (item_kind) WHERE n_chars > max_chars AND longest_run > max_chars""",
}
