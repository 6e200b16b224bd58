"""Queries of cleanup, segmentation, chapters and layout over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions import text as T
from folioforge.operators import chapters as C
from folioforge.operators import outline as O
from folioforge.operators import cleanup as K
from folioforge.operators import segment as G
from folioforge.operators.layout import read_page_rows, read_pages
from folioforge.plans import sqltext as S
from folioforge.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "txt_pages").select("file_id", "page_no", "txt").distinct().filter("txt is not null")


def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that stay once repeated ones, numbers and rotated text are gone."""
    lines = K.page_lines(_pages(spark, d), "file_id", "page_no", "txt")
    return K.strip_furniture(lines).select(F.col("book").alias("file_id"), F.col("page").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), F.md5("s").alias("line"))


def furniture_frequency(spark: SparkSession, d: str) -> DataFrame:
    lines = K.page_lines(_pages(spark, d), "file_id", "page_no", "txt")
    c = K.furniture_counts(lines).filter("freq >= 2 or edge >= 2")
    return c.select(F.col("book").alias("file_id"), F.md5("s").alias("line"), "freq", F.col("edge").cast("long").alias("edge"), "n_pages")


def reflowed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", "body").distinct().filter("body is not null")
    return c.select("chapter_id", F.md5(K.reflow(F.col("body"))).alias("text"))


def cleaned_books(spark: SparkSession, d: str) -> DataFrame:
    """Each file's pages as one text in paragraphs, without furniture."""
    books = K.clean_pages(_pages(spark, d), "file_id", "page_no", "txt")
    return books.select(F.col("book").alias("file_id"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text"))


def best_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Which of a page's two forms is taken."""
    p = table(spark, d, "txt_pages").select("page_id", "txt", "md").distinct()
    b = K.best_extraction(F.col("txt"), F.col("md"))
    return p.select("page_id", b["note"].alias("note"), F.coalesce(F.length(b["text"]), F.lit(0)).cast("long").alias("n_chars"))


def paragraph_pack(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of every chapter, and whether it is small enough to be translated as a whole."""
    c = table(spark, d, "chapters").select("chapter_id", "body").distinct()
    p = G.paragraphs(c, "chapter_id", "body")
    return p.select("chapter_id", "idx", F.length("src").cast("long").alias("n_chars"), F.md5("src").alias("src"))


def small_documents(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "txt_files").select("file_id", "txt").distinct().filter("txt is not null")
    n = G.paragraphs(f, "file_id", "txt", 1800, 4).groupBy("file_id").agg(F.count("*").alias("n"))
    both = f.join(n, "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("file_id", F.col("n").alias("n_paragraphs"), G.small_document(F.col("txt"), F.col("n")).alias("small"))


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translate_pairs").select("chapter_id", "idx", "src").distinct().filter("src is not null")


def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Chapters' paragraphs in order with those joined that have no end of their own."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct("idx", "src"))), lambda x: x["src"])
    m = _paras(spark, d).groupBy("chapter_id").agg(G.merge_dangling(arr).alias("m"))
    return m.select("chapter_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join("m", "\n\n")).alias("text"))


def footnote_runs(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes found behind each chapter's paragraphs, where every fifth chapter got three and every tenth none cited."""
    p = _paras(spark, d).select("chapter_id", "idx", "src")
    last = p.groupBy("chapter_id").agg(F.max("idx").alias("last")).filter("chapter_id % 5 = 0")
    cite = F.when(F.col("chapter_id") % 10 == 0, ". this is no citation at all").otherwise(". Brown, A. Old Mills, p. 12")
    notes = last.select("chapter_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "last").select("chapter_id", (F.col("last") + F.col("k")).cast("int").alias("idx"), F.concat(F.col("k").cast("string"), cite).alias("src"))
    return G.sequential_footnotes(p.unionByName(notes), "chapter_id", "idx", "src").select("chapter_id", F.col("idx").cast("long").alias("idx"))


def skip_sections(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs behind a header of references put before every chapter's last two."""
    p = _paras(spark, d)
    w = W.partitionBy("chapter_id")
    p = p.withColumn("rn", F.row_number().over(w.orderBy("idx"))).withColumn("n", F.count("*").over(w))
    head = p.filter("rn = n - 2").select("chapter_id", (F.col("idx") * 10 + 5).alias("idx"), F.lit("## References").alias("src"))
    return G.skipped_sections(p.select("chapter_id", (F.col("idx") * 10).alias("idx"), "src").unionByName(head), "chapter_id", "idx", "src").select("chapter_id", F.col("idx").cast("long").alias("idx"))


def file_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of every converted file, by whichever tier finds them."""
    files = table(spark, d, "txt_files").select("file_id", "txt").distinct()
    return _chapters(C.split_books(files, "file_id", "txt"))


def page_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of every file's joined pages, with their Markdown; a page that lacks one form gives the other."""
    p = table(spark, d, "txt_pages").select("file_id", "page_no", "txt", "md").distinct()
    page = F.struct("page_no", F.coalesce("txt", "md", F.lit("")).alias("txt"), F.coalesce("md", "txt", F.lit("")).alias("md"))
    books = p.groupBy("file_id").agg(F.array_sort(F.collect_list(page)).alias("p"), F.count("md").alias("n_md"))
    books = books.select("file_id", F.array_join("p.txt", "\f").alias("txt"), F.when(F.col("n_md") > 0, F.array_join("p.md", "\n\n")).alias("md"))
    return _chapters(C.split_books(books, "file_id", "txt", "md"))


def _chapters(got: DataFrame) -> DataFrame:
    return got.select("file_id", "mode", "chapter_no", "title", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body"))


def chapter_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each file's text that its stored chapters hold."""
    f = table(spark, d, "txt_files").select("file_id", F.coalesce("txt", F.lit("")).alias("txt")).distinct()
    c = table(spark, d, "chapters").select("file_id", "chapter_id", F.coalesce("body", F.lit("")).alias("body")).distinct()
    return C.coverage(f, c, "file_id", "txt").withColumn("coverage", F.round("coverage", 6))


def page_layout(spark: SparkSession, d: str) -> DataFrame:
    """Where pages begin in their file's joined text, and the pages to look at for a contents list."""
    p = _pages(spark, d).select("file_id", (F.col("page_no") - 1).alias("page_no"), "txt")
    at = C.page_offsets(p, "file_id", "page_no", "txt")
    scan = C.scan_pages(at, "file_id", "page_no", "n_chars").withColumn("scanned", F.lit(True))
    return at.join(scan, ["file_id", "page_no"], "left").select("file_id", "page_no", F.col("at").cast("long").alias("at_pos"), F.col("n_chars").cast("long").alias("n_chars"), F.coalesce("scanned", F.lit(False)).alias("scanned"))


def chapter_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Chapters kept with a gap of 1500 characters, and where each ends."""
    c = table(spark, d, "chapters").select("file_id", F.col("start_pos").alias("pos")).distinct().filter("pos is not null")
    kept = c.groupBy("file_id").agg(G.min_gap(F.array_sort(F.collect_list(F.struct("pos"))), O.GAP).alias("m")).select("file_id", F.explode("m").alias("m")).select("file_id", "m.pos")
    return C.chapter_bounds(kept, "file_id", "pos", F.lit(1_000_000)).select("file_id", F.col("pos").cast("long").alias("pos"), F.col("end_pos").cast("long").alias("end_pos"))


def pick_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each file's pages among which a model may choose chapter starts, at most PICK_MOST a file."""
    lines = K.page_lines(_pages(spark, d), "file_id", "page_no", "txt").select("book", (F.col("page") * 1000 + F.col("line_no")).alias("pos"), "line")
    got = C.pick_candidates(lines, "book", "pos", "line")
    return got.select(F.col("book").alias("file_id"), F.col("pos").cast("long").alias("pos"), "strong")


def _set_in_glyphs(pages: DataFrame, left: float = 0.0) -> DataFrame:
    """Pages (file_id, page_no, txt) as rows of glyphs on a grid. A raw line ends with a line feed glyph, as a text layer has it."""
    lines = F.split(F.regexp_replace("txt", " +", " "), "\n")

    def glyph(idx: Column, ch: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(idx.alias("idx"), ch.alias("ch"), x0.alias("left"), y0.alias("bottom"), x1.alias("right"), y1.alias("top"))

    def line(text: Column, y: Column) -> Column:
        top, zero = F.lit(1000.0) - y * 14.0, F.lit(0.0)
        chars = F.filter(F.transform(F.split(F.rtrim(text), ""), lambda ch, x: glyph(y * 2000 + x, ch, F.lit(left) + x * 10.0, top - 10, F.lit(left) + x * 10.0 + 9, top)), lambda g: ~g["ch"].isin("", " "))
        return F.concat(F.filter(F.array(glyph(y * 2000 - 1, F.lit("\n"), zero, zero, zero, zero)), lambda g: g["idx"] >= 0), chars)

    glyphs = F.flatten(F.transform(lines, line))
    return pages.select(F.col("file_id").alias("doc_id"), "page_no", F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"), glyphs.alias("glyphs")).filter("exists(glyphs, g -> g.ch <> '\\n')")


def glyph_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages set as glyphs on a grid and read back in order, a row a page."""
    # A page is much work for few bytes: pages are spread over all cores, not packed by size.
    pages = _pages(spark, d).repartition(spark.sparkContext.defaultParallelism, "file_id", "page_no")
    got = read_page_rows(_set_in_glyphs(pages))
    return got.select(F.col("doc_id").alias("file_id"), "page_no", "ok", F.md5(F.regexp_replace("text", r"\s+", "")).alias("text"))


def glyph_damaged(spark: SparkSession, d: str) -> DataFrame:
    """The same where the first glyph of every longer line has lost its box: it is put back beside its neighbour."""
    pages = _set_in_glyphs(_pages(spark, d))
    first = F.transform(F.filter(F.col("glyphs"), lambda g: g["ch"] != "\n"), lambda g: F.struct(F.floor(g["idx"] / 2000).alias("y"), g["idx"].alias("idx")))
    # The smallest index of each line with three glyphs or more.
    rows = pages.select("doc_id", "page_no", F.inline(first)).groupBy("doc_id", "page_no", "y").agg(F.min("idx").alias("idx"), F.count("*").alias("n")).filter("n >= 3")
    lost = rows.groupBy("doc_id", "page_no").agg(F.collect_list("idx").alias("lost"))
    flat = lambda g: F.struct(g["idx"], g["ch"], F.lit(80.0).alias("left"), F.lit(10.0).alias("bottom"), F.lit(80.0).alias("right"), F.lit(10.0).alias("top"))
    damaged = F.transform("glyphs", lambda g: F.when(F.array_contains(F.coalesce("lost", F.array().cast("array<bigint>")), g["idx"].cast("bigint")), flat(g)).otherwise(g))
    got = read_page_rows(pages.join(lost, ["doc_id", "page_no"], "left").withColumn("glyphs", damaged))
    return got.select(F.col("doc_id").alias("file_id"), "page_no", "ok", F.md5(F.regexp_replace("text", r"\s+", "")).alias("text"))


def glyph_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same from a row a glyph, in no order."""
    rows = _set_in_glyphs(_pages(spark, d)).select("doc_id", "page_no", "width", "height", F.inline("glyphs"))
    return read_pages(rows).select(F.col("doc_id").alias("file_id"), "page_no", "ok", F.md5(F.regexp_replace("text", r"\s+", "")).alias("text"))


def glyph_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every page's hash set in two columns of eight rows, each read to its end before the next; file and page stand in the text."""
    p = _pages(spark, d).select("file_id", "page_no", F.md5("txt").alias("h")).distinct()
    words = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.concat(F.substring(F.col("h"), i * 2 + 1, F.lit(2)), F.col("h")))
    chars = lambda w, i: F.transform(
        F.split(w, ""), lambda ch, x: F.struct((i * 100 + x).alias("idx"), ch.alias("ch"), (F.floor(i / 8) * 520 + x * 10.0).alias("left"), (F.lit(900.0) - F.pmod(i, F.lit(8)) * 14).alias("bottom"), (F.floor(i / 8) * 520 + x * 10.0 + 9).alias("right"), (F.lit(910.0) - F.pmod(i, F.lit(8)) * 14).alias("top"))
    )
    pages = p.select(F.col("file_id").alias("doc_id"), "page_no", F.lit(900.0).alias("width"), F.lit(1000.0).alias("height"), F.filter(F.flatten(F.transform(words, chars)), lambda g: g["ch"] != "").alias("glyphs"))
    return read_page_rows(pages).select(F.col("doc_id").alias("file_id"), "page_no", "ok", F.md5(F.regexp_replace("text", r"\s+", "")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (furniture_lines, furniture_frequency, reflowed, cleaned_books, best_extraction, paragraph_pack, small_documents, merged_paragraphs, footnote_runs, skip_sections, file_chapters, page_chapters, chapter_coverage, page_layout, chapter_bounds, pick_lines, glyph_pages, glyph_damaged, glyph_rows, glyph_columns)
}

_P = "(SELECT DISTINCT file_id, page_no, txt FROM txt_pages WHERE txt IS NOT NULL)"
_LINES = f"""lines AS (SELECT file_id, page_no, i AS line_no, l[i] AS line, {S.strip('l[i]')} AS s FROM (SELECT file_id, page_no, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT file_id, page_no, string_split(txt, chr(10)) AS l FROM {_P}))),
    ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY file_id, page_no) AS n FROM lines WHERE s <> '' WINDOW w AS (PARTITION BY file_id, page_no ORDER BY line_no)),
    counts AS (SELECT file_id, s, count(*) AS freq, CAST(sum(CAST(rn <= 2 AS INTEGER) + CAST(rn > n - 2 AS INTEGER)) AS BIGINT) AS edge, min((page_no, line_no)) AS f FROM ranked GROUP BY file_id, s),
    pages AS (SELECT file_id, count(DISTINCT page_no) AS n_pages FROM lines GROUP BY file_id)"""
_TOK = S.tokens("s")
_KEPT = f"""kept AS (SELECT lines.* FROM lines LEFT JOIN counts USING (file_id, s) JOIN pages USING (file_id)
    WHERE NOT regexp_matches(s, '^[0-9]{{1,4}}$') AND NOT (len({_TOK}) >= 6 AND list_sum(list_transform({_TOK}, lambda x: length(x)))::DOUBLE / len({_TOK}) <= 1.3)
    AND (freq IS NULL OR NOT (length(s) < 90 AND (edge >= greatest(3, n_pages // 2) OR freq >= 3)) OR (page_no, line_no) = f))"""
_REFLOW = f"""array_to_string(list_filter(list_transform(regexp_split_to_array(body, '\\n[ \\t]*\\n'), lambda p: list_reduce(list_filter(list_transform(string_split(p, chr(10)), lambda r: {S.strip('r')}), lambda r: r <> ''),
    lambda a, r: CASE WHEN a = '' THEN r WHEN a[-1] = '-' AND regexp_matches(r, '^\\p{{Ll}}') THEN a[:-2] || r WHEN a[-1] = '-' THEN a || r ELSE a || ' ' || r END, '')), lambda p: p <> ''), chr(10) || chr(10))"""
_H = lambda x: f"(CASE WHEN len({S.tokens(x)}) = 0 THEN 1.0 ELSE len(list_filter({S.tokens(x)}, lambda y: length(y) >= 26))::DOUBLE / len({S.tokens(x)}) END)"

def _packed(parts: str, target: int) -> str:
    """Parts filled up to ``target``, those of no more than 50 characters left out."""
    return f"""(CASE WHEN len({parts}) = 0 THEN [] ELSE list_filter(list_reduce(list_transform({parts}, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) + length(b[1]) + 1 <= {target} THEN list_concat(a[:-2], [a[-1] || ' ' || b[1]]) ELSE list_concat(a, b) END), lambda x: length(x) > {G.PIECE}) END)"""


def _paragraphs(source: str, key: str, text: str, target: int, least: int) -> str:
    """Paragraphs of each text as a list: by blank lines, else packed lines, else packed sentences."""
    joins = f"NOT starts_with(a[-1], '#') AND length(a[-1]) + length(b[1]) + 1 <= {G.MERGED} AND (NOT regexp_matches(a[-1], '[.!?:;\"”’)\\]]$') OR regexp_matches(b[1], '^[a-z]'))"
    merged = f"list_reduce(list_transform(blank, lambda x: [x]), lambda a, b: CASE WHEN {joins} THEN list_concat(a[:-2], [a[-1] || ' ' || b[1]]) ELSE list_concat(a, b) END)"
    return f"""t AS (SELECT {key}, {text} AS t FROM {source}),
        b AS (SELECT {key}, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {S.strip('x')}), lambda x: length(x) > {G.PIECE}) AS blank, list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS line,
            list_filter(list_transform(string_split(regexp_replace(replace(t, chr(10), ' '), {S.q(f'([.!?]){T.WS}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda x: {S.strip('x')}), lambda x: length(x) > {G.SENTENCE}) AS sentence FROM t),
        c AS (SELECT *, {_packed('line', target)} AS by_line, {_packed('sentence', target)} AS by_sentence FROM b),
        p AS (SELECT {key}, CASE WHEN len(blank) >= {least} AND list_sum(list_transform(blank, lambda x: length(x))) <= {2 * target} * len(blank) THEN {merged} WHEN len(by_line) >= {least} THEN by_line WHEN len(by_sentence) > 0 THEN by_sentence ELSE blank END AS l FROM c)"""


_APART, _PLAIN = r"^([0-9]\s[0-9])[\s.,):]\s*\S", r"^\[?([0-9]{1,3})\]?[\s.,):]."
_REST = f"CASE WHEN apart <> '' THEN {S.sub('p', '^[0-9]' + chr(92) + 's[0-9][' + chr(92) + 's.,):]' + chr(92) + 's*')} ELSE {S.sub('p', '^' + chr(92) + '[?[0-9]{1,3}' + chr(92) + ']?[' + chr(92) + 's.,):]')} END"

SQL = {
    "paragraph_pack": f"WITH {_paragraphs('(SELECT DISTINCT chapter_id, body FROM chapters WHERE body IS NOT NULL)', 'chapter_id', 'body', G.TARGET, G.LEAST)} SELECT chapter_id, CAST(i AS BIGINT) AS idx, CAST(length(l[i]) AS BIGINT) AS n_chars, md5(l[i]) AS src FROM (SELECT chapter_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)",
    "small_documents": f"WITH {_paragraphs('(SELECT DISTINCT file_id, txt FROM txt_files WHERE txt IS NOT NULL)', 'file_id', 'txt', 1800, 4)} SELECT file_id, CAST(len(l) AS BIGINT) AS n_paragraphs, length(t) <= 120000 AND len(l) <= 14 AND {S.strip('t')} <> '' AS small FROM p JOIN t USING (file_id)",
    "footnote_runs": f"""WITH a AS (SELECT DISTINCT chapter_id, idx, src FROM translate_pairs WHERE src IS NOT NULL), m AS (SELECT chapter_id, max(idx) AS last FROM a WHERE chapter_id % 5 = 0 GROUP BY chapter_id),
        e AS (SELECT chapter_id, idx, src FROM a UNION ALL SELECT chapter_id, CAST(last + k AS INTEGER), k || CASE WHEN chapter_id % 10 = 0 THEN '. this is no citation at all' ELSE '. Brown, A. Old Mills, p. 12' END FROM m, range(1, 4) AS r(k)),
        o AS (SELECT *, {S.strip('src')} AS p, row_number() OVER (PARTITION BY chapter_id ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY chapter_id) AS total FROM e),
        f AS (SELECT *, regexp_extract(p, {S.q(_APART)}, 1) AS apart, regexp_extract(p, {S.q(_PLAIN)}, 1) AS plain FROM o), g AS (SELECT *, {S.strip(_REST)} AS rest FROM f),
        n AS (SELECT *, CASE WHEN contains(p, chr(10)) OR regexp_matches(rest, '^판\\s*[0-9]') OR (length(rest) <= 20 AND NOT regexp_matches(rest, {S.q(T.CITE_MARK)})) THEN NULL WHEN apart <> '' THEN CAST(regexp_replace(apart, '\\s', '', 'g') AS INTEGER)
            WHEN plain <> '' AND NOT regexp_matches(p, '^\\[?[0-9]{{1,3}}\\]?\\.[0-9]') THEN CAST(plain AS INTEGER) END AS num FROM g),
        c AS (SELECT *, coalesce(num <> lag(num) OVER w + 1, true) AS fresh FROM n WHERE length(p) <= {G.FOOTNOTE_CHARS} AND num BETWEEN 1 AND 999 WINDOW w AS (PARTITION BY chapter_id ORDER BY idx)),
        r AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY chapter_id ORDER BY idx) AS run FROM c), k AS (SELECT *, count(*) OVER (PARTITION BY chapter_id, run) AS size FROM r),
        s AS (SELECT chapter_id, min(place) AS first, max(total) AS total, count(*) AS found, bool_or(regexp_matches(src, {S.q(T.EXPLICIT_CITE)})) AS cites FROM k WHERE size >= {G.RUN} GROUP BY chapter_id)
        SELECT chapter_id, CAST(idx AS BIGINT) AS idx FROM k SEMI JOIN (SELECT chapter_id FROM s WHERE cites AND NOT (first::DOUBLE / total < {G.EARLY} AND found::DOUBLE / total > {G.DENSE})) USING (chapter_id) WHERE size >= {G.RUN}""",
    "pick_lines": f"""WITH {_LINES}, q AS (SELECT file_id, page_no * 1000 + line_no AS pos, {S.squeeze('line')} AS s FROM lines), c AS (SELECT *, regexp_matches(s, {S.q(O.PICK_STRONG)}) AS strong FROM q WHERE length(s) BETWEEN 2 AND 60 AND NOT regexp_matches(s, '[.?!。…,]$')),
        n AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n, count(*) FILTER (strong) OVER (PARTITION BY file_id) AS m, row_number() OVER (PARTITION BY file_id, strong ORDER BY pos) - 1 AS rank FROM c),
        r AS (SELECT *, {O.PICK_MOST} - least(m, {O.PICK_MOST}) AS room FROM n), t AS (SELECT *, greatest(1, (n - m) // greatest(room, 1)) AS step FROM r)
        SELECT file_id, CAST(pos AS BIGINT) AS pos, strong FROM t WHERE CASE WHEN n <= {O.PICK_MOST} THEN true WHEN strong THEN m <= {O.PICK_MOST} OR ceil(rank * {O.PICK_MOST}::DOUBLE / m) * m < (rank + 1) * {O.PICK_MOST} ELSE rank % step = 0 AND rank // step < room END""",
    "furniture_lines": f"WITH {_LINES}, {_KEPT} SELECT file_id, page_no, CAST(line_no AS BIGINT) AS line_no, md5(s) AS line FROM kept",
    "furniture_frequency": f"WITH {_LINES} SELECT file_id, md5(s) AS line, freq, edge, n_pages FROM counts JOIN pages USING (file_id) WHERE freq >= 2 OR edge >= 2",
    "reflowed": f"SELECT chapter_id, md5({_REFLOW}) AS text FROM (SELECT DISTINCT chapter_id, body FROM chapters WHERE body IS NOT NULL)",
    "cleaned_books": f"""WITH {_LINES}, {_KEPT}, by_page AS (SELECT file_id, page_no, string_agg(line, chr(10) ORDER BY line_no) AS t FROM kept GROUP BY file_id, page_no),
        books AS (SELECT file_id, string_agg(t, chr(10) ORDER BY page_no) AS body FROM by_page GROUP BY file_id), done AS (SELECT file_id, {_REFLOW} AS text FROM books) SELECT file_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text FROM done""",
    "best_extraction": f"""SELECT page_id, CASE WHEN {S.strip('best')} = '' THEN 'needs_ocr' WHEN swap THEN 'fallback' ELSE '' END AS note, CAST(length(best) AS BIGINT) AS n_chars FROM (SELECT page_id, swap, CASE WHEN swap THEN b ELSE a END AS best FROM (
        SELECT page_id, a, b, {S.strip('b')} <> '' AND ({S.strip('a')} = '' OR ({_H('a')} > 0.03 AND {_H('b')} < {_H('a')})) AS swap FROM (SELECT DISTINCT page_id, coalesce(txt, '') AS a, coalesce(md, '') AS b FROM txt_pages)))""",
    "merged_paragraphs": f"""WITH p AS (SELECT chapter_id, list(src ORDER BY idx, src) AS l FROM (SELECT DISTINCT chapter_id, idx, src FROM translate_pairs WHERE src IS NOT NULL) GROUP BY chapter_id),
        m AS (SELECT chapter_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN NOT starts_with(ltrim(a[-1]), '#') AND length(a[-1]) + length(b[1]) + 1 <= 3000 AND (NOT regexp_matches(a[-1], '[.!?:;"”’)\\]]\\s*$') OR regexp_matches(b[1], '^[a-z]'))
            THEN list_concat(a[:-2], [regexp_replace(a[-1], '\\s+$', '') || ' ' || regexp_replace(b[1], '^\\s+', '')]) ELSE list_concat(a, b) END) AS m FROM p)
        SELECT chapter_id, CAST(len(m) AS BIGINT) AS n, md5(array_to_string(m, chr(10) || chr(10))) AS text FROM m""",
    "skip_sections": """WITH p AS (SELECT chapter_id, idx, row_number() OVER (PARTITION BY chapter_id ORDER BY idx) AS rn, count(*) OVER (PARTITION BY chapter_id) AS n FROM (SELECT DISTINCT chapter_id, idx, src FROM translate_pairs WHERE src IS NOT NULL))
        SELECT chapter_id, CAST(idx * 10 AS BIGINT) AS idx FROM p WHERE rn > n - 2 AND n >= 3 UNION ALL SELECT chapter_id, CAST(idx * 10 + 5 AS BIGINT) FROM p WHERE rn = n - 2""",
    "chapter_coverage": """WITH f AS (SELECT DISTINCT file_id, coalesce(txt, '') AS t FROM txt_files), c AS (SELECT file_id, count(*) AS n_chapters, sum(length(b)) AS held FROM (SELECT DISTINCT file_id, chapter_id, coalesce(body, '') AS b FROM chapters) GROUP BY file_id)
        SELECT file_id, n_chapters, round(held::DOUBLE / greatest(length(t), 1), 6) AS coverage, held::DOUBLE / greatest(length(t), 1) < 0.6 AS warning FROM f JOIN c USING (file_id)""",
    "page_layout": f"""WITH p AS (SELECT file_id, page_no - 1 AS page_no, txt, length(regexp_replace(txt, '\\s+', '', 'g')) AS n FROM {_P}),
        a AS (SELECT *, coalesce(sum(length(txt) + 1) OVER (PARTITION BY file_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
        m AS (SELECT file_id, list_sort(list(n) FILTER (n > 0)) AS l, max(page_no) AS last FROM p GROUP BY file_id),
        t AS (SELECT file_id, last, greatest(60, CAST(floor(coalesce(l[len(l) // 2 + 1], 0) * 0.18) AS BIGINT)) AS thr FROM m),
        s AS (SELECT file_id, page_no, last, row_number() OVER (PARTITION BY file_id ORDER BY page_no) AS rn FROM p JOIN t USING (file_id) WHERE page_no >= 2 AND n <= thr),
        u AS (SELECT file_id, page_no FROM p WHERE page_no < 18 UNION SELECT file_id, page_no FROM s WHERE rn <= 30 UNION SELECT file_id, page_no + 1 FROM s WHERE rn <= 30 AND page_no < last),
        v AS (SELECT file_id, page_no FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_no) AS r FROM u) WHERE r <= 55)
        SELECT a.file_id, a.page_no, CAST(pos AS BIGINT) AS at_pos, CAST(n AS BIGINT) AS n_chars, v.page_no IS NOT NULL AS scanned FROM a LEFT JOIN v ON a.file_id = v.file_id AND a.page_no = v.page_no""",
    "chapter_bounds": """WITH RECURSIVE c AS (SELECT DISTINCT file_id, start_pos AS pos FROM chapters WHERE start_pos IS NOT NULL), k AS (SELECT file_id, min(pos) AS pos FROM c GROUP BY file_id UNION ALL
        SELECT k.file_id, (SELECT min(c.pos) FROM c WHERE c.file_id = k.file_id AND c.pos >= k.pos + 1500) FROM k WHERE (SELECT min(c.pos) FROM c WHERE c.file_id = k.file_id AND c.pos >= k.pos + 1500) IS NOT NULL)
        SELECT file_id, CAST(pos AS BIGINT) AS pos, CAST(coalesce(lead(pos) OVER (PARTITION BY file_id ORDER BY pos), 1000000) AS BIGINT) AS end_pos FROM k""",
    "glyph_damaged": f"SELECT file_id, page_no, true AS ok, md5(regexp_replace(txt, '[\\s\\pC]+', '', 'g')) AS text FROM {_P} WHERE regexp_matches(txt, '[^ \\n]')",
    "glyph_rows": f"SELECT file_id, page_no, true AS ok, md5(regexp_replace(txt, '[\\s\\pC]+', '', 'g')) AS text FROM {_P} WHERE regexp_matches(txt, '[^ \\n]')",
    "glyph_columns": f"SELECT file_id, page_no, true AS ok, md5(array_to_string(list_transform(range(0, 16), lambda i: substring(h, i * 2 + 1, 2) || h), '')) AS text FROM (SELECT file_id, page_no, md5(txt) AS h FROM {_P})",
    "glyph_pages": f"SELECT file_id, page_no, true AS ok, md5(regexp_replace(txt, '[\\s\\pC]+', '', 'g')) AS text FROM {_P} WHERE regexp_matches(txt, '[^ \\n]')",
}
