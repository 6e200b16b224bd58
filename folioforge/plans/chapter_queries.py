"""Queries of the chapter cascade, a tier each, over books made of all documents, and of what belongs to it.

A book is set from the documents of a block of ids, six chapters or more: every document
gives a chapter whose body is made of its text's hash, long enough that no tier takes
another's marks. SQL puts the same books together and knows where each chapter begins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions import text as T
from folioforge.operators import chapters as C
from folioforge.plans import sqltext as S
from folioforge.session import table

#: Ids of a block, chapters of a book, and how often a text's hash is repeated in its chapter.
BLOCK, CHAPTERS, REPEATS = 600, 6, 220
_NAMES = ("Alpha", "Bravo", "Charlie", "Delta", "Echoes", "Foxtrot", "Golfing", "Hotels", "Indigo", "Juliet", "Kilogram", "Limerick")
_ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
#: A heading line of each notation and the title it gives; ``#`` stands for the number, ``@`` for two digits.
_NOTED = (("제 # 장 강 이야기", "강 이야기"), ("Chapter #: Old Mills", "Old Mills"), ("# OLD MILLS", "Old Mills"), ("#. 연구 방법", "연구 방법"), ("#) Old Mills", "Old Mills"), ("# Old Mills", "Old Mills"), ("@\nOld Mills", "Old Mills"))


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """``book, k, doc_id, body``: every document as the k-th chapter of a book."""
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / BLOCK).alias("block"), F.md5(F.coalesce("text", F.lit(""))).alias("h")).distinct()
    w = W.partitionBy("block")
    docs = docs.withColumn("i", F.row_number().over(w.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(w))
    no = F.least(F.floor(F.col("i") / CHAPTERS), F.greatest(F.floor(F.col("n") / CHAPTERS) - 1, F.lit(0)))
    docs = docs.withColumn("no", no).filter("n >= 3")
    return docs.select(F.concat_ws("#", F.col("block").cast("string"), F.col("no").cast("string")).alias("book"), (F.col("i") - F.col("no") * CHAPTERS + 1).cast("int").alias("k"), "doc_id", F.rtrim(F.repeat(F.concat("h", F.lit(" ")), REPEATS)).alias("body"))


def _books(parts: DataFrame, chapter: Column, head: Column | None = None, sep: str = "\n") -> DataFrame:
    """``book, text``: the chapters in order behind the lines ``head``."""
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("c")))), lambda x: x["c"]), sep)
    text = lines(chapter) if head is None else F.concat(lines(head), F.lit("\n" + "~" * 80 + "\n"), lines(chapter))
    return parts.groupBy("book").agg(text.alias("text"))


def _shown(got: DataFrame) -> DataFrame:
    return got.select("book", "mode", "chapter_no", "title", F.md5("body").alias("body"))


def chapter_headings(spark: SparkSession, d: str) -> DataFrame:
    """Markdown headings, notes among them."""
    chapter = F.concat(F.lit("## Mill "), F.col("doc_id").cast("string"), F.lit("\n\n"), "body", F.lit("\n\n### 1. a note\n"))
    books = _books(_parts(spark, d), chapter).withColumnRenamed("text", "md").withColumn("text", F.lit(None).cast("string"))
    return _shown(C.split_books(books, "book", "text", "md"))


def _titled(k: Column) -> Column:
    return F.concat(_pick(_NAMES, k), F.lit(" Cathedral Windows"))


def chapter_contents(spark: SparkSession, d: str) -> DataFrame:
    """A printed contents list; titles stand in capitals before the chapters."""
    k = F.col("k")
    books = _books(_parts(spark, d), F.concat(F.upper(_titled(k)), F.lit("\n"), "body"), F.concat(k.cast("string"), F.lit(". "), _titled(k)))
    return _shown(C.split_books(books, "book", "text"))


def chapter_romans(spark: SparkSession, d: str) -> DataFrame:
    """A Roman contents list with leaders."""
    numbered = F.concat(_pick(_ROMANS, F.col("k")), F.lit(". "), _titled(F.col("k")))
    books = _books(_parts(spark, d), F.concat(numbered, F.lit("\n"), "body"), F.concat(numbered, F.lit(" ........ "), (F.col("k") * 9).cast("string")))
    return _shown(C.split_books(books, "book", "text"))


def chapter_notations(spark: SparkSession, d: str) -> DataFrame:
    """Numbered headings in seven notations, one a book."""
    which = F.pmod(F.split("book", "#")[0].cast("int") + F.split("book", "#")[1].cast("int"), F.lit(len(_NOTED))) + 1
    line = F.replace(F.replace(_pick(tuple(x for x, _ in _NOTED), which), F.lit("#"), F.col("k").cast("string")), F.lit("@"), F.lpad(F.col("k").cast("string"), 2, "0"))
    books = _books(_parts(spark, d), F.concat(line, F.lit("\n"), "body"))
    return _shown(C.split_books(books, "book", "text")).join(_parts(spark, d).select("book", which.cast("long").alias("notation")).distinct(), "book")


def chapter_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks of two levels on the pages of a text."""
    p = _parts(spark, d)
    books = _books(p, F.col("body"), sep="\f")
    rows = p.select("book", (F.col("k") - 1).alias("page"), F.explode(F.array(F.struct(F.concat(F.lit("Mill "), F.col("doc_id").cast("string")).alias("title"), F.lit(0).alias("level")), F.struct(F.lit("sub").alias("title"), F.lit(1).alias("level")))).alias("b"))
    marks = C.top_bookmarks(rows.select("book", "page", "b.title", "b.level"), "book")
    marks = marks.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "title", "level"))), lambda x: F.struct(x["title"], x["page"], x["level"])).alias("marks"))
    return _shown(C.split_books(books.join(marks, "book"), "book", "text", bookmarks="marks"))


def chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of a list located in the text, where each is spelled with a slip."""
    p = _parts(spark, d).withColumn("title", F.repeat(F.concat(_pick(_NAMES, F.col("k")), F.lit("-")), 3))
    slip = F.concat(F.left("title", F.lit(4)), F.lit("x"), F.substring(F.col("title"), F.lit(5), F.length("title")))
    books = _books(p, F.concat(slip, F.lit("\n"), "body"))
    return C.title_marks(books, p.select("book", "k", "title"), "book", "text", "k", "title")


class LineModel:
    """A model that picks the lines beginning with a mark, as a stand-in for one that reads."""

    def complete(self, system: str, prompt: str, max_tokens: int) -> str:
        rows = [x.split(" | ", 2) for x in prompt.split("\n") if x.count(" | ") >= 2]
        return json.dumps({"chapters": [{"idx": int(i), "title": s} for i, _, s in rows if s.startswith("On ")]})


def chapter_model(spark: SparkSession, d: str) -> DataFrame:
    """Books without headings, split at the lines that a model picks."""
    books = _books(_parts(spark, d), F.concat(F.lit("On "), _titled(F.col("k")), F.lit("\n"), "body"))
    return _shown(C.split_books(books, "book", "text", model=LineModel()))


def visual_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents lists as a model gives them: the titles of every file's chapters with blanks among them, fenced or with words around."""
    c = table(spark, d, "chapters").select("file_id", "chapter_id", "chapter_no", F.coalesce("title", F.lit("  ")).alias("title")).distinct().filter("file_id is not null")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", "chapter_id", F.concat(F.lit(" "), F.repeat(F.concat("title", F.lit(" ")), 6)).alias("t")))), lambda x: F.struct(x["t"].alias("title"), x["chapter_no"].alias("page")))
    raw = F.to_json(F.struct(rows.alias("chapters")))
    answers = c.groupBy("file_id").agg(raw.alias("raw")).withColumn("raw", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("```json\n"), "raw", F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), F.col("raw"))))
    return C.visual_contents(answers, "file_id", "raw").select("file_id", F.col("no").cast("long").alias("no"), F.md5("title").alias("title"), F.col("page").cast("long").alias("page"))


def merged_books(spark: SparkSession, d: str) -> DataFrame:
    """Each book's chapters as one text, translated ones first."""
    c = table(spark, d, "chapters").select("stem", "chapter_no", "chapter_id", "body").distinct().filter("stem is not null")
    p = table(spark, d, "translate_pairs").select("chapter_id", "idx", "out", "status").distinct().filter("status = 'translated' and out is not null")
    ko = p.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "out"))), lambda x: x["out"]), "\n\n").alias("body"))
    ko = c.select("stem", "chapter_no", "chapter_id").join(ko, "chapter_id").select("stem", "chapter_no", "body")
    return C.merge_chapters(c.select("stem", "chapter_no", "body"), ko, "stem", "chapter_no", "body").select("stem", F.md5("text").alias("text"))


def single_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Files without stored chapters as one chapter each."""
    f = table(spark, d, "txt_files").select("file_id", "txt").distinct()
    return C.single_chapters(f, table(spark, d, "chapters"), "file_id", "txt").select("file_id", "chapter_no", "title", F.md5("body").alias("body"))


QUERIES = {f.__name__: f for f in (chapter_headings, chapter_contents, chapter_romans, chapter_notations, chapter_bookmarks, chapter_titles, chapter_model, visual_contents, merged_books, single_chapters)}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(S.q, values)) + "]"


_PARTS = f"""p AS (SELECT block || '#' || no AS book, CAST(i - no * {CHAPTERS} + 1 AS BIGINT) AS k, doc_id, rtrim(repeat(h || ' ', {REPEATS})) AS body FROM (
    SELECT *, least(i // {CHAPTERS}, greatest(n // {CHAPTERS} - 1, 0)) AS no FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY block) AS n
    FROM (SELECT DISTINCT doc_id, CAST(floor(doc_id / {BLOCK}) AS BIGINT) AS block, md5(coalesce(text, '')) AS h FROM documents)) WHERE n >= 3))"""
_TITLE = f"({_list(_NAMES)}[k] || ' Cathedral Windows')"
_WHICH = f"((CAST(split_part(book, '#', 1) AS BIGINT) + CAST(split_part(book, '#', 2) AS BIGINT)) % {len(_NOTED)} + 1)"
_LINE = f"replace(replace({_list(tuple(x for x, _ in _NOTED))}[{_WHICH}], '#', k::VARCHAR), '@', lpad(k::VARCHAR, 2, '0'))"


def _chapters(mode: str, title: str, body: str) -> str:
    return f"WITH {_PARTS} SELECT book, '{mode}' AS mode, k AS chapter_no, {title} AS title, md5({body}) AS body FROM p"


SQL = {
    "chapter_headings": _chapters("heading", "'Mill ' || doc_id", "'## Mill ' || doc_id || chr(10) || chr(10) || body || chr(10) || chr(10) || '### 1. a note'"),
    "chapter_contents": _chapters("toc", f"k || '. ' || {_TITLE}", f"upper({_TITLE}) || chr(10) || body"),
    "chapter_romans": _chapters("toc", f"{_list(_ROMANS)}[k] || '. ' || {_TITLE}", f"{_list(_ROMANS)}[k] || '. ' || {_TITLE} || chr(10) || body"),
    "chapter_bookmarks": _chapters("bookmark", "k || '. Mill ' || doc_id", "body"),
    "chapter_model": _chapters("llm", f"k || '. On ' || {_TITLE}", f"'On ' || {_TITLE} || chr(10) || body"),
    "chapter_notations": f"WITH {_PARTS} SELECT book, 'numbered' AS mode, k AS chapter_no, k || '. ' || {_list(tuple(t for _, t in _NOTED))}[{_WHICH}] AS title, md5({_LINE} || chr(10) || body) AS body, {_WHICH} AS notation FROM p",
    "chapter_titles": f"""WITH {_PARTS}, t AS (SELECT *, repeat({_list(_NAMES)}[k] || '-', 3) AS title FROM p)
        SELECT book, CAST(coalesce(sum(length(title) + length(body) + 3) OVER (PARTITION BY book ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, title FROM t""",
    "visual_contents": f"""WITH c AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY chapter_no, chapter_id, t) AS no, t, chapter_no AS page FROM (SELECT DISTINCT file_id, chapter_id, chapter_no, {S.squeeze("repeat(title || ' ', 6)")} AS t FROM chapters WHERE file_id IS NOT NULL) WHERE t <> ''),
        n AS (SELECT file_id FROM c GROUP BY file_id HAVING count(*) BETWEEN 3 AND 40) SELECT file_id, no, md5(substring(t, 1, 90)) AS title, CAST(page AS BIGINT) AS page FROM c SEMI JOIN n USING (file_id)""",
    "merged_books": f"""WITH k AS (SELECT chapter_id, string_agg(out, chr(10) || chr(10) ORDER BY idx, out) AS ko FROM (SELECT DISTINCT chapter_id, idx, out FROM translate_pairs WHERE status = 'translated' AND out IS NOT NULL) GROUP BY chapter_id),
        c AS (SELECT stem, chapter_no, CASE WHEN {S.strip("coalesce(ko, '')")} <> '' THEN {S.strip('ko')} ELSE {S.strip("coalesce(body, '')")} END AS t FROM (SELECT DISTINCT stem, chapter_no, chapter_id, body FROM chapters WHERE stem IS NOT NULL) LEFT JOIN k USING (chapter_id))
        SELECT stem, md5(string_agg(t, chr(10) || chr(10) ORDER BY chapter_no, t)) AS text FROM c WHERE t <> '' GROUP BY stem""",
    "single_chapters": f"SELECT file_id, CAST(1 AS BIGINT) AS chapter_no, '' AS title, md5(txt) AS body FROM (SELECT DISTINCT file_id, txt FROM txt_files) WHERE {S.strip('txt')} <> '' AND file_id NOT IN (SELECT file_id FROM chapters WHERE file_id IS NOT NULL)",
}
