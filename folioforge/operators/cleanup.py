"""Page furniture and reflow over (book, page, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions.text import strip, vertical_noise

#: Edge lines looked at on either side of a page, longest furniture line, repeats in the whole book.
EDGE, FURNITURE_CHARS, REPEATS = 2, 90, 3


def page_lines(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """``book, page, line_no`` (from 1 in the page), ``line`` and ``s``, the line without white space at its ends. Null texts have no line."""
    rows = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return rows.select("book", "page", (F.col("i") + 1).alias("line_no"), "line", strip(F.col("line")).alias("s"))


def furniture_counts(lines: DataFrame) -> DataFrame:
    """``book, s, freq, edge, first_page, first_line, n_pages``: how often each different line stands anywhere and at a page's edge.

    A line of a short page counts at both edges. Ranks are taken within a page, counts are
    pre-aggregated by book and line, so a book of any size is spread over tasks.
    """
    filled = lines.filter("s <> ''")
    page = W.partitionBy("book", "page")
    ranked = filled.withColumn("rn", F.row_number().over(page.orderBy("line_no"))).withColumn("n", F.count("*").over(page))
    edge = (F.col("rn") <= EDGE).cast("int") + (F.col("rn") > F.col("n") - EDGE).cast("int")
    counts = ranked.groupBy("book", "s").agg(F.count("*").alias("freq"), F.sum(edge).alias("edge"), F.min(F.struct("page", "line_no")).alias("first"))
    pages = lines.groupBy("book").agg(F.count_distinct("page").alias("n_pages"))
    return counts.join(pages, "book").select("book", "s", "freq", "edge", F.col("first.page").alias("first_page"), F.col("first.line_no").alias("first_line"), "n_pages")


def strip_furniture(lines: DataFrame) -> DataFrame:
    """``lines`` that stay: of repeated short lines the first one, no lone numbers and no rotated text; blank lines stay."""
    counts = furniture_counts(lines)
    short = F.length("s") < FURNITURE_CHARS
    repeated = short & ((F.col("edge") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") / 2))) | (F.col("freq") >= REPEATS))
    gone = counts.filter(repeated).select("book", "s", "first_page", "first_line")
    kept = lines.filter(~F.col("s").rlike(r"^[0-9]{1,4}$") & ~vertical_noise(F.col("s")))
    kept = kept.join(gone, ["book", "s"], "left")
    first = F.col("first_page").isNull() | ((F.col("page") == F.col("first_page")) & (F.col("line_no") == F.col("first_line")))
    return kept.filter(first).select("book", "page", "line_no", "line", "s")


def reflow(text: Column) -> Column:
    """Lines of a paragraph in one: a hyphen before a small letter is dropped, before others kept, else a blank joins."""
    paras = F.split(text, r"\n[ \t]*\n")

    def join(buf: Column, row: Column) -> Column:
        hyphen = buf.endswith("-")
        small = row.rlike(r"^\p{Ll}")
        return (
            F.when(buf == "", row)
            .when(hyphen & small, F.concat(F.substring(buf, F.lit(1), F.length(buf) - 1), row))
            .when(hyphen, F.concat(buf, row))
            .otherwise(F.concat_ws(" ", buf, row))
        )

    def one(para: Column) -> Column:
        rows = F.filter(F.transform(F.split(para, "\n"), strip), lambda r: r != "")
        return F.aggregate(rows, F.lit(""), join)

    return F.array_join(F.filter(F.transform(paras, one), lambda p: p != ""), "\n\n")


def clean_pages(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """``book, text``: each book's pages without furniture, in paragraphs."""
    kept = strip_furniture(page_lines(pages, book, page, text))
    by_page = kept.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    by_page = by_page.select("book", "page", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
    books = by_page.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("ps"))
    return books.select("book", reflow(F.array_join(F.transform("ps", lambda x: x["text"]), "\n")).alias("text"))


def clean_form_feeds(docs: DataFrame, book: str, text: str) -> DataFrame:
    """The same for texts whose pages are parted by form feeds."""
    pages = docs.select(F.col(book).alias("book"), F.posexplode(F.split(text, "\f")).alias("page", "text"))
    return clean_pages(pages, "book", "page", "text")


def best_extraction(first: Column, second: Column) -> Column:
    """(text, note): the second extraction where the first ran words together and the second less so, or is blank; an error where both are."""
    from folioforge.functions.text import BAD_HEALTH, token_health

    a, b = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    swap = (strip(b) != "") & ((strip(a) == "") | ((token_health(a) > BAD_HEALTH) & (token_health(b) < token_health(a))))
    best = F.when(swap, b).otherwise(a)
    note = F.when(strip(best) == "", F.lit("needs_ocr")).when(swap, F.lit("fallback")).otherwise(F.lit(""))
    return F.struct(F.nullif(best, F.lit("")).alias("text"), note.alias("note"))
