"""Notes rendered from chapters and summaries: single notes, hubs, links, tables of contents, blocks for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions.text import WS, demote_headings, despace, note_filename, strip, yaml_line

#: Headings and marks of the notes.
LINKS_HEADER, TOC_HEADER, SUMMARY_MARK = "## 📑 챕터 심층 노트", "## 📋 챕터 목차", "> **요약:**"
CITE_HEADER, CITE_TABLE, CITE_NONE = "## 핵심 인용", "| 주제 | 원문 인용(대조 검증) |\n|---|---|", "| (원문 확인된 직접 인용 없음) | |"


def wiki_link(title: Column) -> Column:
    name = note_filename(title)
    return F.concat(F.lit("[["), F.substring(name, F.lit(1), F.length(name) - 3), F.lit("]]"))


def two_digits(no: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    return F.when(no < 10, F.concat(F.lit("0"), no.cast("string"))).otherwise(no.cast("string"))


def summary_md(book: Column, chapter: Column, summary: Column, body: Column, author: Column, model: Column, day: Column) -> Column:
    """A summary file: front matter, the summary's line, the body."""
    who = F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit("author: "), author, F.lit("\n"))).otherwise(F.lit(""))
    one = strip(F.regexp_replace(F.coalesce(summary, F.lit("")), f"{WS}+", " "))
    return F.concat(
        F.lit("---\nbook: "), book, F.lit("\n"), who, F.lit("chapter: "), chapter, F.lit("\nmodel: "), F.coalesce(model, F.lit("")), F.lit("\ngenerated: "), F.coalesce(day, F.lit("")),
        F.lit(f"\n---\n{SUMMARY_MARK} "), one, F.lit("\n\n"), strip(F.coalesce(body, F.lit(""))), F.lit("\n"),
    )


def neighbours(chapters: DataFrame, book: str, no: str, title: str) -> DataFrame:
    """Chapters with the titles before and behind them in their book."""
    w = W.partitionBy(book).orderBy(no)
    return chapters.withColumn("prev_title", F.lag(title).over(w)).withColumn("next_title", F.lead(title).over(w))


def chapter_note(book: Column, title: Column, summary: Column, body: Column, prev: Column, nxt: Column, model: Column, day: Column) -> Column:
    """One chapter's note with links to its book and neighbours."""
    name = lambda t: wiki_link(F.concat_ws(" — ", book, t))
    nav = F.concat_ws(" · ", F.when(prev.isNotNull(), name(prev)), F.when(nxt.isNotNull(), name(nxt)))
    way = F.when(nav != "", F.concat(F.lit("  |  "), nav)).otherwise(F.lit(""))
    home = wiki_link(book)
    lines = [
        F.lit("---"), F.concat(F.lit("title: "), book, F.lit(" — "), title), F.concat(F.lit("book: "), book), F.concat(F.lit("chapter: "), title), F.concat(F.lit("model: "), model), F.concat(F.lit("generated: "), day),
        F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.concat(F.lit("> ← "), home, way), F.lit(""), F.concat(F.lit("**요약:** "), summary), F.lit(""), body, F.lit(""), F.lit("---"), F.concat(F.lit("*전체 목차: "), home, F.lit("*"), way),
    ]
    return F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in lines])


def _ordered(row: Column, text: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row.alias("no"), text.alias("t")))), lambda x: x["t"]), "\n")


def hub_notes(sections: DataFrame, overviews: DataFrame, book: str) -> DataFrame:
    """``book, note``: a book's note with its contents and sections; sections that have a note of their own are linked, others stand in full.

    ``sections`` has (no, title, summary, body, noted), ``overviews`` (category, author,
    intro, summary, published, publisher, model, day). A book's sections are its chapters, a
    bounded few; they are sorted by number after the shuffle. Nothing is overwritten here, so
    a book without sections has no note.
    """
    b = F.col(book)
    link = wiki_link(F.concat_ws(" — ", b, "title"))
    brief = F.concat(F.substring("summary", 1, 60), F.when(F.length("summary") > 60, F.lit("…")).otherwise(F.lit("")))
    toc = F.concat(F.lit("- "), F.when(F.col("noted"), F.lit("✅")).otherwise(F.lit("📄")), F.lit(" "), link, F.lit(" — "), brief)
    head = F.concat(F.lit("## "), two_digits(F.col("no")), F.lit(". "), F.col("title"))
    part = F.when(F.col("noted"), F.concat_ws("\n", head, F.concat(F.lit("> 📄 "), link), F.lit(""), "summary", F.lit(""))).otherwise(F.concat_ws("\n", head, F.concat(F.lit("> "), link), F.lit(""), "summary", F.lit(""), "body", F.lit("")))
    s = sections.fillna("", ["title", "summary", "body"]).groupBy(book).agg(_ordered(F.col("no"), toc).alias("toc"), _ordered(F.col("no"), part).alias("parts"))
    o = overviews.groupBy(book).agg(*[F.max(c).alias(c) for c in ("category", "author", "intro", "summary", "published", "publisher", "model", "day")])
    df = s.join(o, book, "left").fillna("", ["category", "author", "intro", "summary", "published", "publisher", "model", "day"])
    cat = F.when(F.col("category") == "", F.lit("기타")).otherwise(F.col("category"))
    tags = F.when(cat == "기타", F.lit("[]")).otherwise(F.concat(F.lit('["'), cat, F.lit('"]')))
    line = lambda k, c: F.when(c != "", F.concat(F.lit(f"{k}: "), c, F.lit("\n"))).otherwise(F.lit(""))
    note = F.concat(
        F.lit("---\ntitle: "), b, F.lit("\ncategory: "), cat, F.lit("\ntags: "), tags, F.lit("\nsource: "), b, F.lit(".txt\n"), line("author", F.col("author")), line("published", F.col("published")),
        F.when(F.col("publisher") != "", F.concat(F.lit('publisher: "'), F.replace(F.col("publisher"), F.lit('"'), F.lit("'")), F.lit('"\n'))).otherwise(F.lit("")),
        F.lit("model: "), F.col("model"), F.lit("\ngenerated: "), F.col("day"), F.lit("\n---\n\n# "), b, F.lit("\n\n"), F.col("intro"), F.lit("\n\n**요약:** "), F.col("summary"),
        F.lit(f"\n\n{TOC_HEADER}\n\n"), F.col("toc"), F.lit("\n\n"), F.col("parts"),
    )
    return df.select(book, note.alias("note"))


def inline_note(book: Column, category: Column, summary: Column, intro: Column, meta: Column, parts: Column, model: Column, day: Column) -> Column:
    """A book's note with its chapters' bodies in it, their headings one level down."""
    return F.concat(F.lit("---\ntitle: "), book, F.lit("\ncategory: "), category, F.lit("\nsummary: "), summary, F.lit("\n"), meta, F.lit("model: "), model, F.lit("\ngenerated: "), day, F.lit("\nmode: chapter(A)\n---\n\n# "), book, F.lit("\n\n## 책 개요\n"), strip(intro), F.lit("\n\n"), parts)


def inline_parts(no: Column, title: Column, body: Column) -> Column:
    """An aggregate: a book's chapters as sections, in order."""
    return _ordered(no, F.concat(F.lit("## "), two_digits(no), F.lit(". "), title, F.lit("\n"), demote_headings(strip(body)), F.lit("\n")))


def links_block(no: Column, title: Column, summary: Column, target: Column) -> Column:
    """An aggregate: the block of links to a book's chapter notes."""
    one = F.concat(F.lit("### "), two_digits(no), F.lit(". "), title, F.lit("\n"), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(summary, F.lit("\n"))).otherwise(F.lit("")), F.lit("→ [["), target, F.lit("|전문 보기]]\n"))
    return F.concat(F.lit(f"{LINKS_HEADER}\n\n"), F.regexp_replace(_ordered(no, one), r"\s+$", ""), F.lit("\n"))


def put_links(note: Column, block: Column) -> Column:
    """A note with the block of links replaced, or appended where it has none."""
    has = note.contains(LINKS_HEADER)
    at = F.locate(LINKS_HEADER, note)
    rest = F.substring(note, at + len(LINKS_HEADER), F.length(note))
    behind = F.locate("\n## ", rest)
    tail = F.when(behind > 0, F.substring(rest, behind, F.length(rest))).otherwise(F.lit(""))
    replaced = F.concat(F.substring(note, F.lit(1), at - 1), F.regexp_replace(block, r"\s+$", ""), tail)
    return F.when(has, replaced).otherwise(F.concat(F.regexp_replace(note, r"\s+$", ""), F.lit("\n\n"), block))


def front_lines(**values: Column) -> Column:
    """Front-matter lines of the values that aren't blank, in order."""
    return F.concat(*[yaml_line(k, v) for k, v in values.items()])


def quoted_rows(body: Column) -> Column:
    """(topic, quote) of the rows in a body's table of quotations."""
    after = F.split(body, "(?m)(?d)^## 핵심 인용[^\n]*$", 2)
    section = F.split(F.coalesce(F.get(after, 1), F.lit("")), "(?m)(?d)^## ", 2)[0]
    rows = F.filter(F.transform(F.split(section, "\n"), strip), lambda r: r.startswith("|") & ~r.contains("---"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), strip))
    kept = F.filter(cells, lambda c: (F.size(c) >= 2) & ~F.get(c, 1).isin("인용", "인용(책 본문 그대로)", "원문 인용", "원문 인용(대조 검증)", ""))
    return F.transform(kept, lambda c: F.struct(F.get(c, 0).alias("topic"), strip(F.regexp_replace(F.get(c, 1), f"{WS}+", " ")).alias("quote")))


def rebuild_citations(body: Column, source: Column, most: Column) -> Column:
    """(body, n_kept): the table of quotations with only those that stand in the source, at most ``most``; at the end where the body has none."""
    text = F.regexp_replace(source, f"{WS}+", "")
    real = F.filter(quoted_rows(body), lambda r: (F.length(despace(r["quote"])) >= 10) & text.contains(despace(r["quote"])))
    kept = F.slice(real, F.lit(1), most)
    rows = F.when(F.size(kept) == 0, F.lit(CITE_NONE)).otherwise(F.array_join(F.transform(kept, lambda r: F.concat(F.lit("| "), r["topic"], F.lit(" | "), r["quote"], F.lit(" |"))), "\n"))
    block = F.concat(F.lit(f"{CITE_HEADER}\n\n{CITE_TABLE}\n"), rows)
    parts = F.split(body, "(?m)(?d)^## 핵심 인용[^\n]*$", 2)
    rest = F.coalesce(F.get(parts, 1), F.lit(""))
    behind = F.regexp_extract(rest, r"(?s)\n(## .*)$", 1)
    new = F.when(F.size(parts) > 1, F.concat(F.get(parts, 0), block, F.when(behind != "", F.concat(F.lit("\n"), behind)).otherwise(F.lit("")))).otherwise(F.concat(body, F.lit("\n\n"), block))
    return F.struct(new.alias("body"), F.size(kept).alias("n_kept"))


def markdown_blocks(notes: DataFrame, key: str, body: str) -> DataFrame:
    """``key, block_no, kind, level, text`` of a note's lines: headings to level 4, quotes, tags, bullets, paragraphs, and tables as one block each without their rules."""
    lines = notes.select(key, F.posexplode(F.split(body, "\n")).alias("i", "raw")).withColumn("s", strip(F.col("raw"))).filter("s <> ''")
    head = F.regexp_extract("s", r"^(#{1,6})\s+(.*)$", 1)
    kind = F.when(F.col("s").startswith("|"), "table").when(head != "", "heading").when(F.col("s").startswith(">"), "quote").when(F.col("s").rlike(r"^#[^\s#]"), "tags").when(F.col("s").rlike(r"^[-*]\s+"), "bullet").otherwise("paragraph")
    lines = lines.withColumn("kind", kind).withColumn("level", F.least(F.length(head), F.lit(4)))
    w = W.partitionBy(key).orderBy("i")
    # A table goes on while its lines follow each other: blank lines end it.
    new = (F.col("kind") != "table") | F.coalesce(F.lag("kind").over(w) != "table", F.lit(True)) | (F.col("i") - F.lag("i").over(w) > 1)
    lines = lines.withColumn("block_no", F.sum(new.cast("int")).over(w)).filter(~((F.col("kind") == "table") & F.col("s").rlike(r"^\|\s*:?-{2,}")))
    clean = F.when(F.col("kind") == "heading", F.regexp_replace("s", r"^#{1,6}\s+", "")).when(F.col("kind") == "quote", strip(F.regexp_replace("s", r"^>+", ""))).when(F.col("kind") == "bullet", F.regexp_replace("s", r"^[-*]\s+", "")).otherwise(F.col("s"))
    by = lines.withColumn("c", clean).groupBy(key, "block_no").agg(F.first("kind").alias("kind"), F.max("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "\n").alias("text"))
    return by.select(key, F.col("block_no").cast("long").alias("block_no"), "kind", F.coalesce("level", F.lit(0)).cast("int").alias("level"), "text")


def classify_note(text: Column, stem: Column) -> Column:
    """Why a note isn't rewritten, by the first rule that holds; empty for those that are."""
    end = F.locate("\n---", text, 4)
    has = text.startswith("---") & (end > 0)
    fm = F.when(has, F.substring(text, F.lit(1), end + 3)).otherwise(F.lit(""))
    body = F.when(has, F.substring(text, end + 4, F.length(text))).otherwise(text)
    return (
        F.when(~fm.contains("model:"), "not_pipeline")
        .when(fm.contains("refined:"), "already_done")
        .when(~body.contains("## 핵심 요약") & ~body.contains("## 주요 내용"), "not_summary")
        .when(stem.contains("_번역") | (F.length(body) > 35_000), "full_text")
        .when(F.length(strip(body)) < 800, "thin")
        .otherwise("")
    )


def accept_rewrite(old: Column, new: Column) -> Column:
    """Is a rewrite long enough, 60 % of the old body and 600 characters, and does it keep sections?"""
    return (F.length(strip(new)) >= F.greatest(F.lit(600), F.floor(F.length(strip(old)) * 0.6))) & new.contains("## ")
