"""Notes of whole books from a model: overviews over chapter summaries, notes over the full text, and notes written anew.

Each is a chain of expressions around one narrow pass that asks the model; what it
answers is checked, rendered and read back with built-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.biblio import frontmatter, frontmatter_value, summary_parts
from folioforge.functions.text import author_from_stem, note_budgets, note_filename, squeeze, strip
from folioforge.operators.model import TextModel, ask_json
from folioforge.operators.notes import SUMMARY_MARK, accept_rewrite, classify_note, front_lines, rebuild_citations

#: Characters of a book's head and tail in an overview's prompt, of an overview file that hold its keys, the category of what has none, heading of keywords.
HEAD, TAIL, KEYS_IN, NO_CATEGORY, KEYWORDS = 3500, 1500, 400, "기타", "## 핵심 키워드"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _line(key: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{key}: "), value, F.lit("\n"))).otherwise(F.lit(""))


def overview_prompts(sections: DataFrame, texts: DataFrame, book: str, no: str, title: str, summary: str, text: str) -> DataFrame:
    """``book, prompt``: a book's chapter summaries in order, then both ends of its text (``texts``: ``book, text``; the longest one counts), where title page and imprint stand.

    Chapters without a summary are left out, and books without any.
    """
    line = F.concat(F.col(no).cast("string"), F.lit(". "), _blank(F.col(title)), F.lit(": "), F.col(summary))
    told = sections.filter(strip(_blank(F.col(summary))) != "")
    listed = told.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(no).alias("n"), line.alias("t")))), lambda x: x["t"]), "\n").alias("listed"))
    # Only the ends of a text are shuffled.
    ends = F.concat(F.left(text, F.lit(HEAD)), F.lit("\n…\n"), F.right(text, F.lit(TAIL)))
    full = texts.filter(F.col(text).isNotNull()).groupBy(book).agg(F.max_by(ends, F.struct(F.length(text), F.left(text, F.lit(HEAD)))).alias("ends"))
    return listed.join(full, book, "left").select(book, F.concat_ws("\n\n", "listed", strip("ends")).alias("prompt"))


def overview_md(book: Column, author: Column, category: Column, published: Column, publisher: Column, model: Column, day: Column, summary: Column, intro: Column, keywords: Column) -> Column:
    """The file of a book's overview; keys without a value are left out."""
    quoted = F.when(publisher != "", F.concat(F.lit('"'), F.replace(publisher, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(F.lit(""))
    head = F.concat(F.lit("---\nbook: "), book, F.lit("\n"), _line("author", author), F.lit("category: "), category, F.lit("\n"), _line("published", published), _line("publisher", quoted), F.lit("model: "), model, F.lit("\ngenerated: "), day, F.lit("\n---\n"))
    words = F.when(keywords != "", F.concat(F.lit(f"\n{KEYWORDS}\n"), keywords, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit(f"{SUMMARY_MARK} "), squeeze(summary), F.lit("\n\n"), strip(intro), F.lit("\n"), words)


def parse_overview(text: Column) -> Column:
    """(category, author, published_date, publisher, model, summary, intro) of an overview file; null where it has neither summary nor introduction."""
    head = F.left(text, F.lit(KEYS_IN))
    value = lambda k: strip(F.regexp_extract(head, rf"(?md)^{k}:\s*(.+)$", 1))
    bare = lambda k: F.regexp_replace(value(k), '^"+|"+$', "")
    parts = summary_parts(text)
    category = F.when(value("category") == "", F.lit(NO_CATEGORY)).otherwise(value("category"))
    row = F.struct(category.alias("category"), value("author").alias("author"), bare("published").alias("published_date"), bare("publisher").alias("publisher"), value("model").alias("model"), parts["summary"].alias("summary"), parts["body"].alias("intro"))
    return F.when((parts["summary"] != "") | (parts["body"] != ""), row)


def overviews(prompts: DataFrame, book: str, model: TextModel, model_name: str, day: str) -> DataFrame:
    """``book, status, file``: the overview that a model writes for each prompt; failed where the answer has neither summary nor introduction."""
    got = ask_json(prompts, book, "prompt", model, ("summary", "intro", "author", "category", "published_date", "publisher", "keywords"))
    v = {c: strip(_blank(F.col(c))) for c in ("summary", "intro", "author", "category", "published_date", "publisher", "keywords")}
    author = F.when(v["author"] != "", v["author"]).otherwise(author_from_stem(F.col(book)))
    category = F.when(v["category"] != "", v["category"]).otherwise(F.lit(NO_CATEGORY))
    words = F.array_join(F.filter(F.transform(F.split(v["keywords"], "\n"), strip), lambda x: x != ""), "\n")
    ok = (F.col("status") == "done") & ((v["summary"] != "") | (v["intro"] != ""))
    file = overview_md(F.col(book), author, category, v["published_date"], v["publisher"], F.lit(model_name), F.lit(day), v["summary"], v["intro"], words)
    return got.select(book, F.when(ok | (F.col("status") == "limited"), F.col("status")).otherwise("failed").alias("status"), F.when(ok, file).alias("file"))


def book_notes(books: DataFrame, book: str, text: str, model: TextModel, model_name: str, day: str, cap: int = 1_900_000) -> DataFrame:
    """``book, status, category, filename, note, n_cites``: a note of each whole book, with only those quotations that stand in its text.

    The prompt names the budgets that follow from the length; a text beyond the model's
    ``cap`` is cut for the model only, quotations are held against all of it. One text a
    book: rows of the same book are asked for one by one.
    """
    rows = books.filter(strip(_blank(F.col(text))) != "").select(F.monotonically_increasing_id().alias("__id"), F.col(book).alias("__book"), F.col(text).alias("__text"))
    budget = note_budgets(F.length(F.left("__text", F.lit(cap))))
    prompt = F.concat(F.lit("Title: "), "__book", F.lit(". Sections: "), budget["n_sub"].cast("string"), F.lit(", quotations: "), budget["n_cite"].cast("string"), F.lit("\n\n"), F.left("__text", F.lit(cap)))
    asked = rows.select(F.struct("__id", "__book", "__text").alias("row"), prompt.alias("prompt"))
    got = ask_json(asked, "row", "prompt", model, ("title", "summary", "body", "tags", "category", "published_date", "publisher"), ("body",), 60_000)
    b, v = F.col("row.__book"), {c: strip(_blank(F.col(c))) for c in ("title", "summary", "body", "category", "published_date", "publisher")}
    fixed = rebuild_citations(v["body"], F.col("row.__text"), note_budgets(F.length("row.__text"))["cite_keep"].cast("int"))
    title = F.when(v["title"] != "", v["title"]).otherwise(b)
    first = strip(F.split(v["category"], r"\|")[0])
    category = F.when(first != "", first).otherwise(F.lit(NO_CATEGORY))
    head = F.concat(F.lit("---\ntitle: "), title, F.lit("\nsummary: "), v["summary"], F.lit("\ntags: "), F.coalesce("tags", F.lit("[]")), F.lit("\nsource: "), b, F.lit(".txt\n"), front_lines(published=v["published_date"], publisher=v["publisher"]), F.lit(f"model: {model_name}\ngenerated: {day}\n---\n\n"))
    note = F.concat(head, F.lit("# "), title, F.lit("\n\n"), strip(fixed["body"]), F.lit("\n\n## sources\n- `"), b, F.lit(".txt`\n"))
    ok = F.col("status") == "done"
    return got.select(b.alias(book), "status", F.when(ok, category).alias("category"), F.when(ok, note_filename(b)).alias("filename"), F.when(ok, note).alias("note"), F.when(ok, fixed["n_kept"]).alias("n_cites"))


def cited_summaries(chapters: DataFrame, key: str, text: str, model: TextModel, most: int) -> DataFrame:
    """``key, status, summary, body, n_cites``: a model's summary of each chapter with those of its quotations, ``most`` at most, that stand in the chapter."""
    asked = chapters.select(F.struct(key, text).alias("row"), F.col(text).alias("prompt"))
    got = ask_json(asked, "row", "prompt", model, ("summary", "body"), ("summary", "body"))
    fixed = rebuild_citations(_blank(F.col("body")), _blank(F.col(f"row.{text}")), F.lit(most))
    ok = F.col("status") == "done"
    return got.select(F.col(f"row.{key}").alias(key), "status", "summary", F.when(ok, fixed["body"]).alias("body"), F.when(ok, fixed["n_kept"]).alias("n_cites"))


def rewritten_notes(notes: DataFrame, key: str, stem: str, text: str, model: TextModel, model_name: str, day: str) -> DataFrame:
    """``key, outcome, note``: notes that a model has written anew. ``outcome`` is the reason for which a note stays, ``failed`` or ``limited``, ``too_short`` (the new one loses too much) or ``done``; ``note`` is null unless done."""
    rows = notes.select(key, stem, text).withColumn("reason", classify_note(_blank(F.col(text)), _blank(F.col(stem))))
    asked = rows.filter("reason = ''").select(F.struct(key, text).alias("row"), F.col(text).alias("prompt"))
    got = ask_json(asked, "row", "prompt", model, ("body", "keywords", "author"), (), 20_000)
    parts = frontmatter(F.col(f"row.{text}"))
    new = strip(_blank(F.col("body")))
    words = F.array_join(F.filter(F.transform(F.split(_blank(F.col("keywords")), "\n"), strip), lambda x: x.startswith("#")), "\n")
    body = F.regexp_replace(F.regexp_replace(new, rf"(?s)\n{KEYWORDS}\n.*$", ""), r"\s+$", "")
    body = F.when(words != "", F.concat(body, F.lit(f"\n\n{KEYWORDS}\n"), words)).otherwise(body)
    author = F.when((strip(_blank(F.col("author"))) != "") & (frontmatter_value(parts["fm"], "author") == ""), F.concat(F.lit("\nauthor: "), strip(F.col("author")))).otherwise(F.lit(""))
    note = F.concat(F.lit("---\n"), parts["fm"], author, F.lit(f"\nrefined: {model_name} ({day})\n---\n\n"), body, F.lit("\n"))
    outcome = F.when(F.col("status") != "done", F.col("status")).when(~accept_rewrite(parts["body"], new), "too_short").otherwise("done")
    done = got.select(F.col(f"row.{key}").alias(key), outcome.alias("outcome"), F.when(outcome == "done", note).alias("note"))
    stay = rows.filter("reason <> ''").select(key, F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("note"))
    return stay.unionByName(done)
