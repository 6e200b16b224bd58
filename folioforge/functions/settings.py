"""Small look-ups: interface texts, engines and providers, PDF information lines, split files, counts of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions.biblio import pdf_date
from folioforge.functions.text import strip

#: Providers in the order in which they are taken, keys before command lines.
PROVIDER_ORDER = ("gemini", "openai", "anthropic", "claude_cli", "codex_cli")


def translate_ui(texts: DataFrame, dictionary: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``shown``: the dictionary's (text, shown) entry, else the text itself."""
    d = dictionary.select(F.col("text").alias("__t"), "shown").dropDuplicates(["__t"])
    return texts.join(d, texts[text] == d["__t"], "left").withColumn("shown", F.coalesce("shown", F.col(text))).drop("__t")


def engine_options(providers: DataFrame) -> DataFrame:
    """``engine, label, available`` of every model of (provider, label, models, usable)."""
    rows = providers.select("provider", "label", "usable", F.explode("models").alias("model"))
    return rows.select(F.concat_ws(":", "provider", "model").alias("engine"), F.concat("label", F.lit(" · "), "model").alias("label"), F.col("usable").alias("available"))


def pick_provider(providers: DataFrame, configured: str | None) -> DataFrame:
    """One row (provider, model): the configured provider if usable, else the first usable in order, else the first of all."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, PROVIDER_ORDER)), F.col("provider")), F.lit(99))
    rank = F.when(F.col("usable") & (F.col("provider") == F.lit(configured)), 0).when(F.col("usable"), order).otherwise(F.lit(1000) + order)
    return providers.select("provider", F.col("models")[0].alias("model"), rank.alias("r")).orderBy("r").limit(1).select("provider", "model")


def pdf_info_dates(lines: DataFrame, doc: str, line: str) -> DataFrame:
    """``doc, source_created, source_modified`` from ``key: value`` lines about a PDF; empty where none is given."""
    value = pdf_date(F.regexp_extract(line, r"^[A-Za-z]+:(.*)$", 1))
    pick = lambda k: F.coalesce(F.max(F.when(F.col(line).startswith(f"{k}:"), value)), F.lit(""))
    return lines.groupBy(doc).agg(pick("CreationDate").alias("source_created"), pick("ModDate").alias("source_modified"))


def split_files(files: DataFrame, name: str, stem: str) -> DataFrame:
    """Files that are numbered parts ``stem_NN_….md`` of their stem."""
    rest = F.substring(name, F.length(stem) + 1, F.length(name))
    return files.filter(F.col(name).startswith(F.col(stem)) & rest.rlike(r"^_[0-9]{2}_.+\.md$"))


def translated_blocks(text: Column) -> Column:
    """How many blocks of a bilingual text have an answer, in either form."""
    old = F.size(F.split(text, r"\n\n\[KO\]\n")) - 1
    blocks = F.filter(F.transform(F.split(text, "\n\n---\n\n"), strip), lambda b: b.contains("\n\n") & ~b.startswith("["))
    return F.when(old > 0, old).otherwise(F.size(blocks))


def source_pdf(texts: DataFrame, pdfs: DataFrame, stem: str, path: str) -> DataFrame:
    """Texts with the first PDF of their stem by path."""
    return texts.join(pdfs.groupBy(stem).agg(F.min(path).alias(path)), stem, "left")


def books_listing(roots: list[DataFrame], stem: str, path: str) -> DataFrame:
    """``stem, path`` over roots in order of priority: the first root that has a stem wins."""
    every = None
    for i, df in enumerate(roots):
        one = df.select(stem, path, F.lit(i).alias("root"))
        every = one if every is None else every.unionByName(one)
    w = W.partitionBy(stem).orderBy("root", path)
    return every.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(stem, path)
