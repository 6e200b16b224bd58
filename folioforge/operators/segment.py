"""Paragraphs, footnotes and sections of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions.text import BULLET_CITATION, CITED_URL, DAGGER, EXPLICIT_CITE, FOOTNOTE_START, NUMBERED_CITATION, SKIPPED_SECTIONS, footnote_number, strip

#: Target length, least paragraphs, least length of a piece and of a sentence, most of a merged paragraph.
TARGET, LEAST, PIECE, SENTENCE, MERGED = 1500, 5, 50, 10, 3000
#: Footnotes in a run, longest footnote, density and place from which a run is the text itself.
RUN, FOOTNOTE_CHARS, DENSE, EARLY = 3, 300, 0.15, 0.5
#: Paragraphs from which the tail is searched, where, length of narrative, paragraphs behind it.
TAIL_LEAST, TAIL_FROM, NARRATIVE, TAIL_MORE = 50, 0.6, 400, 5


def merge_dangling(paras: Column, most: int = MERGED) -> Column:
    """An array of paragraphs with those joined that a page break cut: the one before has no end, or this one goes on in small letters."""

    def step(out: Column, p: Column) -> Column:
        prev = F.try_element_at(out, F.lit(-1))
        open_ = ~prev.rlike(r'[.!?:;"”’)\]]\s*$') | p.rlike("^[a-z]")
        fits = (F.size(out) > 0) & ~F.regexp_replace(prev, r"^\s+", "").startswith("#") & (F.length(prev) + F.length(p) + 1 <= most) & open_
        joined = F.concat_ws(" ", F.regexp_replace(prev, r"\s+$", ""), F.regexp_replace(p, r"^\s+", ""))
        return F.when(fits, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(paras, F.array().cast("array<string>"), step)


def _packed(parts: list[str], target: int) -> list[str]:
    """Parts filled up to ``target``; pieces of no more than PIECE characters are left out."""
    out, buf = [], ""
    for p in parts:
        if len(buf) + len(p) + 1 <= target:
            buf = f"{buf} {p}" if buf else p
        else:
            out.append(buf)
            buf = p
    return [b for b in [*out, buf] if len(b) > PIECE]


def split_text(text: str, target: int = TARGET, least: int = LEAST) -> list[str]:
    """Paragraphs of a text whatever its line ends: blank lines, else packed lines, else packed sentences."""
    by_blank = [p for p in map(str.strip, text.split("\n\n")) if len(p) > PIECE]
    if len(by_blank) >= least and sum(map(len, by_blank)) <= 2 * target * len(by_blank):
        merged: list[str] = []
        for p in by_blank:
            prev = merged[-1] if merged else ""
            if prev and not prev.startswith("#") and len(prev) + len(p) + 1 <= MERGED and (not re.search(r'[.!?:;"”’)\]]$', prev) or re.match("[a-z]", p)):
                merged[-1] = f"{prev} {p}"
            else:
                merged.append(p)
        return merged
    by_line = _packed([x for x in map(str.strip, text.split("\n")) if x], target)
    if len(by_line) >= least:
        return by_line
    sentences = [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+", text.replace("\n", " "))) if len(s) > SENTENCE]
    return _packed(sentences, target) or by_blank


def paragraphs(df: DataFrame, key: str, text: str, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """``key, idx`` (from 1) and ``src`` of each paragraph. Null and blank texts have none. A narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, idx, src = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, p in enumerate(split_text(t, target, least) if t else [], 1):
                    rows.append(i), idx.append(k), src.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(idx, pa.int64()), pa.array(src, pa.string())], names=[key, "idx", "src"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, idx long, src string")


def small_document(text: Column, n_paragraphs: Column) -> Column:
    """Small enough to be translated as a whole (paragraphs counted at 1800 characters, 4 at least)."""
    return (F.length(text) <= 120_000) & (n_paragraphs <= 14) & (strip(text) != "")


def sequential_footnotes(paras: DataFrame, key: str, idx: str, text: str) -> DataFrame:
    """``key, idx`` of footnotes: runs of three consecutive numbers or more among short paragraphs that begin with one.

    A document where runs begin early and are dense is numbered text, and runs without any
    citation are no footnotes; such documents have none.
    """
    w = W.partitionBy(key)
    placed = paras.withColumn("at", F.row_number().over(w.orderBy(idx)) - 1).withColumn("total", F.count("*").over(w))
    cand = placed.select(key, idx, "at", "total", F.col(text).alias("p"), footnote_number(F.col(text)).alias("num")).filter((F.length(strip(F.col("p"))) <= FOOTNOTE_CHARS) & F.col("num").between(1, 999))
    order = W.partitionBy(key).orderBy(idx)
    cand = cand.withColumn("new", F.coalesce((F.col("num") != F.lag("num").over(order) + 1).cast("int"), F.lit(1)))
    cand = cand.withColumn("run", F.sum("new").over(order))
    runs = cand.withColumn("n", F.count("*").over(W.partitionBy(key, "run"))).filter(F.col("n") >= RUN)
    stats = runs.groupBy(key).agg(F.min("at").alias("first"), F.max("total").alias("total"), F.count("*").alias("found"), F.max(F.col("p").rlike(EXPLICIT_CITE)).alias("cites"))
    early = (F.col("first") / F.col("total") < EARLY) & (F.col("found") / F.col("total") > DENSE)
    good = stats.filter(F.col("cites") & ~early).select(key)
    return runs.join(good, key, "left_semi").select(key, idx)


def skipped_sections(paras: DataFrame, key: str, idx: str, text: str) -> DataFrame:
    """``key, idx`` of paragraphs in sections of references; without such a header, those behind the last narrative paragraph near the end."""
    p = strip(F.col(text))
    header = F.when(p.startswith("## "), F.lower(strip(F.substring(p, F.lit(4), F.length(p)))))
    order = W.partitionBy(key).orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    rows = paras.select(key, idx, p.alias("p"), header.alias("header")).withColumn("section", F.last("header", ignorenulls=True).over(order))
    skipped = rows.filter(F.col("section").isin(*SKIPPED_SECTIONS)).select(key, idx)
    rest = rows.join(skipped.select(key).distinct(), key, "left_anti")
    narrative = (F.length("p") >= NARRATIVE) & ~F.col("p").rlike(CITED_URL)
    for pattern in (NUMBERED_CITATION, BULLET_CITATION, DAGGER, FOOTNOTE_START):
        narrative = narrative & ~F.col("p").rlike(pattern)
    w = W.partitionBy(key)
    rest = rest.withColumn("i", F.row_number().over(w.orderBy(idx)) - 1).withColumn("n", F.count("*").over(w)).filter(F.col("n") >= TAIL_LEAST)
    last = rest.filter(narrative & (F.col("i") >= F.floor(F.col("n") * TAIL_FROM))).groupBy(key).agg(F.max("i").alias("last"))
    tail = rest.join(last, key).filter((F.col("last") < F.col("n") - TAIL_MORE) & (F.col("i") > F.col("last"))).select(key, idx)
    return skipped.unionByName(tail)


def min_gap(marks: Column, gap: int) -> Column:
    """Of a sorted array of (pos, …) those at least ``gap`` behind the last one kept."""
    kind = F.slice(marks, 1, 0)
    return F.aggregate(marks, kind, lambda out, m: F.when((F.size(out) > 0) & (m["pos"] - F.try_element_at(out, F.lit(-1))["pos"] < gap), out).otherwise(F.concat(out, F.array(m))))
