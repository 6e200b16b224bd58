"""Work queues of stages, paragraph states and routes, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioforge.functions.text import strip

#: The stages in order, and the states of a paragraph.
STAGES = ("tab2_ready", "tab3_ready", "tab4_ready", "tab4_failed", "tab5_ready")
STATES = ("translated", "preserved", "dropped", "failed")


def queue_add(queue: DataFrame, items: DataFrame) -> DataFrame:
    """(stage, item, seq) with new items behind; an item that is there keeps its place."""
    return queue.select("stage", "item", "seq").unionByName(items.select("stage", "item", "seq")).groupBy("stage", "item").agg(F.min("seq").alias("seq"))


def queue_remove(queue: DataFrame, items: DataFrame) -> DataFrame:
    return queue.join(items.select("stage", "item").distinct(), ["stage", "item"], "left_anti").select("stage", "item", "seq")


def queue_list(queue: DataFrame, stage: str) -> DataFrame:
    return queue.filter(F.col("stage") == stage).orderBy("seq").select("item", "seq")


def queue_clear(queue: DataFrame, stage: str) -> DataFrame:
    return queue.filter(F.col("stage") != stage)


def without_ghosts(queue: DataFrame, existing: DataFrame) -> DataFrame:
    """Queue entries whose item still exists."""
    return queue.join(existing.select("item").distinct(), "item", "left_semi").select("stage", "item", "seq")


def route(stem: Column) -> Column:
    """The stage behind the split: foreign titles are translated, others summarised."""
    from folioforge.functions.text import title_needs_translation

    return F.when(title_needs_translation(stem), "tab3_ready").otherwise("tab4_ready")


def unfinished(paras: DataFrame, state: DataFrame) -> DataFrame:
    """Paragraphs without a reusable state: the same source, and not failed."""
    ok = state.filter("status <> 'failed'").select("chapter_id", "idx", "src").distinct()
    return paras.join(ok, ["chapter_id", "idx", "src"], "left_anti")


def upsert_state(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """State rows (chapter_id, idx, src, tgt, status) where a fresh row replaces the old one of its place."""
    cols = ["chapter_id", "idx", "src", "tgt", "status"]
    both = state.select(*cols, F.lit(0).alias("gen")).unionByName(fresh.select(*cols, F.lit(1).alias("gen")))
    newest = W.partitionBy("chapter_id", "idx").orderBy(F.desc("gen"), F.desc("src"))
    return both.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").select(*cols)


def status_counts(state: DataFrame, by: str) -> DataFrame:
    return state.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATES], F.count("*").alias("n"))


def shrinks(old: DataFrame, new: DataFrame, key: str, n: str) -> DataFrame:
    """Keys whose new count is below the old one: they need a backup before they are overwritten."""
    return old.select(key, F.col(n).alias("n_old")).join(new.select(key, F.col(n).alias("n_new")), key).filter("n_new < n_old")


def first_seen(items: DataFrame, key: str, order: str) -> DataFrame:
    """Items without repeats, in the order in which they first occur."""
    return items.groupBy(key).agg(F.min(order).alias(order))


def disambiguated(items: DataFrame, key: str, order: str) -> DataFrame:
    """Keys made different by ``__N`` behind the second and later ones."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return items.withColumn("widget_key", F.when(n == 0, F.col(key)).otherwise(F.concat_ws("__", key, n.cast("string"))))


def language_files(blocks: DataFrame, key: str, order: list[str], src: str, out: str) -> DataFrame:
    """``key, en, ko``: a bilingual text's sources and its answers in order as two texts, without blanks and marks of kept originals."""
    def joined(c: str) -> Column:
        text = strip(F.coalesce(F.col(c), F.lit("")))
        kept = F.when((text != "") & ~text.startswith("(원문 보존"), F.struct(*order, text.alias("t"))) if c == out else F.when(text != "", F.struct(*order, text.alias("t")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), "\n\n")

    return blocks.groupBy(key).agg(joined(src).alias("en"), joined(out).alias("ko"))


def autostart(queue: DataFrame, processed: DataFrame, stage: str) -> DataFrame:
    """``item, seq`` of a stage's entries that were just processed: the next stage begins with those and leaves the others waiting."""
    return queue.filter(F.col("stage") == stage).join(processed.select("item").distinct(), "item", "left_semi").select("item", "seq")
