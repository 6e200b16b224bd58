"""The stage queue as a stream: items arrive as files, states are kept in tables by idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioforge.operators.model import TextModel, translate_chapters
from folioforge.operators.stages import route


def source(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """New files of a folder, a few a batch, so that a run can stop between batches and go on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def routed(stream: DataFrame, stem: str) -> DataFrame:
    """Items with the stage they go to."""
    return stream.withColumn("stage", route(F.col(stem)))


def stage_counts(stream: DataFrame, at: str, late: str = "1 day", every: str = "1 hour") -> DataFrame:
    """Items by stage and hour; late rows count until the watermark passes."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "stage", "n")


def split_errors(df: DataFrame, ok: str) -> tuple[DataFrame, DataFrame]:
    """Rows that go on, and rows for the failed stage from which they can be put back."""
    return df.filter(F.col(ok)), df.filter(~F.coalesce(F.col(ok), F.lit(False))).withColumn("stage", F.lit("tab4_failed"))


def put_back(failed: DataFrame, stage: str) -> DataFrame:
    """Failed rows for another try in a stage."""
    return failed.withColumn("stage", F.lit(stage))


def translate_stream(stream: DataFrame, state_path: str, checkpoint: str, model: TextModel) -> StreamingQuery:
    """Paragraphs (chapter_id, idx, src) into a state table, to which each batch adds only its own rows under its number.

    The state of a paragraph is its row of the newest batch, read where a batch has the same
    paragraph. A batch that is run again reads the batches before it and writes the same
    folder, so a restart neither repeats an answer nor loses one; every batch writes a
    folder, so one that is gone is noticed instead of being taken for an empty state.
    """

    def batch(df: DataFrame, no: int) -> None:
        spark = df.sparkSession
        known = state_before(spark, state_path, no) if no else spark.createDataFrame([], _STATE)
        own = known.join(df.select("chapter_id", "idx").distinct(), ["chapter_id", "idx"], "left_semi")
        translate_chapters(df, own, model).write.mode("overwrite").parquet(f"{state_path}/batch={no}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "chapter_id long, idx long, src string, tgt string, status string"


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batch folders, by the file system that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def state_before(spark: SparkSession, state_path: str, no: int) -> DataFrame:
    """The newest row of each paragraph over the batches before ``no``; an error if one of them is missing."""
    there = [n for n in _batches(spark, state_path) if n < no]
    if there != list(range(no)):
        raise FileNotFoundError(f"{state_path}: batches {sorted(set(range(no)) - set(there))} are missing")
    rows = spark.read.schema(f"{_STATE}, batch int").parquet(state_path).filter(F.col("batch") < no)
    newest = rows.groupBy("chapter_id", "idx").agg(F.max_by(F.struct("src", "tgt", "status"), "batch").alias("s"))
    return newest.select("chapter_id", "idx", "s.*")


def latest_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The state after the last batch."""
    return state_before(spark, state_path, max(_batches(spark, state_path), default=-1) + 1)
