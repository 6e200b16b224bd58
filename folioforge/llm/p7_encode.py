"""Problem 7: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.tokenizer import decode_ids, encode_documents
from folioforge.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document by byte_bpe_50k; null and empty texts give an empty list."""
    return encode_documents(table(spark, sf_dir, "documents"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded lengths by source: every text must come back from its ids, so ``changed`` is 0."""
    docs = table(spark, sf_dir, "documents")
    back = decode_ids(encode_documents(docs)).withColumnRenamed("text", "back")
    both = docs.select("doc_id", "source", "text").join(back, "doc_id")
    return both.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.length("back")).alias("n_chars"),
        F.sum((F.coalesce("text", F.lit("")) != F.col("back")).cast("long")).alias("changed"),
    )


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}

SQL = {
    "p7_roundtrip": """
        SELECT source, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS changed
        FROM documents GROUP BY source""",
}
