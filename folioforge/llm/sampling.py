"""A share of a table's rows, chosen by their ids alone: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, id_col: str, share: float) -> DataFrame:
    """About ``share`` of the rows, by the hash of the id over its full range, so the smallest share still draws rows; all of them for 1 or more. Null ids hash like any value."""
    return df if share >= 1 else df.filter(F.xxhash64(id_col) < F.lit(-(2**63) + int(share * 2**64)).cast("long"))
