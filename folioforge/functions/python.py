"""Functions without a built-in counterpart, as Arrow-batched UDFs: normal form, sequence similarity, title case."""

from __future__ import annotations

import difflib
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed normal form; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@pandas_udf(StringType())
def nfd(text: pd.Series) -> pd.Series:
    """Decomposed normal form, as some file systems name files; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


@pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of ``a`` against ``b``, whose order matters; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@pandas_udf(StringType())
def english_title(text: pd.Series) -> pd.Series:
    """Title case for titles in capitals without Hangul."""
    return text.map(lambda t: t.title() if t and t.isupper() and not re.search("[가-힣]", t) else t)


@pandas_udf(StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if not link_ else urljoin(b or "", link_) for b, link_ in zip(base, link)])


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL."""
    for name, f in (("nfc", nfc), ("seq_ratio", seq_ratio), ("py_title", english_title), ("absolute_url", absolute_url)):
        spark.udf.register(name, f)
