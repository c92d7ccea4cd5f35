"""What several operators of this subpackage share: words, folds, written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.functions.bounds import scratch_path

#: A word: characters other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(key: Column | str, modulus: int = 5) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that no later job repeats it or loses it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

