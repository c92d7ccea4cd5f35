"""Corpus scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def load_documents(
    spark: SparkSession,
    path: str,
    langs: Sequence[str] | None = None,
    sources: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Documents as rows; language and source filters and the column choice reach the Parquet scan."""
    docs = spark.read.schema(DOCUMENTS).parquet(path)
    if langs is not None:
        docs = docs.filter(F.col("lang").isin(list(langs)))
    if sources is not None:
        docs = docs.filter(F.col("source").isin(list(sources)))
    return docs.select(*columns) if columns else docs


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal out a scan that has fewer splits than there are cores, before work that is heavy per row.

    Such a table is small (or one file without inner cuts), so moving it is cheap.  A table with
    enough splits is returned as it is.  Meant for scans: a plan with shuffles would be run to be asked.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, key) if docs.rdd.getNumPartitions() < cores else docs
