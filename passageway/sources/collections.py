"""Stored collections: one Parquet directory, one partition per collection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("chunk_no", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("collection", T.StringType()),
    ]
)


def write_collections(chunks: DataFrame, out_dir: str, replaced: Iterable[str] | None = None) -> None:
    """Replace every collection that occurs in ``chunks``; leave the others alone.

    Collections named in ``replaced`` are replaced as well if no chunk of theirs occurs: their contents go. Rows are
    brought together by collection before writing, in partitions that Spark sizes by bytes, so a collection has as many
    files as its size asks for, whatever the number of tasks.
    """
    spark = chunks.sparkSession
    names = sorted(set(replaced or ()))
    before = {name: _files(spark, out_dir, "collection", name) for name in names}
    (
        chunks.select(*[f.name for f in CHUNKS.fields])
        .hint("rebalance", "collection")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection")
        .parquet(out_dir)
    )
    # What was written is seen from the files, so the chunks are made once: a partition that still holds what it held
    # before got nothing new.
    for name in names:
        if before[name] and _files(spark, out_dir, "collection", name) == before[name]:
            remove_partition(spark, out_dir, collection=name)


def partition_path(spark: SparkSession, root: str, **values) -> str:
    """The directory of a partition, names escaped as Spark escapes them."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join([root.rstrip("/"), *(f"{k}={utils.escapePathName(str(v))}" for k, v in values.items())])


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the store that holds ``path``."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _files(spark: SparkSession, out_dir: str, column: str, value: str) -> set[str]:
    system, path = file_system(spark, partition_path(spark, out_dir, **{column: value}))
    return {x.getPath().getName() for x in system.listStatus(path)} if system.exists(path) else set()


def remove_partition(spark: SparkSession, out_dir: str, **values) -> None:
    """Delete one partition directory, on whatever file system it lies."""
    system, path = file_system(spark, partition_path(spark, out_dir, **values))
    system.delete(path, True)


def build_collection(chunks: DataFrame, name: str, out_dir: str) -> None:
    """Store ``chunks`` as the whole content of collection ``name``.

    Building twice leaves what building once leaves: the partition is replaced, never appended to, also by nothing.
    """
    write_collections(chunks.withColumn("collection", F.lit(name)), out_dir, [name])


def open_collection(
    spark: SparkSession, out_dir: str, name: str | None = None, cache: bool = False
) -> DataFrame:
    """Read a stored collection (all of them if no name is given).

    The filter is on the partition column, so only that directory is listed and read.  ``cache``
    keeps the rows in executor memory, spilling to disk; lost blocks are read again from storage.
    """
    chunks = spark.read.schema(CHUNKS).parquet(out_dir)
    if name is not None:
        chunks = chunks.filter(F.col("collection") == name)
    return chunks.persist(StorageLevel.MEMORY_AND_DISK) if cache else chunks


def write_vectors(vectors: DataFrame, out_dir: str) -> None:
    """Store (id, embedding, cell) partitioned by cell, replacing what was there.

    Components are stored as FLOAT, whatever they were. Rows are brought together by cell first, in partitions that
    Spark sizes by bytes, so that tasks do not leave a file each in every cell.
    """
    stored = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"), "cell")
    stored.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(out_dir)


def open_vectors(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("id bigint, embedding array<float>, cell int").parquet(out_dir)
