"""Uploads become built collections without a manual step."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from passageway.functions.bounds import materialize
from passageway.operators.corpus import chunk_documents
from passageway.sources.blocks import build_batch
from passageway.sources.collections import write_collections

UPLOADS = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
_STORED = T.StructType(
    [
        *UPLOADS.fields[1:],
        UPLOADS.fields[0],
        T.StructField("version", T.LongType()),
        T.StructField("stream", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
)


def read_uploads(spark: SparkSession, landing_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", files_per_trigger).parquet(landing_dir)


def latest_documents(stored: DataFrame) -> DataFrame:
    """One row per document: the text of its latest upload."""
    return (
        stored.groupBy("collection", "doc_id")
        .agg(F.max_by("text", F.struct("version", F.sha2("text", 256))).alias("text"))
    )


def _stored(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{out_dir}/uploads")


def _version(spark: SparkSession, out_dir: str, stream: str, batch_id: int) -> int:
    """The version a batch was stored under, or the next one: all batches of all streams into ``out_dir`` are one sequence.

    A stream is named by its checkpoint, so a fresh checkpoint starts a new stream whose batch 0 overwrites nothing.
    """
    try:
        versions = _stored(spark, out_dir).groupBy("stream", "batch").agg(F.max("version").alias("version"))
        known = versions.agg(
            F.max(F.when((F.col("stream") == stream) & (F.col("batch") == batch_id), F.col("version"))), F.max("version")
        ).first()
    except AnalysisException:  # nothing has been stored yet
        return 0
    own, last = known
    return own if own is not None else (-1 if last is None else last) + 1


def _build_batch(batch: DataFrame, batch_id: int, out_dir: str, size: int, overlap: int, stream: str = "-") -> None:
    spark = batch.sparkSession
    version = _version(spark, out_dir, stream, batch_id)
    # A replayed batch overwrites its own partitions, so uploads are stored exactly once.
    (
        batch.select("collection", "doc_id", "text")
        .withColumns({"version": F.lit(version).cast("bigint"), "stream": F.lit(stream), "batch": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection", "version", "stream", "batch")
        .parquet(f"{out_dir}/uploads")
    )
    stored = _stored(spark, out_dir)
    # One name for each collection of the batch; they are directories, so no text moves for it.
    touched = [r[0] for r in stored.filter((F.col("stream") == stream) & (F.col("batch") == batch_id)).select("collection").distinct().collect()]
    # All versions count, also those stored after a batch that is replayed.
    documents = latest_documents(stored.filter(F.col("collection").isin(touched)))
    # Uploads and chunks are separate directories: what is read here is not what is replaced.
    chunks = materialize(chunk_documents(documents, size, overlap))
    write_collections(chunks, f"{out_dir}/chunks", touched)


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in the checkpoint: it survives restarts and is new for a new checkpoint."""
    row = spark.read.text(f"{checkpoint}/metadata").first()
    return json.loads(row[0])["id"]


def ingest_stream(
    uploads: DataFrame, out_dir: str, checkpoint: str, size: int = 800, overlap: int = 400, layout: str = "collections"
) -> StreamingQuery:
    """Build the collections named in a stream of uploads; start, process what is there, stop.

    Each micro-batch stores its documents and rewrites the collections they belong to, under
    ``out_dir/chunks``.  Running again, replaying any batch after a failure, or starting anew with another
    checkpoint loses no upload.  A document uploaded again with an empty text has no passages any more.

    With layout ``blocks`` a batch reads and rewrites only the blocks of 4,096 ids that it changed, whatever is stored
    (``sources.blocks``); the result is opened by ``open_blocks(spark, out_dir)``.
    """
    if layout not in ("collections", "blocks"):
        raise ValueError("layout must be 'collections' or 'blocks'")
    batch_builder = build_batch if layout == "blocks" else _build_batch

    def build(batch: DataFrame, batch_id: int) -> None:
        batch_builder(batch, batch_id, out_dir, size, overlap, _stream_name(batch.sparkSession, checkpoint))

    return (
        uploads.writeStream.foreachBatch(build)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
