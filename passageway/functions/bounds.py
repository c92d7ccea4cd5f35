"""Size checks that decide whether a side may be broadcast, and reliable storage for intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary folder only on a local master that names none.

    On a cluster a folder of the driver would be out of the executors' reach, so none being named is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="passageway-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, keep on reliable storage: later actions neither recompute nor lose it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") + 16
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.NumericType):
            return F.greatest(F.size(c), F.lit(0)).cast("bigint") * 8 + 16
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("bigint") * 2 + 16
    if isinstance(field.dataType, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("bigint") * 2 + 16
    return F.lit(16).cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    """Bytes held by the rows of ``df``, by a distributed sum (one number reaches the driver)."""
    width = F.lit(16).cast("bigint")
    for field in df.schema.fields:
        width = width + _width(field)
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0])


def broadcast_within(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it, else ``df`` as it is.

    Without the hint Spark plans a shuffled join, whose hot partitions AQE splits.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
