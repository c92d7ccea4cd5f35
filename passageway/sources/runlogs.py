"""Run logs: written one per result directory, transcribed back into metric rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run_logs(metrics: DataFrame, out_dir: str) -> None:
    """One ``config_id=<id>`` directory per run with its metrics as text lines ``metric = value``."""
    (
        metrics.select("config_id", F.format_string("%s = %s", "metric", F.col("value").cast("string")).alias("line"))
        .repartition("config_id")
        .write.mode("overwrite")
        .partitionBy("config_id")
        .text(out_dir)
    )


def parse_run_logs(spark: SparkSession, glob: str, patterns: Mapping[str, str]) -> DataFrame:
    """(path, metric, value, state) for every log file that matches ``glob`` and every pattern.

    ``patterns`` maps a metric to a regular expression whose first group is the number.  A file is
    one row (line order would be lost across splits) and the last match in a file counts.  ``state`` is
    ``found``, ``absent`` (no match) or ``unreadable`` (a match that is no number); value is null in the last two.
    """
    logs = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.try_element_at(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), F.lit(-1)).alias("text"),
            )
            for metric, pattern in patterns.items()
        ]
    )
    text = F.col("m.text")
    value = text.try_cast("double")
    state = F.when(text.isNull(), "absent").when(value.isNull(), "unreadable").otherwise("found")
    return logs.select("path", F.explode(found).alias("m")).select("path", F.col("m.metric").alias("metric"), value.alias("value"), state.alias("state"))
