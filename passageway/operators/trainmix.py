"""Training mixtures with exact counts, and audits of them.

``records`` has (rec_id, kind, source_ref, prompt, response), ``rec_id`` unique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize
from passageway.functions.text import hex_number


def variants(records: DataFrame, specs: DataFrame, seed: str = "0") -> DataFrame:
    """Rows of each mixture: ``specs`` has (variant, kind, n), the result one row per use.

    A variant takes the n records of a kind that come first in the order of
    ``md5(rec_id|seed)``, all of them if there are fewer.  Variants with the same seed are nested,
    so two of them differ by size or by composition alone.

    The order is never sorted as a whole: a histogram of 65,536 hash ranges finds the range where n
    is reached, whole ranges below it are taken in place, and only rows of that range are ranked.
    """
    order = F.md5(F.concat_ws("|", F.col("rec_id").cast("string"), F.lit(seed)))
    hashed = records.withColumn("_order", order).withColumn("_range", hex_number(F.col("_order"), 4))

    histogram = hashed.groupBy("kind", "_range").agg(F.count("*").alias("rows"))
    below = Window.partitionBy("kind").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    histogram = histogram.withColumn("before", F.coalesce(F.sum("rows").over(below), F.lit(0)))
    wanted = specs.select("variant", "kind", F.col("n").cast("bigint").alias("n"))
    # The last range with room left; its rank bound is what is missing after the ranges before it.
    cuts = (
        wanted.join(histogram, "kind")
        .filter(F.col("before") < F.col("n"))
        .groupBy("variant", "kind")
        .agg(F.max("_range").alias("_edge"), F.max_by(F.col("n") - F.col("before"), "_range").alias("_room"))
    )
    # One row per variant and kind, computed once: the records themselves are not shuffled by kind.
    used = hashed.join(broadcast_within(materialize(cuts)), "kind")
    whole = used.filter(F.col("_range") < F.col("_edge"))
    within = Window.partitionBy("variant", "kind").orderBy("_order", "rec_id")
    edge = (
        used.filter(F.col("_range") == F.col("_edge"))
        .withColumn("_rank", F.row_number().over(within))
        .filter(F.col("_rank") <= F.col("_room"))
        .drop("_rank")
    )
    return whole.unionByName(edge).select("variant", *records.columns)


def mix(records: DataFrame, counts: Mapping[str, int], seed: str = "0", short: str = "error") -> DataFrame:
    """One mixture with exactly ``counts[kind]`` records of each kind.

    Where there are fewer, ``short="error"`` raises and ``short="take"`` takes all there are.
    """
    if short not in ("error", "take"):
        raise ValueError("short must be 'error' or 'take'")
    spark = records.sparkSession
    if short == "error":
        wanted = records.filter(F.col("kind").isin(list(counts)))
        have = {r["kind"]: r["count"] for r in wanted.groupBy("kind").count().collect()}  # a row for each kind asked
        lacking = {kind: n - have.get(kind, 0) for kind, n in counts.items() if have.get(kind, 0) < n}
        if lacking:
            raise ValueError(f"records are lacking: {lacking}")
    specs = spark.createDataFrame([("mix", kind, n) for kind, n in counts.items()], "variant string, kind string, n bigint")
    return variants(records, specs, seed).drop("variant")


def untraceable(records: DataFrame, chunks: DataFrame, kinds: Sequence[str] = ("real",)) -> DataFrame:
    """Records of the given kinds whose ``source_ref`` is missing or names no stored source."""
    known = broadcast_within(materialize(chunks.select("source_ref").distinct()))
    return records.filter(F.col("kind").isin(list(kinds))).join(known, "source_ref", "left_anti")


def provenance_audit(records: DataFrame, chunks: DataFrame, kinds: Sequence[str] = ("real",)) -> DataFrame:
    """Per kind: records, and how many of them must be traced but cannot."""
    lost = untraceable(records, chunks, kinds).groupBy("kind").agg(F.count("*").alias("n_lost"))
    return (
        records.groupBy("kind")
        .agg(F.count("*").alias("n_records"))
        .join(lost, "kind", "left")
        .select("kind", "n_records", F.coalesce("n_lost", F.lit(0)).alias("n_untraceable"))
        .withColumn("ok", F.col("n_untraceable") == 0)
    )


def distribution_gap(train: DataFrame, evalset: DataFrame, key: str) -> DataFrame:
    """Shares of each key value on both sides, their difference, and the total variation distance."""
    a = train.groupBy(key).agg(F.count("*").alias("n_train"))
    b = evalset.groupBy(key).agg(F.count("*").alias("n_eval"))
    zero = F.lit(0).cast("bigint")
    counts = a.join(b, key, "full_outer").select(
        key, F.coalesce("n_train", zero).alias("n_train"), F.coalesce("n_eval", zero).alias("n_eval")
    )
    all_train = a.agg(F.sum("n_train")).scalar()
    all_eval = b.agg(F.sum("n_eval")).scalar()
    shares = counts.withColumn("p_train", F.coalesce(F.try_divide(F.col("n_train"), all_train), F.lit(0.0))).withColumn(
        "p_eval", F.coalesce(F.try_divide(F.col("n_eval"), all_eval), F.lit(0.0))
    )
    gap = F.abs(F.col("p_train") - F.col("p_eval"))
    distance = shares.agg(F.sum(gap) / 2).scalar()
    return shares.withColumn("gap", F.col("p_train") - F.col("p_eval")).withColumn("total_variation", distance)
