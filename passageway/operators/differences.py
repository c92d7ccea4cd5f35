"""Which rows of two fixed sets differ: digests of rows in ranges of a hash, compared from the top down.

A set is stored as digests by key, in directories of families of hash ranges and sorted by range, each range with its
number of rows and the sum of their digests. Two sets are compared by their families, then by the ranges of those
that differ; only ranges that differ are read for rows. Equal sets are told by the top alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize
from passageway.functions.text import hex_number

#: Ranges of a family, and families of a set, as powers of two.
RANGE_BITS, FAMILY_BITS = 6, 6
_ROWS = "key string, n bigint, digest decimal(38,0), range int, family int"
_SUMS = "family int, range int, n bigint, digest decimal(38,0)"


def _field(name: str) -> Column:
    """A value as text that no other value has: nulls and the joints between columns cannot be mistaken."""
    text = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _number(columns: Sequence[str]) -> Column:
    return hex_number(F.md5(F.concat_ws("|", *map(_field, columns))), 15)


def store_digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], out_dir: str) -> None:
    """Store the digests of the rows of ``df`` by key, replacing what was there.

    ``columns`` are what is compared, ``keys`` what names a row; rows of one key (nulls are a key) are one entry with
    their number and the sum of their digests, made with sums on the map side, so a key of any number of rows is not hot.
    """
    ranges = (1 << (RANGE_BITS + FAMILY_BITS)) - 1
    key = F.concat_ws("|", *map(_field, keys))
    row = df.select(key.alias("key"), _number(columns).cast("decimal(38,0)").alias("digest"))
    rows = row.groupBy("key").agg(F.count("*").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    rows = rows.withColumn("range", hex_number(F.md5("key"), 6).bitwiseAND(F.lit(ranges)).cast("int"))
    rows = rows.withColumn("family", F.shiftright("range", RANGE_BITS).cast("int"))
    rows.hint("rebalance", "family").sortWithinPartitions("family", "range").write.mode("overwrite").partitionBy("family").parquet(f"{out_dir}/rows")
    # Of a range: entries and the sum of digests that hold the key, the number and the digest of each entry.
    whole = hex_number(F.md5(F.concat_ws("|", "key", F.col("n").cast("string"), F.col("digest").cast("string"))), 15).cast("decimal(38,0)")
    stored = df.sparkSession.read.schema(_ROWS).parquet(f"{out_dir}/rows")
    sums = stored.groupBy("family", "range").agg(F.count("*").alias("n"), F.sum(whole).cast("decimal(38,0)").alias("digest"))
    sums.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/sums")  # at most 4,096 rows


def _differing(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    side = lambda df, name: df.groupBy(by).agg(F.struct(F.sum("n"), F.sum("digest")).alias(name))
    joined = side(a, "a").join(side(b, "b"), by, "full_outer")
    return joined.filter(~F.col("a").eqNullSafe(F.col("b"))).select(by)


def differing_ranges(spark: SparkSession, dir_a: str, dir_b: str) -> list[int]:
    """The hash ranges in which two stored sets differ, found among the families that differ; 4,096 at most."""
    a, b = (spark.read.schema(_SUMS).parquet(f"{d}/sums") for d in (dir_a, dir_b))
    families = F.broadcast(materialize(_differing(a, b, "family")))
    inside = [x.join(families, "family", "left_semi") for x in (a, b)]
    return sorted(r.range for r in _differing(*inside, "range").collect())


def changed_rows(spark: SparkSession, dir_a: str, dir_b: str) -> DataFrame:
    """(key, change) of the rows that differ between two stored sets: ``added``, ``removed`` or ``changed``.

    A key is written as its values, each after its length (``2:17``), null as ``-``. Reads the ranges that differ alone.
    """
    ranges = differing_ranges(spark, dir_a, dir_b)
    wanted = F.col("family").isin(sorted({r >> RANGE_BITS for r in ranges})) & F.col("range").isin(ranges)
    a, b = (spark.read.schema(_ROWS).parquet(f"{d}/rows").filter(wanted) for d in (dir_a, dir_b))
    side = lambda df, name: df.select("range", "key", F.struct("n", "digest").alias(name))
    joined = side(a, "a").join(side(b, "b"), ["range", "key"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return joined.select("key", change.alias("change"))


def named(changes: DataFrame, *frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key columns of changed rows, from the frames they came from: (*keys, change)."""
    short = broadcast_within(materialize(changes))
    found = None
    for df in frames:
        rows = df.select(*keys, F.concat_ws("|", *map(_field, keys)).alias("key")).join(short, "key").select(*keys, "change")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()
