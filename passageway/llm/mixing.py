"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within
from passageway.llm.common import written
from passageway.llm.order import hash_part, running_sum, size_class

#: Expected copies are counted in 1 / UNIT, as integers: exact sums up to 1e11 copies of a source.
UNIT_BITS = 26
UNIT = 1 << UNIT_BITS


def capped_targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Targets of sources by weight, none above ``most`` times its size, the excess shared anew by weight.

    ``sources``: one row per source with ``source``, ``source_size``. The weights repeat along the sources in code
    point order, null last. With caps sorted by cap / weight, sources before some place stop at their caps and the others
    get weight * level; this is what repeated sharing ends at. The windows have one narrow row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    up = Window.orderBy("ratio", "place")
    total = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    df = sources.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    df = df.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "budget": F.sum("source_size").over(total) * F.lit(float(share))})
    df = df.withColumn("ratio", F.col("cap") / F.col("weight"))
    df = df.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    df = df.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    # The level rises along the sources that stop at their caps and falls after them.
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(total))
    return df.select("source", "source_size", F.round(target, 6).alias("target"))


def systematic_copies(df: DataFrame, stratum: list[str], expected: str, size: str, key: list[str], offset: Column, out: str = "copies") -> DataFrame:
    """Copies per row by systematic sampling within each stratum.

    ``expected`` holds the expected copies of a row in 1 / ``UNIT`` (a whole number). Rows are laid end to end, each
    as long as its expected copies; with one random ``offset`` (0 to 1, a function of the stratum) a row is emitted
    once for each whole number its stretch crosses, so at most ``ceil(expected)`` and at least ``floor(expected)``
    times. Rows lie in order of ``size``, so what is taken follows the sizes within the stratum.
    """
    laid = df.withColumns({"_class": size_class(F.col(size)), "_part": hash_part(*map(F.col, key))})
    laid = running_sum(laid, stratum, expected, "_class", "_part", [size, *key], "_end")
    shift = F.floor(offset * UNIT).cast("bigint")
    end = F.col("_end")
    copies = F.shiftright(end + shift, UNIT_BITS) - F.shiftright(end - F.col(expected) + shift, UNIT_BITS)
    return laid.withColumn(out, copies).drop("_class", "_part", "_end")


def mix_sources(
    docs: DataFrame, size: str = "size", weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """``docs`` (doc_id, source, and the number of words in ``size``) with source_size, target, copies and taken.

    Every document of a source has the same expected number of copies, target / source_size. Nulls: a null source is
    a source of its own, last in order; a null doc_id takes part like any other; a null size is 0. Sources without
    words have target 0 and no copies. Repeated rows are separate documents. An empty table gives no rows. Columns of
    the input are kept; the added ones replace columns of the same names.
    """
    weights = weights or [5, 2, 1]
    docs = docs.drop("source_size", "target", "copies", "taken").withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("bigint"))
    sources = docs.groupBy("source").agg(F.sum(size).alias("source_size"))
    targets = written(capped_targets(sources, weights, share, most), "targets").withColumn(
        "_expected", F.coalesce(F.round(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")) * UNIT), F.lit(0)).cast("bigint")
    )
    name = F.col("source")
    docs = docs.withColumn("_source", F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name)))
    targets = targets.withColumn("_source", F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name))).drop("source")
    joined = docs.join(broadcast_within(targets), "_source")
    offset = hash_part(F.lit(seed), F.col("_source"), parts=1 << 20) / F.lit(float(1 << 20))
    copies = systematic_copies(joined, ["_source"], "_expected", size, ["doc_id"], offset)
    return copies.withColumn("taken", F.col("copies") * F.col(size)).drop("_source", "_expected")


def take_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy taken."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
