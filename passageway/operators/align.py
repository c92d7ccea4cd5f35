"""Two numberings of passages compared as an edit: what moved its number only, what moved place, what came and went.

Passages whose text occurs once on either side are anchors. Runs of anchors that stand one after the other on both sides
are found inside blocks of 4,096 numbers and joined across blocks; the heaviest chain of runs that rises on both sides is
what kept its order, and anchors outside it have moved. An inserted passage is thus one insertion, although it changes
the number of everything behind it.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageway.functions.bounds import materialize

BLOCK_BITS = 12
#: Runs that one task chains. Numberings with more are chained family by family (blocks of blocks of numbers), and the
#: families' chains once more as a whole.
CHAIN_ROWS = 1_000_000


def _digest(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def _side(chunks: DataFrame, number: str) -> DataFrame:
    """(collection, digest, number of the only passage with it or null, how many there are)."""
    rows = chunks.select("collection", _digest("text").alias("digest"), "chunk_no")
    # Sums on the map side: a text that is everywhere is a row per task.
    return rows.groupBy("collection", "digest").agg(F.count("*").alias(f"n_{number}"), F.min("chunk_no").alias(number))


def _runs(anchors: DataFrame) -> DataFrame:
    """(collection, l, r, n): maximal runs of anchors whose numbers both go up by one, inside blocks of left numbers."""
    block = F.shiftright("l", BLOCK_BITS)
    order = Window.partitionBy("collection", "_block").orderBy("l")
    new = (F.col("l") - F.lag("l").over(order) != 1) | (F.col("r") - F.lag("r").over(order) != 1)
    marked = anchors.withColumn("_block", block).withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("collection", "_block", "_run").agg(F.min("l").alias("l"), F.min("r").alias("r"), F.count("*").alias("n")).drop("_block", "_run")


def heaviest_chain(runs: list[tuple[int, int, int]]) -> list[int]:
    """Indices of the runs (l, r, n), in order of l, that rise in r and hold most anchors; ties to the run that ends first.

    Runs do not overlap on either side. ``ends`` holds, by rising r, the chains that no lighter or equal r beats.
    """
    ends: list[int] = []  # r of the last run of a chain
    best: list[tuple[int, int]] = []  # its weight and last run
    back = [-1] * len(runs)
    for i, (_, r, n) in enumerate(runs):
        at = bisect.bisect_left(ends, r)
        weight, back[i] = (best[at - 1][0] + n, best[at - 1][1]) if at else (n, -1)
        stop = at
        while stop < len(ends) and best[stop][0] <= weight:
            stop += 1
        ends[at:stop] = [r]
        best[at:stop] = [(weight, i)]
    chain, i = [], best[-1][1] if best else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def _chained(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The runs (collection, l, r, n) of each group that are in its heaviest chain."""

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by("l")
        rows = list(zip(group.column("l").to_pylist(), group.column("r").to_pylist(), group.column("n").to_pylist()))
        return group.take(pa.array(heaviest_chain(rows), pa.int64())).select(["collection", "l", "r", "n"])

    return runs.groupBy(*keys).applyInArrow(chain, "collection string, l bigint, r bigint, n bigint")


def _joined(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that go on where the one before them ends, as one."""
    order = Window.partitionBy(*keys).orderBy("l")
    goes_on = (F.lag("l").over(order) + F.lag("n").over(order) == F.col("l")) & (F.lag("r").over(order) + F.lag("n").over(order) == F.col("r"))
    marked = runs.withColumn("_new", F.coalesce(~goes_on, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("l").alias("l"), F.min("r").alias("r"), F.sum("n").alias("n")).drop("_run")


def _kept_runs(anchors: DataFrame) -> DataFrame:
    runs = materialize(_runs(anchors))
    largest = runs.groupBy("collection").count().agg(F.max("count")).first()[0] or 0
    if largest > CHAIN_ROWS:
        family = F.shiftright("l", 2 * BLOCK_BITS)
        runs = materialize(_chained(_joined(runs.withColumn("_family", family), ["collection", "_family"]), ["collection", "_family"]))
    return materialize(_chained(_joined(runs, ["collection"]), ["collection"]))


def align_shifted(left: DataFrame, right: DataFrame) -> DataFrame:
    """(collection, left_no, right_no, status) of every passage of two frames (collection, chunk_no, text).

    ``same``: the number is the same; ``shifted``: the order is, the number not; ``moved``: it stands elsewhere in the
    order; ``deleted`` and ``inserted``: the text is on one side only; ``repeated``: the text is on both sides and more
    than once on one of them, so it cannot be said which is which (a row for every such passage, on its own side).
    Texts are compared by 128 bits of a digest; a null text is empty. Numbers are unique in a collection. Without
    ``collection`` all passages are one collection.
    """
    left, right = (x if "collection" in x.columns else x.withColumn("collection", F.lit("corpus")) for x in (left, right))
    both = _side(left, "l").join(_side(right, "r"), ["collection", "digest"], "full_outer")
    both = materialize(both)
    anchors = materialize(both.filter("n_l = 1 AND n_r = 1").select("collection", "l", "r"))
    kept = _kept_runs(anchors).select("collection", F.col("l").alias("_l"), (F.col("r") - F.col("l")).alias("_shift"), "n")
    # A run of the chain is spread over the blocks it reaches into, so that every anchor finds its run by block.
    blocks = F.sequence(F.shiftright("_l", BLOCK_BITS), F.shiftright(F.col("_l") + F.col("n") - 1, BLOCK_BITS))
    spread = kept.select("*", F.explode(blocks).alias("_block"))
    found = anchors.withColumn("_block", F.shiftright("l", BLOCK_BITS)).join(spread, ["collection", "_block"], "left")
    within = F.coalesce((F.col("l") >= F.col("_l")) & (F.col("l") < F.col("_l") + F.col("n")) & (F.col("r") - F.col("l") == F.col("_shift")), F.lit(False))
    ordered = found.groupBy("collection", "l", "r").agg(F.bool_or(within).alias("_ordered"))
    status = F.when(~F.col("_ordered"), "moved").when(F.col("l") == F.col("r"), "same").otherwise("shifted")
    placed = ordered.select("collection", F.col("l").alias("left_no"), F.col("r").alias("right_no"), status.alias("status"))

    def others(chunks: DataFrame, mine: str, theirs: str, alone: str) -> DataFrame:
        rows = chunks.select("collection", _digest("text").alias("digest"), F.col("chunk_no").cast("bigint").alias("no"))
        state = both.filter(f"n_{mine} IS NOT NULL AND NOT (n_l <=> 1 AND n_r <=> 1)")
        state = state.select("collection", "digest", F.when(F.col(f"n_{theirs}").isNull(), alone).otherwise("repeated").alias("status"))
        none = F.lit(None).cast("bigint")
        left_no, right_no = (F.col("no"), none) if mine == "l" else (none, F.col("no"))
        return rows.join(state, ["collection", "digest"]).select("collection", left_no.alias("left_no"), right_no.alias("right_no"), "status")

    return placed.unionByName(others(left, "l", "r", "deleted")).unionByName(others(right, "r", "l", "inserted"))
