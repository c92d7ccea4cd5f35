"""Chunks with stable numbers, and the checks on collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize
from passageway.functions.text import hex_number

# Neighbouring ids summed together on each level of the numbering.
_FANOUT_BITS = 12
# Sums (three numbers each) that one task may run through.
_ROWS_IN_ONE_TASK = 1_000_000


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    """Number of windows of ``size`` characters, ``size - overlap`` apart, that cover ``length`` characters."""
    step = size - overlap
    rest = F.greatest(F.ceil((length - F.lit(overlap)) / F.lit(step)), F.lit(1))
    return F.when(length > 0, rest).otherwise(F.lit(0)).cast("bigint")


def pieces(last: Column, size: int, overlap: int) -> Column:
    """The windows 0 to ``last`` of the column ``text``."""
    step = size - overlap
    windows = F.sequence(F.lit(0).cast("bigint"), last)
    return F.transform(windows, lambda i: F.col("text").substr((i * step + 1).cast("int"), F.lit(size)))


def before(parent: list[str], order: str) -> Column:
    """The sum of ``n`` over all rows of the same parent before this one."""
    w = Window.partitionBy(*parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def _offsets(sums: DataFrame, bits_left: int) -> DataFrame:
    """(collection, block, offset) from (collection, block, n): what all smaller blocks hold.

    Few blocks are run through directly.  Many are summed in families first, so that no window ever
    sees more than the members of one family, however the ids are spread.
    """
    if bits_left <= _FANOUT_BITS or sums.count() <= _ROWS_IN_ONE_TASK:
        return sums.select("collection", "block", before(["collection"], "block").alias("offset"))
    member = sums.withColumn("family", F.shiftright("block", _FANOUT_BITS))
    families = materialize(member.groupBy("collection", F.col("family").alias("block")).agg(F.sum("n").alias("n")))
    above = _offsets(families, bits_left - _FANOUT_BITS).withColumnRenamed("block", "family")
    return (
        member.withColumn("inside", before(["collection", "family"], "block"))
        .join(above, ["collection", "family"])
        .select("collection", "block", (F.col("offset") + F.col("inside")).alias("offset"))
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """Add ``before``, the chunks of all documents with a smaller id in the same collection.

    A running sum over a collection would be one task.  Instead the chunks of every 4,096
    neighbouring ids are summed (a pass over the lengths alone), the sums turned into offsets, and
    the running sum left to do is that inside a block.
    """
    docs = docs.withColumn("block", F.shiftright("doc_id", _FANOUT_BITS))
    sums = materialize(docs.groupBy("collection", "block").agg(F.sum("n").alias("n")))
    offsets = materialize(_offsets(sums, 64 - _FANOUT_BITS))
    return (
        docs.withColumn("inside", before(["collection", "block"], "doc_id"))
        .join(broadcast_within(offsets), ["collection", "block"])
        .withColumn("before", F.col("offset") + F.col("inside"))
    )


def present(name: str) -> Column:
    """The column; a null ends the job with a message."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"a document has no {name}"))).alias(name)


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 400, length_col: str | None = None) -> DataFrame:
    """Cut documents into overlapping passages, numbered 1, 2, ... per collection.

    ``docs`` needs ``doc_id`` (unique per collection, not null) and ``text``; without a ``collection``
    column (not null) all belong to collection ``corpus``.  Numbers follow document id, then position, so the same
    documents always get the same numbers.  A passage no longer than ``overlap`` is whole in at
    least one chunk.  ``length_col`` names a column that holds the length of the text in characters;
    with it the texts are read once instead of twice.  A length that is not the text's, and a null id or
    collection, end the job with a message: neither loses a document silently.  A null text is empty.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    if "collection" not in docs.columns:
        docs = docs.withColumn("collection", F.lit("corpus"))
    length = F.coalesce(F.col(length_col) if length_col else F.length("text"), F.lit(0))
    counted = docs.select(
        present("collection"), present("doc_id"), F.coalesce("text", F.lit("")).alias("text"), chunk_count(length, size, overlap).alias("n"), length.alias("length")
    )
    numbered = _numbered(counted).withColumn("last", F.col("n") - 1)
    if length_col:
        stale = F.concat(F.lit("the stored length of document "), F.col("doc_id").cast("string"), F.lit(" is not that of its text"))
        right = F.length("text") == F.col("length")
        numbered = numbered.withColumn("text", F.when(right, F.col("text")).otherwise(F.raise_error(stale)))
        # The check must see texts that yield no chunk, too.
        numbered = numbered.withColumn("last", F.when(right, F.col("last")).otherwise(F.raise_error(stale)))
    return (
        numbered.filter(F.col("last") >= 0)
        .select("collection", "doc_id", "before", F.posexplode(pieces(F.col("last"), size, overlap)).alias("pos", "text"))
        .select("collection", (F.col("before") + F.col("pos") + 1).alias("chunk_no"), "doc_id", "pos", "text")
    )


def resolve_collection(sources: DataFrame, session_col: str = "session") -> DataFrame:
    """The documents each session asks: its uploaded ones if there are any, else the built-in ones."""
    uploaded = sources.filter(F.col("origin") == "uploaded")
    builtin = sources.filter(F.col("origin") == "builtin")
    replaced = broadcast_within(materialize(uploaded.select(session_col).distinct()))
    return uploaded.unionByName(builtin.join(replaced, session_col, "left_anti"))


def audit_collection(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Per collection: stored and expected count, repeated numbers, repeated texts, verdict.

    ``expected`` has (collection, expected).  A surplus copy counts once per extra row.  A
    collection on one side only is reported too.
    """
    numbers = (
        chunks.groupBy("collection", "chunk_no")
        .count()
        .groupBy("collection")
        .agg(F.sum("count").alias("n_chunks"), F.sum(F.col("count") - 1).alias("repeated_numbers"))
    )
    texts = (
        chunks.groupBy("collection", F.sha2("text", 256).alias("digest"))
        .count()
        .groupBy("collection")
        .agg(F.sum(F.col("count") - 1).alias("repeated_texts"))
    )
    joined = numbers.join(texts, "collection").join(expected, "collection", "full_outer")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "collection",
        F.coalesce("n_chunks", zero).alias("n_chunks"),
        F.coalesce(F.col("expected").cast("bigint"), zero).alias("expected"),
        F.coalesce("repeated_numbers", zero).alias("repeated_numbers"),
        F.coalesce("repeated_texts", zero).alias("repeated_texts"),
    ).withColumn("ok", (F.col("n_chunks") == F.col("expected")) & (F.col("repeated_numbers") == 0))


def _by_number(chunks: DataFrame, side: str, keys: list[str]) -> DataFrame:
    digest = hex_number(F.sha2("text", 256), 15).cast("decimal(38,0)")
    return chunks.groupBy(*keys).agg(F.struct(F.count("*"), F.sum(digest)).alias(side))


def align_numbering(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chunk_no",)) -> DataFrame:
    """Compare two numberings: ``same``, ``different``, ``left_only`` or ``right_only`` per number.

    ``keys`` name a passage; frames that hold several collections need ("collection", "chunk_no").

    Each number is reduced to the count and digest sum of its texts before the join, so the join
    carries no passages and a number stored many times by mistake does not multiply.
    """
    status = (
        F.when(F.col("right").isNull(), "left_only")
        .when(F.col("left").isNull(), "right_only")
        .when(F.col("left") == F.col("right"), "same")
        .otherwise("different")
    )
    keys = list(keys)
    joined = _by_number(left, "left", keys).join(_by_number(right, "right", keys), keys, "full_outer")
    return joined.select(*keys, status.alias("status"))
