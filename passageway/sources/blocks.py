"""Collections stored by block: an upload rewrites the blocks it changed and nothing else.

A block is 4,096 neighbouring document ids of a collection, a family 4,096 neighbouring blocks. Passages are stored with
their number inside their block. What stands before a block is kept apart, as a tree of sums of two levels: every block
has a leaf with its number of passages, the sum over the smaller blocks of its family and a digest of its documents;
families are summed when a collection is opened. An upload that makes a document longer or shorter therefore moves the
numbers of all later passages without touching one of them.

Below the root: ``uploads`` (collection, block, version, stream, batch) holds what came in, ``passages`` (collection,
block, version) and ``leaves`` (collection, family, version) what was built. Directories of a version are written once;
readers take the latest leaves and the versions of blocks that these name, so a batch that fails half-way is not seen.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize
from passageway.operators.corpus import before, chunk_count, pieces, present
from passageway.sources.collections import file_system, partition_path, remove_partition

BLOCK_BITS = 12
_UPLOADS = "doc_id bigint, text string, collection string, block bigint, version bigint, stream string, batch bigint"
_PASSAGES = "doc_id bigint, pos int, inside bigint, text string, collection string, block bigint, version bigint"
_LEAVES = "block bigint, block_version bigint, n bigint, inside bigint, digest decimal(38,0), collection string, family bigint, version bigint"


def _append(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that occur in ``df``; those of a version are only ever written by that version."""
    _write(df.hint("rebalance", *partitions), path, *partitions)


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    """``_append`` of rows of which a task holds few partitions, each of them whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _under(spark: SparkSession, root: str, schema: str, folders: list[str]) -> DataFrame:
    """Rows of some directories below ``root``; only those are listed."""
    folders = [x for x in folders if (lambda fs, at: fs.exists(at))(*file_system(spark, x))]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*folders)


def store_uploads(batch: DataFrame, out_dir: str, version: int, stream: str, batch_id: int) -> None:
    """Keep (collection, doc_id, text) of one batch; storing it again replaces it. A null id or collection ends the job."""
    rows = batch.select(present("doc_id"), F.col("text"), present("collection"))
    marks = {"version": F.lit(version).cast("bigint"), "stream": F.lit(stream), "batch": F.lit(batch_id).cast("bigint")}
    rows = rows.withColumn("block", F.shiftright("doc_id", BLOCK_BITS)).withColumns(marks)
    _append(rows, f"{out_dir}/uploads", "collection", "block", "version", "stream", "batch")


def _latest_leaves(leaves: DataFrame) -> DataFrame:
    """The leaves of each family as its last version has them."""
    last = F.max("version").over(Window.partitionBy("collection", "family"))
    return leaves.withColumn("_last", last).filter("version = _last").drop("_last")


def _digest() -> Column:
    """Of the documents of a group, whatever their order."""
    return F.sum(F.xxhash64("doc_id", "sha").cast("decimal(38,0)"))


def _latest_documents(stored: DataFrame, size: int, overlap: int) -> DataFrame:
    """(collection, block, doc_id, text, sha, n, before): the latest upload of each document, its passages and those
    before it in its block.

    Texts are moved once: a block's uploads stand in order in one task, which also leaves a block's documents together.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = stored.select("collection", "block", "doc_id", "version", text).withColumn("sha", F.sha2("text", 256))
    order = Window.partitionBy("collection", "block").orderBy("doc_id", F.desc("version"), F.desc("sha"))
    old = F.coalesce(F.lag("doc_id").over(order) == F.col("doc_id"), F.lit(False))
    n = F.when(F.col("_old"), F.lit(0)).otherwise(chunk_count(F.length("text"), size, overlap))
    counted = rows.withColumn("_old", old).withColumn("n", n.cast("bigint"))
    above = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("before", above).filter("NOT _old").drop("_old", "version")


def rebuild_blocks(spark: SparkSession, out_dir: str, touched: DataFrame, version: int, size: int = 800, overlap: int = 400) -> DataFrame:
    """Bring the blocks named in ``touched`` (collection, block) up to date; returns (collection, block, n) of those that
    were written.

    A document is its latest upload, by version. Blocks whose documents digest to what their leaf says are left alone, so
    a batch that is replayed, or uploads what is there, writes nothing. Reads the uploads of the touched blocks and the
    leaves of their families, whatever else is stored.
    """
    # One name for each block that a batch touches: they are directories.
    names = [(r.collection, r.block) for r in touched.select("collection", "block").distinct().collect()]
    families = sorted({(c, b >> BLOCK_BITS) for c, b in names})
    uploads, leaves = f"{out_dir}/uploads", f"{out_dir}/leaves"
    stored = _under(spark, uploads, _UPLOADS, [partition_path(spark, uploads, collection=c, block=b) for c, b in names])
    docs = materialize(_latest_documents(stored, size, overlap))
    current = materialize(_latest_leaves(_under(spark, leaves, _LEAVES, [partition_path(spark, leaves, collection=c, family=f) for c, f in families])))

    sums = docs.groupBy("collection", "block").agg(F.sum("n").alias("n"), _digest().alias("digest"))
    known = current.select("collection", "block", F.col("digest").alias("_known"))
    changed = sums.join(known, ["collection", "block"], "left").filter("_known IS NULL OR _known <> digest").drop("_known")
    changed = materialize(changed.withColumn("family", F.shiftright("block", BLOCK_BITS)))
    if changed.isEmpty():
        return changed.select("collection", "block", "n")

    cut = docs.join(broadcast_within(changed.select("collection", "block")), ["collection", "block"])
    cut = cut.filter("n > 0").select("collection", "block", "doc_id", "before", F.posexplode(pieces(F.col("n") - 1, size, overlap)).alias("pos", "text"))
    inside = F.col("before") + F.col("pos") + 1
    marked = cut.select("doc_id", "pos", inside.alias("inside"), "text", "collection", "block", F.lit(version).cast("bigint").alias("version"))
    # The documents of a block are together already, so passages, twice the text, are written where they are cut.
    _write(marked, f"{out_dir}/passages", "collection", "block", "version")

    # Families of changed blocks get a new version of their leaves: at most 4,096 rows each.
    last = current.groupBy("collection", "family").agg(F.max("version").alias("_last"))
    ours = changed.select("collection", "family", "block", F.lit(version).cast("bigint").alias("block_version"), "n", "digest")
    others = current.join(broadcast_within(changed.select("collection", "family").distinct()), ["collection", "family"], "left_semi")
    others = others.join(broadcast_within(changed.select("collection", "block")), ["collection", "block"], "left_anti")
    grown = ours.unionByName(others.select(*ours.columns)).join(last, ["collection", "family"], "left")
    grown = grown.withColumn("version", F.coalesce(F.col("_last") + 1, F.lit(0)).cast("bigint")).drop("_last")
    grown = grown.withColumn("inside", before(["collection", "family"], "block"))
    _append(grown.select("block", "block_version", "n", "inside", "digest", "collection", "family", "version"), leaves, "collection", "family", "version")
    return changed.select("collection", "block", "n")


def _standing(spark: SparkSession, out_dir: str, name: str | None) -> DataFrame:
    """(collection, block, version, n, offset): the version of each block that counts, and what stands before it."""
    leaves = spark.read.schema(_LEAVES).parquet(f"{out_dir}/leaves")
    if name is not None:
        leaves = leaves.filter(F.col("collection") == name)
    leaves = materialize(_latest_leaves(leaves))
    families = leaves.groupBy("collection", "family").agg(F.sum("n").alias("n"))  # a row for 16 million ids
    above = families.select("collection", "family", before(["collection"], "family").alias("_above"))
    return leaves.join(broadcast_within(above), ["collection", "family"]).select(
        "collection", "block", F.col("block_version").alias("version"), "n", (F.col("_above") + F.col("inside")).alias("offset")
    )


def open_blocks(spark: SparkSession, out_dir: str, name: str | None = None) -> DataFrame:
    """(collection, chunk_no, doc_id, pos, text) of one collection or all, numbered 1, 2, ... by document id, then position.

    The numbers are those of ``chunk_documents`` over the latest documents. Passages of superseded versions are left out
    by a join with the leaves, whose blocks prune directories; a block of any size is read by as many tasks as its files ask for.
    """
    passages = spark.read.schema(_PASSAGES).parquet(f"{out_dir}/passages")
    if name is not None:
        passages = passages.filter(F.col("collection") == name)
    blocks = broadcast_within(materialize(_standing(spark, out_dir, name).filter("n > 0").drop("n")))
    return passages.join(blocks, ["collection", "block", "version"]).select(
        "collection", (F.col("offset") + F.col("inside")).alias("chunk_no"), "doc_id", "pos", "text"
    )


def block_versions(spark: SparkSession, out_dir: str) -> DataFrame:
    """(collection, block, version, n, offset) of the blocks as they stand, for looking at what a batch wrote."""
    return _standing(spark, out_dir, None)


def remove_superseded(spark: SparkSession, out_dir: str) -> int:
    """Delete passages and leaves that later versions replaced; returns the number of directories. Not while others read.

    The driver learns the names of the directories that go, one for each block version that a batch replaced.
    """
    standing = _standing(spark, out_dir, None).select("collection", "block", "version")
    written = spark.read.schema(_PASSAGES).parquet(f"{out_dir}/passages").select("collection", "block", "version").distinct()
    gone = [(f"{out_dir}/passages", r.asDict()) for r in written.join(standing, ["collection", "block", "version"], "left_anti").collect()]
    leaves = spark.read.schema(_LEAVES).parquet(f"{out_dir}/leaves").select("collection", "family", "version").distinct()
    last = leaves.groupBy("collection", "family").agg(F.max("version").alias("version"))
    gone += [(f"{out_dir}/leaves", r.asDict()) for r in leaves.join(last, ["collection", "family", "version"], "left_anti").collect()]
    for root, values in gone:
        remove_partition(spark, root, **values)
    return len(gone)


def next_version(spark: SparkSession, out_dir: str, stream: str, batch_id: int) -> int:
    """The version of a batch: the one it had, else the next one over all streams. Kept in a log of one row a batch."""
    log = f"{out_dir}/log"
    try:
        rows = spark.read.schema("stream string, batch bigint, version bigint").parquet(log)
        own = F.max(F.when((F.col("stream") == stream) & (F.col("batch") == batch_id), F.col("version")))
        known, last = rows.agg(own, F.max("version")).first()
    except AnalysisException:  # nothing has been logged yet
        known, last = None, None
    if known is not None:
        return known
    version = 0 if last is None else last + 1
    spark.createDataFrame([(stream, batch_id, version)], "stream string, batch bigint, version bigint").coalesce(1).write.mode("append").parquet(log)
    return version


def build_batch(batch: DataFrame, batch_id: int, out_dir: str, size: int, overlap: int, stream: str = "-") -> DataFrame:
    """Store one batch of uploads and rebuild the blocks it changed: (collection, block, n) of those."""
    spark = batch.sparkSession
    version = next_version(spark, out_dir, stream, batch_id)
    batch = batch.persist()  # a batch is read for its uploads and for the names of its blocks
    try:
        store_uploads(batch, out_dir, version, stream, batch_id)
        touched = batch.select("collection", F.shiftright("doc_id", BLOCK_BITS).alias("block"))
        return rebuild_blocks(spark, out_dir, touched, version, size, overlap)
    finally:
        batch.unpersist()
