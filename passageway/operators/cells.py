"""Vectors in many cells: centres of centres, probing in two steps, and exact search by bounds on cells.

The centres of cells are a table of any size; only the centres they are grouped around (some square root of their
number) go to every task. A vector is assigned to the nearest centre of its nearest group, and a question looks for its
nearest centres in its nearest groups, so neither ever meets all centres.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize, measured_bytes
from passageway.functions.scan import BLOCK_BYTES
from passageway.functions.vectors import CosineScorer, matrix, nearest_cells
from passageway.operators.retrieve import best_vectors, centroid_matrix, fit_cells, merge_best, rank_top, with_cells

#: Vectors that meet the centres of their group in one task.
GROUP_ROWS = 1 << 16


class CellTree(NamedTuple):
    """``centres`` (cell, centroid, parent) and the centres of the groups, which fit one block."""

    centres: DataFrame
    groups: np.ndarray


class Bounded(NamedTuple):
    """``top`` (qid, rank, id, score) and ``looked_into`` (qid, cell), the cells that could not be left out."""

    top: DataFrame
    looked_into: DataFrame


def group_centres(centroids: DataFrame, n_groups: int | None = None, seed: int = 42) -> CellTree:
    """Centres (cell, centroid) of any number grouped around centres of their own, by k-means over the centres."""
    centroids = materialize(centroids.select(F.col("cell").cast("int").alias("cell"), "centroid"))
    n, dim = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if not n:
        raise ValueError("there are no centres")
    most = max(1, BLOCK_BYTES // (8 * dim))
    wanted = min(n_groups or math.ceil(math.sqrt(n)), most, n)
    points = centroids.select(F.col("cell").alias("id"), F.col("centroid").alias("embedding"))
    groups = centroid_matrix(fit_cells(points, wanted, seed)) if wanted > 1 else np.zeros((1, dim))
    grouped = with_cells(points, groups, 1).select(F.col("id").alias("cell"), F.col("embedding").alias("centroid"), F.col("cells")[0].alias("parent"))
    return CellTree(materialize(grouped), groups)


def _part(df: DataFrame, share: float, seed: int) -> DataFrame:
    """About ``share`` of the rows, by a hash of the id."""
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_cell_tree(vectors: DataFrame, n_cells: int, seed: int = 42, rows_each: int = 64, max_iter: int = 10) -> CellTree:
    """Fit about ``n_cells`` cells in two levels: groups first, then cells inside each group, as many as its share.

    Fitted on a bounded sample: about ``rows_each`` vectors (id, embedding) for each group, then for each cell, and at
    most ``GROUP_ROWS`` in one group. Every vector can be assigned.
    """
    count = vectors.count()
    dim = (vectors.agg(F.max(F.size("embedding"))).first()[0] or 1) if count else 1
    n_groups = max(1, min(math.ceil(math.sqrt(n_cells)), BLOCK_BYTES // (8 * dim), count))
    first = materialize(_part(vectors.select("id", "embedding"), rows_each * n_groups / max(count, 1), seed))
    groups = centroid_matrix(fit_cells(first, n_groups, seed))
    drawn = _part(vectors.select("id", "embedding"), rows_each * n_cells / max(count, 1), seed + 1)
    drawn = materialize(with_cells(drawn, groups, 1).withColumn("parent", F.col("cells")[0]).drop("cells"))
    sizes = drawn.groupBy("parent").agg(F.count("*").alias("size"))
    shares = sizes.withColumn("wanted", F.greatest(F.lit(1), F.round(F.col("size") * (n_cells / max(drawn.count(), 1))).cast("int")))
    kept = drawn.join(F.broadcast(shares), "parent")  # one row a group
    kept = kept.filter(F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.col("size")) < GROUP_ROWS)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng(seed + int(rows["parent"].iloc[0]))
        centres = x[rng.choice(len(x), min(int(rows["wanted"].iloc[0]), len(x)), replace=False)]
        for _ in range(max_iter):
            own = nearest_cells(x, centres, 1)[:, 0]
            held = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        return pd.DataFrame({"parent": int(rows["parent"].iloc[0]), "place": range(len(centres)), "centroid": list(centres)})

    found = kept.groupBy("parent").applyInPandas(fitted, "parent int, place int, centroid array<double>")
    found = materialize(found)
    # Cells are numbered group by group; there are as many groups as fit one block.
    before = {r.parent: r.n for r in found.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for parent in sorted(before):
        starts.append((parent, total))
        total += before[parent]
    offsets = vectors.sparkSession.createDataFrame(starts, "parent int, _start int")
    cells = found.join(F.broadcast(offsets), "parent").select((F.col("_start") + F.col("place")).alias("cell"), "centroid", "parent")
    return CellTree(materialize(cells), groups)


def assign(vectors: DataFrame, tree: CellTree) -> DataFrame:
    """Add ``parent``, ``cell`` and ``reach`` (the distance of the vector, scaled to length 1, from the centre).

    Vectors are dealt by group to meet its centres; a group with many vectors is dealt out over several tasks, each of
    which gets the centres of that group.
    """
    rows = vectors.select(*[F.col(f"`{c}`") for c in vectors.columns if c not in ("parent", "cell", "reach")])
    columns = rows.columns
    rows = with_cells(rows, tree.groups, 1).withColumn("parent", F.col("cells")[0]).drop("cells")
    rows = materialize(rows)
    sizes = rows.groupBy("parent").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).cast("int").alias("_parts"))
    parts = F.broadcast(materialize(sizes))  # one row a group
    rows = rows.join(parts, "parent").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    centres = tree.centres.join(parts, "parent").select("parent", "cell", "centroid", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        x = matrix(left.column("embedding"))
        right = right.sort_by("cell")
        c, cell = matrix(right.column("centroid")), right.column("cell").to_numpy()
        own = np.concatenate([nearest_cells(x[a : a + 512], c, 1)[:, 0] for a in range(0, len(x), 512)] or [np.zeros(0, dtype=np.int64)])
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
        reach = np.linalg.norm(unit - c[own], axis=1)
        out = left.select([*columns, "parent"]).append_column("cell", pa.array(cell[own].astype(np.int32)))
        return out.append_column("reach", pa.array(reach))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns)
    grouped = rows.groupBy("parent", "_part").cogroup(centres.groupBy("parent", "_part"))
    return grouped.applyInArrow(lambda a, b: nearest(a, b) if a.num_rows else a.select([]), f"{kinds}, parent int, cell int, reach double")


def write_cells(assigned: DataFrame, out_dir: str) -> None:
    """Store assigned vectors by group, inside a file by cell, replacing what was there."""
    rows = assigned.hint("rebalance", "parent").sortWithinPartitions("parent", "cell")
    rows.write.mode("overwrite").partitionBy("parent").parquet(out_dir)


def nearest_in_tree(queries: DataFrame, tree: CellTree, n_groups: int, n_cells: int) -> DataFrame:
    """(qid, embedding, cells): the ``n_cells`` nearest centres among those of the ``n_groups`` nearest groups."""
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding")
    asked = materialize(with_cells(asked, tree.groups, min(n_groups, len(tree.groups))))
    groups = [r.g for r in asked.select(F.explode("cells").alias("g")).distinct().collect()]  # at most all groups
    centres = tree.centres.filter(F.col("parent").isin(groups)).select(
        F.col("cell").alias("id"), F.col("centroid").alias("embedding"), F.col("parent").alias("cell")
    )
    near = merge_best(best_vectors(asked, centres, CosineScorer(n_cells, distance=True), BLOCK_BYTES), n_cells)
    near = rank_top(near, n_cells, score_col="coarse")
    lists = near.groupBy("qid").agg(F.collect_list(F.col("id").cast("int")).alias("cells"))  # n_cells at most
    return asked.drop("cells").join(lists, "qid")


def _only(vectors: DataFrame, asked: DataFrame, tree: CellTree) -> DataFrame:
    """The vectors in cells that some question looks into; stored by group, only those groups are read."""
    wanted = materialize(asked.select(F.explode("cells").alias("cell")).distinct())
    if "parent" in vectors.columns:
        groups = tree.centres.join(broadcast_within(wanted), "cell", "left_semi").select("parent").distinct()
        vectors = vectors.filter(F.col("parent").isin([r.parent for r in groups.collect()]))
    return vectors.join(broadcast_within(wanted), "cell", "left_semi")


def probe_topk(
    queries: DataFrame, vectors: DataFrame, tree: CellTree, k: int = 8, ef: int = 200, n_groups: int = 16, nprobe: int = 4, coarse_dims: int | None = None
) -> DataFrame:
    """Approximate top-k from the ``nprobe`` cells nearest to each question, found in its ``n_groups`` nearest groups.

    ``vectors`` has (id, embedding, cell), and ``parent`` if it was stored by group. Looking into all groups and cells
    gives the exact ranking; questions without any cell have no rows.
    """
    asked = materialize(nearest_in_tree(queries, tree, n_groups, nprobe))
    best = best_vectors(asked, _only(vectors, asked, tree), CosineScorer(ef, coarse_dims), BLOCK_BYTES)
    pool = rank_top(merge_best(best, ef), ef, score_col="coarse").drop("rank")
    return rank_top(pool, k).select("qid", "rank", "id", "score")


def cell_reach(assigned: DataFrame) -> DataFrame:
    """(cell, reach, n): how far the vectors of each cell are from its centre, at most. Keep it with the vectors."""
    return assigned.groupBy("cell").agg(F.max("reach").alias("reach"), F.count("*").alias("n"))


def exact_topk_bounded(queries: DataFrame, vectors: DataFrame, tree: CellTree, reach: DataFrame, k: int = 8, nprobe: int = 4) -> Bounded:
    """The k vectors of highest cosine, equal to ``exact_topk``, without looking into cells that cannot hold one.

    The k-th score among the ``nprobe`` nearest cells is a floor for every question. On the unit sphere a vector of a
    cell is at least as far from the question as the centre less the reach of the cell, so its cosine has a ceiling;
    cells below the floor are left out, the others are searched whole. Vectors and questions of length 0 have cosine 0
    with everything, and the same bounds hold for them.
    """
    first = probe_topk(queries, vectors, tree, k, k, nprobe=nprobe)
    full = first.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding").join(full, "qid", "left")
    asked = materialize(asked.withColumn("floor", F.coalesce("floor", F.lit(-2.0))))
    cells = tree.centres.join(reach, "cell").select("cell", "centroid", "reach")
    context = queries.sparkSession.sparkContext

    def within(sent):
        def kept(batches):
            q = matrix(sent.value.column("embedding"))
            qid, floor = sent.value.column("qid").to_numpy(), sent.value.column("floor").to_numpy()
            if not len(q):
                return
            norms = np.linalg.norm(q, axis=1, keepdims=True)
            unit = np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)
            for batch in batches:
                c, far, cell = matrix(batch.column("centroid")), batch.column("reach").to_numpy(), batch.column("cell").to_numpy()
                for a in range(0, len(c), 256):
                    gap = np.sqrt(np.maximum(0, (unit**2).sum(1)[:, None] - 2 * unit @ c[a : a + 256].T + (c[a : a + 256] ** 2).sum(1)))
                    ceiling = 1 - np.maximum(0, gap - far[a : a + 256] - 1e-6) ** 2 / 2
                    i, j = np.nonzero(ceiling >= floor[:, None] - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(cell[a + j].astype(np.int32))], names=["qid", "cell"])

        return kept

    blocks = max(1, -(-measured_bytes(asked) // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    found = None
    for i in range(blocks):
        rows = cells.mapInArrow(within(context.broadcast(asked.filter(part == i).toArrow())), "qid bigint, cell int")
        found = rows if found is None else found.unionAll(rows)
    looked = materialize(found)
    lists = looked.groupBy("qid").agg(F.collect_list("cell").alias("cells"))  # all cells at most
    listed = materialize(asked.drop("floor").join(lists, "qid"))
    best = best_vectors(listed, _only(vectors, listed, tree), CosineScorer(k), BLOCK_BYTES)
    return Bounded(rank_top(merge_best(best, k), k).select("qid", "rank", "id", "score"), looked)
