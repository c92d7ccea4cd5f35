"""Ranking passages for a batch of questions, and measuring the ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize, measured_bytes
from passageway.functions.lexical import Bm25Scorer
from passageway.functions.scan import BLOCK_BYTES, best_per_task
from passageway.functions.text import words
from passageway.functions.vectors import CosineScorer, matrix, nearest_cells
from passageway.operators.encode import TermStats, query_terms


def rank_top(scored: DataFrame, k: int, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """Add ``rank`` 1..k per ``qid`` by score, ties to the smaller id.

    The literal bound lets Spark cut every task's share to k rows a query before the shuffle.
    """
    w = Window.partitionBy("qid").orderBy(F.desc(score_col), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_best(best: DataFrame, pool: int) -> DataFrame:
    """Cut the rows returned by the tasks to ``pool`` a query in 64 shares, so that no task gets all of a query."""
    share = F.pmod(F.xxhash64("id"), F.lit(64))
    w = Window.partitionBy("qid", "_share").orderBy(F.desc("coarse"), "id")
    ranked = best.withColumn("_share", share).withColumn("_place", F.row_number().over(w))
    return ranked.filter(F.col("_place") <= pool).drop("_share", "_place")


def best_vectors(queries: DataFrame, vectors: DataFrame, scorer: CosineScorer, block_bytes: int) -> DataFrame:
    """The best rows of every task for the queries (qid, embedding, maybe cells), in cells where the scorer asks for them."""
    listed = ["cells"] if "cells" in queries.columns else []
    cells = ["cell"] if listed or scorer.centroids is not None else []
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding", *listed)
    return best_per_task(asked, vectors.select(F.col("id").cast("bigint").alias("id"), "embedding", *cells), scorer, block_bytes)


def exact_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 8, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The k vectors of highest cosine per query: (qid, rank, id, score).

    ``queries`` has (qid, embedding), ``vectors`` (id, embedding).  Scores are compared to ten
    places and ties go to the smaller id.  Scoring is a matrix product in each task, of which only
    k rows a query leave the task, so no row per (query, vector) pair ever exists.
    """
    best = best_vectors(queries, vectors, CosineScorer(k), block_bytes)
    return rank_top(merge_best(best, k), k).select("qid", "rank", "id", "score")


def fit_cells(vectors: DataFrame, n_cells: int = 16, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Cell centres by MLlib k-means over all vectors: (cell, centroid).  Keep them with the collection."""
    train = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    centers = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(train).clusterCenters()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def centroid_matrix(centroids: DataFrame) -> np.ndarray:
    return matrix(centroids.orderBy("cell").toArrow().column("centroid"))


def with_cells(vectors: DataFrame, centers: np.ndarray, n: int) -> DataFrame:
    """Add ``cells``, the ``n`` nearest cells of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("array<int>")
    def nearest(embedding: pd.Series) -> pd.Series:
        if embedding.empty:
            return pd.Series([], dtype=object)
        rows = np.stack(embedding.to_numpy()).astype(np.float64)
        return pd.Series(list(nearest_cells(rows, shared.value, n).astype(np.int32)))

    return vectors.withColumn("cells", nearest("embedding"))


def assign_cells(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``cell``, the nearest centre.  Stored partitioned by it, probing reads only the cells asked for.

    Centres that are too many to send to every task are grouped around centres of their own (``operators.cells``); the
    cell is then the nearest of the nearest group.
    """
    if measured_bytes(centroids) > BLOCK_BYTES:
        from passageway.operators import cells

        return cells.assign(vectors, cells.group_centres(centroids)).select(*vectors.columns, "cell")
    nearest = with_cells(vectors, centroid_matrix(centroids), 1)
    return nearest.withColumn("cell", F.col("cells")[0]).drop("cells")


def ann_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 8,
    ef: int = 200,
    coarse: str = "prefix",
    coarse_dims: int | None = None,
    centroids: DataFrame | None = None,
    nprobe: int = 4,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Approximate top-k through a candidate pool of ``ef`` rows: (qid, rank, id, score).

    ``prefix`` fills the pool by cosine over the first ``coarse_dims`` dimensions (16 unless given); ``ivf`` only
    from the ``nprobe`` cells nearest to the query, by the cosine over all dimensions unless ``coarse_dims`` is given
    (``vectors`` may bring a stored ``cell`` column, else cells are assigned here).  The pool is then ranked by the
    exact cosine, computed in the same pass.  Centres that are too many to send to every task are probed in two steps
    (``operators.cells``).
    """
    if ef < k:
        raise ValueError("the pool must hold at least k candidates")
    scorer = CosineScorer(ef, 16 if coarse == "prefix" and coarse_dims is None else coarse_dims)
    if coarse == "ivf":
        if centroids is None:
            raise ValueError("ivf needs centroids")
        if "cell" not in vectors.columns:
            vectors = assign_cells(vectors, centroids)
        if measured_bytes(centroids) > BLOCK_BYTES:
            from passageway.operators import cells

            tree = cells.group_centres(centroids)
            return cells.probe_topk(queries, vectors, tree, k, ef, nprobe=nprobe, coarse_dims=coarse_dims)
        centers = centroid_matrix(centroids)
        scorer = scorer._replace(centroids=centers, nprobe=min(nprobe, len(centers)))
        queries = materialize(queries.select("qid", "embedding"))
        probed = with_cells(queries, centers, scorer.nprobe).select(F.explode("cells").alias("cell")).distinct()
        # At most one number a cell; as a literal list it prunes the directories of stored vectors.
        vectors = vectors.filter(F.col("cell").isin([row.cell for row in probed.collect()]))
    elif coarse != "prefix":
        raise ValueError("coarse must be 'prefix' or 'ivf'")
    best = best_vectors(queries, vectors, scorer, block_bytes)
    pool = rank_top(merge_best(best, ef), ef, score_col="coarse").drop("rank")
    return rank_top(pool, k).select("qid", "rank", "id", "score")


def _top_ids(ranked: DataFrame, k: int, name: str) -> DataFrame:
    # At most k ids a group.
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return ranked.filter(F.col("rank") <= k).groupBy("qid").agg(ids.alias(name))


def compare_topk(a: DataFrame, b: DataFrame, k: int = 8) -> DataFrame:
    """Agreement of two rankings per query: same ids in the same order, and the share of common ids."""
    empty = F.array().cast("array<bigint>")
    left, right = F.coalesce("a_ids", empty), F.coalesce("b_ids", empty)
    return (
        _top_ids(a, k, "a_ids")
        .join(_top_ids(b, k, "b_ids"), "qid", "full_outer")
        .select(
            "qid",
            left.alias("a_ids"),
            right.alias("b_ids"),
            (left == right).alias("identical"),
            (F.size(F.array_intersect(left, right)) / F.lit(k)).alias("overlap"),
        )
    )


def bm25_topk(
    queries: DataFrame, stats: TermStats, k: int = 8, k1: float = 1.2, b: float = 0.75, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The k documents of highest BM25 score per question: (qid, rank, id, score).

    ``stats`` may be limited to ``only=query_terms(queries)``.  Every document is scored from its
    own words in the task that reads it, so a word found everywhere neither makes a hot key nor a
    row per (question, document); k rows a question leave each task.
    """
    asked = query_terms(queries, stats.mode).join(stats.terms.select("token", "idf"), "token").select("qid", "token", "idf")
    average = stats.corpus.select(F.try_divide("total_len", "n_docs")).first()
    scorer = Bm25Scorer(k, float((average and average[0]) or 1.0), k1, b)
    best = best_per_task(asked.withColumn("qid", F.col("qid").cast("bigint")), stats.words, scorer, block_bytes)
    return rank_top(merge_best(best, k), k).select("qid", "rank", "id", "score")


def rrf_fuse(lists: Sequence[DataFrame], c: int = 60, depth: int = 50, k: int = 8) -> DataFrame:
    """Reciprocal rank fusion: each list adds 1 / (c + rank) for its first ``depth`` ids."""
    votes = [x.filter(F.col("rank") <= depth).select("qid", "id", "rank") for x in lists]
    fused = (
        reduce(DataFrame.unionByName, votes)
        .groupBy("qid", "id")
        .agg(F.round(F.sum(1 / (F.lit(c) + F.col("rank"))), 9).alias("score"))
    )
    return rank_top(fused, k).select("qid", "rank", "id", "score")


def first_gold_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """The best rank of any expected passage per question of ``gold`` (qid, id); null if unranked."""
    hits = gold.select("qid", "id").join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    return hits.groupBy("qid").agg(F.min("rank").alias("gold_rank"))


def sweep_k(ranked: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Hit rate for several window sizes: (k, n_questions, n_hits, hit_rate)."""
    windows = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hit = F.coalesce(F.col("gold_rank") <= F.col("k"), F.lit(False))
    return (
        first_gold_rank(ranked, gold)
        .select("qid", "gold_rank", windows)
        .groupBy("k")
        .agg(
            F.count("*").alias("n_questions"),
            F.count_if(hit).alias("n_hits"),
            F.avg(hit.cast("int")).alias("hit_rate"),
        )
    )


def smallest_window(ranked: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The smallest of ``ks`` that reaches the expected passage, per question (null: none does)."""
    fits = F.array_min(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("gold_rank")))
    return first_gold_rank(ranked, gold).select("qid", "gold_rank", fits.alias("k"))


def rank_displacement(a: DataFrame, b: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Movement of the expected passage from ``a`` to ``b`` and whether it crosses the border k."""
    before = first_gold_rank(a, gold).withColumnRenamed("gold_rank", "rank_a")
    after = first_gold_rank(b, gold).withColumnRenamed("gold_rank", "rank_b")
    in_a = F.coalesce(F.col("rank_a") <= k, F.lit(False))
    in_b = F.coalesce(F.col("rank_b") <= k, F.lit(False))
    border = F.when(in_a & ~in_b, "lost").when(~in_a & in_b, "gained").otherwise("same")
    return before.join(after, "qid").select(
        "qid", "rank_a", "rank_b", (F.col("rank_b") - F.col("rank_a")).alias("displacement"), border.alias("border")
    )


def label(chunk_no: Column) -> Column:
    """The citation mark of a passage number."""
    return F.concat(F.lit("[资料§"), chunk_no.cast("string"), F.lit("]"))


def _with_passages(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    # The ranking is small next to the chunks: kept once, measured, and sent to where they are read.
    wanted = broadcast_within(materialize(ranked))
    return chunks.select(F.col("chunk_no").alias("id"), "text").join(wanted, "id")


def assemble_context(
    queries: DataFrame, ranked: DataFrame, chunks: DataFrame, template: str, k: int = 8
) -> DataFrame:
    """Fill ``{context}`` and ``{question}`` of a template: (qid, n_passages, prompt).

    Passages come in rank order, each after its mark ``[资料§N]`` on a line of its own.
    """
    found = _with_passages(ranked.filter(F.col("rank") <= k).select("qid", "rank", "id"), chunks)
    # At most k passages a group.
    passages = F.array_sort(F.collect_list(F.struct("rank", "id", "text")))
    lines = F.array_join(F.transform("passages", lambda p: F.concat(label(p["id"]), F.lit(" "), p["text"])), "\n")
    context = found.groupBy("qid").agg(passages.alias("passages"))
    # The context goes in last: text that looks like a slot in a question stays text.
    before, _, after = template.partition("{context}")
    fill = lambda piece: F.replace(F.lit(piece), F.lit("{question}"), F.col("question"))
    prompt = F.concat(fill(before), F.coalesce(lines, F.lit("")), fill(after))
    return queries.join(context, "qid", "left").select(
        "qid", F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"), prompt.alias("prompt")
    )


def extractive_answers(
    queries: DataFrame, ranked: DataFrame, chunks: DataFrame, threshold: float, refusal: str, k: int = 8
) -> DataFrame:
    """A model-free answer table: (qid, chunk_no, coverage, answer).

    The answer is the passage among the first k that covers most of the question's distinct words
    (ties to the better rank), with its citation; below ``threshold`` it is the refusal.
    """
    asked = queries.select("qid", F.array_distinct(words("question")).alias("asked"))
    found = _with_passages(ranked.filter(F.col("rank") <= k).select("qid", "rank", "id"), chunks)
    share = F.size(F.array_intersect("asked", words("text"))) / F.greatest(F.size("asked"), F.lit(1))
    best = (
        found.join(asked, "qid")
        .select("qid", "rank", "id", "text", F.round(share, 6).alias("coverage"))
        .groupBy("qid")
        .agg(F.max_by(F.struct("id", "coverage", "text"), F.struct("coverage", -F.col("rank"))).alias("best"))
    )
    covered = F.coalesce(F.col("best.coverage") >= threshold, F.lit(False))
    answer = F.when(covered, F.concat("best.text", F.lit(" "), label(F.col("best.id")))).otherwise(F.lit(refusal))
    return queries.select("qid").join(best, "qid", "left").select(
        "qid",
        F.when(covered, F.col("best.id")).alias("chunk_no"),
        F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"),
        answer.alias("answer"),
    )
