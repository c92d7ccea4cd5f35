"""Scoring rows where they are read: each task returns its best rows for every question."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import materialize, measured_bytes

BEST_SCHEMA = "qid bigint, id bigint, coarse double, score double"
_ARROW = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("coarse", pa.float64()), ("score", pa.float64())])

# Bytes of the asked side that go to every task at once; a larger one is cut into blocks.
BLOCK_BYTES = 16 * 1024 * 1024
# Bytes that the best rows of one block may take in a task, at ROW_BYTES each.
HELD_BYTES = 128 * 1024 * 1024
ROW_BYTES = 32

Batches = Iterable[pa.RecordBatch]
# (batches of rows, asked) -> batches of BEST_SCHEMA
Scorer = Callable[[Batches, pa.Table], Iterator[pa.RecordBatch]]
# query index, row id, coarse score, score
Best = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def keep_best(rows: Best, pool: int) -> Best:
    """The best ``pool`` rows a query by coarse score, ties to the smaller id."""
    q, ids, coarse, _ = rows
    order = np.lexsort((ids, -coarse, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    order = order[rank < pool]
    return tuple(column[order] for column in rows)


def above_floor(scores: np.ndarray, pool: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) that may belong to the best ``pool`` of each query, ties included.

    ``floor`` is the lowest score already held by a query whose pool is full.
    """
    n = scores.shape[1]
    if n > pool:
        floor = np.maximum(floor, np.partition(scores, n - pool, axis=1)[:, n - pool])
    return np.nonzero(scores >= floor[:, None])


class Held:
    """The best ``pool`` rows a query seen so far by a task."""

    def __init__(self, n_queries: int, pool: int) -> None:
        self.pool = pool
        self.rows: Best | None = None
        self.floor = np.full(n_queries, -np.inf)

    def add(self, parts: list[Best]) -> None:
        parts = [part for part in (self.rows, *parts) if part is not None]
        if not parts:
            return
        self.rows = keep_best(tuple(np.concatenate(column) for column in zip(*parts)), self.pool)
        q, _, coarse, _ = self.rows
        queries = np.arange(len(self.floor))
        end = np.searchsorted(q, queries, side="right")
        full = end - np.searchsorted(q, queries, side="left") == self.pool
        self.floor[full] = coarse[end[full] - 1]


def to_batch(best: Best, qids: np.ndarray) -> pa.RecordBatch:
    q, ids, coarse, score = best
    return pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids), pa.array(coarse), pa.array(score)], schema=_ARROW)


def best_per_task(asked: DataFrame, rows: DataFrame, scorer: Scorer, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score ``rows`` (with ``id``) for ``asked`` (with ``qid``) where they are read, without a shuffle of either.

    The asked side is sent to the tasks in blocks of bounded bytes, dealt by question, so small that the best rows a task
    holds for a block are bounded too; the rows are scanned once for each block. Blocks do not change the result.
    """
    asked = materialize(asked)
    context = rows.sparkSession.sparkContext
    n_questions = asked.select("qid").distinct().count()
    n_blocks = max(1, -(-measured_bytes(asked) // block_bytes), -(-n_questions * scorer.pool * ROW_BYTES // HELD_BYTES))

    def scored(block: pa.Table) -> DataFrame:
        sent = context.broadcast(block)
        return rows.mapInArrow(lambda batches: scorer(batches, sent.value), BEST_SCHEMA)

    part = F.pmod(F.xxhash64("qid"), F.lit(n_blocks))
    blocks = [asked if n_blocks == 1 else asked.filter(part == i) for i in range(n_blocks)]
    return reduce(DataFrame.unionAll, [scored(block.toArrow()) for block in blocks])
