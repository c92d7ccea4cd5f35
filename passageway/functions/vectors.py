"""Cosine scoring of Arrow batches of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from passageway.functions.scan import Batches, Best, Held, above_floor, keep_best, to_batch

# Queries scored at once against one batch; bounds the score matrix held by a task.
_STRIPE = 256
#: Places to which scores are compared: far above the noise of summation, so that equal scores are equal whatever the
#: order of summation, and far below any difference that matters.
PLACES = 10


class CosineScorer(NamedTuple):
    """Keeps the best ``pool`` rows a query by cosine over the leading ``coarse_dims`` (all if None).

    A query looks into the cells listed in its column ``cells`` if there is one, else into its ``nprobe`` nearest cells
    if ``centroids`` are given, else at all rows. With ``distance`` the best rows are the nearest ones, by squared
    distance less the square of the query.
    """

    pool: int
    coarse_dims: int | None = None
    centroids: np.ndarray | None = None
    nprobe: int = 0
    distance: bool = False

    def __call__(self, batches: Batches, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        queries = matrix(asked.column("embedding"))
        qids = asked.column("qid").to_numpy()
        if len(qids) == 0:
            return
        asking, by_cell = self._asking(asked, queries)
        held = Held(len(qids), self.pool)
        for batch in batches:
            rows, ids = matrix(batch.column("embedding")), batch.column("id").to_numpy()
            cells = np.zeros(len(ids), dtype=np.int64)
            if by_cell:
                cells = batch.column("cell").to_numpy()
            found = []
            order = np.argsort(cells, kind="stable")
            for members in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                who = asking(cells[members[0]]) if len(members) else []
                for start in range(0, len(who), _STRIPE):
                    stripe = who[start : start + _STRIPE]
                    q, *rest = self._candidates(queries[stripe], rows[members], ids[members], held.floor[stripe])
                    found.append((stripe[q], *rest))
            held.add(found)
        if held.rows is not None:
            yield to_batch(held.rows, qids)

    def _asking(self, asked: pa.Table, queries: np.ndarray) -> tuple[Callable[[int], np.ndarray], bool]:
        """Which queries look into a cell, and whether rows have cells."""
        if "cells" in asked.column_names:
            lists = asked.column("cells").combine_chunks()
            cell = lists.flatten().to_numpy(zero_copy_only=False)
            query = np.repeat(np.arange(len(queries)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(cell, kind="stable")
            cell, query = cell[order], query[order]
            return lambda c: query[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")], True
        if self.centroids is None:
            everyone = np.arange(len(queries))
            return lambda c: everyone, False
        probes = np.zeros((len(queries), len(self.centroids)), dtype=bool)
        np.put_along_axis(probes, nearest_cells(queries, self.centroids, self.nprobe), True, axis=1)
        return lambda c: np.nonzero(probes[:, c])[0], True

    def _candidates(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> Best:
        dims = self.coarse_dims or queries.shape[1]
        coarse = -squared_distances(queries, rows) if self.distance else cosine(queries[:, :dims], rows[:, :dims])
        q, r = above_floor(coarse, self.pool, floor)
        q, best, coarse, r = keep_best((q, ids[r], coarse[q, r], r), self.pool)
        return q, best, coarse, coarse if self.distance or dims == queries.shape[1] else pairwise_cosine(queries[q], rows[r])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a 2-d array; rows of unequal length are an error, never dropped."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = len(values) // n if n else 0
    lengths = column.value_lengths()
    if n and (lengths.null_count or not np.all(lengths.to_numpy(zero_copy_only=False) == dim)):
        raise ValueError("all embeddings need the same length")
    return values.reshape(n, dim)


def _divide(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.round(np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), PLACES)


def cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of every query with every row of a batch; 0 where a vector is zero."""
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    return _divide(queries @ rows.T, norms)


def pairwise_cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1)
    return _divide(np.einsum("ij,ij->i", queries, rows), norms)


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centroid, less the square of the row; equal ones are equal."""
    return np.round((centroids**2).sum(axis=1)[None, :] - 2 * rows @ centroids.T, 9)


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` nearest centroids of each row, nearest first, ties to the smaller index."""
    return np.argsort(squared_distances(rows, centroids), axis=1, kind="stable")[:, :n]
