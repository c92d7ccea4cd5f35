"""Counting and BM25 scoring of words in Arrow batches of tokenised texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from passageway.functions.scan import Batches, Best, Held, keep_best, to_batch
from passageway.functions.vectors import PLACES

# Cells of the (question, text) score matrix and term matches held at once by a task.
_CELLS = 2_000_000


# Words of the texts that a task works on at once (a longer text alone), however many a batch brings.
_WORDS = 500_000
# Rows of one batch handed back to Spark.
_BATCH_ROWS = 65_536
COUNTS_SCHEMA = "id bigint, token string, tf bigint, doc_len int"
_COUNTS = pa.schema([("id", pa.int64()), ("token", pa.string()), ("tf", pa.int64()), ("doc_len", pa.int32())])


ENCODED_SCHEMA = "id bigint, embedding array<double>, token string, tf bigint"
_ENCODED = pa.schema(
    [("id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("token", pa.string()), ("tf", pa.int64())]
)


def _frequencies(text: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, frequency), one entry per word of a text, in text order."""
    pair, tf = np.unique(text * max(n_codes, 1) + code, return_counts=True)
    return *np.divmod(pair, max(n_codes, 1)), tf


def _sums(cell: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of ``n`` that occur and the sums of their weights: pairs without a word in common have no cell."""
    if n <= len(cell):  # counted without sorting where most cells occur
        cells = np.flatnonzero(np.bincount(cell, minlength=n))
        return cells, np.bincount(cell, weights=weight, minlength=n)[cells]
    cells, at = np.unique(cell, return_inverse=True)
    return cells, np.bincount(at, weights=weight, minlength=len(cells))


def _lengths(lists: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    return pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _layout(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the text of each word."""
    length = _lengths(lists)
    return length, np.repeat(np.arange(len(length)), length)


def in_pieces(batches: Batches, vocabulary: pa.Array | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """The rows of the batches, cut between texts so that wide arrays of a number a word stay small.

    With ``vocabulary`` each piece brings the number of every word in it, -1 for a word that is not there; they are looked
    up once a batch, because a lookup first takes in the whole vocabulary.
    """
    for batch in batches:
        lists = batch.column("words")
        upto = np.concatenate([[0], np.cumsum(_lengths(lists))])
        code = None
        if vocabulary is not None:
            code = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] + _WORDS, side="right")) - 1)
            yield batch.slice(start, stop - start), None if code is None else code[upto[start] : upto[stop]]
            start = stop


def count_terms(batches: Batches) -> Iterator[pa.RecordBatch]:
    """(id, token, tf, doc_len) from (id, words): a text is one row, so its counts need no shuffle."""
    for batch, _ in in_pieces(batches):
        lists, ids = batch.column("words"), batch.column("id").to_numpy()
        length, text = _layout(lists)
        words = lists.flatten().dictionary_encode()
        text, word, tf = _frequencies(text, words.indices.to_numpy(zero_copy_only=False), len(words.dictionary))
        for start in range(0, len(tf), _BATCH_ROWS):
            part = slice(start, start + _BATCH_ROWS)
            token = words.dictionary.take(pa.array(word[part]))
            columns = [ids[text[part]], token, tf[part], length[text[part]].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_COUNTS)


class HashedEncoder(NamedTuple):
    """Adds up the weights of known words (``terms``: token, idf, bucket) to one vector a text.

    With ``keep_unknown`` the other words follow as rows of their own, (id, null, token, tf).
    """

    dim: int
    keep_unknown: bool

    def __call__(self, batches: Batches, terms: pa.Table) -> Iterator[pa.RecordBatch]:
        terms = terms.combine_chunks()
        vocabulary = terms.column("token").combine_chunks()
        idf, bucket = terms.column("idf").to_numpy(), terms.column("bucket").to_numpy()
        for batch, code in in_pieces(batches, vocabulary):
            lists, ids = batch.column("words"), batch.column("id").to_numpy()
            _, text = _layout(lists)
            known = code >= 0
            where, term, tf = _frequencies(text[known], code[known], len(vocabulary))
            weight = (1 + np.log(tf)) * idf[term]
            sums = np.bincount(where * self.dim + bucket[term], weights=weight, minlength=len(ids) * self.dim)
            offsets = pa.array(np.arange(0, len(sums) + 1, self.dim, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(sums.astype(np.float64)))
            yield self._batch(ids, vectors, pa.nulls(len(ids), pa.string()), np.zeros(len(ids), np.int64))
            if self.keep_unknown and not known.all():
                rest = lists.flatten().filter(pa.array(~known)).dictionary_encode()
                where, word, tf = _frequencies(text[~known], rest.indices.to_numpy(zero_copy_only=False), len(rest.dictionary))
                token = rest.dictionary.take(pa.array(word))
                yield self._batch(ids[where], pa.nulls(len(tf), pa.list_(pa.float64())), token, tf)

    @staticmethod
    def _batch(ids: np.ndarray, vectors: pa.Array, token: pa.Array, tf: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), vectors, token, pa.array(tf)], schema=_ENCODED)


class Bm25Scorer(NamedTuple):
    """Keeps the best ``k`` texts a question; ``asked`` has (qid, token, idf), rows (id, words)."""

    k: int
    average_length: float
    k1: float
    b: float

    @property
    def pool(self) -> int:
        return self.k

    def __call__(self, batches: Batches, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        asked = asked.combine_chunks()
        if asked.num_rows == 0:
            return
        qids, question = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
        tokens = asked.column("token").combine_chunks().dictionary_encode()
        token = tokens.indices.to_numpy(zero_copy_only=False)
        by_token = np.argsort(token, kind="stable")
        # Questions that use term t: entries first[t] .. first[t + 1].
        first = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(tokens.dictionary)))])
        uses = question[by_token], asked.column("idf").to_numpy()[by_token], first
        held = Held(len(qids), self.k)
        for batch, code in in_pieces(batches, tokens.dictionary):
            for found in self._score(batch, code, len(tokens.dictionary), uses, held.floor):
                held.add([found])
        if held.rows is not None:
            yield to_batch(held.rows, qids)

    def _score(self, batch: pa.RecordBatch, code: np.ndarray, n_codes: int, uses: tuple, floor: np.ndarray) -> Iterator[Best]:
        lists, ids = batch.column("words"), batch.column("id").to_numpy()
        question, idf, first = uses
        length, text = _layout(lists)
        known = code >= 0
        text, term, tf = _frequencies(text[known], code[known], n_codes)
        saturated = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[text] / self.average_length))
        n_uses = (first[1:] - first[:-1])[term]

        # Cut the batch between texts where a piece would grow too large.
        work = np.concatenate([[0], np.cumsum(np.bincount(text, weights=n_uses, minlength=len(ids)))])
        start = 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(work, work[start] + _CELLS, side="right")) - 1)
            lo, hi = np.searchsorted(text, [start, stop])
            repeat = n_uses[lo:hi]
            entry = np.repeat(np.arange(lo, hi), repeat)
            use = np.arange(len(entry)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + first[term[entry]]
            cell = question[use] * (stop - start) + text[entry] - start
            cells, score = _sums(cell, idf[use] * saturated[entry], len(floor) * (stop - start))
            score = np.round(score, PLACES)
            q, r = np.divmod(cells, stop - start)
            good = score >= np.maximum(floor, 0.0)[q]
            q, r, score = q[good], r[good], score[good]
            yield keep_best((q, ids[start + r], score, score), self.k)
            start = stop
