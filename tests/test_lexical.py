"""Word counts, vectors and scores do not depend on how a batch is cut, and no array spans a whole batch."""

import numpy as np
import pyarrow as pa
import pytest

from passageway.functions import lexical

TEXTS = [["a", "b", "a"], [], None, ["c"] * 9, ["b", "c"], ["x", "a", "b"], ["d", "d"]]
BATCH = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(TEXTS, pa.list_(pa.string()))], names=["id", "words"])
TERMS = pa.table({"token": ["a", "b", "c"], "idf": [1.0, 2.0, 0.5], "bucket": pa.array([0, 1, 1], pa.int32())})
ASKED = pa.table({"qid": [1, 1, 2], "token": ["a", "b", "c"], "idf": [1.0, 2.0, 0.5]})
FUNCTIONS = {
    "count": lambda: lexical.count_terms([BATCH, BATCH.slice(2, 3)]),
    "encode": lambda: lexical.HashedEncoder(4, True)([BATCH, BATCH.slice(2, 3)], TERMS),
    "score": lambda: lexical.Bm25Scorer(3, 2.0, 1.2, 0.75)([BATCH, BATCH.slice(2, 3)], ASKED),
}


def rows(name):
    return sorted((tuple(map(str, r.values())) for b in FUNCTIONS[name]() for r in b.to_pylist()))


@pytest.mark.parametrize("name", FUNCTIONS)
def test_pieces_of_a_batch(monkeypatch, name):
    whole, sizes, plain = rows(name), [], lexical._frequencies
    monkeypatch.setattr(lexical, "_WORDS", 4)
    monkeypatch.setattr(lexical, "_frequencies", lambda text, code, n: sizes.append(len(np.asarray(text))) or plain(text, code, n))
    assert rows(name) == whole
    assert max(sizes) == 9 and sorted(sizes)[-3] <= 4  # only the longer text, which comes twice, goes beyond


def test_sums_by_counting_are_those_by_sorting():
    rng = np.random.default_rng(2)
    cell, weight = rng.integers(0, 40, 60) * 2, rng.random(60)
    counted, sorted_ = lexical._sums(cell, weight, 60 + 20), lexical._sums(cell, weight, 10_000)
    dense = lexical._sums(cell % 50, weight, 60)
    assert all((a == b).all() for a, b in zip(counted, sorted_))
    assert dense[0].tolist() == sorted({x % 50 for x in cell.tolist()})
    assert np.allclose(dense[1], [weight[cell % 50 == c].sum() for c in dense[0]])
