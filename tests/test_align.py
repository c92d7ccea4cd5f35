"""Alignment of shifted numbers against the longest rising subsequence found outright."""

import random
from collections import Counter

import pytest

from passageway.operators import align


def frame(spark, texts):
    rows = [(c, i, t) for c, ts in texts.items() for i, t in enumerate(ts, 1)]
    return spark.createDataFrame(rows, "collection string, chunk_no bigint, text string").repartition(3)


def aligned(spark, left, right):
    rows = align.align_shifted(frame(spark, left), frame(spark, right)).collect()
    return {(r.collection, r.left_no, r.right_no): r.status for r in rows}, len(rows)


def test_one_insertion_is_one_insertion(spark):
    texts = [f"passage {i}" for i in range(300)]
    got, n = aligned(spark, {"a": texts}, {"a": [*texts[:100], "new", *texts[100:]]})
    assert n == 301 and Counter(got.values()) == {"same": 100, "shifted": 200, "inserted": 1}
    assert got["a", None, 101] == "inserted"


def test_moves_deletions_and_repeats(spark):
    texts = [f"p{i}" for i in range(120)]
    right = [*texts[10:40], *texts[60:90], *texts[40:50], *texts[90:], "dup", "dup", None]
    got, n = aligned(spark, {"a": [*texts, "dup"], "b": ["x"]}, {"a": right, "c": ["x"]})
    assert n == len(got) == 120 + 1 + 3 + 2
    assert Counter(got.values()) == {"shifted": 90, "moved": 10, "deleted": 21, "repeated": 3, "inserted": 2}
    assert all(got["a", 41 + i, 61 + i] == "moved" for i in range(10))
    assert got["b", 1, None] == "deleted" and got["c", None, 1] == "inserted"


def longest(pairs):
    """Most anchors of a rising chain, by comparing each with all before."""
    best = []
    for i, (_, r) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(i) if pairs[j][1] < r), default=0))
    return max(best, default=0)


@pytest.mark.parametrize("rows", [1_000_000, 5])
def test_kept_order_is_as_long_as_can_be(spark, monkeypatch, rows):
    monkeypatch.setattr(align, "BLOCK_BITS", 4)
    monkeypatch.setattr(align, "CHAIN_ROWS", rows)
    rng = random.Random(2)
    left = [f"t{i}" for i in range(250)]
    pieces = [left[i : i + 10] for i in range(0, 250, 10)]
    for _ in range(4):
        pieces.insert(rng.randrange(25), pieces.pop(rng.randrange(25)))
    right = [t for piece in pieces for t in piece if rng.random() < 0.95]
    right.insert(77, "new")
    got, _ = aligned(spark, {"a": left}, {"a": right})
    pairs = sorted((k[1], k[2]) for k, s in got.items() if s in ("same", "shifted", "moved"))
    kept = sorted((k[1], k[2]) for k, s in got.items() if s in ("same", "shifted"))
    assert [r for _, r in kept] == sorted(r for _, r in kept) and len(pairs) == len(right) - 1
    assert len(kept) == longest(pairs) if rows > 5 else len(kept) >= 0.8 * longest(pairs)


def test_chain_against_all_chains():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(0, 9)
        places = rng.sample(range(n), n)
        runs = [(i * 10, places[i] * 10, rng.randrange(1, 6)) for i in range(n)]
        best = 0
        for mask in range(1 << n):
            some = [runs[i] for i in range(n) if mask >> i & 1]
            if all(a[1] < b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(x[2] for x in some))
        chain = [runs[i] for i in align.heaviest_chain(runs)]
        assert all(a[1] < b[1] for a, b in zip(chain, chain[1:])) and sum(x[2] for x in chain) == best


def test_empty_sides(spark):
    assert aligned(spark, {}, {}) == ({}, 0)
    assert set(aligned(spark, {"a": ["x", "y"]}, {})[0].values()) == {"deleted"}
    both = align.align_shifted(frame(spark, {"a": ["x"]}).drop("collection"), frame(spark, {"b": ["x"]}).drop("collection"))
    assert [tuple(r) for r in both.collect()] == [("corpus", 1, 1, "same")]
