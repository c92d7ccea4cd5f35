import os
from itertools import combinations

import numpy as np
import pytest
from brute import components, likeness, shingles, words

from passageway.llm import verified

SF = "/root/testdata/sf0.1"


def edited(rng, tokens, changes):
    out = list(tokens)
    for at in rng.integers(0, len(out), changes).tolist():
        out[at] = f"new{rng.integers(1 << 30)}"
    return out


def similar_texts(rng):
    """Families of copies with few to many changed words, so that likenesses lie on both sides of 0.8, among other texts."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for family in range(60):
        base = rng.choice(vocabulary, int(rng.integers(60, 400))).tolist()
        out.append(" ".join(base))
        out += [" ".join(edited(rng, base, int(rng.integers(0, 1 + len(base) // 30)))) for _ in range(family % 6)]
    return out + [" ".join(rng.choice(vocabulary, 80)) for _ in range(100)]


@pytest.mark.parametrize("block", [2, 1024])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(verified.exact_links, "__defaults__", (block,))
    texts = dict(enumerate(similar_texts(np.random.default_rng(3))))
    sets = {k: shingles(v) for k, v in texts.items()}
    true = components(sorted(texts), lambda a, b: likeness(sets[a], sets[b]) >= 0.8)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in verified.one_of_each_verified(df).collect()}
    due = set(true.values())
    assert due <= kept  # no link below the threshold
    gone = set(texts) - due
    assert len(gone) > 40 and len(gone - kept) >= 0.9 * len(gone)


def test_estimates_agree_with_exact_likeness():
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in rng.integers(0, 900, 500).tolist()]
    for changes in (0, 3, 10, 25, 60):
        other = edited(rng, base, changes)
        a, b = (verified.shingle_hashes([w.encode() for w in t], 5) for t in (base, other))
        bits = int(np.bitwise_count(verified.sketch(a) ^ verified.sketch(b)).sum())
        exact = likeness(shingles(" ".join(base)), shingles(" ".join(other)))
        assert abs(1 - 2 * bits / verified.BITS - exact) < 0.13


def test_neighbours_against_all_pairs():
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 64, 700, dtype=np.uint64) & np.uint64(0xFFFF00000FFFF))
    exact = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 6).sum(1) > 1
    assert exact.any() and not exact.all()
    assert (verified.with_neighbour(fps, 6) == exact).all()


def test_same_words_in_another_order_are_not_duplicates(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.permutation(base)) for _ in range(4)] + [" ".join(base), " ".join(base).upper() + " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in verified.one_of_each_verified(df).collect()) == [0, 1, 2, 3, 4]


def test_a_large_family(spark):
    """Near copies of one text: settled by estimates, without a pair for each two of them."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300).tolist()]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["doc_id"] for r in verified.one_of_each_verified(df).collect()] == [0]


def test_odd_documents(spark, odd_docs):
    kept = verified.one_of_each_verified(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 1, 2 and 2 are copies; 3, 4 and 5 have no word.
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert verified.one_of_each_verified(odd_docs.filter("false")).count() == 0


def test_rows_without_ids(spark):
    texts = ["one two three four five six", "one two three four five six", "quite another text of some words", None]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    kept = [r["text"] for r in verified.one_of_each_verified(df).collect()]
    assert sorted(kept, key=str) == sorted([texts[0], texts[2], None], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_recall_and_precision_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {k: frozenset(map(hash, shingles(v))) for k, v in texts.items()}
    first = {}
    for k in sorted(sets):
        first.setdefault((sets[k], len(words(texts[k]))) if not sets[k] else sets[k], k)
    lists = {}
    for k in first.values():
        # Sets that share 0.8 or more share one of the first fifth of their elements, in any fixed order.
        for h in sorted(sets[k])[: len(sets[k]) // 5 + 1]:
            lists.setdefault(h, []).append(k)
    pairs = {p for found in lists.values() for p in combinations(sorted(found), 2)}
    linked = {p for p in pairs if likeness(sets[p[0]], sets[p[1]]) >= 0.8}
    root = components(sorted({k for p in linked for k in p}), lambda a, b: (a, b) in linked)
    gone = {k for k, r in root.items() if k != r}
    kept = {r["doc_id"] for r in verified.one_of_each_verified(docs).collect()}
    dropped = set(first.values()) - kept
    assert len(gone) >= 20 and len(dropped & gone) >= 0.9 * len(gone)
    assert len(dropped & gone) >= 0.9 * len(dropped)
