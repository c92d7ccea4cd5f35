import itertools

import numpy as np
import pytest
import xxhash
from brute import components, words

from passageway.llm import simhash
from passageway.llm.components import connected_components


def plain_fingerprint(text, n=3):
    w = words(text)
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "one two", "A b c D e f", "x y z " * 50_000, "É é ß ẞ İ i I"])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 3])
def test_masks_cover_every_difference(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        change = sum(1 << b for b in bits)
        assert any(change & m == 0 for m in masks)
    assert all(25 <= m.bit_count() <= 44 for m in masks)


def clustered(rng, n):
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    out = base[rng.integers(0, 6, n)]
    for _ in range(5):
        out ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0)).astype(np.uint64)
    return np.unique(out)


def test_links_of_a_long_run_connect_as_all_pairs_do():
    fps = clustered(np.random.default_rng(1), 900)
    for run in (10_000, 40):
        links = simhash.run_links(fps, 3, run=run)
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        keys = fps.tolist()
        exact = components(keys, lambda a, b: (a ^ b).bit_count() <= 3)
        root = {k: k for k in keys}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in links:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        assert {k: find(k) for k in keys} == exact


def test_links_over_tables(spark):
    fps = clustered(np.random.default_rng(2), 700)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint"))
    exact = components(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    found = {r["node"] % (1 << 64): r["component"] for r in connected_components(links).collect()}
    groups = lambda label: sorted(sorted(g) for g in label.values())
    by = lambda pairs: {v: [k for k, w in pairs.items() if w == v] for v in pairs.values()}
    assert groups(by(found)) == groups({v: g for v, g in by(exact).items() if len(g) > 1})


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, int(x)) for x in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = set(edges)
    exact = components(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in linked or (b, a) in linked)
    assert {k: exact[k] for k in got} == got and all(exact[k] == k for k in exact if k not in got)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    label = {r["doc_id"]: r["component_id"] for r in rows}
    assert label[1] == label[2] == 1 and label[3] == label[4] == label[5] == 3 and label[6] == 6
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 6, 7, 8, 9, 10} <= set(ids) and not {2, 4, 5} & set(ids)
    assert simhash.one_of_each(odd_docs.filter("false")).count() == 0


def test_rows_without_a_key_or_with_the_same_one_stay(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(None, text(i)) for i in range(20)] + [(None, text(0)), (5, text(1)), (7, text(40)), (7, text(41)), (7, text(41)), (6, text(41)), (8, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()), key=repr)
    assert kept == sorted([(None, text(i)) for i in range(20) if i != 1] + [(5, text(1)), (6, text(41)), (7, text(40)), (8, None)], key=repr)
