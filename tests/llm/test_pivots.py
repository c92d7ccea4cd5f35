import numpy as np
import pytest
from brute import components

from passageway.llm import pivots


def exact(vectors, cosine):
    unit = {k: v / np.linalg.norm(v) for k, v in vectors.items()}
    linked = lambda a, b: len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine
    keys = sorted(vectors)
    links = {k: sum(linked(k, o) for o in keys if o != k) for k in keys}
    return links, components(keys, linked)


def result(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("block", [8, 2048])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(pivots.list_links, "__defaults__", (block,))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(25, 32))
    vectors = {i: centres[i % 25] + rng.normal(size=32) * (0.05 + 0.3 * (i % 3 == 0)) for i in range(600)}
    vectors |= {600 + i: rng.normal(size=32) for i in range(150)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id bigint, embedding array<double>")
    got = result(pivots.near_vectors(df).collect())
    links, _ = exact(vectors, 0.95)
    assert all(got[k][0] <= links[k] for k in vectors)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(links.values()) > 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [nan, 1.0, 0.0]),
        (9, [inf, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [-1.0, 0.0, 0.0]), (12, [0.95, 0.3122498999199199, 0.0]), (13, [0.9, 0.435889894354, 0.0]), (14, None),
    ]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id bigint, embedding array<float>, node int, w int")
    got = result(pivots.near_vectors(df).collect())
    assert len(got) == 14
    valid = {k: np.array(v, dtype=np.float32).astype(float) for k, v in rows if k in (1, 2, 3, 10, 11, 12, 13)}
    links, labels = exact(valid, 0.95)
    assert got == {k: (links.get(k, 0), labels.get(k, k)) for k, _ in rows}
    assert pivots.near_vectors(df.filter("false")).count() == 0
    assert pivots.near_vectors(df.filter("vec_id = 4")).collect()[0]["n_links"] == 0
    assert [r["kept"] for r in pivots.near_vectors(df.filter("vec_id < 3")).orderBy("vec_id").collect()] == [True, False]


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_vectors(df).collect()), key=repr) == [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)]


def hot_region(n, seed=9):
    """A third of ``n`` vectors around one centre, with cosines of about 0.96 to one another; the rest at random."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    x = np.concatenate([centre + rng.normal(size=(n // 3, 64)) * np.sqrt((1 / 0.96 - 1) / 64), rng.normal(size=(n - n // 3, 64))])
    return (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(n)], centre


def test_links_of_a_hot_region(spark):
    x, _ = hot_region(20_000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = pivots.near_vectors(df).collect()
    exact = sum(int((x[a : a + 1000] @ x.T >= 0.95).sum()) for a in range(0, len(x), 1000)) - len(x)
    assert exact > 10_000_000 and 0.9 * exact <= sum(r["n_links"] for r in got) <= exact


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_pivots_of_a_hot_region(spark, n):
    x, centre = hot_region(n)
    most = int(n**0.5 / 2)
    sample = spark.createDataFrame([(i, v) for i, v in enumerate(x[: 8 * most].tolist())], "node bigint, vec array<double>")
    refs = pivots.choose_pivots(sample, most, 0.95)[64]
    hot = x[x @ centre > 0.9][:2000]
    near = np.argsort(-(hot @ refs.T), axis=1)[:, :5]
    i, j = np.nonzero(np.triu(hot @ hot.T >= 0.95, 1))
    i, j = i[::20], j[::20]
    assert ((near[i][:, :, None] == near[j][:, None, :]).sum((1, 2)) >= 2).mean() >= 0.9


def test_a_region_of_its_own_has_few_pivots():
    x, centre = hot_region(3000)
    hot = x[x @ centre > 0.9]
    assert len(pivots.spread_pivots(hot, 64, 0.9)) <= 5 and len(pivots.spread_pivots(x, 64, 0.9)) == 64
