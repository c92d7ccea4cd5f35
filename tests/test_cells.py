"""Cells in two levels against flat cells and the exact ranking."""

import re

import numpy as np
import pytest

from passageway.operators import cells, retrieve

NAMES = ("qid", "rank", "id", "score")


def frame(spark, x, name):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{name} bigint, embedding array<double>")


def rows(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12))
    v = centres[rng.integers(0, 30, 1500)] + 0.15 * rng.normal(size=(1500, 12))
    v[:500] = centres[0] + 0.05 * rng.normal(size=(500, 12))  # a third in one region
    v[700] = 0
    v[800:810] = v[800]
    q = np.concatenate([centres[:6] + 0.1 * rng.normal(size=(6, 12)), v[800:801], np.zeros((1, 12)), -v[3:4]])
    return frame(spark, q, "qid"), frame(spark, v, "id").repartition(4)


@pytest.fixture(scope="module")
def tree(points):
    return cells.fit_cell_tree(points[1], 40, rows_each=8)


def test_all_cells_are_exact_and_stored_groups_are_pruned(spark, points, tree, tmp_path, monkeypatch):
    queries, vectors = points
    monkeypatch.setattr(cells, "GROUP_ROWS", 100)  # the large group meets its centres in several tasks
    assigned = cells.assign(vectors, tree)
    cells.write_cells(assigned, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == 1500 and stored.select("id").distinct().count() == 1500
    want = rows(retrieve.exact_topk(queries, vectors, 7))
    assert rows(cells.probe_topk(queries, stored, tree, 7, n_groups=99, nprobe=99)) == want
    few = cells.probe_topk(queries.filter("qid = 2"), stored, tree, 7, n_groups=1, nprobe=1)
    assert few.count() == 7
    read = cells._only(stored, spark.createDataFrame([([0],)], "cells array<int>"), tree)
    assert re.search(r"PartitionFilters: \[.*parent#\d+ = \d+", read._jdf.queryExecution().executedPlan().toString())
    bounded = cells.exact_topk_bounded(queries, stored, tree, cells.cell_reach(stored), 7)
    assert rows(bounded.top) == want
    # A question amid its cell does not look into all of them.
    looked = dict(bounded.looked_into.groupBy("qid").count().collect())
    n_cells = tree.centres.count()
    assert looked[0] < n_cells / 2 and looked[7] == stored.select("cell").distinct().count()


def test_assignment_is_the_nearest_of_the_nearest_group(points, tree):
    x = {r.id: np.array(r.embedding) for r in points[1].collect()}
    centres = {r.cell: (np.array(r.centroid), r.parent) for r in tree.centres.collect()}
    assert len(centres) >= 30
    for r in cells.assign(points[1], tree).collect():
        v = x[r.id]
        group = min(range(len(tree.groups)), key=lambda g: (round(float(((v - tree.groups[g]) ** 2).sum()), 6), g))
        assert r.parent == group
        near = min((round(float(((v - c) ** 2).sum()), 7), i) for i, (c, p) in centres.items() if p == group)
        assert abs(near[0] - float(((v - centres[r.cell][0]) ** 2).sum())) < 1e-6
        unit = v / np.linalg.norm(v) if v.any() else v
        assert abs(r.reach - np.linalg.norm(unit - centres[r.cell][0])) < 1e-9


def test_bounds_hold_when_cells_overlap(spark):
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(400, 4)), rng.normal(size=(12, 4))
    vectors, queries = frame(spark, v, "id"), frame(spark, q, "qid")
    tree = cells.fit_cell_tree(vectors, 50, rows_each=4)
    assigned = cells.assign(vectors, tree)
    for k in (1, 30, 500):
        found = cells.exact_topk_bounded(queries, assigned, tree, cells.cell_reach(assigned), k, nprobe=2)
        assert rows(found.top) == rows(retrieve.exact_topk(queries, vectors, k))


def test_a_hundred_thousand_centres(spark, monkeypatch):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(100_000, 4)).round(3)
    v, q = rng.normal(size=(300, 4)), rng.normal(size=(3, 4))
    centres = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "cell int, centroid array<double>")
    vectors, queries = frame(spark, v, "id"), frame(spark, q, "qid")
    tree = cells.group_centres(centres, 60)
    assert tree.centres.count() == 100_000 and len(tree.groups) == 60
    assigned = cells.assign(vectors, tree)
    assert assigned.count() == 300
    got = cells.probe_topk(queries, assigned, tree, 5, n_groups=60, nprobe=100_000)
    assert rows(got) == rows(retrieve.exact_topk(queries, vectors, 5))


def test_centres_too_many_for_a_block_are_probed_in_two_steps(spark, points, monkeypatch):
    queries, vectors = points
    centres = retrieve.fit_cells(vectors, 9)
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 100)
    assigned = retrieve.assign_cells(vectors, centres)
    assert assigned.columns == ["id", "embedding", "cell"] and assigned.count() == 1500
    got = retrieve.ann_topk(queries, assigned, 5, coarse="ivf", centroids=centres, nprobe=9)
    assert rows(got) == rows(retrieve.exact_topk(queries, vectors, 5))


def test_no_vectors_and_no_questions(spark, points, tree):
    queries, vectors = points
    none = cells.assign(vectors.limit(0), tree)
    assert none.count() == 0
    assert cells.probe_topk(queries, none, tree, 3).count() == 0
    assigned = cells.assign(vectors, tree)
    assert cells.exact_topk_bounded(queries.limit(0), assigned, tree, cells.cell_reach(assigned), 3).top.count() == 0
    with pytest.raises(ValueError):
        cells.group_centres(spark.createDataFrame([], "cell int, centroid array<double>"))
