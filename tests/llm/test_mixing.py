import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from passageway.llm import mixing, order
from passageway.llm.common import word_count


def shared(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    names = sorted((k for k in sizes if k is not None), key=lambda x: x) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[k] for k in open_)
        gone = 0.0
        for k in list(open_):
            target[k] += left * weight[k] / total
            if target[k] >= most * sizes[k]:
                gone += target[k] - most * sizes[k]
                target[k] = most * sizes[k]
                open_.discard(k)
        left = gone
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 40, "c": 10, None: 7}, {"z": 5}, {"a": 0, "b": 0}, {"b": 0, "a": 50, "é": 900, "Z": 3, None: 80}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.capped_targets(rows, [5, 2, 1], 1.5, 2.0).collect()}
    assert got == pytest.approx(shared(sizes, [5, 2, 1], 1.5, 2.0), abs=1e-5)


def test_copies_follow_their_expectation(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), (F.col("id") % 700 + 1).alias("size"))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 20_000
    taken = defaultdict(int)
    for r in rows:
        expected = r["target"] / r["source_size"]
        assert math.floor(expected - 1e-6) <= r["copies"] <= math.ceil(expected + 1e-6) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"], r["target"]] += r["taken"]
    for (_, target), words in taken.items():
        assert abs(words - target) < 2_000
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("size", word_count("text"))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["source"] for r in rows} == {"a", "b", "ü", None}
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.take_copies(mixing.mix_sources(docs)).count() == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(docs.filter("false")).count() == 0


def test_running_sum(spark):
    df = spark.range(5_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 9).alias("c"), (F.col("id") % 4).alias("p"), "id", (F.col("id") % 11).alias("v"))
    got = order.running_sum(df, ["g"], "v", "c", "p", ["id"], "total").orderBy("g", "c", "p", "id").collect()
    total = defaultdict(int)
    for r in got:
        total[r["g"]] += r["v"]
        assert r["total"] == total[r["g"]]
