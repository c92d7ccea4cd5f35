import hashlib

import pytest
from pyspark.sql import functions as F

from passageway.operators import trainmix


@pytest.fixture(scope="module")
def records(spark):
    """Two thirds of the rows are of one kind and one source."""
    return spark.range(3000).select(
        F.col("id").alias("rec_id"), F.when(F.col("id") % 3 < 2, "real").otherwise("synthetic").alias("kind"),
        F.when(F.col("id") % 3 < 2, "src0").otherwise("src9").alias("source_ref"), F.lit("p").alias("prompt"), F.lit("r").alias("response"),
    ).repartition(6)


def first(records, kind, n, seed):
    ids = [r.rec_id for r in records.filter(F.col("kind") == kind).collect()]
    return set(sorted(ids, key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())[:n])


def ids(df):
    return {r.rec_id for r in df.collect()}


def test_exact_counts(records):
    mixed = trainmix.mix(records, {"real": 201, "synthetic": 99}, "7")
    assert mixed.count() == 300 and mixed.columns == records.columns
    assert ids(mixed) == first(records, "real", 201, "7") | first(records, "synthetic", 99, "7")


def test_crowded_ranges(records, monkeypatch):
    """All rows in few hash ranges: the bound falls inside a range with many rows."""
    monkeypatch.setattr(trainmix, "hex_number", lambda digest, digits: F.conv(F.substring(digest, 1, 1), 16, 10).cast("bigint"))
    for n in (0, 1, 777, 2000, 5000):
        assert ids(trainmix.mix(records, {"real": n}, "s", short="take")) == first(records, "real", n, "s")


def test_lacking_records_are_an_error(records):
    with pytest.raises(ValueError, match="'real': 3000"):
        trainmix.mix(records, {"real": 5000, "synthetic": 10}, "s")
    with pytest.raises(ValueError, match="'other': 1"):
        trainmix.mix(records, {"other": 1}, "s")


def test_variants_change_one_thing(spark, records):
    specs = spark.createDataFrame([("small", "real", 100), ("large", "real", 300), ("mixed", "real", 100), ("mixed", "synthetic", 200)], "variant string, kind string, n int")
    got = {}
    for r in trainmix.variants(records, specs).collect():
        got.setdefault(r.variant, set()).add((r.kind, r.rec_id))
    assert {k: len(v) for k, v in got.items()} == {"small": 100, "large": 300, "mixed": 300}
    assert got["small"] < got["large"] and got["small"] < got["mixed"]


def test_provenance(spark, records):
    known = spark.createDataFrame([("src9",), ("src9",)], "source_ref string")
    got = {r.kind: (r.n_records, r.n_untraceable, r.ok) for r in trainmix.provenance_audit(records, known).collect()}
    assert got == {"real": (2000, 2000, False), "synthetic": (1000, 0, True)}
    missing = records.withColumn("source_ref", F.lit(None).cast("string"))
    assert trainmix.untraceable(missing, known).count() == 2000


def test_gap(spark, records):
    other = records.filter("kind = 'real'")
    row = trainmix.distribution_gap(records, other, "kind").first()
    assert row.total_variation == pytest.approx(1 / 3)
    assert trainmix.distribution_gap(records, records, "kind").first().total_variation == 0
