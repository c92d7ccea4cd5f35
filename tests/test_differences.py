"""Differences of stored sets against comparing all rows."""

import random
import re

from passageway.operators import differences

SCHEMA = "id bigint, part string, text string"


def stored(spark, rows, out):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    differences.store_digests(df, ["id", "part"], ["id", "part", "text"], out)
    return df


def brute(a, b):
    def sets(rows):
        out = {}
        for i, part, text in rows:
            out.setdefault((i, part), []).append("-" if text is None else "+" + text)
        return {k: sorted(v) for k, v in out.items()}

    x, y = sets(a), sets(b)
    names = {k: "added" if k not in x else "removed" if k not in y else "changed" for k in {*x, *y} if x.get(k) != y.get(k)}
    return sorted(((*k, v) for k, v in names.items()), key=repr)


def test_changes_are_named(spark, tmp_path):
    rng = random.Random(3)
    a = [(i, rng.choice(["p", "q|", None]), rng.choice(["x", "y", "", None, "z" * 50])) for i in range(400)]
    a += [(None, "p", "no id"), (None, None, None), (7, "p", "again"), (7, "p", "again"), (1, "1:2", "t"), (11, "2", "t")]
    b = [r for r in a if rng.random() < 0.97] + [(500, "p", "new"), (7, "p", "again")]
    b = [(i, part, "changed" if i is not None and i % 97 == 0 else text) for i, part, text in b]
    one, two = (stored(spark, rows, str(tmp_path / n)) for rows, n in ((a, "a"), (b, "b")))
    changes = differences.changed_rows(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = differences.named(changes, one, two, keys=["id", "part"]).collect()
    assert sorted(map(tuple, got), key=repr) == brute(a, b) and changes.count() == len(got)


def test_only_differing_ranges_are_read(spark, tmp_path):
    rows = [(i, "p", f"t{i}") for i in range(300)]
    stored(spark, rows, str(tmp_path / "a"))
    stored(spark, [*rows[:17], (17, "p", "other"), *rows[18:]], str(tmp_path / "b"))
    assert len(differences.differing_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b"))) == 1
    changes = differences.changed_rows(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert [tuple(r) for r in changes.collect()] == [("2:17|1:p", "changed")]
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*family#\d+ = \d+", plan) and re.search(r"PushedFilters: \[.*EqualTo\(range,", plan)


def test_equal_and_empty_sets(spark, tmp_path):
    rows = [(i, "p", f"t{i}") for i in range(50)]
    stored(spark, rows, str(tmp_path / "a"))
    stored(spark, rows[::-1], str(tmp_path / "b"))
    assert differences.differing_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b")) == []
    assert differences.changed_rows(spark, str(tmp_path / "a"), str(tmp_path / "b")).count() == 0
    stored(spark, [], str(tmp_path / "none"))
    gone = differences.changed_rows(spark, str(tmp_path / "a"), str(tmp_path / "none")).collect()
    assert len(gone) == 50 and {r.change for r in gone} == {"removed"}
