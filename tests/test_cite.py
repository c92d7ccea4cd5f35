import random
import re

import pytest
from pyspark.sql import functions as F

from passageway.operators import cite

ANSWERS = "config_id string, qid int, run int, answer string"
KEY = ("a", 1, 1)


def answers(spark, *texts):
    return spark.createDataFrame([("a", i, 1, t) for i, t in enumerate(texts, 1)], ANSWERS)


def supplied(spark, *ids, qids=(1,)):
    rows = [("a", q, r, n) for q in qids for r, n in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "config_id string, qid int, rank int, chunk_no int")


def test_extraction_keeps_order_and_repeats(spark):
    df = answers(spark, "x [资料§103]、[资料§103] y [资料§7] [资料§x]", "none")
    assert [r.citations for r in cite.extract_citations(df).orderBy("qid").collect()] == [[103, 103, 7], []]


@pytest.mark.parametrize(
    "ids, text, want",
    [
        ([30], "a [资料§3]、[资料§30]。", "a [资料§30]。"),
        ([30], "a [资料§30]、[资料§3]。", "a [资料§30]。"),
        ([1, 2], "a [资料§1]、[资料§9]、[资料§2]", "a [资料§1]、[资料§2]"),
        ([7], "a [资料§007] b [资料§70]", "a [资料§007] b "),
        ([], "a [资料§1]、[资料§2]", "a "),
        ([5], "no marks、here", "no marks、here"),
        ([3], "x [资料§[资料§9]4]", "x [资料§ 4]"),
        ([3], "x [[资料§9]资料§3]", "x [ 资料§3]"),
    ],
)
def test_whitelist(spark, ids, text, want):
    got = cite.enforce_whitelist(answers(spark, text), supplied(spark, *ids) if ids else supplied(spark, 1, qids=(99,)))
    assert got.first().answer == want


def test_places_not_numbers_are_counted(spark):
    row = cite.illegal_citations(answers(spark, "[资料§9][资料§9] [资料§1]"), supplied(spark, 1)).first()
    assert (row.illegal, row.n_illegal) == (["9", "9"], 2)


def test_numbers_of_any_length(spark):
    long = "9" * 30
    df = answers(spark, f"a[资料§{long}]、[资料§0001] b[资料§{long}]")
    assert cite.extract_citations(df).first().citations == [None, 1, None]
    row = cite.illegal_citations(df, supplied(spark, 1)).first()
    assert (row.illegal, row.n_illegal) == ([long, long], 2)
    assert cite.enforce_whitelist(df, supplied(spark, 1)).first().answer == "a[资料§0001] b"
    assert cite.dedupe_citations(df).first().n_repeated == 1


def test_control_characters_stay(spark):
    text = "x\x01y\x02a [资料§9]z\x02\x01"
    assert cite.enforce_whitelist(answers(spark, text), supplied(spark, 1)).first().answer == "x\x01y\x02a z\x02\x01"


def test_flips_report_what_has_no_partner(spark):
    schema = "config_id string, qid int, run int, correct boolean"
    a = spark.createDataFrame([("c", 1, 1, True), ("c", 2, 1, False), ("d", 1, 1, True)], schema)
    b = spark.createDataFrame([("c", 1, 1, False), ("c", 3, 1, True)], schema)
    got = {r.config_id: (r.n_compared, r.n_gained, r.n_lost, r.n_flipped, r.n_unmatched) for r in cite.verdict_flips(a, b).collect()}
    assert got == {"c": (1, 0, 1, 1, 2), "d": (0, 0, 0, 0, 1)}


def test_passages_beyond_the_window_are_illegal(spark):
    df = answers(spark, "[资料§5]")
    assert cite.illegal_citations(df, supplied(spark, 1, 2, 5), 2).first().n_illegal == 1


def test_after_the_whitelist_nothing_illegal_is_left(spark):
    rng = random.Random(11)
    pieces = ["word", " ", "、", "，", ", ", "。", "[资料§", "]", "资料§3", "4", "\n"]
    texts = [
        "".join(rng.choice(pieces) if rng.random() < 0.5 else f"[资料§{rng.randrange(12)}]" for _ in range(rng.randrange(12)))
        for _ in range(400)
    ]
    df, ids = answers(spark, *texts), supplied(spark, 1, 3, 10, qids=range(1, 401))
    once = cite.enforce_whitelist(df, ids)
    assert cite.illegal_citations(once, ids).agg(F.sum("n_illegal")).first()[0] == 0
    clean = {r.qid: r.answer for r in once.collect()}
    again = {r.qid: r.answer for r in cite.enforce_whitelist(once, ids).collect()}
    assert clean == again and len(clean) == 400
    legal = re.compile(r"\[资料§(?:1|3|10)\]")
    for qid, text in enumerate(texts, 1):
        assert legal.findall(text) == legal.findall(clean[qid])


def test_repeats(spark):
    df = answers(spark, "x [资料§103]、[资料§103] [资料§103] y [资料§7]、[资料§103]")
    row = cite.dedupe_citations(df).first()
    assert (row.n_repeated, row.answer) == (3, "x [资料§103] y [资料§7]、[资料§103]")


def test_retry_replaces_only_flagged(spark):
    first, second = answers(spark, "one", "two", "three"), answers(spark, "ONE", "TWO")
    flags = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 3, 1)], "config_id string, qid int, run int")
    got = {r.qid: (r.answer, r.retried) for r in cite.apply_retry(first, second, flags).collect()}
    assert got == {1: ("ONE", True), 2: ("two", False), 3: ("three", False)}


def test_flips(spark):
    schema = "config_id string, qid int, run int, correct boolean"
    a = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 1, False), ("a", 3, 1, True)], schema)
    b = spark.createDataFrame([("a", 1, 1, False), ("a", 2, 1, True), ("a", 3, 1, True)], schema)
    row = cite.verdict_flips(a, b).first()
    assert (row.n_compared, row.n_gained, row.n_lost, row.n_flipped) == (3, 1, 1, 2)
    assert cite.verdict_flips(a, a).first().n_flipped == 0
