import pytest
from pyspark.sql import functions as F

from passageway.operators import evaluate
from passageway.sources import runlogs

# Published F1 and the matrix (TP, FP, FN, TN) it belongs to.
PUBLISHED = [
    (0.667, 6, 2, 4, 8), (0.824, 7, 0, 3, 10), (0.462, 3, 0, 7, 10), (0.571, 4, 0, 6, 10), (0.706, 6, 1, 4, 9),
    (0.737, 7, 2, 3, 8), (0.429, 3, 1, 7, 9), (0.947, 9, 0, 1, 10),
]


def final(spark, config, tp, fp, fn, tn, n_correct=0):
    """Verdicts of 20 questions with the given matrix."""
    rows = [(False, True)] * tp + [(True, True)] * fp + [(False, False)] * fn + [(True, False)] * tn
    answered = 0
    out = []
    for qid, (in_corpus, refused) in enumerate(rows):
        correct = in_corpus and not refused and answered < n_correct
        answered += correct
        out.append((config, qid, in_corpus, refused, correct))
    return spark.createDataFrame(out, "config_id string, qid int, in_corpus boolean, refused boolean, correct boolean")


@pytest.mark.parametrize("f1, tp, fp, fn, tn", PUBLISHED)
def test_published_matrices(spark, f1, tp, fp, fn, tn):
    row = evaluate.confusion(final(spark, "c", tp, fp, fn, tn)).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (tp, fp, fn, tn)
    assert round(row.f1, 3) == f1 and row.tp + row.fp + row.fn + row.tn == 20


def test_published_rates(spark):
    """2 + 6, 4 + 7 and 5 + 7 of 20 are 40, 55 and 60 %."""
    want = {"first": (2, 6, 0.4), "final": (4, 7, 0.55), "fallback": (5, 7, 0.6)}
    rows = final(spark, "first", 6, 2, 4, 8, 2).union(final(spark, "final", 7, 0, 3, 10, 4)).union(final(spark, "fallback", 7, 0, 3, 10, 5))
    got = {r.config_id: (r.n_correct, r.n_refused, r.total_rate) for r in evaluate.answer_rates(rows).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_interval_of_twenty(spark):
    row = evaluate.proportion_ci(spark.createDataFrame([(0.55, 20)], "rate double, n int"), "rate", "n").first()
    assert round(row.half_width, 3) == 0.219
    assert (round(row.wilson_low, 3), round(row.wilson_high, 3)) == (0.342, 0.742)


def test_consistency_finds_a_typo(spark):
    rows = spark.createDataFrame(PUBLISHED, "f1 double, tp int, fp int, fn int, tn int")
    assert evaluate.check_consistency(rows).filter("not ok").count() == 0
    typo = rows.withColumn("f1", F.when(F.col("f1") == 0.824, 0.842).otherwise(F.col("f1")))
    assert [r.f1 for r in evaluate.check_consistency(typo).filter("not ok").collect()] == [0.842]


def test_empty_matrix_has_no_f1(spark):
    row = evaluate.confusion(final(spark, "c", 0, 0, 0, 5)).first()
    assert row.f1 is None and row.precision is None


def test_judging(spark):
    answers = spark.createDataFrame(
        [("c", 1, 1, "the arm uses IK"), ("c", 1, 2, "the arm"), ("c", 1, 3, "not in the material"), ("c", 2, 1, "not in the material"), ("c", 3, 1, None), ("c", 4, 1, "x")],
        "config_id string, qid int, run int, answer string",
    )
    questions = spark.createDataFrame(
        [(1, True, ["arm", "IK"]), (2, False, []), (3, True, [])], "qid int, in_corpus boolean, expected_terms array<string>"
    )
    got = {(r.qid, r.run): (r.refused, r.correct) for r in evaluate.judge(answers, questions, ["not in the", "无"]).collect()}
    assert got[1, 1] == (False, True) and got[1, 2] == (False, False) and got[1, 3] == (True, False)
    assert got[2, 1] == (True, False) and got[4, 1] == (False, None)


def test_majority_reports_ties_and_missing_runs(spark):
    v = [("c", 1, r, True, r < 3, False) for r in (1, 2, 3)] + [("c", 2, r, True, r == 1, False) for r in (1, 2)]
    df = spark.createDataFrame(v, "config_id string, qid int, run int, in_corpus boolean, refused boolean, correct boolean")
    got = {r.qid: (r.refused, r.tied, r.missing_runs) for r in evaluate.majority(df).collect()}
    assert got == {1: (True, False, 0), 2: (False, True, 1)}


def test_run_logs_round_trip(spark, tmp_path):
    rows = [("a", "f1", 0.824), ("a", "tp", 7.0), ("b", "f1", 1e-05)]
    runlogs.write_run_logs(spark.createDataFrame(rows, "config_id string, metric string, value double"), str(tmp_path))
    patterns = {m: rf"(?m)^{m} = ([-0-9.Ee]+)$" for m in ("f1", "tp")}
    got = runlogs.parse_run_logs(spark, f"{tmp_path}/*/*.txt", patterns)
    found = [(r.path.split("config_id=")[1][0], r.metric, r.value, r.state) for r in got.collect()]
    assert sorted(found) == [(*rows[0], "found"), (*rows[1], "found"), (*rows[2], "found"), ("b", "tp", None, "absent")]


def test_bad_number_does_not_end_the_job(spark, tmp_path):
    (tmp_path / "run_log.txt").write_text("f1 = -\n")
    got = runlogs.parse_run_logs(spark, str(tmp_path), {"f1": r"f1 = ([-\d.]+)"}).collect()
    assert [(r.value, r.state) for r in got] == [(None, "unreadable")]


def test_last_match_counts(spark, tmp_path):
    (tmp_path / "run_log.txt").write_text("f1 = 0.5\nagain\nf1 = 0.7\n")
    got = runlogs.parse_run_logs(spark, str(tmp_path), {"f1": r"f1 = ([\d.]+)", "tp": r"tp = (\d+)"}).collect()
    assert [(r.metric, r.value) for r in got] == [("f1", 0.7), ("tp", None)]


CONFIGS = [("a", {"k": "4", "runs": "1"}), ("b", {"k": "8", "runs": "3"}), ("c", {"k": "8", "runs": "3", "adapter": "x"}), ("d", {"k": "8"})]


@pytest.fixture(scope="module")
def experiments(spark):
    configs = spark.createDataFrame(CONFIGS, "config_id string, params map<string,string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("d", "d")], "config_a string, config_b string")
    metrics = spark.createDataFrame(
        [(c, m, v) for c, v in zip("abcd", (0.667, 0.947, 0.824, 0.5)) for m in ("f1", "total")], "config_id string, metric string, value double"
    )
    return configs, pairs, metrics


def test_only_equal_calibers_are_subtracted(spark, experiments):
    configs, pairs, metrics = experiments
    got = {(r.config_a, r.config_b): (r.delta, r.reason) for r in evaluate.compare_runs(metrics, configs, pairs, ["k", "runs"]).collect()}
    assert got["a", "b"] == (None, "differs: k,runs")
    assert got["b", "c"][0] == pytest.approx(-0.123) and got["b", "c"][1] is None
    assert got["b", "d"] == got["d", "d"] == (None, "differs: runs")


def test_gaps_have_reasons(spark, experiments):
    configs, _, metrics = experiments
    pairs = spark.createDataFrame([("b", "c"), ("b", "zz"), ("yy", "zz")], "config_a string, config_b string")
    some = metrics.filter("NOT (config_id = 'c' AND metric = 'f1')")
    got = {(r.config_a, r.config_b, r.metric): (r.delta, r.reason) for r in evaluate.compare_runs(some, configs, pairs, ["k"]).collect()}
    assert got["b", "c", "f1"] == (None, "missing: metric of c") and got["b", "c", "total"][1] is None
    assert got["b", "zz", "f1"] == (None, "missing: parameters of zz") and got["yy", "zz", None] == (None, "missing: parameters of yy,zz")
    assert len(got) == 5


def test_changed_parameters(spark, experiments):
    configs, pairs, _ = experiments
    got = {(r.config_a, r.config_b): (r.changed, r.single_variable) for r in evaluate.config_diff(configs, pairs).collect()}
    assert got == {("a", "b"): (["k", "runs"], False), ("b", "c"): (["adapter"], True), ("b", "d"): (["runs"], True), ("d", "d"): ([], False)}


def test_ledger_accepts_small_effects_only_with_one_direction(spark):
    rows = [("a", "b", -0.123, True), ("a", "c", -0.123, False), ("a", "d", 0.3, False), ("a", "e", 0.0, False), ("a", "f", None, None)]
    df = spark.createDataFrame(rows, "config_a string, config_b string, delta double, same_direction boolean")
    got = {r.config_b: r.effect for r in evaluate.effect_ledger(df, 0.219).collect()}
    assert got == {"b": "regression", "c": "inconclusive", "d": "gain", "e": "none", "f": "not comparable"}


def test_direction(spark):
    rows = [("a", "b", -0.1), ("a", "b", -0.2), ("a", "b", 0.0), ("a", "c", 0.1), ("a", "c", -0.1), ("a", "d", 0.0)]
    got = {r.config_b: r.same_direction for r in evaluate.same_direction(spark.createDataFrame(rows, "config_a string, config_b string, delta double")).collect()}
    assert got == {"b": True, "c": False, "d": False}


def test_paired(spark):
    a, b = final(spark, "a", 5, 0, 5, 10, 7), final(spark, "b", 5, 0, 5, 10, 4)
    row = evaluate.paired_ab(a, b).first()
    assert (row.n, row.both, row.only_a, row.only_b, row.neither) == (20, 4, 3, 0, 13) and row.delta == pytest.approx(-0.15)
    assert (row.missing_a, row.missing_b) == (0, 0)
    row = evaluate.paired_ab(a.filter("qid > 1"), b.filter("qid < 19")).first()
    assert row.n + row.missing_a + row.missing_b == 20 and row.missing_a > 0 and row.missing_b > 0


def test_ablation(spark):
    df = spark.createDataFrame([(1, "只依据资料回答。 Cite! Refuse otherwise")], "template_id int, template string")
    got = [(r.variant, r.removed, r.text) for r in evaluate.ablation_variants(df).orderBy("variant").collect()]
    assert got == [
        (0, "", "只依据资料回答。 Cite! Refuse otherwise"),
        (1, "只依据资料回答。", "Cite! Refuse otherwise"),
        (2, "Cite!", "只依据资料回答。 Refuse otherwise"),
        (3, "Refuse otherwise", "只依据资料回答。 Cite!"),
    ]


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a|b", None), (2, "", "x"), (2, None, "x")], "q int, t string, u string")
    of = lambda d: evaluate.fingerprint(d, ["q", "t", "u"]).first()
    assert of(df) == of(df.orderBy(F.desc("q")).repartition(3))
    assert of(df) != of(df.withColumn("u", F.coalesce("u", F.lit("b"))))
    assert of(df) != of(df.limit(2)) and of(df.limit(0)).n_rows == 0


def test_gate_fails_on_each_fault(spark):
    clean, faulty = spark.range(2).filter("id < 1"), spark.range(2)
    names = ["collection", "numbering", "citations"]
    row = evaluate.release_gate([evaluate.check_row(n, clean, "id > 0") for n in names]).first()
    assert (row.n_checks, row.passed, row.failing, row.empty) == (3, True, "", "")
    for bad in names:
        row = evaluate.release_gate([evaluate.check_row(n, faulty if n == bad else clean, "id > 0") for n in names]).first()
        assert (row.passed, row.failing) == (False, bad)
    row = evaluate.release_gate([evaluate.check_row("a", clean, "id > 0"), evaluate.check_row("b", spark.range(0), "id > 0")]).first()
    assert (row.passed, row.failing, row.empty) == (False, "b", "b")


def test_log_keeps_what_it_corrects(spark):
    rows = [(1, 1, "F1 0.842"), (1, 2, "F1 0.824"), (2, 1, "ok")]
    df = spark.createDataFrame(rows, "entry_id int, version int, text string")
    assert sorted((r.entry_id, r.text, r.n_versions) for r in evaluate.log_current(df).collect()) == [(1, "F1 0.824", 2), (2, "ok", 1)]
    assert evaluate.log_history(df).count() == 3
    twice = spark.createDataFrame([*rows, (1, 2, "F1 0.9"), (2, 1, "ok")], df.schema)
    current = {(r.entry_id, r.n_same) for r in evaluate.log_current(twice).collect()}
    assert current == {(1, 2), (2, 2)} and evaluate.log_current(twice).count() == 2 and evaluate.log_history(twice).count() == 5


def test_final_table(spark):
    df = spark.createDataFrame([("a", "f1", 0.1), ("b", "f1", 0.2), ("a", "tp", 3.0)], "config_id string, metric string, value double")
    got = sorted(map(tuple, evaluate.final_table(df, ["a", "b"]).collect()))
    assert got == [("f1", 0.1, 0.2, "", ""), ("tp", 3.0, None, "", "")]
    clash = df.union(spark.createDataFrame([("a", "f1", 0.3), ("x", "tp", 1.0)], df.schema))
    assert sorted(map(tuple, evaluate.final_table(clash, ["a", "b"]).collect())) == [("f1", None, 0.2, "a", ""), ("tp", 3.0, None, "", "x")]


def test_hits_strict_and_loose(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 1, 30), (1, 2, 30)], "qid int, rank int, id int")
    gold_chunks = spark.createDataFrame([(1, 10), (2, 10)], "qid int, id int")
    gold_docs = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "qid int, doc_id int")
    chunk_docs = spark.createDataFrame([(10, 1), (11, 1), (30, 3)], "id int, doc_id int")
    row = evaluate.retrieval_hits(ranked, gold_chunks, gold_docs, chunk_docs, 1).first()
    assert (row.n_questions, row.n_strict, row.n_loose) == (3, 1, 2)


def test_gold_documents_are_found_once(spark):
    """They may come from a pass over all texts."""
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for row in rows:
            seen.add(1)
            yield row

    gold = spark.createDataFrame([(1, 10), (2, 20)], "qid bigint, doc_id bigint")
    gold = spark.createDataFrame(gold.rdd.mapPartitions(counted), gold.schema)
    ranked = spark.createDataFrame([(1, 1, 7)], "qid bigint, rank int, id bigint")
    chunk_docs = spark.createDataFrame([(7, 10)], "id bigint, doc_id bigint")
    row = evaluate.retrieval_hits(ranked, ranked.select("qid", "id"), gold, chunk_docs, 8).first()
    assert (row["n_questions"], row["n_strict"], row["n_loose"], seen.value) == (2, 1, 1, 2)
