"""Uncertainty of differences against plain counting."""

import hashlib
import math
import random

import pytest

from passageway.operators import uncertainty
from passageway.operators.evaluate import confusion

FINAL = "config_id string, qid bigint, in_corpus boolean, refused boolean, correct boolean"


def finals(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        inside = rng.random() < 0.6
        for config, share in (("a", 0.5), ("b", 0.75)):
            refused = rng.random() < (0.1 if inside else share)
            rows.append((config, q, inside, refused, inside and not refused and rng.random() < share))
    return rows


def weight(u):
    total, term, k = 0.0, math.exp(-1), 0
    while True:
        total += term
        if u < math.floor(total * 16**6) or k > 12:
            return k
        k += 1
        term /= k


def f1(rows):
    tp = sum(w for w, inside, r, _ in rows if not inside and r)
    fp = sum(w for w, inside, r, _ in rows if inside and r)
    fn = sum(w for w, inside, r, _ in rows if not inside and not r)
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else None


def test_bootstrap_against_drawing_each_replicate(spark):
    rows = finals(1)
    final = spark.createDataFrame(rows, FINAL).repartition(5)
    pairs = spark.createDataFrame([("a", "b")], "config_a string, config_b string")
    paired = uncertainty.pair_verdicts(final, pairs)
    got = {r.metric: r for r in uncertainty.paired_bootstrap(paired, 43, "s").collect()}
    deltas = []
    for r in range(43):
        sides = {}
        for config, q, inside, refused, correct in rows:
            u = int(hashlib.md5(f"s|{q}|{r // 5}".encode()).hexdigest()[r % 5 * 6 : r % 5 * 6 + 6], 16)
            sides.setdefault(config, []).append((weight(u), inside, refused, correct))
        deltas.append(f1(sides["b"]) - f1(sides["a"]))
    deltas.sort()
    assert got["f1"].n == 120 and got["f1"].n_replicates == 43
    assert abs(got["f1"].low - deltas[1]) < 1e-9 and abs(got["f1"].high - deltas[41]) < 1e-9  # the second from either end
    assert got["total_rate"].low <= got["total_rate"].delta <= got["total_rate"].high
    again = {r.metric: r for r in uncertainty.paired_bootstrap(paired.coalesce(1), 43, "s").collect()}
    assert again == got


def test_bootstrap_covers_and_copes(spark):
    pairs = spark.createDataFrame([("a", "b")], "config_a string, config_b string")
    same = [(c, q, q % 2 == 0, q % 3 == 0, False) for q in range(50) for c in "ab"]
    got = uncertainty.paired_bootstrap(uncertainty.pair_verdicts(spark.createDataFrame(same, FINAL), pairs), 20).collect()
    assert all(r.delta == r.low == r.high == 0 for r in got)
    # No positive question: F1 is not defined, whatever is drawn; unpaired questions are in no pair.
    odd = [("a", 1, True, False, True), ("b", 1, True, False, None), ("a", 2, True, False, True)]
    got = {r.metric: r for r in uncertainty.paired_bootstrap(uncertainty.pair_verdicts(spark.createDataFrame(odd, FINAL), pairs), 20).collect()}
    assert (got["f1"].n, got["f1"].delta, got["f1"].low, got["f1"].n_replicates) == (1, None, None, 0)
    assert got["total_rate"].delta == -1.0
    assert uncertainty.paired_bootstrap(uncertainty.pair_verdicts(spark.createDataFrame([], FINAL), pairs), 20).count() == 0


def test_poisson_weights_have_mean_one():
    edges = uncertainty.poisson_edges()
    assert edges == sorted(edges) and abs(sum(1 - e / 16**6 for e in edges) - 1) < 1e-5


@pytest.mark.parametrize("a, b", [(0, 0), (5, 5), (0, 1), (1, 9), (3, 12), (400, 300), (2000, 1700)])
def test_exact_tail(a, b):
    n, m = a + b, min(a, b)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)
    assert abs(uncertainty.exact_tail(a, b) - want) < 1e-9 and uncertainty.exact_tail(a, b) == uncertainty.exact_tail(b, a)
    assert 0 < uncertainty.exact_tail(3_000_000, 2_990_000) < 1


def test_mcnemar(spark):
    rows = finals(2)
    pairs = spark.createDataFrame([("a", "b")], "config_a string, config_b string")
    got = uncertainty.mcnemar(uncertainty.pair_verdicts(spark.createDataFrame(rows, FINAL), pairs)).first()
    right = {(c, q): (correct if inside else refused) for c, q, inside, refused, correct in rows}
    only = [sum(right[x, q] and not right[y, q] for q in range(120)) for x, y in ("ab", "ba")]
    assert (got.n, got.only_a, got.only_b) == (120, *only) and abs(got.p - uncertainty.exact_tail(*only)) < 1e-12


#: Published matrices of a whole prompt and three variants: TP, FP, FN, TN and the F1 they state (fixed values).
MATRICES = [(7, 0, 3, 10, 0.824), (3, 0, 7, 10, 0.462), (4, 0, 6, 10, 0.571), (6, 1, 4, 9, 0.706)]


def test_ablation_effects_reproduce_published_matrices(spark):
    rows = []
    for variant, (tp, fp, fn, tn, _) in enumerate(MATRICES):
        rows += [("t", variant, q, False, q < tp) for q in range(tp + fn)]
        rows += [("t", variant, 10 + q, True, q < fp) for q in range(fp + tn)]
    rows.append(("alone", 2, 1, True, False))
    verdicts = spark.createDataFrame(rows, "template_id string, variant int, qid bigint, in_corpus boolean, refused boolean")
    got = {(r.template_id, r.variant): r for r in uncertainty.ablation_effects(verdicts).collect()}
    for variant, (tp, fp, fn, tn, score) in enumerate(MATRICES):
        r = got["t", variant]
        assert (r.tp, r.fp, r.fn, r.tn, round(r.f1, 3)) == (tp, fp, fn, tn, score)
        assert abs(r.delta_f1 - (r.f1 - got["t", 0].f1)) < 1e-12 and r.n_paired == 20
        assert (r.lost, r.gained) == (7 - tp + fp, 0) and abs(r.p - uncertainty.exact_tail(r.lost, 0)) < 1e-12
    alone = got["alone", 2]
    assert (alone.delta_f1, alone.n_paired, alone.p) == (None, 0, 1.0)
    assert confusion(verdicts, ["variant"]).count() == 4
