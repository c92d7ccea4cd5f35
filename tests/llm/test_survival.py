"""The audit against filters that are really applied in every order."""

from itertools import permutations

import numpy as np
import pytest

from brute import WORD
from passageway.llm import survival


def fails(rows):
    """Per row the set of failed filters, by the plain reading of each condition."""
    out = []
    for key, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        same = [k for k, t, _ in rows if (t or "") == text and k is not None and key is not None and k < key]
        conditions = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": bool(same),
        }
        out.append({f for f, failed in conditions.items() if failed})
    return out


def brute(rows, labels):
    good = {k for k, quality, _ in labels if quality == 1 and k is not None}
    bad = {k for k, _, toxic in labels if toxic == 1 and k is not None}
    failed = fails(rows)
    out, shapley = {}, {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(key, f) for (key, _, s), f in zip(rows, failed) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                out[part, order, step] = {
                    "kept": len(left),
                    "removed": len(gone),
                    "redundant": sum(x in f for _, f in mine) - len(gone),
                    "unique_fails": sum(f == {x} for _, f in mine),
                    "good_lost": sum(k in good for k, _ in gone),
                    "toxic_lost": sum(k in bad for k, _ in gone),
                }
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    for (part, order, step), row in out.items():
        row["shapley"] = shapley[part, order[step - 1]]
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS part", "2 AS failed", "3 AS key")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = survival.audit_filters(docs, marks).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    out = {(r.part, r.filter_order, r.step): {n: r[n] for n in names} for r in found}
    assert len(out) == len(found)
    return out


def sample(seed=5, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = rng.choice([f"w{j}" for j in range(rng.integers(2, 400))], rng.integers(1, 450)).tolist()
        words += ["HELLO"] * int(rng.integers(0, 6)) + ["a&b"] * int(rng.random() < 0.3)
        rows.append((i, " ".join(words), rng.choice(["a", "b", "ü"]).item()))
    rows += [(n + i, rows[int(rng.integers(0, n))][1], "a") for i in range(60)]
    return rows, [(i, int(rng.random() < 0.5), int(rng.random() < 0.2)) for i in range(0, n, 2)]


def test_against_applied_filters(spark):
    rows, labels = sample()
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_odd_rows(spark):
    long_text = " ".join(f"x{i % 5000}" for i in range(120_000))
    rows = [
        (1, None, None), (2, "", ""), (None, "", "a"), (None, None, "a"), (3, "A B", "a"), (3, "A B", "a"), (4, "A B", None),
        (5, long_text, "a"), (6, long_text, "b"), (7, "a b\x1c" * 300, "b"), (8, "é\x0bÉ " * 250, "b"), (0, "A B", "b"),
    ]
    labels = [(3, 1, None), (3, 0, 1), (None, 1, 1), (5, 1, 0), (6, 1, 1), (99, 1, 1), (1, None, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "x", "s")], []) == brute([(1, "x", "s")], [])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 1000])
def test_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert survival.positional_popcount(words).tolist() == [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]


def test_survival_words():
    for failed in range(32):
        assert [bool(int(survival.WORDS[failed]) >> s & 1) for s in range(32)] == [not s & failed for s in range(32)]


def test_hot_copies_and_parts_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(survival, "_KEYS", 3)
    rows = [(i, "same text", f"s{i % 7}") for i in range(40)] + [(100 + i, f"t{i}", f"s{i}") for i in range(7)]
    assert audited(spark, rows, [(1, 1, 1), (2, 1, 0)]) == brute(rows, [(1, 1, 1), (2, 1, 0)])
