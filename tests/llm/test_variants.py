"""Spelling variants against counting and comparing all words outright."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from passageway.llm import variants

LETTER = "[A-Za-zÀ-ÿ]+"


def brute_counts(rows, least=5):
    held = Counter()
    for doc_id, text in rows:
        for run in re.findall(LETTER, text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 6 and n >= least}


def neighbours(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in alphabet}
        if i < len(word):
            out |= {word[:i] + c + word[i + 1 :] for c in alphabet} | {word[:i] + word[i + 1 :]}
    return out - {word}


def brute_groups(counts):
    alphabet = sorted({c for w in counts for c in w})
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [x for x in neighbours(w, alphabet) if x in counts]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def vocabulary(seed, n, letters, least=6, most=9):
    """Words over few letters, so that many are near one another and share their grams."""
    rng = np.random.default_rng(seed)
    return {"".join(rng.choice(list(letters), rng.integers(least, most + 1))): int(x) for x in (5 * rng.pareto(0.6, n) + 5).clip(5, 1e9)}


def grouped(spark, counts):
    words = spark.createDataFrame(list(counts.items()) or [("x", 1)], "word string, n bigint").filter("n >= 5")
    rows = [tuple(r) for r in variants.group_variants(words).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdeÿ", "abcdefghijklmnopqrstuvwxyzàé"])
def test_groups_against_all_words(spark, letters):
    counts = vocabulary(3, 3000, letters)
    assert grouped(spark, counts) == brute_groups(counts)


def test_hot_grams_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(variants, "LIST", 3)
    monkeypatch.setattr(variants, "_PAIRS", 50)
    monkeypatch.setattr(variants, "TASK_WORDS", 400)
    counts = {w + "ing": n for w, n in vocabulary(4, 1500, "abc", 3, 7).items()} | vocabulary(5, 500, "abcd")
    assert grouped(spark, counts) == brute_groups(counts)


def test_grams_frequent_or_not(spark, monkeypatch):
    counts = vocabulary(6, 1200, "abcdef")
    for positions in (1, 20, 1 << 40):
        monkeypatch.setattr(variants, "POSITIONS", positions)
        assert grouped(spark, counts) == brute_groups(counts)


def test_long_and_repetitive_words(spark):
    counts = {"a" * k: 5 * 7**k if k < 12 else 5 for k in range(6, 14)}
    for size in (47, 48, 49, 50, 300):
        counts |= {"é" * size: 400, "é" * (size - 1) + "f": 20, "f" + "é" * size: 19, "ab" * size: 100, "ab" * (size - 1) + "b": 9}
    assert grouped(spark, counts) == brute_groups(counts)


def test_counts_and_result_on_documents(spark, odd_docs):
    rng = np.random.default_rng(9)
    stock = sorted(vocabulary(7, 60, "abcdefghiéß"))
    rows = [(i if i % 9 else None, " ".join(rng.choice(stock, 400)) + "×÷ ÜnïcodeĀx 3") for i in range(80)]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()] + [rows[3]] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS key", "4 AS root")
    counts = brute_counts(rows)
    assert {r.word: r.n for r in variants.count_words(docs).collect()} == counts
    assert any(n < 400 for n in counts.values())
    assert {tuple(r) for r in variants.spelling_variants(docs).collect()} == brute_groups(counts)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "12 ab")], "doc_id bigint, text string")
    assert variants.spelling_variants(docs).collect() == []
    assert variants.spelling_variants(docs.limit(0)).collect() == []


def test_bounds_hold():
    """Every edit leaves all but ``most_affected`` grams, and a word keeps at least two."""
    rng = np.random.default_rng(11)
    frequent = {bytes(g) for g in rng.integers(97, 100, (30, 2), dtype=np.uint8)} | {bytes(g) for g in rng.integers(97, 100, (40, 3), dtype=np.uint8)}
    for _ in range(300):
        word = bytes(rng.integers(97, 101, rng.integers(6, 12), dtype=np.uint8))
        grams = variants.numbered(variants.decompose(b"\x01" + word + b"\x02", frequent))
        affected = variants.most_affected(variants.decompose(b"\x01" + word + b"\x02", frequent))
        assert len(grams) - affected >= 2
        for other in neighbours(word.decode(), "abcde"):
            theirs = variants.numbered(variants.decompose(b"\x01" + other.encode() + b"\x02", frequent))
            assert len(set(grams) - set(theirs)) <= affected
            assert variants.one_edit(word, other.encode())
