import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passageway.llm import fingerprints as fp

POWERS = fp.Powers()


def hashes(text):
    return fp.PrefixHashes(fp.code_points(text), POWERS)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab𝒳é", max_size=40), st.text(alphabet="ab𝒳é", max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_spans_and_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = hashes(a), hashes(b)
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert x.common_extension(i, y, j) == n
    for size in range(min(len(a) - i, len(b) - j) + 1):
        assert (x.span(i, i + size) == y.span(j, j + size)) == (a[i : i + size] == b[j : j + size])
        assert int(x.spans(np.array([i]), np.array([i + size]))[0]) == x.span(i, i + size)


def test_likeness_estimates_common_spans():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefgh"), 40_000))
    other = "".join(rng.choice(list("abcdefgh"), 40_000))
    a, half, b = (fp.sketch(hashes(t), 12, 128) for t in (text, text[:20_000] + other[:20_000], other))
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) < 0.05 and 0.35 < fp.likeness(a, half) < 0.65


def expected(rows):
    """(n_chars, sha256 of the edited text, common start) in order of the ids."""
    out = []
    for k, text in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        same = next((i for i, (x, y) in enumerate(zip(text, edited)) if x != y), min(len(text), len(edited)))
        out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), same))
    return out


@pytest.mark.parametrize("n", [1, 2, 60])
def test_documents(spark, n):
    texts = [None, "", "x", "häuser 𝒳𝒳", "w" * 300_000] + ["text number %d with some words" % (i // 2) for i in range(60)]
    rows = [(i * i - 40, texts[i], "f", 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, block int").repartition(5)
    got = sorted(fp.fingerprint_documents(df).collect(), key=lambda r: r["doc_id"])
    order = sorted(rows)
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    assert [(r["n_chars"], r["edited_sha256"], r["same_start"]) for r in got] == expected([r[1] or "" for r in order])
    prints = {}
    for r, row in zip(got, order):
        assert prints.setdefault(row[1] or "", r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(prints.values())) == len(prints)
    for i, r in enumerate(got):
        if r["fingerprint"] == got[(i + 1) % n]["fingerprint"]:
            assert r["near_next"] == 1
        a, b = fp.sketch_of(r["fingerprint"]), fp.sketch_of(r["edited_fingerprint"])
        assert r["near_edited"] == fp.likeness(a, b)


def test_odd_rows(spark, odd_docs):
    rows = fp.fingerprint_documents(odd_docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd_docs.select("doc_id").collect())
    assert fp.fingerprint_documents(odd_docs.filter("false")).count() == 0
