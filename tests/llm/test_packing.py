import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from passageway.llm import packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TEXTS = ["", " ", "  lead", "two  spaces", "a \n b\t c ", "don't they'll", "ÄÖ straße 漢字 𝒳 x", "<|endoftext|> a", "a <|endoftext|> b", "漢 <|endoftext|><|endoftext|>", "<|endoftext", "  　 x y", "é ê ß", "1234 5,678.9", "mixed 漢 latin Ω end", "tail 漢 ", "퟿ ok"]


def exact():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_named_library(text):
    assert packing.Encoder(PATH, PATTERN).encode(text).tolist() == exact().encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed,capacity,kinds,most", [(0, 64, 64, 50), (1, 64, 5, 3), (2, 300, 40, 7), (3, 5000, 200, 9), (4, 2, 2, 5), (5, 1, 1, 4), (6, 64, 1, 1)])
def test_every_piece_is_packed_once(seed, capacity, kinds, most):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, most + 1)) for n in rng.choice(np.arange(1, capacity + 1), min(kinds, capacity), replace=False)}
    packed = packing.pack_histogram(counts, capacity)
    held = Counter()
    for lengths, count in packed:
        assert sum(lengths) <= capacity
        for n in lengths:
            held[n] += count
    assert held == counts
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    plain = packing.Packing(capacity)
    for n in sorted(counts, reverse=True):
        plain.place(n, counts[n])
    assert best <= sum(c for _, c in packed) <= 1.05 * sum(plain.count) + 2


def test_repeats_fit_the_histogram():
    patterns = packing.patterns_of(40)
    assert len({tuple(sorted(p)) for p in patterns.tolist()}) == len(patterns) and (patterns.sum(1) == 40).all()
    truth = np.zeros(len(patterns))
    truth[np.random.default_rng(0).choice(len(patterns), 10, replace=False)] = 100
    histogram = np.zeros(41)
    for p, n in zip(patterns, truth):
        for part in p[p > 0]:
            histogram[part] += n
    chosen, repeats = packing.fit_repeats(patterns, histogram, rounds=60)
    fitted = np.zeros(41)
    for p, n in zip(patterns[chosen], repeats):
        for part in p[p > 0]:
            fitted[part] += n
    assert (repeats >= 0).all() and np.abs(fitted - histogram).max() < 1


def check(rows, docs, capacity):
    encoder = exact()
    ids = {k: encoder.encode(t or "", add_special_tokens=False).ids + [0] for k, t in docs}
    places = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for key, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            part = ids[key][at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids[key]) and all(r["length"] == capacity for r in own[1:])
    assert set(pieces) == set(ids)


def test_documents(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "the cat sat " * (i * 7)) for i in range(40)] + [(200, None), (201, "x " * 9_000)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id bigint, text string, piece int, offset int")
    rows = packing.pack_documents(df, PATH, PATTERN, 256).collect()
    check(rows, docs, 256)
    tokens = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.1 * tokens / 256 + 1
    assert packing.pack_documents(df.filter("false"), PATH, PATTERN).count() == 0


def test_odd_rows(spark, odd_docs):
    rows = packing.pack_documents(odd_docs, PATH, PATTERN).collect()
    assert len([r for r in rows if r["doc_id"] == 2]) == 2 and len([r for r in rows if r["doc_id"] is None]) == 1
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.select("doc_id").collect()}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
