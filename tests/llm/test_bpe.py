"""Encoding and decoding against the library whose files are read, and merges against one pair at a time."""

import hashlib
import json
import re

import numpy as np
import pytest

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passageway.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(FILE[0])


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(*FILE)


def same(ours, theirs, texts):
    ids, begin = ours.encode(texts)
    assert len(begin) == len(texts) + 1
    for i, text in enumerate(texts):
        want = theirs.encode(text, add_special_tokens=False).ids
        got = ids[begin[i] : begin[i + 1]]
        assert got.tolist() == want, text[:80]
        assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False) == text


TEXTS = [
    "", " ", "a", "The cat's mat, they'll say: don't!", "two  spaces   three\n\n\tx ", "ÄÖÜ straße 漢字 𝒳 é ‍﻿",
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext|", " <|endoftext|>  \n", "'s 's's ''s S'S 's1",
    "1234567890 3.14 ½ ² Ⅷ", "\x00\x1c\x1d\x85\xa0  x\x0b", "aaaaaaaaaaaaaaa", "the" * 50, "https://example.com/?a=b&c=%20",
]


def test_texts(ours, theirs):
    same(ours, theirs, TEXTS)


def test_random_characters(ours, theirs):
    rng = np.random.default_rng(2)
    pools = ["abc  '", "aeiou th\n", "".join(map(chr, range(256))), "漢字仮名 ab𝒳😀é́", "<|endoftext|> "]
    same(ours, theirs, ["".join(rng.choice(list(pools[i % 5]), rng.integers(0, 60))) for i in range(4000)])


def test_code_points(ours, theirs):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    same(ours, theirs, ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} ." for c in points[i : i + 16]) for i in range(0, len(points), 16)])


def test_long_words_and_texts(ours, theirs, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(x), 5000)) for x in ("ab", "abcdefghijklmnopqrstuvwxyz", "aä漢𝒳b", "a")]
    same(ours, theirs, words)
    ours._forget()
    monkeypatch.setattr(bpe, "LONG", 1 << 30)  # the same words in rounds
    same(ours, theirs, words)
    monkeypatch.setattr(bpe, "STRETCH", 7)  # and texts cut wherever they may be
    same(ours, theirs, [*TEXTS, "one two  three   four\nfive 's six " * 20, " " * 50 + "x" + " " * 50])
    ours._forget()


def test_forgetting_changes_nothing(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 0)
    same(ours, theirs, TEXTS)
    same(ours, theirs, TEXTS[::-1])


def test_merges_one_at_a_time(ours):
    """Rounds over many words against merging the lowest pair, leftmost first, of one word after another."""
    rank = ours._ranked()
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"etaoin shr"), rng.integers(1, 30)).astype(np.uint8)) for _ in range(500)]
    ids, ends = ours.merge(words)
    for i, word in enumerate(words):
        symbols = ours.first[list(word)].tolist()
        while True:
            r, at = min(((rank.get(a << 32 | b, 1 << 60), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(1 << 60, 0))
            if r == 1 << 60:
                break
            symbols[at : at + 2] = [int(ours.merged[r])]
        assert ids[ends[i] : ends[i + 1]].tolist() == symbols
        assert ours._merge_long(word) == symbols


def test_decoding_of_cut_and_unknown_ids(ours, theirs):
    ids = theirs.encode("漢😀 x", add_special_tokens=False).ids
    for some in (ids[:1], ids[1:], ids[:-2], [*ids, 60000], [50256, 0]):
        assert ours.decode(np.array(some)) == theirs.decode(some, skip_special_tokens=False)
    assert ours.decode(np.array([-1])) == ""


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(FILE[0], encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Bpe(str(tmp_path / "x.json"), FILE[1])


def test_columns(spark, odd_docs, theirs):
    docs = odd_docs.withColumn("ids", bpe.encode("text", *FILE))
    rows = docs.withColumns({"back": bpe.decode("ids", *FILE), "digest": bpe.ids_digest("ids")}).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.back == (r.text or "")
        assert r.digest == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
    assert docs.limit(0).collect() == []
    none = spark.createDataFrame([(None,), ([None, 64],)], "ids array<int>").select(bpe.decode("ids", *FILE), bpe.ids_digest("ids")).collect()
    assert tuple(none[0]) == (None, None) and none[1][0] == "a"


def test_ids_are_made_once(spark, odd_docs):
    docs = odd_docs.withColumn("ids", bpe.encode("text", *FILE)).select("doc_id", F.size("ids"), bpe.ids_digest("ids"), bpe.decode("ids", *FILE))
    evaluations = re.findall(r"ArrowEvalPython \[(.*?)\], \[", docs._jdf.queryExecution().optimizedPlan().toString())
    assert len(evaluations) == 2 and sum(len(re.findall(r"\bids\(", x)) for x in evaluations) == 1
