"""Search in stored postings against scoring every document."""

import random
import re

import pytest

from passageway.operators import encode, postings, retrieve

NAMES = ("qid", "rank", "id", "score")


def rows(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def corpus(rng, n):
    """Common words everywhere, rare words in a few neighbouring documents; ids with gaps and below zero."""
    texts = []
    for i in range(n):
        words = rng.choices(["the", "of", "and", "in"], k=rng.randint(0, 30)) + rng.choices([f"w{j}" for j in range(40)], k=rng.randint(0, 12))
        words += [f"rare{i // 25}"] * rng.randint(0, 3)
        rng.shuffle(words)
        texts.append((i * 3 - 60, " ".join(words)))
    return texts


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("postings"))
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "BLOCK_BITS", 5)
    docs = spark.createDataFrame(corpus(random.Random(1), 400) + [(5000, None), (5001, "")], "doc_id bigint, text string").repartition(3)
    postings.build_postings(encode.term_stats(docs), out)
    yield docs, out
    patch.undo()


@pytest.mark.parametrize("k", [1, 4, 600])
def test_equal_to_the_scan(spark, index, k):
    docs, out = index
    asked = [(1, "the rare3"), (2, "w1 w2 w3 the of"), (3, "unknown words"), (4, "rare15 rare2 of"), (5, None), (6, "The, THE and in"), (7, "w5")]
    queries = spark.createDataFrame(asked, "qid int, question string")
    want = rows(retrieve.bm25_topk(queries, encode.term_stats(docs), k))
    found = postings.postings_topk(spark, out, queries, k)
    assert rows(found.top) == want
    assert rows(postings.postings_topk(spark, out, queries, k, batch_bytes=900).top) == want


def test_blocks_are_skipped_and_lists_not_read_for_maxima(spark, index):
    docs, out = index
    queries = spark.createDataFrame([(1, "the rare3 of")], "qid int, question string")
    found = postings.postings_topk(spark, out, queries, 3)
    assert rows(found.top) == rows(retrieve.bm25_topk(queries, encode.term_stats(docs), 3))
    held = {r.block: r.scored for r in found.blocks.collect()}
    assert len(held) >= 30 and sum(held.values()) <= 8
    tokens = spark.createDataFrame([("rare3",)], "token string").withColumn("shard", postings._shard("token"))
    tops = postings._of(spark, out, "postings", postings._POSTINGS, tokens).select("token", "block", "top")
    plan = tops._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*shard#\d+ = \d+", plan) and "ReadSchema: struct<token:string,block:bigint,top:double>" in plan


def test_no_documents_and_no_questions(spark, index, tmp_path):
    docs, out = index
    assert postings.postings_topk(spark, out, spark.createDataFrame([], "qid int, question string")).top.count() == 0
    postings.build_postings(encode.term_stats(docs.limit(0)), str(tmp_path))
