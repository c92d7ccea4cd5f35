"""Collections stored by block against cutting all documents anew."""

import os
import random

import pytest

from passageway.operators.corpus import chunk_documents
from passageway.sources import blocks
from passageway.streaming import ingest

SCHEMA = "collection string, doc_id bigint, text string"


def build(spark, rows, batch_id, out, **named):
    return sorted(tuple(r) for r in blocks.build_batch(spark.createDataFrame(rows, SCHEMA), batch_id, out, 4, 2, **named).collect())


def contents(spark, out, name=None):
    return sorted((r.collection, r.chunk_no, r.doc_id, r.pos, r.text) for r in blocks.open_blocks(spark, out, name).collect())


def anew(spark, documents):
    rows = [(c, d, t) for (c, d), t in documents.items()]
    return sorted(map(tuple, chunk_documents(spark.createDataFrame(rows, SCHEMA), 4, 2).collect()))


def versions(out):
    return {root.removeprefix(f"{out}/passages/") for root, _, files in os.walk(f"{out}/passages") if any(f.endswith(".parquet") for f in files)}


def test_one_document_writes_one_block(spark, tmp_path):
    out = str(tmp_path)
    rows = [("a b=c/%", i * 1000, f"text {i}") for i in range(40)] + [("b", 5, "other")]
    assert len(build(spark, rows, 0, out)) == 11
    was = versions(out)
    # Longer than before: the numbers of all later passages move, and none of them is written.
    assert build(spark, [("a b=c/%", 3000, "a much longer text than before")], 1, out) == [("a b=c/%", 0, 22)]
    assert len(versions(out) - was) == 1
    documents = {(c, d): t for c, d, t in rows} | {("a b=c/%", 3000): "a much longer text than before"}
    assert contents(spark, out) == anew(spark, documents)
    assert contents(spark, out, "b") == [("b", 1, 5, 0, "othe"), ("b", 2, 5, 1, "her")]


def test_what_is_there_already_writes_nothing(spark, tmp_path):
    out = str(tmp_path)
    rows = [("a", 1, "one"), ("a", 2, None), ("a", 9000, "three")]
    build(spark, rows, 0, out)
    was = versions(out)
    assert build(spark, rows[:1], 1, out) == [] and build(spark, [("a", 2, "")], 2, out) == []
    assert versions(out) == was
    assert contents(spark, out) == anew(spark, {("a", 1): "one", ("a", 9000): "three"})


@pytest.mark.parametrize("seed", [0, 1])
def test_rounds_replays_and_streams(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(blocks, "BLOCK_BITS", 2)
    rng, out, documents, rounds = random.Random(seed), str(tmp_path), {}, []
    for k in range(5):
        rows = {(rng.choice("ab"), rng.randrange(-20, 120)): "x" * rng.randrange(0, 12) for _ in range(12)}
        rounds.append([(c, d, t + str(k) if t else t) for (c, d), t in rows.items()])
        documents |= {(c, d): t for c, d, t in rounds[-1]}
        build(spark, rounds[-1], k % 3, out, stream=f"s{k // 3}")
        assert contents(spark, out) == anew(spark, documents)
    # Any batch again, whatever came later.
    for k in (1, 4, 0):
        assert build(spark, rounds[k], k % 3, out, stream=f"s{k // 3}") == []
    assert contents(spark, out) == anew(spark, documents)
    assert blocks.remove_superseded(spark, out) > 0
    assert contents(spark, out) == anew(spark, documents) and blocks.remove_superseded(spark, out) == 0


def test_a_batch_that_failed_is_not_seen_and_is_made_up_for(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    build(spark, [("a", 1, "first"), ("a", 5000, "second")], 0, out)
    was = contents(spark, out)
    append = blocks._append
    monkeypatch.setattr(blocks, "_append", lambda df, path, *p: 1 / 0 if path.endswith("leaves") else append(df, path, *p))
    with pytest.raises(ZeroDivisionError):
        build(spark, [("a", 1, "changed now")], 1, out)
    assert contents(spark, out) == was
    monkeypatch.setattr(blocks, "_append", append)
    build(spark, [("a", 1, "changed now")], 1, out)
    assert contents(spark, out) == anew(spark, {("a", 1): "changed now", ("a", 5000): "second"})


def test_nulls_end_the_batch_and_empty_uploads_empty(spark, tmp_path):
    out = str(tmp_path)
    for row in (("a", None, "text"), (None, 1, "text")):
        with pytest.raises(Exception, match="a document has no"):
            build(spark, [row], 0, out)
    build(spark, [("a", 1, "text"), ("b", 2, "text")], 1, out)
    build(spark, [("a", 1, "")], 2, out)
    assert contents(spark, out) == anew(spark, {("b", 2): "text"})
    assert build(spark, [], 3, out) == []


def test_stream_in_blocks(spark, tmp_path):
    landing, out, progress = (str(tmp_path / n) for n in ("landing", "out", "progress"))
    documents = {}
    for rows in ([("a", 5, "abcdefgh"), ("a", 2, "xyz"), ("b", 1, "0123456789")], [("a", 1, "new first"), ("a", 5, "shorter")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        ingest.ingest_stream(ingest.read_uploads(spark, landing), out, progress, 4, 2, layout="blocks").awaitTermination()
        documents |= {(c, d): t for c, d, t in rows}
        assert contents(spark, out) == anew(spark, documents)
    with pytest.raises(ValueError):
        ingest.ingest_stream(ingest.read_uploads(spark, landing), out, progress, layout="rows")


def test_texts_are_moved_once(spark):
    """Latest uploads, their passages and what stands before them come from one shuffle of the texts."""
    rows = [("a", 0, 1, 0, "old"), ("a", 0, 1, 2, "newest"), ("a", 0, 1, 1, "newer text"), ("a", 0, 2, 0, None), ("a", 0, 3, 1, "abc"), ("b", 1, 2, 0, "x")]
    stored = spark.createDataFrame(rows, "collection string, block bigint, doc_id bigint, version bigint, text string")
    docs = blocks._latest_documents(stored, 4, 2)
    assert docs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted((r.collection, r.block, r.doc_id, r.text, r.n, r.before) for r in docs.collect())
    assert got == [("a", 0, 1, "newest", 2, 0), ("a", 0, 2, "", 0, 2), ("a", 0, 3, "abc", 1, 2), ("b", 1, 2, "x", 1, 0)]
