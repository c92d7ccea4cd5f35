import random

from pyspark.sql import functions as F

from passageway.operators import corpus
from passageway.sources import collections
from passageway.sources.documents import load_documents


def cut(text, size, overlap):
    """Windows by the definition: the first one, then further ones until the end is covered."""
    if not text:
        return []
    pieces, start = [text[:size]], 0
    while start + size < len(text):
        start += size - overlap
        pieces.append(text[start : start + size])
    return pieces


def expected_chunks(docs, size, overlap):
    out, numbers = [], {}
    for collection, doc_id, text in sorted(docs, key=lambda d: (d[0], d[1])):
        for pos, piece in enumerate(cut(text, size, overlap)):
            numbers[collection] = numbers.get(collection, 0) + 1
            out.append((collection, numbers[collection], doc_id, pos, piece))
    return sorted(out)


def random_docs(seed, ids):
    rng = random.Random(seed)
    return [
        (rng.choice("aab"), i, "".join(rng.choice("xyé§字 ") for _ in range(rng.choice([0, 1, 5, 6, 7, 30]))))
        for i in ids
    ]


def test_chunks_match_definition(spark):
    docs = random_docs(1, range(-5, 60))
    df = spark.createDataFrame(docs, "collection string, doc_id bigint, text string").repartition(7)
    got = sorted(map(tuple, corpus.chunk_documents(df, 6, 2).collect()))
    assert got == expected_chunks(docs, 6, 2)


def test_numbering_through_families(spark, monkeypatch):
    """The same numbers when sums are too many for one task, for ids of any spread."""
    monkeypatch.setattr(corpus, "_ROWS_IN_ONE_TASK", 3)
    rng = random.Random(3)
    ids = [*range(5000, 5040), *{rng.randrange(-(2**62), 2**62) for _ in range(60)}, *{rng.randrange(2**30) for _ in range(60)}]
    docs = random_docs(2, ids)
    df = spark.createDataFrame(docs, "collection string, doc_id bigint, text string")
    got = sorted(map(tuple, corpus.chunk_documents(df, 6, 2).collect()))
    assert got == expected_chunks(docs, 6, 2)


def test_short_passage_is_whole_in_one_chunk(spark):
    text = "".join(chr(97 + i % 26) for i in range(300))
    chunks = [r.text for r in corpus.chunk_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), 40, 20).collect()]
    assert all(any(text[i : i + 20] in c for c in chunks) for i in range(len(text) - 19))


def numbered(spark, n):
    return spark.range(1, n + 1).select(
        F.lit("c").alias("collection"), F.col("id").alias("chunk_no"), F.lit(1).cast("bigint").alias("doc_id"),
        F.col("id").cast("int").alias("pos"), F.concat(F.lit("t"), "id").alias("text"),
    )


def test_building_twice_keeps_105(spark, tmp_path):
    for _ in range(2):
        collections.build_collection(numbered(spark, 105), "sample", str(tmp_path))
    collections.build_collection(numbered(spark, 7), "other", str(tmp_path))
    assert collections.open_collection(spark, str(tmp_path), "sample").count() == 105
    plan = collections.open_collection(spark, str(tmp_path), "other")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan


def test_cached_collection(spark, tmp_path):
    collections.build_collection(numbered(spark, 5), "sample", str(tmp_path))
    cached = collections.open_collection(spark, str(tmp_path), "sample", cache=True)
    assert cached.count() == 5 and cached.storageLevel.useMemory and cached.storageLevel.useDisk
    cached.unpersist()


def test_audit_sees_append(spark):
    once = numbered(spark, 105)
    expected = spark.createDataFrame([("c", 105), ("gone", 3)], "collection string, expected int")
    clean = {r.collection: r for r in corpus.audit_collection(once, expected).collect()}
    assert clean["c"].ok and not clean["gone"].ok
    twice = {r.collection: r for r in corpus.audit_collection(once.union(once), expected).collect()}["c"]
    assert (twice.n_chunks, twice.repeated_numbers, twice.repeated_texts, twice.ok) == (210, 105, 105, False)


def test_alignment(spark):
    left = numbered(spark, 5)
    right = numbered(spark, 6).withColumn("text", F.when(F.col("chunk_no") == 2, "x").otherwise(F.col("text")))
    right = right.filter("chunk_no <> 4").union(right.filter("chunk_no = 3"))
    got = {r.chunk_no: r.status for r in corpus.align_numbering(left, right).collect()}
    assert got == {1: "same", 2: "different", 3: "different", 4: "left_only", 5: "same", 6: "right_only"}


def test_upload_overrides_builtin(spark):
    rows = [("s1", "builtin", 1), ("s1", "uploaded", 2), ("s2", "builtin", 1)]
    got = corpus.resolve_collection(spark.createDataFrame(rows, "session string, origin string, doc_id int"))
    assert sorted((r.session, r.doc_id) for r in got.collect()) == [("s1", 2), ("s2", 1)]


def test_texts_move_once(spark, tmp_path):
    """With stored lengths the texts are scanned and shuffled once; offsets come from numbers alone."""
    path = str(tmp_path / "d.parquet")
    docs = [(c, i, t, len(t)) for c, i, t in random_docs(4, range(40))]
    spark.createDataFrame(docs, "collection string, doc_id bigint, text string, n bigint").write.parquet(path)
    chunked = corpus.chunk_documents(spark.read.parquet(path), 6, 2, length_col="n")
    plan = chunked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert sorted(map(tuple, chunked.collect())) == expected_chunks([d[:3] for d in docs], 6, 2)


def test_scan_pushes_filters_and_columns(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "t", "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(path)
    plan = load_documents(spark, path, ["en"], columns=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def fails_with(action, message):
    try:
        action()
    except Exception as e:
        return message in str(e)
    return False


def test_stale_lengths_and_missing_ids_are_errors(spark):
    schema = "collection string, doc_id bigint, text string, n bigint"
    for row, message in (
        (("a", 7, "0123456789", 4), "the stored length of document 7"),
        (("a", 8, "0123456789", 0), "the stored length of document 8"),
        (("a", None, "text", 4), "no doc_id"),
        ((None, 9, "text", 4), "no collection"),
    ):
        df = spark.createDataFrame([("a", 1, "fine", 4), row], schema)
        assert fails_with(lambda: corpus.chunk_documents(df, 4, 2, length_col="n").collect(), message)
    right = spark.createDataFrame([("a", 1, "0123456789", 10), ("a", 2, None, None)], schema)
    assert sorted(corpus.chunk_documents(right, 4, 2, length_col="n").collect()) == sorted(corpus.chunk_documents(right, 4, 2).collect())


def test_building_from_nothing_empties(spark, tmp_path):
    out = str(tmp_path)
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    for name in ("sample", "other"):
        collections.build_collection(corpus.chunk_documents(docs, 4, 2), name, out)
    collections.build_collection(corpus.chunk_documents(docs.withColumn("text", F.lit("")), 4, 2), "sample", out)
    assert {r.collection for r in collections.open_collection(spark, out).collect()} == {"other"}


def test_many_tasks_leave_few_files(spark, tmp_path):
    rows = spark.range(2_000).select("id", F.array(F.col("id").cast("double"), F.lit(0.1)).alias("embedding"), (F.col("id") % 16).cast("int").alias("cell"))
    collections.write_vectors(rows.repartition(8), str(tmp_path))
    assert len(list(tmp_path.glob("cell=*/*.parquet"))) <= 2 * 16
    stored = collections.open_vectors(spark, str(tmp_path)).orderBy("id").collect()
    assert len(stored) == 2_000 and stored[3].embedding[0] == 3.0


def test_numbering_of_several_collections(spark):
    rows = [("a", 1, "x"), ("b", 1, "y")]
    left = spark.createDataFrame(rows, "collection string, chunk_no bigint, text string")
    right = spark.createDataFrame([("a", 1, "x"), ("b", 1, "z")], left.schema)
    got = {(r.collection, r.chunk_no): r.status for r in corpus.align_numbering(left, right, ["collection", "chunk_no"]).collect()}
    assert got == {("a", 1): "same", ("b", 1): "different"}
