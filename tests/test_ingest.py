from passageway.operators.corpus import chunk_documents
from passageway.plans import registry
from passageway.sources.collections import open_collection
from passageway.streaming import ingest

SCHEMA = "collection string, doc_id bigint, text string"


def contents(spark, out):
    return sorted((r.collection, r.chunk_no, r.doc_id, r.pos, r.text) for r in open_collection(spark, f"{out}/chunks").collect())


def batch_contents(spark, rows):
    return sorted(map(tuple, chunk_documents(spark.createDataFrame(rows, SCHEMA), 4, 2).collect()))


def test_uploads_build_and_replays_change_nothing(spark, tmp_path):
    landing, out, progress = (str(tmp_path / n) for n in ("landing", "out", "progress"))

    def upload(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    def run():
        ingest.ingest_stream(ingest.read_uploads(spark, landing), out, progress, 4, 2).awaitTermination()

    upload([("a", 5, "abcdefgh"), ("a", 2, "xyz"), ("b", 1, "0123456789")])
    run()
    first = [("a", 2, "xyz"), ("a", 5, "abcdefgh"), ("b", 1, "0123456789")]
    assert contents(spark, out) == batch_contents(spark, first)

    # Nothing new: running again leaves the contents.
    run()
    assert contents(spark, out) == batch_contents(spark, first)

    # A smaller id shifts the numbers of its collection; a known id is replaced; b is untouched.
    second = [("a", 1, "new first"), ("a", 5, "shorter")]
    upload(second)
    run()
    now = [("a", 1, "new first"), ("a", 2, "xyz"), ("a", 5, "shorter"), ("b", 1, "0123456789")]
    assert contents(spark, out) == batch_contents(spark, now)

    # A batch delivered twice is stored once.
    ingest._build_batch(spark.createDataFrame(second, SCHEMA), 1, out, 4, 2)
    assert contents(spark, out) == batch_contents(spark, now)


def test_replay_of_an_older_batch_keeps_later_uploads(spark, tmp_path):
    out = str(tmp_path)
    batches = [[("a", 1, "one"), ("a", 2, "kept")], [("a", 1, "two")], [("b", 3, "other")]]
    for batch_id, rows in enumerate(batches):
        ingest._build_batch(spark.createDataFrame(rows, SCHEMA), batch_id, out, 4, 2)
    now = [("a", 1, "two"), ("a", 2, "kept"), ("b", 3, "other")]
    assert contents(spark, out) == batch_contents(spark, now)
    for batch_id in (0, 1, 0):
        ingest._build_batch(spark.createDataFrame(batches[batch_id], SCHEMA), batch_id, out, 4, 2)
        assert contents(spark, out) == batch_contents(spark, now)


def test_fresh_checkpoint_keeps_what_was_uploaded(spark, tmp_path):
    out = str(tmp_path / "out")
    for run, rows in enumerate([[("a", 1, "first"), ("a", 2, "stays")], [("a", 1, "second"), ("a", 3, "new")]]):
        landing = str(tmp_path / f"landing{run}")
        spark.createDataFrame(rows, SCHEMA).write.parquet(landing)
        ingest.ingest_stream(ingest.read_uploads(spark, landing), out, str(tmp_path / f"progress{run}"), 4, 2).awaitTermination()
    assert contents(spark, out) == batch_contents(spark, [("a", 1, "second"), ("a", 2, "stays"), ("a", 3, "new")])


def test_empty_upload_empties(spark, tmp_path):
    out = str(tmp_path)
    for batch_id, rows in enumerate([[("a b=c/%", 1, "text"), ("b", 1, "text")], [("a b=c/%", 1, "")]]):
        ingest._build_batch(spark.createDataFrame(rows, SCHEMA), batch_id, out, 4, 2)
    assert contents(spark, out) == batch_contents(spark, [("b", 1, "text")])


def test_documents_in_one_file_or_in_many(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (tmp_path / "one").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for name in ("many", "one"):
        got = registry.ingest_stream(spark, f"{tmp_path}/{name}").select("chunk_no", "doc_id", "text").collect()
        assert sorted(map(tuple, got)) == [(i + 1, i, f"text {i}") for i in range(4)]
