import os
from collections import Counter

import duckdb
import pytest
from brute import components, likeness, shingles
from oracle_check import connect, difference, spark_result, sql_result

import corpus_pipeline as pipeline
from passageway.llm import queries, sql
from passageway.llm.common import written

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sql.ORACLES)
def test_query_against_sql(spark, name):
    assert difference(spark_result(queries.QUERIES[name](spark, SF)), sql_result(connect(SF), sql.ORACLES[name])) is None


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"start": docs}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        seen[name] = docs
        if name != "pack":
            assert docs.columns == seen["start"].columns
    rows = {k: v.collect() for k, v in seen.items()}
    toxic = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 1").fetchall()}
    gone = {r["doc_id"] for r in rows["start"]} - {r["doc_id"] for r in rows["toxicity"]}
    assert len(gone - toxic) <= 0.05 * len(rows["start"])
    kept = {r["doc_id"] for r in rows["toxicity"]} - {r["doc_id"] for r in rows["language"]}
    assert not [r for r in rows["toxicity"] if r["doc_id"] in kept and any(c.isalpha() for c in r["text"])]
    sets = {r["doc_id"]: shingles(r["text"], pipeline.SHINGLE) for r in rows["language"]}
    label = components(sorted(sets), lambda a, b: likeness(sets[a], sets[b]) >= pipeline.SIMILARITY)
    first, stay = set(label.values()), {r["doc_id"] for r in rows["near duplicates"]}
    assert first <= stay and len(stay - first) <= 0.1 * (len(label) - len(first))
    mixed = Counter(r["doc_id"] for r in rows["mix"])
    assert set(mixed) <= {r["doc_id"] for r in rows["near duplicates"]} and max(mixed.values()) <= 2
    assert Counter(r["doc_id"] for r in rows["pack"] if r["piece"] == 0) == mixed
    places = Counter()
    for r in rows["pack"]:
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 2048


def test_odd_and_empty_documents(spark, odd_docs, tmp_path):
    docs = odd_docs.select(*pipeline.COLUMNS, "score", "size")
    labels = spark.createDataFrame([(1, 0), (6, 0), (9, 1), (3, None)], "doc_id bigint, toxic int")
    for name, table in (("full", docs), ("empty", docs.filter("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = pipeline.run(spark, f"{tmp_path}/full").collect()
    ids = {r["doc_id"] for r in rows}
    assert ids and not ids & {3, 4, 5, 8}
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
