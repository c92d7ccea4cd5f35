import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageway.functions.scan import best_per_task
from passageway.functions.vectors import CosineScorer
from passageway.operators import encode, retrieve
from passageway.plans import study
from passageway.sources import collections


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    """Vectors of which a third are copies of one, and queries."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[100:200] = v[100]
    q = np.vstack([rng.normal(size=(20, 8)), v[100:101], np.zeros((1, 8))])
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "qid bigint, embedding array<double>")
    return q, v, queries, vectors.repartition(5)


def brute(q, v, k, dims=None, pool=None):
    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / n), 10) if n else 0.0

    out = []
    for i, a in enumerate(q):
        members = range(len(v))
        if pool:
            members = sorted(members, key=lambda j: (-cos(a[:dims], v[j][:dims]), j))[:pool]
        best = sorted(members, key=lambda j: (-cos(a, v[j]), j))[:k]
        out += [(i, rank, j, cos(a, v[j])) for rank, j in enumerate(best, 1)]
    return sorted(out)


def test_exact_topk_both_ways(spark, points, monkeypatch):
    q, v, queries, vectors = points
    want = brute(q, v, 7)
    names = ("qid", "rank", "id", "score")
    assert rows(retrieve.exact_topk(queries, vectors, 7), *names) == want
    blocked = retrieve.exact_topk(queries, vectors, 7, block_bytes=500)
    scan = best_per_task(queries.selectExpr("CAST(qid AS BIGINT) AS qid", "embedding"), vectors.selectExpr("CAST(id AS BIGINT) AS id", "embedding"), CosineScorer(7), 500)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("MapInArrow") > 1
    assert rows(blocked, *names) == want


def test_prefix_pool(points):
    q, v, queries, vectors = points
    got = retrieve.ann_topk(queries, vectors, 5, ef=40, coarse_dims=3)
    assert rows(got, "qid", "rank", "id", "score") == brute(q, v, 5, 3, 40)


def test_full_pool_and_all_cells_are_exact(spark, points, tmp_path):
    q, v, queries, vectors = points
    want = brute(q, v, 5)
    names = ("qid", "rank", "id", "score")
    assert rows(retrieve.ann_topk(queries, vectors, 5, ef=300, coarse_dims=2), *names) == want
    cells = retrieve.fit_cells(vectors, 6)
    assert rows(retrieve.ann_topk(queries, vectors, 5, ef=300, coarse="ivf", centroids=cells, nprobe=6, coarse_dims=2), *names) == want
    blocked = retrieve.ann_topk(queries, vectors, 5, ef=300, coarse="ivf", centroids=cells, nprobe=6, block_bytes=900)
    assert rows(blocked, *names) == want


def test_all_cells_with_default_dimensions_are_exact(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 48))
    v = centres[np.arange(900) % 6] + 0.3 * rng.normal(size=(900, 48))
    q = centres + 0.2 * rng.normal(size=(6, 48))
    frame = lambda x, name: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{name} int, embedding array<double>")
    vectors, queries = frame(v, "id"), frame(q, "qid")
    cells = retrieve.fit_cells(vectors, 6)
    got = retrieve.ann_topk(queries, vectors, 8, ef=90, coarse="ivf", centroids=cells, nprobe=6)
    names = ("qid", "rank", "id", "score")
    assert rows(got, *names) == rows(retrieve.exact_topk(queries, vectors, 8), *names)


def test_probing_reads_only_the_cells_asked_for(spark, points, tmp_path):
    q, v, queries, vectors = points
    cells = retrieve.fit_cells(vectors, 6)
    collections.write_vectors(retrieve.assign_cells(vectors, cells), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path))
    one = queries.filter("qid = 3")
    got = retrieve.ann_topk(one, stored, 5, coarse="ivf", coarse_dims=None, centroids=cells, nprobe=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[cell#\d+ IN \(\d+,\d+\)", plan)
    members = [r.id for r in retrieve.assign_cells(vectors, cells).collect()]
    assert len(members) == 300 and got.count() == 5


def test_scores_that_differ_little_are_told_apart(spark):
    v = [[1.0, 2e-4], [1.0, 1e-4], [1.0, 3e-4]]  # cosines 1e-8 and more apart
    vectors = spark.createDataFrame(list(enumerate(v)), "id bigint, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "qid bigint, embedding array<double>")
    assert [r[2] for r in rows(retrieve.exact_topk(asked, vectors, 3), "qid", "rank", "id", "score")] == [1, 0, 2]


def test_unequal_vectors_are_refused(spark, points):
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="same length"):
        retrieve.exact_topk(points[2], bad, 1).collect()


TEXTS = ["the cat sat", "the dog sat on the cat", "a bird", "the the the", "cat cat cat dog", "", "§§", "the cat sat"]


def brute_bm25(questions, k, k1=1.2, b=0.75):
    tok = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    docs = [tok(t) for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for qid, question in questions:
        scores = {}
        for t in set(tok(question)):
            df = sum(t in d for d in docs)
            for i, d in enumerate(docs):
                if t in d:
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    tf = d.count(t)
                    scores[i] = scores.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        best = sorted(((-round(s, 10), i) for i, s in scores.items()))[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_bm25_both_ways(spark, monkeypatch):
    questions = [(1, "the cat"), (2, "Bird, bird!"), (3, "unknown words"), (4, "dog the the on")]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(questions, "qid bigint, question string")
    stats = encode.term_stats(docs, only=encode.query_terms(asked))
    want = brute_bm25(questions, 4)
    names = ("qid", "rank", "id", "score")
    assert rows(retrieve.bm25_topk(asked, stats, 4), *names) == want
    assert rows(retrieve.bm25_topk(asked, encode.term_stats(docs), 4), *names) == want
    monkeypatch.setattr("passageway.functions.scan.HELD_BYTES", 4 * 32 * 3)
    assert rows(retrieve.bm25_topk(asked, stats, 4, block_bytes=150), *names) == want
    monkeypatch.setattr("passageway.functions.lexical._CELLS", 5)
    assert rows(retrieve.bm25_topk(asked, stats, 4), *names) == want


def test_texts_are_scored_where_they_are_read(spark, tmp_path):
    """No shuffle below the scoring; only the best rows of each task are exchanged."""
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, other string").write.parquet(path)
    docs = spark.read.parquet(path)
    asked = spark.createDataFrame([(1, "the cat")], "qid bigint, question string")
    stats = encode.term_stats(docs, only=encode.query_terms(asked))
    plan = retrieve.bm25_topk(asked, stats, 2)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("MapInArrow")
    assert "Exchange" not in below and "ReadSchema: struct<doc_id:bigint,text:string>" in below
    assert above.count("WindowGroupLimit") == 4
    plan = encode.encode(docs, stats.terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_model_vectors(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.id: r.embedding for r in encode.encode_with_model(docs, make).collect()}
    assert got == {i: [float(len(t)), 1.0] for i, t in enumerate(TEXTS)}


def test_encoding_with_common_and_rare_words(spark):
    """The same vectors whether words are summed in place or looked up by shuffle."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    stats = encode.term_stats(docs)
    terms = {r.token: r.idf for r in stats.terms.collect()}
    want = {}
    for i, text in enumerate(TEXTS):
        words = [w for w in re.split(r"[\W_]+", text) if w]
        want[i] = [0.0] * 8
        for w in set(words):
            want[i][int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 8] += (1 + math.log(words.count(w))) * terms[w]
    for limit, share in ((10**6, 0.001), (350, 0.3), (0, 0.3)):
        got = {r.id: r.embedding for r in encode.encode(docs, stats.terms, dim=8, hot_share=share, max_bytes=limit).collect()}
        assert got == {i: pytest.approx(v) for i, v in want.items()}
    common, rare = encode._common_and_rare(stats.terms.withColumn("bucket", F.lit(0)), 0.3, 350)
    assert {r.token for r in common.collect()} == {"the", "cat", "sat"} and rare.count() == len(terms) - 3
    common, rare = encode._common_and_rare(stats.terms.withColumn("bucket", F.lit(0)), 1e-6, 350)
    kept, left = [r.idf for r in common.collect()], [r.idf for r in rare.collect()]
    assert kept and max(kept) < min(left) and len(kept) + len(left) == len(terms)
    fewer = stats.terms.filter("token <> 'cat'")
    a, b = (encode.encode(docs, fewer, dim=8, max_bytes=limit).orderBy("id").collect() for limit in (10**6, 0))
    assert [r.embedding for r in a] == [pytest.approx(r.embedding) for r in b] and a[0].embedding != want[0]
    postings = rows(encode.term_frequencies(stats), "id", "token", "tf", "doc_len")
    assert (3, "the", 3, 3) in postings and sum(p[2] for p in postings) == 21


def test_window_four_to_eight(spark):
    """The expected passage at rank 5: missed by a window of 4, reached by one of 8."""
    ranked = spark.createDataFrame([(1, r, 100 + r) for r in range(1, 9)], "qid int, rank int, id int")
    gold = spark.createDataFrame([(1, 105), (2, 7)], "qid int, id int")
    got = {r.k: r.n_hits for r in retrieve.sweep_k(ranked, gold, [4, 5, 8]).collect()}
    assert got == {4: 0, 5: 1, 8: 1}
    assert rows(retrieve.smallest_window(ranked, gold, [1, 2, 4, 8]).na.fill(0), "qid", "gold_rank", "k") == [(1, 5, 8), (2, 0, 0)]


def test_displacement_four_to_five(spark):
    at = lambda rank: spark.createDataFrame([(1, rank, 9)], "qid int, rank int, id int")
    gold = spark.createDataFrame([(1, 9)], "qid int, id int")
    lost = retrieve.rank_displacement(at(4), at(5), gold, 4).first()
    assert (lost.displacement, lost.border) == (1, "lost")
    assert retrieve.rank_displacement(at(5), at(4), gold, 4).first().border == "gained"
    assert retrieve.rank_displacement(at(4), at(5), gold, 8).first().border == "same"


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30)], "qid int, rank int, id int")
    b = spark.createDataFrame([(1, 1, 30), (1, 2, 40)], "qid int, rank int, id int")
    ab, ba = (rows(retrieve.rrf_fuse(x, k=3), "rank", "id", "score") for x in ([a, b], [b, a]))
    assert ab == ba and ab[0][1] == 30


def test_agreement(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 5)], "qid int, rank int, id bigint")
    b = spark.createDataFrame([(1, 1, 20), (1, 2, 10), (3, 1, 5)], "qid int, rank int, id bigint")
    got = rows(retrieve.compare_topk(a, b, 2), "qid", "identical", "overlap")
    assert got == [(1, False, 1.0), (2, False, 0.0), (3, False, 0.0)]


def test_context_and_answers(spark):
    chunks = spark.createDataFrame([(1, "red fox"), (2, "blue {question} whale"), (3, "green")], "chunk_no bigint, text string")
    asked = spark.createDataFrame([(1, "blue whale"), (2, "zzz")], "qid bigint, question string")
    ranked = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 3)], "qid bigint, rank int, id bigint")
    got = rows(retrieve.assemble_context(asked, ranked, chunks, "Q {question}\n{context}!", 2), "qid", "n_passages", "prompt")
    assert got == [
        (1, 2, "Q blue whale\n[资料§2] blue {question} whale\n[资料§1] red fox!"),
        (2, 0, "Q zzz\n!"),
    ]
    got = rows(retrieve.extractive_answers(asked, ranked, chunks, 0.5, "no").na.fill(0), "qid", "chunk_no", "answer")
    assert got == [(1, 2, "blue {question} whale [资料§2]"), (2, 0, "no")]


def test_rewrite_and_prefix(spark):
    asked = spark.createDataFrame([(1, "Robot arm robot"), (2, ""), (3, None)], "qid int, question string")
    rules = spark.createDataFrame([("robot", "humanoid machine"), ("ROBOT", "zzz")], "term string, replacement string")
    got = rows(encode.rewrite_queries(asked, rules), "qid", "rewritten")
    assert got == [(1, "humanoid machine arm humanoid machine"), (2, ""), (3, None)]
    assert encode.with_instruction(asked, "find: ").first().question == "find: Robot arm robot"


@pytest.mark.parametrize("arm, hits", [("lexical", [20, 20, 20, 20]), ("vector", [11, 12, 15, 17]), ("fused", [17, 17, 18, 20])])
def test_hits_on_the_corpus(spark, arm, hits):
    """Hits of 20 at k = 1, 2, 4, 8, measured independently on the sf0.01 tables."""
    sf = "/root/testdata/sf0.01"
    units = study.document_units(spark, sf)
    lexical, vector = (lambda: study.lexical(spark, sf, units, 50)), (lambda: study.vector(spark, sf, units, 50))
    ranked = {"lexical": lexical, "vector": vector, "fused": lambda: retrieve.rrf_fuse([lexical(), vector()])}[arm]()
    got = rows(retrieve.sweep_k(ranked, study.gold(study.questions(spark, sf), units), [1, 2, 4, 8]), "k", "n_hits")
    assert [n for _, n in got] == hits
