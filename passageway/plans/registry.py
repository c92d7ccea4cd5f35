"""One query per operator: each takes (spark, sf_dir) and returns a DataFrame.

Arrays are joined to text and rates rounded at the very end, so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize, scratch_path
from passageway.operators import align, cells, cite, corpus, differences, encode, evaluate, postings, retrieve, trainmix, uncertainty
from passageway.plans import study
from passageway.sources import blocks, collections, runlogs
from passageway.sources.documents import DOCUMENTS, load_documents
from passageway.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _text(ids: Column | str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",").alias(ids if isinstance(ids, str) else "ids")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- corpus -----------------------------------------------------------------------------------


def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    return load_documents(
        spark, f"{sf}/documents.parquet", ["de", "fr"], ["src1", "src2", "src3"], ["doc_id", "lang", "source", "n_chars"]
    )


def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "ingest")
    uploads = (
        spark.readStream.schema(DOCUMENTS)
        .parquet(f"{sf}/documents.parque[t]")  # as a pattern: one file, or a folder of them; a stream over a plain path takes folders only
        .select(F.col("lang").alias("collection"), "doc_id", "text")
    )
    ingest.ingest_stream(uploads, f"{out}/built", f"{out}/progress").awaitTermination()
    return collections.open_collection(spark, f"{out}/built/chunks")


def ingest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of uploads into blocks: all documents, then the documents of one source again, revised."""
    out = scratch_path(spark, "blocks")
    uploads = study.table(spark, sf, "documents").select(F.col("lang").alias("collection"), "doc_id", "text", "source")
    first = uploads.filter("collection IS NOT NULL").drop("source")
    revised = first.join(uploads.filter("source = 'src1'").select("doc_id"), "doc_id", "left_semi")
    revised = revised.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" (revised)")))
    for i, rows in enumerate((first, revised)):
        rows.select("collection", "doc_id", "text").write.parquet(f"{out}/landing{i}")
        stream = ingest.read_uploads(spark, f"{out}/landing{i}")
        ingest.ingest_stream(stream, f"{out}/built", f"{out}/progress{i}", layout="blocks").awaitTermination()
    return blocks.open_blocks(spark, f"{out}/built")


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return study.chunks(spark, sf, "source")


def build_collection(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "collection")
    chunked = study.chunks(spark, sf)
    for _ in range(2):
        collections.build_collection(chunked, "sample", out)
    return collections.open_collection(spark, out, "sample")


def resolve_collection(spark: SparkSession, sf: str) -> DataFrame:
    docs = study.documents(spark, sf)
    session_uploads = study.hash_mod(2, F.lit("s"), F.col("source")) == 0
    origin = F.when(session_uploads & (study.hash_mod(10, F.lit("o"), F.col("doc_id").cast("string")) < 3), "uploaded")
    sources = docs.select(F.col("source").alias("session"), F.coalesce(origin, F.lit("builtin")).alias("origin"), "doc_id")
    return corpus.resolve_collection(sources).select("session", "origin", "doc_id")


def _appended_twice(spark: SparkSession, sf: str) -> DataFrame:
    once = study.chunks(spark, sf, "lang")
    return once.unionByName(once.filter(F.col("collection") == "fr"))


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    return (
        study.documents(spark, sf)
        .groupBy(F.col("lang").alias("collection"))
        .agg(F.sum(corpus.chunk_count(F.length("text"), 800, 400)).alias("expected"))
    )


def audit_collection(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.audit_collection(_appended_twice(spark, sf), _expected(spark, sf))


def align_numbering(spark: SparkSession, sf: str) -> DataFrame:
    partial = study.documents(spark, sf).filter(F.col("lang") != "es")
    return corpus.align_numbering(study.chunks(spark, sf), corpus.chunk_documents(partial))


def align_shifted(spark: SparkSession, sf: str) -> DataFrame:
    """All passages against those of a corpus that lost one language and got revised copies in front."""
    docs = study.documents(spark, sf).select("doc_id", "text", "lang")
    revised = docs.filter("lang = 'de'").select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(F.lit("revised "), "text").alias("text"), "lang")
    later = docs.filter("lang IS NULL OR lang <> 'es'").unionByName(revised)
    aligned = align.align_shifted(study.chunks(spark, sf), corpus.chunk_documents(later))
    zero = F.lit(0).cast("bigint")
    return aligned.select("collection", F.coalesce("left_no", zero).alias("left_no"), F.coalesce("right_no", zero).alias("right_no"), "status")


def open_collection(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "collections")
    collections.write_collections(study.chunks(spark, sf, "lang"), out)
    return collections.open_collection(spark, out, "de")


# --- questions and encoding -------------------------------------------------------------------


def with_instruction(spark: SparkSession, sf: str) -> DataFrame:
    return encode.with_instruction(study.user_questions(spark, sf), study.INSTRUCTION)


def rewrite_queries(spark: SparkSession, sf: str) -> DataFrame:
    terms = study.questions(spark, sf).select(F.explode(study.words("question")).alias("term")).distinct()
    rules = terms.select("term", F.concat(F.lit("<"), "term", F.lit(">")).alias("replacement"))
    return encode.rewrite_queries(study.user_questions(spark, sf), rules).select("qid", "rewritten")


def rewrite_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping rules of two and three words, taken from the questions themselves."""
    asked = study.user_questions(spark, sf)
    words = F.split("question", " ")
    terms = asked.select(F.explode(F.array(*[F.array_join(F.slice(words, a, n), " ") for a, n in ((2, 2), (3, 3), (2, 4))])).alias("term"))
    rules = terms.distinct().select("term", F.concat(F.lit("<"), "term", F.lit(">")).alias("replacement"))
    return encode.rewrite_phrases(asked, encode.phrase_trie(rules)).select("qid", "rewritten")


def encode_text(spark: SparkSession, sf: str) -> DataFrame:
    units = study.document_units(spark, sf)
    vectors = encode.encode(units, encode.term_stats(units, "id").terms, "id")
    return _rounded(vectors.select("id", F.posexplode("embedding").alias("bucket", "weight")), "weight")


def encode_text_bigram(spark: SparkSession, sf: str) -> DataFrame:
    units = study.document_units(spark, sf)
    vectors = encode.encode(units, encode.term_stats(units, "id", mode="bigram").terms, "id", mode="bigram")
    return _rounded(vectors.select("id", F.posexplode("embedding").alias("bucket", "weight")), "weight")


def _length_model() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in for a caller's model: characters and spaces of each text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)

    return predict


def encode_with_model(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encode.encode_with_model(study.document_units(spark, sf), _length_model, "id")
    return encoded.select(
        "id", F.col("embedding")[0].cast("bigint").alias("x0"), F.col("embedding")[1].cast("bigint").alias("x1")
    )


def term_postings(spark: SparkSession, sf: str) -> DataFrame:
    return encode.term_frequencies(encode.term_stats(study.documents(spark, sf)))


def _terms(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return _rounded(encode.term_stats(study.documents(spark, sf), mode=mode).terms, "idf")


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf, "word")


def term_stats_bigram(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf, "bigram")


# --- retrieval --------------------------------------------------------------------------------


def exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieve.exact_topk(study.label_centers(spark, sf), study.vectors(spark, sf), 8), "score")


def exact_topk_text(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(study.vector(spark, sf, study.document_units(spark, sf), 8), "score")


def ann_topk_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(retrieve.ann_topk(study.label_centers(spark, sf), study.vectors(spark, sf), 8, ef=50), "score")


def _ivf(spark: SparkSession, sf: str, centers: DataFrame, nprobe: int) -> DataFrame:
    out = scratch_path(spark, "vectors")
    collections.write_vectors(retrieve.assign_cells(study.vectors(spark, sf), centers), out)
    stored = collections.open_vectors(spark, out)
    found = retrieve.ann_topk(study.label_centers(spark, sf), stored, 8, coarse="ivf", centroids=centers, nprobe=nprobe)
    return _rounded(found, "score")


def ann_topk_ivf(spark: SparkSession, sf: str) -> DataFrame:
    return _ivf(spark, sf, retrieve.fit_cells(study.vectors(spark, sf), 16), 4)


def ann_topk_ivf_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _ivf(spark, sf, retrieve.fit_cells(study.vectors(spark, sf), 16), 16)


def ann_topk_ivf_label_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells around the label means, which need no fitting: 4 of 10 are probed."""
    centers = study.label_centers(spark, sf).select(F.col("qid").cast("int").alias("cell"), F.col("embedding").alias("centroid"))
    return _ivf(spark, sf, centers, 4)


def _stored_tree(spark: SparkSession, sf: str, n_cells: int) -> tuple[cells.CellTree, DataFrame]:
    out = scratch_path(spark, "cells")
    tree = cells.fit_cell_tree(study.vectors(spark, sf), n_cells)
    cells.write_cells(cells.assign(study.vectors(spark, sf), tree), out)
    return tree, spark.read.parquet(out)


def ann_topk_tree_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells in two levels, all of which are probed."""
    tree, stored = _stored_tree(spark, sf, 64)
    return _rounded(cells.probe_topk(study.label_centers(spark, sf), stored, tree, 8, n_groups=64, nprobe=64), "score")


def exact_topk_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The exact ranking from the cells that bounds cannot rule out."""
    tree, stored = _stored_tree(spark, sf, 64)
    return _rounded(cells.exact_topk_bounded(study.label_centers(spark, sf), stored, tree, cells.cell_reach(stored), 8).top, "score")


def compare_topk(spark: SparkSession, sf: str) -> DataFrame:
    queries, vectors = study.label_centers(spark, sf), study.vectors(spark, sf)
    exact = retrieve.exact_topk(queries, vectors, 8)
    pooled = retrieve.ann_topk(queries, vectors, 8, ef=10)
    compared = retrieve.compare_topk(exact, pooled, 8)
    return _rounded(compared.select("qid", _text("a_ids"), _text("b_ids"), "identical", "overlap"), "overlap")


def compare_pools(spark: SparkSession, sf: str) -> DataFrame:
    """How far a pool of 10, of 200 and of all vectors agrees with the exact ranking."""
    queries, vectors = study.label_centers(spark, sf), study.vectors(spark, sf)
    exact = retrieve.exact_topk(queries, vectors, 8)
    rows = []
    pools = [(str(ef), retrieve.ann_topk(queries, vectors, 8, ef=ef)) for ef in (10, 200)]
    # A pool that all vectors enter is ranked by the cosine over all dimensions in each task, which k rows a question leave.
    pools.append(("all", retrieve.ann_topk(queries, vectors, 8, ef=8, coarse_dims=1 << 16)))
    for name, pool in pools:
        compared = retrieve.compare_topk(exact, pool, 8)
        rows.append(
            compared.agg(
                F.lit(name).alias("pool"), F.count("*").alias("n_queries"), F.count_if("identical").alias("n_identical"), F.avg("overlap").alias("overlap")
            )
        )
    return _rounded(reduce(DataFrame.unionByName, rows), "overlap")


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(study.lexical(spark, sf, study.document_units(spark, sf), 8), "score")


def bm25_topk_bigram(spark: SparkSession, sf: str) -> DataFrame:
    """As for scripts without spaces: texts and questions as character pairs."""
    return _rounded(study.lexical(spark, sf, study.document_units(spark, sf), 8, mode="bigram"), "score")


def bm25_topk_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking from stored postings, of which blocks that cannot reach the first eight are not read."""
    out = scratch_path(spark, "postings")
    postings.build_postings(encode.term_stats(study.document_units(spark, sf), "id"), out)
    return _rounded(postings.postings_topk(spark, out, study.questions(spark, sf), 8).top, "score")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    units = study.document_units(spark, sf)
    stats = encode.term_stats(units, "id")
    lists = [study.lexical(spark, sf, units, 50, stats), study.vector(spark, sf, units, 50, stats)]
    return retrieve.rrf_fuse(lists, k=8)


def _document_gold(spark: SparkSession, sf: str) -> DataFrame:
    return study.gold(study.questions(spark, sf), study.document_units(spark, sf))


def sweep_k(spark: SparkSession, sf: str) -> DataFrame:
    ranked = study.vector(spark, sf, study.document_units(spark, sf), 8)
    return _rounded(retrieve.sweep_k(ranked, _document_gold(spark, sf), [1, 2, 4, 8]), "hit_rate")


def smallest_window(spark: SparkSession, sf: str) -> DataFrame:
    ranked = study.vector(spark, sf, study.document_units(spark, sf), 8)
    found = retrieve.smallest_window(ranked, _document_gold(spark, sf), [1, 2, 4, 8])
    return found.select("qid", F.coalesce("gold_rank", F.lit(0)).alias("gold_rank"), F.coalesce("k", F.lit(0)).alias("k"))


def rank_displacement(spark: SparkSession, sf: str) -> DataFrame:
    """Where the expected document goes when every question gets an instruction prefix."""
    units = study.document_units(spark, sf)
    plain, prefixed = study.vector_both(spark, sf, units, 50, study.INSTRUCTION)
    moved = retrieve.rank_displacement(plain, prefixed, _document_gold(spark, sf), 4)
    zero = F.lit(0)
    return moved.select(
        "qid",
        F.coalesce("rank_a", zero).alias("rank_a"),
        F.coalesce("rank_b", zero).alias("rank_b"),
        F.coalesce("displacement", zero).alias("displacement"),
        "border",
    )


def assemble_context(spark: SparkSession, sf: str) -> DataFrame:
    chunks = study.stored_chunks(spark, sf)
    ranked = study.lexical(spark, sf, study.as_units(chunks), 8)
    return retrieve.assemble_context(study.questions(spark, sf), ranked, chunks, study.TEMPLATE)


def extractive_answers(spark: SparkSession, sf: str) -> DataFrame:
    chunks = study.stored_chunks(spark, sf)
    ranked = study.lexical(spark, sf, study.as_units(chunks), 8)
    answers = retrieve.extractive_answers(study.questions(spark, sf), ranked, chunks, study.THRESHOLD, study.REFUSAL)
    return answers.withColumn("chunk_no", F.coalesce("chunk_no", F.lit(0).cast("bigint")))


# --- citations --------------------------------------------------------------------------------


def extract_citations(spark: SparkSession, sf: str) -> DataFrame:
    found = cite.extract_citations(study.cited_answers(spark, sf))
    return found.select("config_id", "qid", "run", _text("citations"))


def illegal_citations(spark: SparkSession, sf: str) -> DataFrame:
    found = cite.illegal_citations(study.cited_answers(spark, sf), study.supplied(spark, sf))
    return found.select("config_id", "qid", "run", _text("illegal"), "n_illegal")


def _whitelisted(spark: SparkSession, sf: str) -> DataFrame:
    return cite.enforce_whitelist(study.cited_answers(spark, sf), study.supplied(spark, sf))


def enforce_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return _whitelisted(spark, sf).select("config_id", "qid", "run", "answer")


def apply_retry(spark: SparkSession, sf: str) -> DataFrame:
    answers = study.cited_answers(spark, sf)
    flags = cite.illegal_citations(answers, study.supplied(spark, sf)).filter("n_illegal > 0")
    return cite.apply_retry(answers, study.judged_answers(spark, sf), flags)


def dedupe_citations(spark: SparkSession, sf: str) -> DataFrame:
    return cite.dedupe_citations(study.cited_answers(spark, sf)).select("config_id", "qid", "run", "answer", "n_repeated")


def verdict_flips(spark: SparkSession, sf: str) -> DataFrame:
    """What the named retry does to the verdicts of the cited answers."""
    questions = study.judged_questions(spark, sf)
    before = evaluate.judge(study.cited_answers(spark, sf), questions, study.REFUSAL_PATTERNS)
    after = evaluate.judge(apply_retry(spark, sf), questions, study.REFUSAL_PATTERNS)
    return cite.verdict_flips(before, after)


# --- evaluation -------------------------------------------------------------------------------


def judge(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.judge(study.judged_answers(spark, sf), study.judged_questions(spark, sf), study.REFUSAL_PATTERNS)


def majority(spark: SparkSession, sf: str) -> DataFrame:
    return study.final(spark, sf)


def retrieval_hits(spark: SparkSession, sf: str) -> DataFrame:
    questions = study.questions(spark, sf)
    chunks = study.stored_chunks(spark, sf)
    units = study.as_units(chunks)
    ranked = materialize(study.lexical(spark, sf, units, 8))
    # Only a ranked passage can be a hit: the others need not be compared with the questions.
    found = units.join(broadcast_within(ranked.select("id").distinct()), "id", "left_semi")
    hits = evaluate.retrieval_hits(
        ranked,
        study.gold(questions, found),
        _document_gold(spark, sf).select("qid", F.col("id").alias("doc_id")),
        chunks.select(F.col("chunk_no").alias("id"), "doc_id"),
        8,
    )
    return _rounded(hits, "strict_rate", "loose_rate")


def answer_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.answer_rates(study.final(spark, sf)), "correct_rate", "refusal_rate", "total_rate")


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(study.matrix(spark, sf), "precision", "recall", "f1")


def answer_quality(spark: SparkSession, sf: str) -> DataFrame:
    """End to end: rank chunks, answer or refuse, and score the refusals against the gold."""
    questions = study.questions(spark, sf)
    answers = extractive_answers(spark, sf)
    answerable = study.gold(questions, study.document_units(spark, sf)).select("qid").distinct()
    final = answers.join(answerable.withColumn("found", F.lit(True)), "qid", "left").select(
        F.lit("lexical").alias("config_id"),
        F.coalesce("found", F.lit(False)).alias("in_corpus"),
        (F.col("answer") == study.REFUSAL).alias("refused"),
    )
    return _rounded(evaluate.confusion(final), "precision", "recall", "f1")


def proportion_ci(spark: SparkSession, sf: str) -> DataFrame:
    rates = evaluate.answer_rates(study.final(spark, sf)).select("config_id", "n", "total_rate")
    return _rounded(
        evaluate.proportion_ci(rates, "total_rate", "n"), "total_rate", "half_width", "wilson_low", "wilson_high"
    )


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix with its F1 as published: three digits, and one configuration mistyped."""
    wrong = F.when(F.col("config_id") == "retry", 0.01).otherwise(0.0)
    return study.matrix(spark, sf).withColumn("f1", F.round(F.col("f1"), 3) + wrong)


def check_consistency(spark: SparkSession, sf: str) -> DataFrame:
    checked = evaluate.check_consistency(_stated(spark, sf))
    return _rounded(checked.select("config_id", "f1", "recomputed", "ok"), "f1", "recomputed")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.to_metrics(confusion(spark, sf), study.METRICS)


def parse_run_logs(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "runlogs")
    runlogs.write_run_logs(_metrics(spark, sf), out)
    patterns = {m: rf"(?m)^{m} = ([-0-9.Ee]+)$" for m in study.METRICS}
    parsed = runlogs.parse_run_logs(spark, f"{out}/*/*.txt", patterns)
    return parsed.select(
        F.regexp_extract("path", "config_id=([^/]+)/", 1).alias("config_id"), "metric", F.coalesce("value", F.lit(0.0)).alias("value"), "state"
    )


def final_table(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.final_table(_metrics(spark, sf), study.CONFIG_IDS)


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.compare_runs(_metrics(spark, sf), study.run_configs(spark), study.run_pairs(spark), study.CALIBER)


def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    compared = _compared(spark, sf).withColumns(
        {"delta": F.coalesce("delta", F.lit(0.0)), "reason": F.coalesce("reason", F.lit(""))}
    )
    return _rounded(compared, "delta")


def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    diff = evaluate.config_diff(study.conversation_profiles(spark, sf), study.neighbour_pairs(spark, sf))
    return diff.select("config_a", "config_b", _text("changed"), "n_changed", "single_variable")


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of the rates where bigger is better, for every pair, whatever its caliber."""
    metrics = evaluate.to_metrics(answer_rates(spark, sf), ["correct_rate", "refusal_rate", "total_rate"])
    return evaluate.compare_runs(metrics, study.run_configs(spark), study.run_pairs(spark), [])


def same_direction(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.same_direction(_deltas(spark, sf))


def paired_ab(spark: SparkSession, sf: str) -> DataFrame:
    final = study.final(spark, sf)
    base, tuned = (final.filter(F.col("config_id") == c) for c in ("base", "tuned"))
    return _rounded(evaluate.paired_ab(base, tuned), "delta")


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    return uncertainty.pair_verdicts(study.final(spark, sf), study.run_pairs(spark))


def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of F1 and of the share of right answers, with an interval from 200 replicates."""
    return _rounded(uncertainty.paired_bootstrap(_paired(spark, sf), 200, "7"), "delta", "low", "high")


def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(uncertainty.mcnemar(_paired(spark, sf)), "p")


def effect_ledger(spark: SparkSession, sf: str) -> DataFrame:
    deltas = _deltas(spark, sf)
    agree = evaluate.same_direction(deltas).select("config_a", "config_b", "same_direction")
    total = deltas.filter(F.col("metric") == "total_rate").select("config_a", "config_b", "delta")
    # The interval of a pair is the wider one of its two sides, from their numbers of answers.
    widths = evaluate.proportion_ci(answer_rates(spark, sf), "total_rate", "n").select("config_id", "half_width")
    sides = [widths.select(F.col("config_id").alias(f"config_{x}"), F.col("half_width").alias(f"half_{x}")) for x in "ab"]
    joined = total.join(agree, ["config_a", "config_b"]).join(sides[0], "config_a").join(sides[1], "config_b")
    ledger = evaluate.effect_ledger(joined, F.greatest("half_a", "half_b"))
    return _rounded(ledger.select("config_a", "config_b", "delta", "same_direction", "effect"), "delta")


def ablation_variants(spark: SparkSession, sf: str) -> DataFrame:
    templates = study.questions(spark, sf).select(F.col("qid").alias("template_id"), F.col("question").alias("template"))
    return evaluate.ablation_variants(templates)


def ablation_effects(spark: SparkSession, sf: str) -> DataFrame:
    """The configurations as the whole prompt and two variants of it, over all labelled documents."""
    variant = F.array_position(F.array(*map(F.lit, study.CONFIG_IDS)), F.col("config_id")).cast("int") - 1
    verdicts = study.final(spark, sf).withColumns({"template_id": F.lit("prompt"), "variant": variant})
    return _rounded(uncertainty.ablation_effects(verdicts), "precision", "recall", "f1", "delta_f1", "p")


def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.fingerprint(study.documents(spark, sf), ["doc_id", "text", "lang"])


def changed_questions(spark: SparkSession, sf: str) -> DataFrame:
    """What was added, removed or changed between the documents and a later state of them."""
    docs = study.documents(spark, sf).select("doc_id", "text", "lang")
    kept = docs.filter("lang IS NULL OR lang <> 'es'")
    revised = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    added = docs.filter("lang = 'de'").withColumn("doc_id", -1 - F.col("doc_id"))
    later = kept.withColumn("text", revised).unionByName(added)
    out = scratch_path(spark, "digests")
    for name, df in (("now", docs), ("later", later)):
        differences.store_digests(df, ["doc_id"], ["doc_id", "text", "lang"], f"{out}/{name}")
    changes = differences.changed_rows(spark, f"{out}/now", f"{out}/later")
    return differences.named(changes, docs, later, keys=["doc_id"])


def release_gate(spark: SparkSession, sf: str) -> DataFrame:
    cited = cite.illegal_citations(_whitelisted(spark, sf), study.supplied(spark, sf))
    return evaluate.release_gate(
        [
            evaluate.check_row("collection", audit_collection(spark, sf), "not ok"),
            evaluate.check_row("numbering", align_numbering(spark, sf), "status <> 'same'"),
            evaluate.check_row("top_ids", compare_topk(spark, sf), "not identical"),
            evaluate.check_row("citations", cited, "n_illegal > 0"),
            evaluate.check_row("matrix", check_consistency(spark, sf), "not ok"),
        ]
    )


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return study.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("entry_id"), F.col("turn").alias("version"), "text"
    )


def log_current(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.log_current(_log(spark, sf))


def log_history(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.log_history(_log(spark, sf))


# --- training mix -----------------------------------------------------------------------------


def training_mix(spark: SparkSession, sf: str) -> DataFrame:
    return trainmix.mix(study.train_records(spark, sf), {"real": 201, "synthetic": 99}, "7", short="take")


def mix_variants(spark: SparkSession, sf: str) -> DataFrame:
    specs = spark.createDataFrame(
        [("real only", "real", 201), ("aligned", "real", 201), ("aligned", "synthetic", 99), ("even", "real", 150), ("even", "synthetic", 150)],
        "variant string, kind string, n bigint",
    )
    return trainmix.variants(study.train_records(spark, sf), specs, "7").select("variant", "kind", "rec_id")


def provenance_audit(spark: SparkSession, sf: str) -> DataFrame:
    known = study.documents(spark, sf).select(F.col("source").alias("source_ref"))
    return trainmix.provenance_audit(study.train_records(spark, sf), known)


def distribution_gap(spark: SparkSession, sf: str) -> DataFrame:
    band = lambda text: F.floor(F.length(text) / 100).cast("bigint").alias("band")
    train = study.train_records(spark, sf).filter(F.col("kind") == "real").select(band("response"))
    gap = trainmix.distribution_gap(train, study.documents(spark, sf).select(band("text")), "band")
    return _rounded(gap, "p_train", "p_eval", "gap", "total_variation")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        corpus_scan, ingest_stream, ingest_blocks, chunk_documents, build_collection, resolve_collection, audit_collection,
        align_numbering, align_shifted, open_collection,
        with_instruction, rewrite_queries, rewrite_phrases, encode_text, encode_text_bigram, encode_with_model, term_postings, term_stats, term_stats_bigram,
        exact_topk, exact_topk_text, ann_topk_prefix, ann_topk_ivf, ann_topk_ivf_all_cells, ann_topk_ivf_label_cells, ann_topk_tree_all_cells, exact_topk_bounded, compare_topk, compare_pools, bm25_topk,
        bm25_topk_bigram, bm25_topk_postings, rrf_fuse, sweep_k, smallest_window, rank_displacement, assemble_context, extractive_answers,
        extract_citations, illegal_citations, enforce_whitelist, apply_retry, dedupe_citations, verdict_flips,
        judge, majority, retrieval_hits, answer_rates, confusion, answer_quality, proportion_ci, check_consistency,
        parse_run_logs, final_table, compare_runs, config_diff, same_direction, paired_ab, paired_bootstrap, mcnemar, effect_ledger,
        ablation_variants, ablation_effects, fingerprint, changed_questions, release_gate, log_current, log_history,
        training_mix, mix_variants, provenance_audit, distribution_gap,
    )
}
