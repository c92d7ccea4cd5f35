"""Inputs of the registered queries, all derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.functions.bounds import BROADCAST_BYTES, broadcast_within, materialize, measured_bytes, scratch_path
from passageway.functions.text import hash_mod, words
from passageway.operators.corpus import chunk_documents
from passageway.operators.encode import TermStats, encode, query_terms, term_stats, with_instruction
from passageway.operators.evaluate import confusion, majority
from passageway.operators.retrieve import bm25_topk, exact_topk
from passageway.sources.collections import build_collection, open_collection
from passageway.sources.documents import load_documents, spread

# Configuration, percent of answerable questions refused, percent of unanswerable
# questions refused, percent of answered questions answered correctly.
CONFIGS = [("base", 5, 90, 75), ("tuned", 10, 70, 45), ("retry", 20, 72, 55)]
CONFIG_IDS = [c[0] for c in CONFIGS]
# What was held constant or changed in each configuration.
PARAMS = {
    "base": {"k": "8", "temperature": "0.2", "runs": "3", "criterion": "dual", "adapter": "none"},
    "tuned": {"k": "8", "temperature": "0.2", "runs": "3", "criterion": "dual", "adapter": "lora"},
    "retry": {"k": "4", "temperature": "0.2", "runs": "1", "criterion": "old", "adapter": "none"},
}
PAIRS = [("base", "tuned"), ("base", "retry"), ("tuned", "retry")]
CALIBER = ["k", "temperature", "runs", "criterion"]
METRICS = ["tp", "fp", "fn", "tn", "precision", "recall", "f1"]
INSTRUCTION = "represent this sentence for searching relevant passages: "
TEMPLATE = "Answer from the passages only.\n{context}\nQuestion: {question}\nAnswer:"
REFUSAL = "资料中没有相关内容。"
REFUSAL_PATTERNS = ["资料中没有相关内容", "no such information"]
THRESHOLD = 0.7


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load_documents(spark, f"{sf}/documents.parquet"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def chunks(spark: SparkSession, sf: str, collection: str | None = None) -> DataFrame:
    docs = documents(spark, sf)
    if collection is not None:
        docs = docs.withColumn("collection", F.col(collection))
    return chunk_documents(docs, length_col="n_chars")


def _spaced(text: str) -> Column:
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def gold(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, id) of the passages whose words contain the question's words in sequence.

    Candidates share the question's longest word (an equi-join); they are then compared whole. Questions that may be
    broadcast are compared in the pass that finds them, others after a join of ids alone.
    """
    asked = queries.select("qid", _spaced("question").alias("needle"), words("question").alias("w"))
    # Longest first; the last of the sorted pairs.
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x), x.alias("word"))))["word"]
    keys = asked.select("qid", "needle", longest.alias("word"))
    named = lambda *columns: passages.select("id", *columns, F.explode(F.array_distinct(words("text"))).alias("word"))
    if measured_bytes(keys) <= BROADCAST_BYTES:
        # The questions are where the passages are read: one pass, in which a passage is never copied for its words.
        pairs = named("text").join(F.broadcast(keys), "word")
    else:
        candidates = broadcast_within(materialize(named().join(keys, "word").select("qid", "id", "needle")))
        pairs = passages.select("id", "text").join(candidates, "id")
    return pairs.filter(F.contains(_spaced("text"), F.col("needle"))).select("qid", "id")


def document_units(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("id"), "text")


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as a built collection: cut once, then read with only the columns asked for."""
    out = scratch_path(spark, "corpus")
    build_collection(chunks(spark, sf), "corpus", out)
    return open_collection(spark, out, "corpus")


def as_units(chunked: DataFrame) -> DataFrame:
    return chunked.select(F.col("chunk_no").alias("id"), "text")


def lexical(
    spark: SparkSession, sf: str, units: DataFrame, k: int, stats: TermStats | None = None, mode: str = "word"
) -> DataFrame:
    asked = questions(spark, sf)
    return bm25_topk(asked, stats or term_stats(units, "id", mode=mode, only=query_terms(asked, mode)), k)


def vector(
    spark: SparkSession, sf: str, units: DataFrame, k: int, stats: TermStats | None = None, instruction: str | None = None
) -> DataFrame:
    asked = questions(spark, sf)
    if instruction:
        asked = with_instruction(asked, instruction)
    terms = (stats or term_stats(units, "id")).terms
    encoded = encode(asked, terms, "qid", "question").withColumnRenamed("id", "qid")
    return exact_topk(encoded, encode(units, terms, "id"), k)


def vector_both(spark: SparkSession, sf: str, units: DataFrame, k: int, instruction: str) -> tuple[DataFrame, DataFrame]:
    """``vector`` without and with the instruction: the units are encoded and scanned once for both."""
    asked = questions(spark, sf).select(F.col("qid").cast("bigint").alias("qid"), "question")
    terms = term_stats(units, "id").terms
    both = asked.select((F.col("qid") * 2).alias("qid"), "question").unionByName(
        with_instruction(asked, instruction).select((F.col("qid") * 2 + 1).alias("qid"), "question")
    )
    encoded = encode(both, terms, "qid", "question").withColumnRenamed("id", "qid")
    # At most k rows a question, kept: both rankings are read off them.
    ranked = materialize(exact_topk(encoded, encode(units, terms, "id"), k))
    sides = (ranked.filter(F.col("qid").bitwiseAND(1) == side) for side in (0, 1))
    return tuple(x.withColumn("qid", F.shiftright("qid", 1)) for x in sides)


def label_centers(spark: SparkSession, sf: str) -> DataFrame:
    """Query vectors: the mean embedding of each label, as (qid, embedding)."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy(F.col("label").cast("bigint").alias("qid")).agg(
        F.transform(ordered, lambda c: c["x"]).alias("embedding")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _turns(spark: SparkSession, sf: str, role: str) -> DataFrame:
    return (
        table(spark, sf, "conversations")
        .filter(F.col("role") == role)
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    )


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, "user").withColumnRenamed("text", "question")


def supplied(spark: SparkSession, sf: str) -> DataFrame:
    """Eight passage numbers per assistant turn: (config_id, qid, rank, chunk_no)."""
    rank = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")
    number = hash_mod(105, F.col("qid").cast("string"), F.col("rank").cast("string")) + 1
    return (
        _turns(spark, sf, "assistant")
        .select(F.lit("base").alias("config_id"), "qid", rank)
        .withColumn("chunk_no", number)
    )


def _mark(number: Column) -> Column:
    return F.concat(F.lit("[资料§"), number.cast("string"), F.lit("]"))


def cited_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of every assistant turn, citing one supplied passage twice and two numbers at random."""
    runs = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run")
    qid, run = F.col("qid").cast("string"), F.col("run").cast("string")
    first = hash_mod(105, qid, run) + 1
    second = hash_mod(105, F.lit("x"), qid, run) + 1
    third = hash_mod(105, F.lit("y"), qid, run) + 1
    cited = F.concat(_mark(second), F.lit("、"), _mark(first), F.lit("、"), _mark(first), _mark(third))
    return (
        _turns(spark, sf, "assistant")
        .select(F.lit("base").alias("config_id"), "qid", runs, "text")
        .select("config_id", "qid", "run", F.concat("text", F.lit(" "), cited).alias("answer"))
    )


def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of every assistant turn, some of them refusals in either wording."""
    runs = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run")
    u = hash_mod(100, F.lit("j"), F.col("qid").cast("string"), F.col("run").cast("string"))
    answer = F.when(u < 25, REFUSAL).when(u < 40, "There is no such information here.").otherwise(F.col("text"))
    return (
        _turns(spark, sf, "assistant")
        .select(F.lit("base").alias("config_id"), "qid", runs, "text")
        .select("config_id", "qid", "run", answer.alias("answer"))
    )


def judged_questions(spark: SparkSession, sf: str) -> DataFrame:
    qid = F.col("qid").cast("string")
    own = F.slice(F.split("text", " "), 1, 2)
    terms = F.when(hash_mod(100, F.lit("t"), qid) < 70, own).otherwise(F.array(F.lit("absent term")))
    return _turns(spark, sf, "assistant").select(
        "qid", (hash_mod(2, F.lit("q"), qid) == 0).alias("in_corpus"), terms.alias("expected_terms")
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of three configurations over all labelled documents, with reproducible noise."""
    configs = F.array(
        *[F.struct(F.lit(c).alias("config_id"), F.lit(a).alias("fp"), F.lit(b).alias("tp"), F.lit(d).alias("right")) for c, a, b, d in CONFIGS]
    )
    rows = (
        table(spark, sf, "labels")
        .select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("in_corpus"), F.explode(configs).alias("c"))
        .select("qid", "in_corpus", "c.*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))
    )
    key = [F.col("config_id"), F.col("qid").cast("string"), F.col("run").cast("string")]
    return (
        rows.withColumn("refused", hash_mod(100, *key) < F.when(F.col("in_corpus"), F.col("fp")).otherwise(F.col("tp")))
        .withColumn("correct", F.col("in_corpus") & ~F.col("refused") & (hash_mod(100, F.lit("c"), *key) < F.col("right")))
        .select("config_id", "qid", "run", "in_corpus", "refused", "correct")
    )


def final(spark: SparkSession, sf: str) -> DataFrame:
    return majority(verdicts(spark, sf))


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return confusion(final(spark, sf))


def run_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARAMS.items()), "config_id string, params map<string,string>")


def run_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "config_a string, config_b string")


def conversation_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A parameter map per conversation, standing for the configuration of a run."""
    counted = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("u"),
        F.count_if(F.col("role") == "assistant").alias("a"),
        F.count_if(F.col("role") == "system").alias("s"),
    )
    entries = [
        F.lit("user"), F.col("u").cast("string"),
        F.lit("assistant"), F.col("a").cast("string"),
        F.when(F.col("s") > 0, "system").otherwise("plain"), F.lit("yes"),
    ]
    return counted.select(F.col("conv_id").cast("string").alias("config_id"), F.create_map(*entries).alias("params"))


def neighbour_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation with the one of the next number, if there is one."""
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    following = ids.select((F.col("conv_id") - 1).alias("conv_id"))
    return ids.join(following, "conv_id").select(
        F.col("conv_id").cast("string").alias("config_a"), (F.col("conv_id") + 1).cast("string").alias("config_b")
    )


def train_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a record: assistant turns real, user turns synthetic."""
    rec_id = F.col("conv_id") * 1000 + F.col("turn")
    kind = F.when(F.col("role") == "assistant", "real").when(F.col("role") == "user", "synthetic").otherwise("template")
    ref = F.concat(F.lit("src"), hash_mod(22, F.lit("r"), rec_id.cast("string")).cast("string"))
    return table(spark, sf, "conversations").select(
        rec_id.alias("rec_id"), kind.alias("kind"), ref.alias("source_ref"), F.col("role").alias("prompt"), F.col("text").alias("response")
    )
