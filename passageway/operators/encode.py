"""Preparing questions, term statistics, and encoding text as vectors."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageway.functions.bounds import BROADCAST_BYTES, broadcast_within, materialize, measured_bytes
from passageway.functions.lexical import COUNTS_SCHEMA, ENCODED_SCHEMA, HashedEncoder, count_terms
from passageway.functions.text import hex_number, tokens


def with_instruction(queries: DataFrame, prefix: str) -> DataFrame:
    """Put an instruction before every question (the query side only, never the passages)."""
    return queries.withColumn("question", F.concat(F.lit(prefix), F.col("question")))


def rewrite_queries(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Replace the words of each question by rule: ``rules`` has (term, replacement), one row a term.

    Words are compared in lower case; words without a rule stay.  Of rules that differ in case alone the first
    replacement in order of text counts.  Adds ``rewritten``, null for a null question.
    """
    words = queries.select("qid", F.posexplode(F.split("question", " ")).alias("pos", "word"))
    single = rules.groupBy(F.lower("term").alias("_term")).agg(F.min("replacement").alias("replacement"))
    replaced = words.join(broadcast_within(single), F.lower("word") == F.col("_term"), "left").select(
        "qid", "pos", F.coalesce("replacement", "word").alias("word")
    )
    # One group holds the words of one question.
    rebuilt = replaced.groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " "
        ).alias("rewritten")
    )
    return queries.join(rebuilt, "qid", "left")


def phrase_trie(rules: DataFrame) -> DataFrame:
    """(prefix, replacement): every beginning of a rule in whole words, with the replacement where a rule ends, else null.

    ``rules`` has (term, replacement); terms are words with single spaces between, compared in lower case. Of rules that
    differ in case alone the first replacement in order of text counts. Build it once and keep it.
    """
    parts = rules.filter(F.col("term").isNotNull()).select(F.split(F.lower("term"), " ").alias("w"), "replacement")
    ends = F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n")
    prefixes = parts.select("w", "replacement", ends)
    ended = F.when(F.col("n") == F.size("w"), F.coalesce("replacement", F.lit("")))
    return prefixes.groupBy(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("prefix")).agg(F.min(ended).alias("replacement"))


def rewrite_phrases(queries: DataFrame, trie: DataFrame) -> DataFrame:
    """Replace phrases of each question (qid, question) by the rules of ``phrase_trie``, from left to right.

    At every word the longest rule that begins there counts, and the search goes on behind it. Positions go down the trie
    word by word, a join per level, and only those that are still on a path go on; levels end when none is. Adds
    ``rewritten``, null for a null question; a replaced phrase is its replacement, null replacements are empty.
    """
    trie = broadcast_within(materialize(trie))
    split = materialize(queries.select("qid", F.split("question", " ").alias("w")).filter("w IS NOT NULL"))
    at = split.select("qid", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("pos"))
    ends, size = None, 1
    while True:
        phrase = F.lower(F.array_join(F.slice("w", F.col("pos"), F.lit(size)), " "))
        at = materialize(at.filter(F.col("pos") + size - 1 <= F.size("w")).withColumn("prefix", phrase).join(trie, "prefix").drop("prefix"))
        if at.isEmpty():
            break
        found = at.filter("replacement IS NOT NULL").select("qid", "pos", F.lit(size).alias("size"), "replacement")
        ends = found if ends is None else ends.unionAll(found)
        at, size = at.drop("replacement"), size + 1
    if ends is None:
        return queries.withColumn("rewritten", F.col("question"))
    longest = ends.groupBy("qid", "pos").agg(F.max_by(F.struct("size", "replacement"), "size").alias("rule"))
    # A group holds the matches of one question, one a word at most.
    rules = longest.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rule"))).alias("rules"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, pos: Column) -> Column:
        rule = F.try_element_at(F.col("rules"), pos)
        piece = F.coalesce(rule["replacement"], F.element_at("w", pos))
        taken = F.struct((pos + F.coalesce(rule["size"], F.lit(1))).alias("next"), F.concat(state["out"], F.array(piece)).alias("out"))
        return F.when(pos < state["next"], state).otherwise(taken)

    joined = split.join(rules, "qid", "left")
    walked = F.aggregate(F.sequence(F.lit(1), F.size("w")), start, step, lambda state: F.array_join(state["out"], " "))
    rewritten = joined.select("qid", walked.alias("rewritten"))
    return queries.join(rewritten, "qid", "left")


class TermStats(NamedTuple):
    """``words`` (id, words), ``terms`` (token, df, idf), ``corpus`` (n_docs, total_len; one row)."""

    words: DataFrame
    terms: DataFrame
    corpus: DataFrame
    mode: str


def query_terms(queries: DataFrame, mode: str = "word") -> DataFrame:
    """The distinct words of each question as (qid, token)."""
    return queries.select("qid", F.explode(F.array_distinct(tokens("question", mode))).alias("token"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_stats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mode: str = "word",
    only: DataFrame | None = None,
) -> TermStats:
    """Document frequencies, inverse document frequencies and lengths, in one pass that is kept.

    ``only`` (one ``token`` column) limits ``terms`` to these words; all documents and whole texts
    are counted all the same.
    """
    split = docs.select(F.col(id_col).cast("bigint").alias("id"), tokens(text_col, mode).alias("words"))
    # Lengths are taken before the explode: after it, every row would carry all words of its document.
    sized = split.select("words", F.size("words").alias("doc_len"))
    # A document names each word once, so counts combine before the shuffle.  The empty word, which
    # no tokeniser yields, stands for the document itself and counts documents and lengths.
    named = sized.select("doc_len", F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("token"))
    if only is not None:
        wanted = only.select("token").union(only.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
        named = named.join(broadcast_within(wanted), "token", "left_semi")
    counts = materialize(named.groupBy("token").agg(F.count("*").alias("df"), F.sum("doc_len").alias("total_len")))
    corpus = counts.filter(F.col("token") == "").select(F.col("df").alias("n_docs"), "total_len")
    n_docs = corpus.select("n_docs").scalar()
    terms = counts.filter(F.col("token") != "").select("token", "df", idf(F.col("df"), n_docs).alias("idf"))
    return TermStats(split, terms, corpus, mode)


def term_frequencies(stats: TermStats) -> DataFrame:
    """Postings: (id, token, tf, doc_len), counted where the documents are read."""
    return stats.words.mapInArrow(count_terms, COUNTS_SCHEMA)


def _common_and_rare(terms: DataFrame, hot_share: float, max_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The part of a vocabulary that goes to every task, and the rest (None if nothing is left).

    A vocabulary measured as small goes whole.  Of a larger one go the words in at least one
    document of a thousand: at most a thousand times the mean number of distinct words per document,
    however large the corpus.  What is left has no hot key.  If even those are too many, as many of the
    commonest go as fit, by a histogram of idf.
    """
    if measured_bytes(terms) <= max_bytes:
        return terms, None
    # exp(-idf) is (df + 1/2) / (n_docs + 1), the share of the documents.
    edge = -math.log(hot_share)
    if measured_bytes(terms.filter(F.col("idf") <= edge)) > max_bytes:
        edge = _edge_within(terms, max_bytes)
    return terms.filter(F.col("idf") <= edge), terms.filter(F.col("idf") > edge)


def _edge_within(terms: DataFrame, max_bytes: int, steps: int = 200) -> float:
    """The largest of ``steps`` idf values up to which the words take at most ``max_bytes``."""
    low, high = terms.agg(F.min("idf"), F.max("idf")).first()
    width = (high - low) / steps or 1.0
    step = F.least(F.floor((F.col("idf") - low) / width), F.lit(steps - 1))
    size = F.octet_length("token") + 64  # as ``measured_bytes`` counts a row of them
    held, edge = 0, low - 1.0
    for row in terms.groupBy(step.alias("step")).agg(F.sum(size).alias("bytes"), F.max("idf").alias("top")).orderBy("step").collect():
        held += row["bytes"]
        if held > max_bytes:
            break
        edge = row["top"]
    return edge


def encode(
    texts: DataFrame,
    terms: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dim: int = 64,
    mode: str = "word",
    hot_share: float = 0.001,
    max_bytes: int = BROADCAST_BYTES // 2,
) -> DataFrame:
    """Hashed TF-IDF vectors: (id, embedding ARRAY<DOUBLE>) for every row of ``texts``, ids being unique.

    A word falls into bucket ``md5(word) mod dim`` (first six hex digits) with weight
    ``(1 + ln tf) * idf``; words missing from ``terms`` weigh nothing.  ``terms`` comes from
    :func:`term_stats` of the corpus, for passages and questions alike.

    Common words are summed where the texts are read.  Rare words, if the vocabulary is too large to
    send, are looked up by a shuffle on the word and added to the vector by one on the id.
    """
    # Hashed once a word of the vocabulary, not once a posting.
    bucket = (hex_number(F.md5("token"), 6) % dim).cast("int").alias("bucket")
    common, rare = _common_and_rare(terms.select("token", "idf", bucket), hot_share, max_bytes)
    shared = terms.sparkSession.sparkContext.broadcast(common.toArrow())
    encoder = HashedEncoder(dim, rare is not None)
    split = texts.select(F.col(id_col).cast("bigint").alias("id"), tokens(text_col, mode).alias("words"))
    encoded = split.mapInArrow(lambda batches: encoder(batches, shared.value), ENCODED_SCHEMA)
    if rare is None:
        return encoded.select("id", "embedding")

    # Rows that carry a vector match no word; their key spreads them by id.
    key = F.coalesce("token", F.concat(F.lit(" "), F.col("id").cast("string")))
    found = encoded.withColumn("_key", key).join(rare.withColumnRenamed("token", "_key"), "_key", "left")
    addend = F.when(F.col("idf").isNotNull(), F.struct("bucket", ((1 + F.log("tf")) * F.col("idf")).alias("weight")))
    # One group holds the rare words of one text.
    gathered = found.groupBy("id").agg(
        F.first("embedding", ignorenulls=True).alias("sums"), F.collect_list(addend).alias("addends")
    )
    vector = F.transform(
        "sums",
        lambda v, i: v
        + F.aggregate(F.filter("addends", lambda a: a["bucket"] == i), F.lit(0.0), lambda acc, a: acc + a["weight"]),
    )
    return gathered.select("id", vector.alias("embedding"))


def encode_with_model(
    texts: DataFrame,
    make_predict_fn: Callable,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_size: int = 256,
) -> DataFrame:
    """Vectors from the caller's model, in Arrow batches; the model is loaded once a Python worker."""
    model = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return texts.select(F.col(id_col).alias("id"), model(F.col(text_col)).alias("embedding"))
