"""Stored postings with block maxima: BM25 for batches of questions without scanning the corpus.

Documents are taken in blocks of neighbouring ids. For every token and block the index has one posting row (the
documents of the block that hold the token, and what it adds to their scores before its idf) and one maximum. A question
cannot score more in a block than its tokens' maxima there, so blocks below the k-th score found so far are never read.
Both tables are stored by a hash of the token and sorted by it: of a batch of questions only the directories and row
groups of its tokens are read, and the maxima are read without the postings.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize
from passageway.functions.scan import BEST_SCHEMA, HELD_BYTES, ROW_BYTES, Held, to_batch
from passageway.functions.vectors import PLACES
from passageway.operators.encode import TermStats, query_terms, term_frequencies
from passageway.operators.retrieve import merge_best, rank_top

#: Neighbouring ids in a block, as a power of two.
BLOCK_BITS = 10
#: Directories of tokens.
SHARDS = 64
#: Blocks that are scored first to get a floor for a question.
FIRST = 2
# Rounding of sums must never rule a block out.
_SLACK = 10.0**-PLACES


class Skipping(NamedTuple):
    """``top`` (qid, rank, id, score) and ``blocks`` (block, scored): the blocks that hold a word of some question, and
    whether their postings were read."""

    top: DataFrame
    blocks: DataFrame


def _shard(token: Column | str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SHARDS)).cast("int")


def build_postings(stats: TermStats, out_dir: str, k1: float = 1.2, b: float = 0.75) -> None:
    """Store an index of all words of ``stats`` (counted without ``only``), replacing what was there.

    A group holds the documents of one block that have one token: a token found everywhere is as many groups as there
    are blocks, and none is large.
    """
    average = stats.corpus.select(F.try_divide("total_len", "n_docs")).first()
    mean = float((average and average[0]) or 1.0)
    tf = F.col("tf")
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.lit(mean)))
    found = term_frequencies(stats).select("token", F.shiftright("id", BLOCK_BITS).alias("block"), "id", impact.alias("impact"))
    rows = found.groupBy("token", "block").agg(F.array_sort(F.collect_list(F.struct("id", "impact"))).alias("held"), F.max("impact").alias("top"))
    rows = rows.select("token", "block", "top", F.col("held.id").alias("ids"), F.col("held.impact").alias("impacts"), _shard("token").alias("shard"))
    stored = rows.hint("rebalance", "shard").sortWithinPartitions("shard", "token", "block")
    stored.write.mode("overwrite").partitionBy("shard").parquet(f"{out_dir}/postings")
    words = stats.terms.select("token", "idf", _shard("token").alias("shard"))
    words.hint("rebalance", "shard").sortWithinPartitions("shard", "token").write.mode("overwrite").partitionBy("shard").parquet(f"{out_dir}/terms")


_POSTINGS = "token string, block bigint, top double, ids array<bigint>, impacts array<double>, shard int"


def _of(spark: SparkSession, out_dir: str, name: str, schema: str, tokens: DataFrame) -> DataFrame:
    """The rows of some tokens (token, shard): their directories by a literal list, and the tokens by a semi join."""
    shards = [r.shard for r in tokens.select("shard").distinct().collect()]  # SHARDS at most
    stored = spark.read.schema(schema).parquet(f"{out_dir}/{name}").filter(F.col("shard").isin(shards))
    return stored.join(broadcast_within(tokens.select("token")), "token", "left_semi")


class _Asked:
    """The words of a batch of questions: for each token the questions that have it, with its idf."""

    def __init__(self, asked: pa.Table):
        asked = asked.combine_chunks()
        self.qids, question = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
        tokens = asked.column("token").to_pylist()
        self.place = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        token = np.array([self.place[t] for t in tokens], dtype=np.int64)
        order = np.argsort(token, kind="stable")
        self.question, self.idf = question[order], asked.column("idf").to_numpy()[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(self.place)))])
        self.floor = np.full(len(self.qids), -np.inf)

    def uses(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        i = self.place[token]
        at = slice(self.first[i], self.first[i + 1])
        return self.question[at], self.idf[at]

    def ceilings(self, tokens: list[str], tops: np.ndarray) -> np.ndarray:
        """The most that each question can score in a block with these tokens and maxima."""
        out = np.zeros(len(self.qids))
        for token, top in zip(tokens, tops):
            question, idf = self.uses(token)
            out[question] += idf * top
        return out


def _blocks(batches, columns: list[str]):
    """(block, table) of rows sorted by block, a block at a time."""
    held = []
    for batch in batches:
        rows = pa.Table.from_batches([batch]).select(columns)
        block = rows.column("block").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield held[0].column("block")[0].as_py(), pa.concat_tables(held)
                held = []
            held.append(rows.slice(a, b - a))
    if held:
        yield held[0].column("block")[0].as_py(), pa.concat_tables(held)


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "token")


def _scored(rows: DataFrame, sent, k: int) -> DataFrame:
    """The best k rows a question of every task, over blocks that come whole."""

    def score(batches):
        asked, floor = sent.value
        held = Held(len(asked.qids), k)
        for _, block in _blocks(batches, ["block", "token", "top", "ids", "impacts"]):
            tokens = block.column("token").to_pylist()
            ceiling = asked.ceilings(tokens, block.column("top").to_numpy())
            open_ = (ceiling > 0) & (ceiling + _SLACK >= np.maximum(floor, held.floor))
            if not open_.any():
                continue
            lists = block.column("ids").combine_chunks()
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            impacts = block.column("impacts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            docs, place = np.unique(ids, return_inverse=True)
            asking = np.flatnonzero(open_)
            row = np.full(len(asked.qids), -1)
            row[asking] = np.arange(len(asking))
            scores = np.zeros((len(asking), len(docs)))
            for i, token in enumerate(tokens):
                at = slice(end[i] - size[i], end[i])
                for question, idf in zip(*asked.uses(token)):
                    if row[question] >= 0:
                        scores[row[question], place[at]] += idf * impacts[at]  # a document is once in a list
            scores = np.round(scores, PLACES)
            q, d = np.nonzero(scores > 0)
            held.add([(asking[q], docs[d], scores[q, d], scores[q, d])])
        if held.rows is not None:
            yield to_batch(held.rows, asked.qids)

    return _by_block(rows).mapInArrow(score, BEST_SCHEMA)


def _searched(spark: SparkSession, out_dir: str, asked: DataFrame, k: int) -> Skipping:
    """One batch of questions (qid, token, idf), small enough to be sent to every task."""
    context = spark.sparkContext
    tokens = materialize(asked.select("token", _shard("token").alias("shard")).distinct())
    words = _Asked(asked.toArrow())
    sent = context.broadcast(words)
    # The maxima alone: the lists are not read.
    tops = materialize(_by_block(_of(spark, out_dir, "postings", _POSTINGS, tokens).select("token", "block", "top")))

    def best_blocks(batches):
        asked = sent.value
        held = Held(len(asked.qids), FIRST)
        for block, rows in _blocks(batches, ["block", "token", "top"]):
            ceiling = asked.ceilings(rows.column("token").to_pylist(), rows.column("top").to_numpy())
            q = np.flatnonzero((ceiling > 0) & (ceiling >= held.floor))
            held.add([(q, np.full(len(q), block), ceiling[q], ceiling[q])])
        if held.rows is not None:
            yield to_batch(held.rows, asked.qids)

    promising = rank_top(merge_best(tops.mapInArrow(best_blocks, BEST_SCHEMA), FIRST), FIRST, score_col="coarse")
    first = materialize(promising.select(F.col("id").alias("block")).distinct())
    postings = _of(spark, out_dir, "postings", _POSTINGS, tokens)
    none = np.full(len(words.qids), -np.inf)
    start = _scored(postings.join(broadcast_within(first), "block", "left_semi"), context.broadcast((words, none)), k)
    floors = rank_top(merge_best(start, k), k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    floor = none.copy()
    for r in floors.collect():  # a number for each question of the batch
        if r.floor is not None:
            floor[np.searchsorted(words.qids, r.qid)] = r.floor
    bounded = context.broadcast((words, floor))

    def survivors(batches):
        asked, floor = bounded.value
        blocks, kept = [], []
        for block, rows in _blocks(batches, ["block", "token", "top"]):
            ceiling = asked.ceilings(rows.column("token").to_pylist(), rows.column("top").to_numpy())
            blocks.append(block)
            kept.append(bool(((ceiling > 0) & (ceiling + _SLACK >= floor)).any()))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(kept, pa.bool_())], names=["block", "scored"])

    blocks = materialize(tops.repartition("block").sortWithinPartitions("block", "token").mapInArrow(survivors, "block bigint, scored boolean"))
    wanted = broadcast_within(blocks.filter("scored").select("block"))
    best = _scored(postings.join(wanted, "block", "left_semi"), bounded, k)
    return Skipping(rank_top(merge_best(best, k), k).select("qid", "rank", "id", "score"), blocks)


def postings_topk(spark: SparkSession, out_dir: str, queries: DataFrame, k: int = 8, mode: str = "word", batch_bytes: int = HELD_BYTES) -> Skipping:
    """The k documents of highest BM25 score per question (qid, question), equal to ``bm25_topk`` over the same texts.

    Questions go in batches so small that a task can hold their best rows and a row of scores for each. Questions
    without a known word have no rows; a question counts each of its words once.
    """
    asked = query_terms(queries.select(F.col("qid").cast("bigint").alias("qid"), "question"), mode).withColumn("shard", _shard("token"))
    asked = materialize(asked)
    wanted = materialize(asked.select("token", "shard").distinct())
    terms = _of(spark, out_dir, "terms", "token string, idf double, shard int", wanted)
    asked = materialize(asked.join(terms.select("token", "idf"), "token").select("qid", "token", "idf"))
    n_questions = asked.select("qid").distinct().count()
    # Of each question a task holds k rows, and a score for each document of a block.
    batches = min(n_questions, -(-n_questions * (k * ROW_BYTES + (8 << BLOCK_BITS)) // batch_bytes))
    if not n_questions:
        return Skipping(spark.createDataFrame([], "qid bigint, rank int, id bigint, score double"), spark.createDataFrame([], "block bigint, scored boolean"))
    part = F.pmod(F.xxhash64("qid"), F.lit(batches))
    found = [_searched(spark, out_dir, asked.filter(part == i), k) for i in range(batches)]
    top, blocks = found[0]
    for x in found[1:]:
        top, blocks = top.unionAll(x.top), blocks.unionAll(x.blocks)
    if batches > 1:
        blocks = blocks.groupBy("block").agg(F.max("scored").alias("scored"))
    return Skipping(top, blocks)
