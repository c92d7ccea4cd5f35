"""Filter interaction audit: survival words of documents, added up by carry-save positional popcounts.

A document that fails some of the filters survives every subset of filters that holds none of those. Its survival word
has one bit per subset. How many documents survive each subset follows from adding the words bit by bit, and every order
in which the filters may be applied is read off those counts: no order is ever run over the documents.
"""

from __future__ import annotations

import hashlib
import re
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within
from passageway.llm.common import written

FILTERS = "ABCDE"
#: Words of 32 bits hold the subsets of five filters.
SUBSETS = 1 << len(FILTERS)
COPY = FILTERS.index("E")
_CAPITAL = bytes(range(ord("A"), ord("Z") + 1))
_SIGN = re.compile(rb"[#$%&*|]")
#: Keys (part, labels) that a task counts before it hands its counts on.
_KEYS = 4096


def survival_words() -> np.ndarray:
    """The survival word of every set of failed filters: bit s is set if subset s holds none of them."""
    subsets, failed = np.arange(SUBSETS), np.arange(SUBSETS)[:, None]
    return ((subsets & failed) == 0).astype(np.uint64) @ (np.uint64(1) << subsets.astype(np.uint64)).astype(np.uint64)


WORDS = survival_words().astype(np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """For each of 32 bits, the number of words in which it is set.

    Full adders turn three words of one weight into a sum word and a carry word of twice the weight, in all 32 positions
    at once, until at most two words of each weight are left; only those are taken apart.
    """
    counts, weight = np.zeros(SUBSETS, dtype=np.int64), 1
    level = words.astype(np.uint32)
    bits = np.arange(SUBSETS, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, level[3 * third :]])
        counts += weight * ((level[:, None] >> bits) & 1).sum(axis=0, dtype=np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def failed_by_text(text: bytes, code_points: int) -> int:
    """The failed filters that the text alone decides, one bit each (A lowest).

    A: under 200 words; B: less than half of the words are different; C: more than one character in fifty is a
    capital A-Z; D: holds one of ``#$%&*|``.
    """
    words = text.split()  # bytes are split at space and the control characters 9 to 13
    capitals = len(text) - len(text.translate(None, _CAPITAL))
    failed = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * code_points, bool(_SIGN.search(text)))
    return sum(1 << i for i, x in enumerate(failed) if x)


def failed_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, failed): a bit for each failed filter of every document.

    E is failed by a document whose text is that of one with a smaller key, wherever that is. Texts are compared by 128
    bits of a digest. Their smallest keys are found with sums on the map side, so a group of copies of any size sends a
    row per task; only texts that occur twice go back to the documents, by broadcast if they are few and else by a join
    whose hot partitions AQE splits.

    A null text is the empty text, a null part the part ''. Rows without a key never fail E (no key is smaller), and nor
    do repeated rows of the smallest key.
    """
    kind = docs.schema[key].dataType

    def judged(batches):
        for batch in batches:
            points = pc.utf8_length(batch.column(2)).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            digests, failed = [], []
            for i, n in enumerate(points):
                content = texts[i].as_py()
                digests.append(hashlib.blake2b(content, digest_size=16).digest())
                failed.append(failed_by_text(content, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())], names=["key", "part", "digest", "failed"]
            )

    empty = F.lit("")
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), empty).alias("part"), F.coalesce(F.col(text).cast("string"), empty).alias("text")
    )
    rows = written(rows.mapInArrow(judged, f"key {kind.simpleString()}, part string, digest binary, failed int"), "failed")
    first = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copy = F.when(F.col("key") > F.col("first"), F.lit(1 << COPY)).otherwise(F.lit(0))
    return rows.join(broadcast_within(written(first, "first")), "digest", "left").select("key", "part", F.col("failed").bitwiseOR(copy).alias("failed"))


def label_marks(labels: DataFrame, key: str = "doc_id", marks: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """(key, one Boolean per mark): whether any label of the key is 1; keys without a 1 and null keys are left out."""
    one = [F.max(F.coalesce(F.col(m) == 1, F.lit(False))).alias(f"mark{i}") for i, m in enumerate(marks)]
    found = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*one)
    return found.filter(" OR ".join(f"mark{i}" for i in range(len(marks))))


def subset_survivors(failed: DataFrame, marks: DataFrame, n_marks: int = 2) -> DataFrame:
    """(part, survivors, survivors0, survivors1, ...): arrays by subset of the number of documents that survive it, of all
    documents and of those with each mark. Each task turns its documents into survival words and adds them up."""

    def added(batches):
        held: dict[tuple, np.ndarray] = {}

        def flushed():
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32())]
            counts = np.array([held[k] for k in keys], dtype=np.int64).reshape(-1, SUBSETS)
            names = ["part", "marks", *(f"n{i}" for i in range(SUBSETS))]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[:, i]) for i in range(SUBSETS))], names=names)

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            names = parts.dictionary.to_pylist()
            group = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) << n_marks | batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            words = WORDS[batch.column(2).to_numpy(zero_copy_only=False)][order]
            found, start = np.unique(group[order], return_index=True)
            for g, a, b in zip(found.tolist(), start, [*start[1:], len(words)]):
                key = names[g >> n_marks], g & ((1 << n_marks) - 1)
                held[key] = held.get(key, 0) + positional_popcount(words[a:b])
            if len(held) >= _KEYS:
                yield flushed()
        if held:
            yield flushed()

    mark = F.lit(0)
    for i in range(n_marks):
        mark = mark + F.when(F.col(f"mark{i}"), F.lit(1 << i)).otherwise(F.lit(0))
    rows = failed.join(broadcast_within(written(marks, "marks")), "key", "left").select("part", mark.cast("int").alias("marks"), "failed")
    columns = [f"n{i}" for i in range(SUBSETS)]
    counts = rows.mapInArrow(added, "part string, marks int, " + ", ".join(f"{c} bigint" for c in columns))
    sums = [F.sum(c).alias(c) for c in columns]
    for i in range(n_marks):
        has = F.col("marks").bitwiseAND(F.lit(1 << i)) != 0
        sums += [F.sum(F.when(has, F.col(c)).otherwise(F.lit(0))).alias(f"m{i}{c}") for c in columns]
    named = [F.array(*(f"m{i}{c}" for c in columns)).alias(f"survivors{i}") for i in range(n_marks)]
    return counts.groupBy("part").agg(*sums).select("part", F.array(*columns).alias("survivors"), *named)


def _shapley(letter: int) -> Column:
    """Documents that a filter removes, summed over all orders: a subset stands before it in |s|! * (n - 1 - |s|)! orders."""
    n, bit, total = len(FILTERS), 1 << letter, F.lit(0)
    for s in range(SUBSETS):
        if not s & bit:
            size = s.bit_count()
            total = total + factorial(size) * factorial(n - 1 - size) * (F.col("survivors")[s] - F.col("survivors")[s | bit])
    return total


def audit_orders(survivors: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step of it, zeros included, from the counts of ``subset_survivors``.

    Parts come from the documents: an empty table has none and gives no rows.
    """
    orders = [""]
    for _ in FILTERS:
        orders = [o + x for o in orders for x in FILTERS if x not in o]
    rows = (
        survivors.withColumn("by_filter", F.array(*(_shapley(i) for i in range(len(FILTERS)))))
        .withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    before, letter = F.lit(0), F.lit(0)
    for i, x in enumerate(FILTERS):
        place = F.instr("filter_order", F.lit(x))
        before = before + F.when(place < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0))
        letter = letter + F.when(place == F.col("step"), F.lit(i)).otherwise(F.lit(0))
    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.col("_letter") + 1)
    rows = rows.withColumns({"_before": before, "_letter": letter}).withColumn("_bit", bit)
    after, rest = F.col("_before").bitwiseOR(F.col("_bit")), F.lit(SUBSETS - 1).bitwiseXOR(F.col("_bit"))
    lost = lambda counts: F.get(counts, F.col("_before")) - F.get(counts, after)
    failing = F.get("survivors", F.lit(0)) - F.get("survivors", F.col("_bit"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("survivors", after).alias("kept"),
        lost("survivors").alias("removed"),
        (failing - lost("survivors")).alias("redundant"),
        (F.get("survivors", rest) - F.get("survivors", F.lit(SUBSETS - 1))).alias("unique_fails"),
        lost("survivors0").alias("good_lost"),
        lost("survivors1").alias("toxic_lost"),
        F.get("by_filter", F.col("_letter")).cast("bigint").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How the five filters interact on (doc_id, text, source), with labels (doc_id, quality, toxic).

    Per part (source; null: ''), order and step: kept, removed, redundant (fail the step's filter, removed before),
    unique_fails (fail this filter only), good_lost and toxic_lost (removed here, labelled 1), shapley (removed by the
    filter, summed over all orders). Texts are judged whole, however long; other columns of ``docs`` are not touched.
    A document that is repeated counts as often as it is there; labels of one key that differ count as 1 if one is 1.
    """
    # One row per part is written, so that the report is planned over plain columns.
    return audit_orders(written(subset_survivors(failed_filters(docs), label_marks(labels)), "survivors"))
