"""How sure a difference between two runs over the same questions is: paired bootstrap, exact test, leave-one-out effects."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within, materialize
from passageway.functions.text import hex_number
from passageway.functions.vectors import PLACES
from passageway.operators.evaluate import confusion, f1_score

#: Replicates whose weights come from one digest of 32 hex digits, six digits each.
PER_DIGEST = 5
_DIGITS = 6


def poisson_edges(digits: int = _DIGITS) -> list[int]:
    """Where the distribution of a Poisson number of mean 1 steps up, among the numbers of so many hex digits."""
    total, term, edges = 0.0, math.exp(-1), []
    for k in range(1, 40):
        total += term
        term /= k
        edge = math.floor(total * 16**digits)
        if edge >= 16**digits - 1:
            break
        edges.append(edge)
    return edges


def poisson_weight(number: Column) -> Column:
    """How often a row is drawn: a Poisson number of mean 1 from a hash of six hex digits."""
    return F.size(F.filter(F.array(*map(F.lit, poisson_edges())), lambda edge: edge <= number))


def _right(side: str) -> Column:
    return F.when(F.col("in_corpus"), F.col(f"{side}.correct")).otherwise(F.col(f"{side}.refused"))


def pair_verdicts(final: DataFrame, pairs: DataFrame) -> DataFrame:
    """(config_a, config_b, qid, in_corpus, a, b): both verdicts (refused, correct) of every question that both sides have.

    ``final`` has one verdict per (config_id, qid); ``pairs`` (config_a, config_b) is a short list.
    """
    pairs = broadcast_within(pairs)
    verdict = F.struct("refused", "correct")
    a = final.join(pairs, final["config_id"] == pairs["config_a"]).select("config_a", "config_b", "qid", "in_corpus", verdict.alias("a"))
    b = final.join(pairs, final["config_id"] == pairs["config_b"]).select("config_a", "config_b", "qid", "in_corpus", verdict.alias("b"))
    return a.join(b, ["config_a", "config_b", "qid", "in_corpus"])


def paired_bootstrap(paired: DataFrame, replicates: int = 200, seed: str = "0", level: float = 0.95) -> DataFrame:
    """(config_a, config_b, metric, n, delta, low, high, n_replicates) for ``f1`` and ``total_rate``, b less a.

    Every question weighs a Poisson number of mean 1 in every replicate, from a hash of the seed, the question and the
    replicate, and the same on both sides: results can be repeated on any engine and any partitioning. One pass; a task
    hands on a row of sums per pair and five replicates. The interval is that of the ranked differences; replicates in
    which a metric is not defined (no question drawn that counts) are left out and not counted in ``n_replicates``.
    """
    groups = -(-replicates // PER_DIGEST)
    positive = ~F.col("in_corpus")
    parts = {"n": F.lit(1), "right_a": _right("a").cast("int"), "right_b": _right("b").cast("int")}
    for s in "ab":
        refused = F.col(f"{s}.refused")
        parts |= {f"tp_{s}": (positive & refused).cast("int"), f"fp_{s}": (~positive & refused).cast("int"), f"fn_{s}": (positive & ~refused).cast("int")}
    keys = ["config_a", "config_b"]
    rows = paired.select(*keys, "qid", *[F.coalesce(c, F.lit(0)).alias(name) for name, c in parts.items()])
    drawn = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("qid").cast("string"), F.col("group").cast("string")))
    drawn = drawn.withColumn("_digest", digest)
    for j in range(PER_DIGEST):
        number = hex_number(F.substring("_digest", j * _DIGITS + 1, _DIGITS), _DIGITS)
        drawn = drawn.withColumn(f"_w{j}", poisson_weight(number))
    sums = [F.sum(F.col(f"_w{j}") * F.col(p)).alias(f"{p}_{j}") for j in range(PER_DIGEST) for p in parts]
    summed = drawn.groupBy(*keys, "group").agg(*sums)
    structs = [F.struct((F.col("group") * PER_DIGEST + j).alias("replicate"), *[F.col(f"{p}_{j}").alias(p) for p in parts]) for j in range(PER_DIGEST)]
    by_replicate = summed.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.*").filter(F.col("replicate") < replicates)

    def deltas(df: DataFrame) -> DataFrame:
        f1 = f1_score("tp_b", "fp_b", "fn_b") - f1_score("tp_a", "fp_a", "fn_a")
        rate = F.try_divide("right_b", "n") - F.try_divide("right_a", "n")
        both = F.array(F.struct(F.lit("f1").alias("metric"), f1.alias("delta")), F.struct(F.lit("total_rate").alias("metric"), rate.alias("delta")))
        kept = [c for c in ("n",) if c in df.columns]
        return df.select(*keys, *kept, F.explode(both).alias("m")).select(*keys, *kept, "m.metric", F.round("m.delta", PLACES).alias("delta"))

    whole = deltas(rows.groupBy(*keys).agg(*[F.sum(p).cast("bigint").alias(p) for p in parts]))
    # One array of ``replicates`` numbers per pair and metric.
    spread = deltas(by_replicate).drop("n").groupBy(*keys, "metric").agg(F.array_sort(F.collect_list("delta")).alias("all"))
    m = F.size("all")
    cut = F.greatest(F.ceil(F.round(m * F.lit((1 - level) / 2), 9)), F.lit(1)).cast("int")
    ends = spread.select(*keys, "metric", F.try_element_at("all", cut).alias("low"), F.try_element_at("all", F.greatest(m + 1 - cut, F.lit(1))).alias("high"), m.alias("n_replicates"))
    return whole.join(ends, [*keys, "metric"], "left").select(*keys, "metric", "n", "delta", "low", "high", F.coalesce("n_replicates", F.lit(0)).alias("n_replicates"))


def exact_tail(only_a: int, only_b: int) -> float:
    """Two-sided exact probability of so uneven a split of the questions that only one side has right, if both are alike."""
    n, m = only_a + only_b, min(only_a, only_b)
    if 2 * m >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) - n * math.log(2)
    total, term, i = 0.0, 1.0, m
    while i >= 0 and term > 1e-18:  # each term is less than the one before
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * math.exp(log + math.log(total)))


def _tail(only_a: str, only_b: str) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([exact_tail(int(x), int(y)) for x, y in zip(a, b)], dtype=np.float64)

    return tail(only_a, only_b)  # one row per pair of runs or variant


def mcnemar(paired: DataFrame) -> DataFrame:
    """(config_a, config_b, n, only_a, only_b, p): the exact McNemar test on right answers; a null verdict is not right."""
    a, b = (F.coalesce(_right(s), F.lit(False)) for s in "ab")
    counts = paired.groupBy("config_a", "config_b").agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    return counts.withColumn("p", _tail("only_a", "only_b"))


def ablation_effects(verdicts: DataFrame) -> DataFrame:
    """What leaving a sentence out does: per (template_id, variant) its matrix, and its effect against the whole template.

    ``verdicts`` has (template_id, variant, qid, in_corpus, refused), one row per question and variant; variant 0 is the
    whole. Adds ``delta_f1``, and over the questions that both have: ``n_paired``, ``gained`` (wrong before, right
    without the sentence), ``lost`` and the exact ``p`` of that split. Variants of a template without a variant 0 have a
    null difference and no pairs.
    """
    keys = ["template_id", "variant"]
    verdicts = materialize(verdicts.select(*keys, "qid", "in_corpus", "refused"))
    scored = confusion(verdicts, keys)
    base = scored.filter("variant = 0").select("template_id", F.col("f1").alias("_f1"))
    right = F.coalesce(F.col("refused") != F.col("in_corpus"), F.lit(False))
    marked = verdicts.select(*keys, "qid", right.alias("right"))
    whole = marked.filter("variant = 0").select("template_id", "qid", F.col("right").alias("_was"))
    moved = marked.join(whole, ["template_id", "qid"]).groupBy(*keys).agg(
        F.count("*").alias("n_paired"), F.count_if(~F.col("_was") & F.col("right")).alias("gained"), F.count_if(F.col("_was") & ~F.col("right")).alias("lost")
    )
    none = F.lit(0).cast("bigint")
    joined = scored.join(base, "template_id", "left").join(moved, keys, "left")
    joined = joined.withColumns({c: F.coalesce(c, none) for c in ("n_paired", "gained", "lost")})
    return joined.withColumn("delta_f1", F.col("f1") - F.col("_f1")).withColumn("p", _tail("lost", "gained")).drop("_f1")
