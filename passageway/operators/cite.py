"""Citations ``[资料§N]`` in answers: extract, check against what was supplied, repair.

``answers`` has (config_id, qid, run, answer); ``retrieved`` has (config_id, qid, rank, chunk_no).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = ["config_id", "qid"]
CITATION = r"\[资料§(\d+)\]"
_SEPARATOR = "[、，,]"
# Stands for a removed citation while separators are tidied; where an answer has it, it is written otherwise meanwhile.
_REMOVED, _ESCAPE = "\x01", "\x02"


def cited_texts(answer: Column | str) -> Column:
    """Cited numbers as written but for leading zeros, in order of appearance, repeats kept."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.transform(found, lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))


def citations(answer: Column | str) -> Column:
    """Cited numbers in order of appearance, repeats kept; null for a number beyond BIGINT, which no passage has."""
    return F.transform(cited_texts(answer), lambda n: n.try_cast("bigint"))


def extract_citations(answers: DataFrame) -> DataFrame:
    return answers.withColumn("citations", citations("answer"))


def supplied_ids(retrieved: DataFrame, k: int = 8) -> DataFrame:
    """The passages given to the model, (config_id, qid, ids); at most k a group."""
    return (
        retrieved.filter(F.col("rank") <= k)
        .groupBy(*_KEY)
        .agg(F.array_sort(F.collect_set(F.col("chunk_no").cast("bigint"))).alias("ids"))
    )


def _with_supplied(answers: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    joined = answers.join(supplied_ids(retrieved, k), _KEY, "left")
    return joined.withColumn("ids", F.coalesce("ids", empty))


def illegal_citations(answers: DataFrame, retrieved: DataFrame, k: int = 8) -> DataFrame:
    """Adds ``illegal`` (numbers outside the supplied passages, by place, as text of any length) and ``n_illegal``."""
    ids = F.transform("ids", lambda n: n.cast("string"))
    illegal = F.filter(cited_texts("answer"), lambda n: ~F.array_contains(ids, n))
    return (
        _with_supplied(answers, retrieved, k)
        .withColumn("illegal", illegal)
        .withColumn("n_illegal", F.size("illegal"))
        .drop("ids")
    )


def enforce_whitelist(answers: DataFrame, retrieved: DataFrame, k: int = 8) -> DataFrame:
    """Delete every citation outside the supplied passages, and the separator it leaves dangling.

    A deleted citation takes the separator before it; the first of a row takes the one after it.
    Where deleting would join what stands around into another citation, a space stays in its place.
    """
    allowed = F.array_join(F.transform("ids", lambda n: n.cast("string")), "|")
    outside = F.concat(F.lit(r"\[资料§(?!0*(?:"), allowed, F.lit(r")\])\d+\]"))
    # An empty list must forbid all numbers, not allow the empty one.
    outside = F.when(F.size("ids") == 0, F.lit(r"\[资料§\d+\]")).otherwise(outside)
    escaped = F.replace(F.replace("answer", F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_REMOVED), F.lit(_ESCAPE + "a"))
    marked = F.regexp_replace(escaped, outside, F.lit(_REMOVED))
    tidy = F.regexp_replace(marked, rf"{_SEPARATOR}\s*{_REMOVED}", "")
    tidy = F.regexp_replace(tidy, rf"{_REMOVED}(?:{_SEPARATOR}\s*)?", "")
    legal = F.filter(citations("answer"), lambda n: F.array_contains(F.col("ids"), n))
    return (
        _with_supplied(answers, retrieved, k)
        .select("*", marked.alias("_marked"), tidy.alias("_tidy"), legal.alias("_legal"))
        .withColumn("answer", F.when(citations("_tidy") == F.col("_legal"), F.col("_tidy")).otherwise(F.replace("_marked", F.lit(_REMOVED), F.lit(" "))))
        .withColumn("answer", F.replace(F.replace("answer", F.lit(_ESCAPE + "a"), F.lit(_REMOVED)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)))
        .drop("ids", "_marked", "_tidy", "_legal")
    )


def apply_retry(answers: DataFrame, retries: DataFrame, flags: DataFrame) -> DataFrame:
    """Second answers replace first ones where flagged: ``flags`` has (config_id, qid, run), one row a flag.

    Adds ``retried``.  A flagged answer without a second one stays.
    """
    key = [*_KEY, "run"]
    flagged = flags.select(*key).distinct().withColumn("_flagged", F.lit(True))
    second = retries.select(*key, F.col("answer").alias("_second"))
    retried = F.col("_flagged").isNotNull() & F.col("_second").isNotNull()
    return (
        answers.join(flagged, key, "left")
        .join(second, key, "left")
        .select(*key, F.when(retried, F.col("_second")).otherwise(F.col("answer")).alias("answer"), retried.alias("retried"))
    )


def dedupe_citations(answers: DataFrame) -> DataFrame:
    """Count repeated citations (``n_repeated``) and collapse adjacent repeats to one."""
    cited = cited_texts("answer")
    collapsed = F.regexp_replace("answer", rf"(\[资料§\d+\])(?:{_SEPARATOR}?\s*\1)+", "$1")
    return answers.withColumn("n_repeated", F.size(cited) - F.size(F.array_distinct(cited))).withColumn("answer", collapsed)


def verdict_flips(before: DataFrame, after: DataFrame, verdict: str = "correct") -> DataFrame:
    """Verdicts changed by a processing step, per configuration and direction.

    ``n_unmatched`` counts verdicts that have none on the other side; a configuration on one side only is listed.
    """
    key = [*_KEY, "run"]
    a = before.select(*key, F.struct(F.col(verdict).alias("v")).alias("a"))
    b = after.select(*key, F.struct(F.col(verdict).alias("v")).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    was, now = F.col("a.v"), F.col("b.v")
    return (
        a.join(b, key, "full_outer")
        .groupBy("config_id")
        .agg(
            F.count_if(both).alias("n_compared"),
            F.count_if(both & ~was & now).alias("n_gained"),
            F.count_if(both & was & ~now).alias("n_lost"),
            F.count_if(both & ~was.eqNullSafe(now)).alias("n_flipped"),
            F.count_if(~both).alias("n_unmatched"),
        )
    )
