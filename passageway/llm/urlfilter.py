"""URL filters: pattern rules are found by their rarest literal token, and only those found are matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageway.functions.bounds import broadcast_within

def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Host labels and complete path segments; a mark tells them apart."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def _rule_tokens(host: Column, path: Column) -> Column:
    """Tokens that every url matching the rule has: all labels, and the segments that end within the rule."""
    parts = F.split(path, "/")
    return _tokens(host, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "/"))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9_/\-])", r"\\$1")


def index_rules(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each rule under its rarest token: (token, rule, pattern, action). ``frequency``: token, n."""
    rules = rules.select(
        F.concat("host", "path").alias("rule"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(F.col("host")), F.lit("(?=/|$)"), _quoted(F.col("path"))).alias("pattern"),
        "action",
        F.explode(_rule_tokens(F.col("host"), F.col("path"))).alias("token"),
    )
    counted = rules.join(frequency, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.groupBy("rule", "pattern", "action").agg(F.min(F.struct("n", "token"))["token"].alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the longest that fits, or null) and verdict (its action, or ``default``).

    A rule (host, path, action) fits its host and all subdomains if the url's path starts with the rule's path. It is
    turned into a pattern and stored under its rarest token: a host label or a complete path segment, counted over
    all different (host, path) of the urls. The tokens of a url fetch the rules stored under them, and only those
    patterns are run. Of several rules that fit, the longest text wins, then the last in order of text, then
    ``block`` before ``allow``; the host of a rule must not be empty. Urls are judged once per different (host, path). A null url, or one without ``://``,
    has empty host and path; an empty table gives no rows; repeated rows each get a row. Columns of the input are
    kept, columns named like the added ones are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    places = pages.select("host", "path").distinct()
    tokens = places.withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
    asked = rules.select(F.explode(_rule_tokens(F.col("host"), F.col("path"))).alias("token")).distinct()
    frequency = tokens.select("token").join(broadcast_within(asked), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = index_rules(rules, frequency)
    found = tokens.join(broadcast_within(index), "token").filter(F.expr("rlike(concat(host, path), pattern)"))
    rank = F.struct(F.length("rule").alias("a"), F.col("rule").alias("b"), F.col("action").alias("c"))
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select("host", "path", F.col("best.b").alias("rule"), F.col("best.c").alias("verdict"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
