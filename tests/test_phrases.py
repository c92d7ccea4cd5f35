"""Phrase rules against walking through each question word by word."""

import random

from passageway.operators import encode


def brute(question, rules):
    if question is None:
        return None
    words, out, i = question.split(" "), [], 0
    while i < len(words):
        fits = [n for n in range(1, len(words) - i + 1) if " ".join(words[i : i + n]).lower() in rules]
        if fits:
            out.append(rules[" ".join(words[i : i + max(fits)]).lower()])
            i += max(fits)
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def rewritten(spark, questions, rules):
    asked = spark.createDataFrame(list(enumerate(questions)), "qid bigint, question string")
    table = spark.createDataFrame(rules, "term string, replacement string")
    return [r.rewritten for r in encode.rewrite_phrases(asked, encode.phrase_trie(table)).orderBy("qid").collect()]


def test_overlapping_rules(spark):
    rng = random.Random(1)
    questions = [" ".join(rng.choices(["a", "B", "c", "d"], k=rng.randint(0, 12))) for _ in range(150)] + [None, "", "  a  b", "a"]
    rules = {" ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(1, 5))): f"<{i}>" for i in range(25)}
    assert rewritten(spark, questions, list(rules.items())) == [brute(q, rules) for q in questions]


def test_longest_leftmost_and_case(spark):
    rules = [("new york", "NY"), ("new york city", "NYC"), ("york city hall", "no"), ("Hall", "second"), ("hall", "first"), ("gone", None), (None, "x")]
    assert rewritten(spark, ["New York city hall", "york City HALL", "the new york", "gone now"], rules) == ["NYC first", "no", "the NY", " now"]


def test_a_prefix_alone_is_no_rule(spark):
    assert rewritten(spark, ["a b c", "a b d"], [("a b d", "x"), ("b c d e", "y")]) == ["a b c", "x"]
    assert rewritten(spark, ["a b", None], []) == ["a b", None]
