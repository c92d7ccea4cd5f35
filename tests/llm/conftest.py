import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns that operators also make."""
    long_text = " ".join(f"word{i % 977} the of" for i in range(40_000))
    rows = [
        (1, "The cat sat on the mat, said Ann.", "en", "a", 33),
        (2, "The cat sat on the mat, said Ann.", "en", "a", 33),
        (2, "The cat sat on the mat, said Ann.", "en", "a", 33),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, " \t\n ", "de", None, 4),
        (6, long_text, "en", "b", len(long_text)),
        (7, "Der Hund und die Katze schlafen nicht.", "de", "b", 38),
        (None, "A row without an id", "en", "a", 19),
        (8, "12345 67 !!", "en", "a", 11),
        (9, "x", "fr", "ü", 1),
        (10, "ÄÖÜ straße 漢字 𝒳 e\u0301 <|endoftext|>  two  spaces ", "de", "ü", 40),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.selectExpr("*", "1 AS score", "'x' AS size", "2 AS taken", "3 AS copies", "4 AS node", "5 AS fp", "6 AS length", "7 AS rule")
