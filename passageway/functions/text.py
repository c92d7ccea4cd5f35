"""Tokens and token hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Anything that is neither a letter nor a digit separates words.
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """Lower-cased words of a text, in order, repeats kept."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def bigrams(text: Column | str) -> Column:
    """Character pairs inside each word (for scripts written without spaces).

    A word of one character stands for itself.
    """
    return F.flatten(
        F.transform(
            words(text),
            lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))),
                    lambda i: w.substr(i, F.lit(2)),
                )
            ),
        )
    )


def tokens(text: Column | str, mode: str = "word") -> Column:
    if mode == "word":
        return words(text)
    if mode == "bigram":
        return bigrams(text)
    raise ValueError(f"mode must be 'word' or 'bigram', not {mode!r}")


def hex_number(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a BIGINT (at most 15 digits fit)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_mod(modulus: int, *parts: Column) -> Column:
    """A reproducible number in [0, modulus) from the parts, alike on every engine with md5."""
    return hex_number(F.md5(F.concat_ws("|", *parts)), 6) % modulus
