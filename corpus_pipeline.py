"""The corpus pipeline: filter, deduplicate, mix and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; other columns are dropped, also such as are named
like columns that operators make.

Texts are judged whole, however long. Toxicity: null texts count as empty ones and equal texts have equal scores.
Language: documents whose text is null or without a letter go. Near duplicates: repeated rows and equal texts leave one
row, rows without an id take part like any other, and of a group without ids one row stays as well. Mix: documents
without a source are one source; repeated rows are documents of their own. Pack: every row is packed, copies too; null
and empty texts are the end token alone. Empty tables give no rows at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.llm import langid, mixing, packing, toxicity, verified
from passageway.llm.common import fold, table, word_count, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose language is less sure than this is rejected; four languages guessed at random would have as much.
LEAST_SURE = 0.25
#: Near duplicates share this much of their shingles of five words.
SHINGLE, SIMILARITY = 5, 0.8


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay. The classifier learns from the labels of documents outside the test fold."""
    labelled = toxicity.labelled_texts(docs.filter(fold("doc_id") != 0), table(spark, sf_dir, "labels"))
    return _columns(toxicity.score_toxicity(docs, toxicity.train(labelled), out="_score").filter("_score < 0.5"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is recognised stay, under the language they are labelled with."""
    model = langid.train(langid.training_texts(docs.filter(fold("doc_id") != 0)))
    found = langid.identify(docs, model)
    return _columns(found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SURE)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return _columns(verified.one_of_each_verified(docs, words=SHINGLE, similarity=SIMILARITY))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes is a row."""
    sized = docs.withColumn("_size", word_count("text"))
    return _columns(mixing.take_copies(mixing.mix_sources(sized, "_size")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near duplicates", drop_near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Classifiers and tokenizers cannot be expressed in SQL; the tests compare stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
