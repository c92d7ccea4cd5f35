"""One query per operator of this subpackage, over whole tables, with the parameters used in production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.functions.bounds import scratch_path
from passageway.llm import bpe, fingerprints, langid, lmscore, mixing, packing, pivots, simhash, survival, toxicity, urlfilter, variants, warc
from passageway.llm.common import fold, table, word_count, written


def op1_score_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", (fold("doc_id") == 0).alias("held_out"))
    model = toxicity.train(toxicity.labelled_texts(docs.filter("NOT held_out"), table(spark, sf, "labels")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_identify_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", (fold("doc_id") == 0).alias("held_out"))
    model = langid.train(langid.training_texts(docs.filter("NOT held_out")))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op3_score_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", (fold("doc_id") == 1).alias("held_out"))
    return lmscore.score_texts(docs)


def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", word_count("text").alias("size"))
    mixed = mixing.mix_sources(written(docs, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_judge_urls(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.sql(
        "SELECT * FROM VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), "
        "('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, action)"
    )
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_pack_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048)


def op5_resolve_revisits(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf, "pages"), scratch_path(spark, "archives"))
    page = lambda c: warc.record_key(c).cast("bigint")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def op6_fingerprint_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf, "documents"))


def op7_simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf, "embeddings"), cosine=0.95)


def op11_encode_documents(spark: SparkSession, sf: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    encoded = table(spark, sf, "documents").select("doc_id", bpe.encode("text", *file).alias("ids"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        bpe.ids_digest("ids").alias("ids_sha256"),
        F.sha2(bpe.decode("ids", *file), 256).alias("decoded_sha256"),
    )


def op12_audit_filters(spark: SparkSession, sf: str) -> DataFrame:
    return survival.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_group_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_score_toxicity, op2_identify_language, op3_score_pitman_yor, op4_mix_sources, op5_resolve_revisits, op6_fingerprint_documents, op7_simhash_components, op8_near_vectors, op9_judge_urls, op10_pack_documents, op11_encode_documents, op12_audit_filters, op13_group_variants)}
