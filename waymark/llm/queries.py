"""The queries of this subpackage: each numbered operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, conversations, importance, licenses, mixing, neardup, packing, pages, quality_rules, simhash, spelling, tokens, url_filters
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.fit_urls(spark))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_quality_rules(docs, table(spark, sf_dir, "labels")))


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so each embedding is rendered as a recording of 64 notes within the task that reads it."""
    prints = audio.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.sonify)
    return audio.align(prints, F.col("id") % 20 == 0)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.fit_licenses())


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return importance.resample(docs, importance.fit_importance(docs, table(spark, sf_dir, "labels")))[0]


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_prints(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_mixing, op3_token_counts, op4_quality_rules, op5_chroma_fingerprints, op6_html_extraction, op7_packing, op8_license_scan, op9_minhash_near_dedup, op10_quality_classifier,
        op11_simhash_near_dedup, op12_spelling_variants, op13_conversation_repair, pipeline,
    )
}
ORACLE_SQL: dict[str, str] = {}
