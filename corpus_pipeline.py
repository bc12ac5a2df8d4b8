"""A corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import materialize, table
from waymark.llm.importance import fit_importance, keep_sampled
from waymark.llm.mixing import apply_mix
from waymark.llm.neardup import keep_first
from waymark.llm.packing import pack
from waymark.llm.quality_rules import fit_quality_rules, keep_good
from waymark.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit_quality_rules(docs, table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_sampled(docs, fit_importance(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Forests, sampled weights and token ids are beyond SQL. Near-dedup, mixing, packing and the classifier's models have brute-force
#: tests of their own; the pipeline as a whole is tested for columns, counts and what its stages reject.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
