"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and is written as Parquet in the
shared folder before the next one reads it, so a lost executor never sets the pipeline back by more than a stage.
All stages but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmart.llm import chosen_path, decontam, packing, pii, quality
from rankmart.llm.common import free_name, read_table, shared_path, stored, temporary
from rankmart.llm.queries import PII_KEY
from rankmart.llm.registry import prepare
from rankmart.sources.files import Store

ORACLE_SQL = None  # tokenizers and min-hash paths have no SQL form; tests/llm holds the brute-force version


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the distribution-divergence rules reject go."""
    prepare(spark)
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id."""
    prepare(spark)
    return chosen_path.keep_one_per_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced; n_chars follows the new text."""
    prepare(spark)
    out = pii.replace_entities(docs, PII_KEY).drop(free_name("pii", docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of at most 4096 ids."""
    prepare(spark)
    out = packing.pack_digests(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, before = read_table(prepare(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        with temporary(spark):  # what a stage wrote on its way goes when its output stands, and so does its input
            docs = stored(stage(spark, docs, sf_dir), name, path, keep=True)
        if before is not None:
            Store(spark, before).delete(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
