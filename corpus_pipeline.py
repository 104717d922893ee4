"""The corpus pipeline: documents are filtered, cleaned of repeats and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanworks.llm import line_dedup, line_labels, near_dedup, packing, quality_model
from spanworks.workdir import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the attention classifier accepts."""
    model = quality_model.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_model.keep_quality(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and are mostly content lines.

    The labeller learns from all documents, as the stage before leaves few bad ones.
    """
    chain = line_labels.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return line_labels.keep_content(docs, chain)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat earlier ones, short ones if equal; documents left without a word go."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", pack),
]

#: SQL cannot express trained models or tokenizers; tests/llm/test_pipeline.py has each stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written before the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
