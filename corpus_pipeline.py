"""A corpus pipeline of five of the operators: toxicity, quality, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstar.llm import common, decontamination, neardup, packing, quality_fm, toxicity_mil
from loomstar.llm.queries import QUALITY_METADATA, THRESHOLD


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over the threshold go. Trained on the labelled documents outside the held-out fold."""
    model = toxicity_mil.fit(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 4) != 2)
    return toxicity_mil.keep_harmless(docs, model, THRESHOLD)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold go."""
    model = quality_fm.fit(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 5) != 0, metadata=QUALITY_METADATA)
    return quality_fm.keep_good(docs, model, QUALITY_METADATA, THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; shingles of five words."""
    return neardup.keep_one(docs, size=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("packing", pack)]

#: Trained classifiers and sketches have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
