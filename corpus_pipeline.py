"""Training-data pipeline over ``documents``: quality rules, toxicity,
near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. ``run`` writes each
stage's rows as Parquet in the shared checkpoint folder and reads them again, so
a lost executor costs tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import table
from codeatlas.llm.mixing import mix
from codeatlas.llm.near_dedup import drop_near
from codeatlas.llm.packing import pack
from codeatlas.llm.quality_rules import keep_good
from codeatlas.llm.toxicity import drop_toxic
from codeatlas.session import cut_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality cascade; rejected ones go."""
    return keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; toxic ones go. Learned from the labels of ``sf_dir``."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to the target weights of their sources, shuffled; the columns
    of ``docs`` alone, whatever their names."""
    # the document travels as one struct, so that a column named like one of the operator's stays as it is
    held = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("document"))
    return mix(held).select(*[F.col("document")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens."""
    return pack(docs)


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

# Learned scores and tokenizers are not SQL: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
