"""Corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs; all but the last return the columns of
``documents``.  As a result is written before the next stage begins, a stage deletes
what the one before it stored on the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, packing, quality, shingles, toxicity
from tidewatch.llm.common import staged, stored, table
from tidewatch.llm.queries import TOXICITY_ROWS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half, by a lexicon fitted on labelled documents."""
    fitted = lambda: toxicity.fit_sample(docs, table(spark, sf_dir, "labels"), F.lit(True), TOXICITY_ROWS)
    return staged(spark, lambda: toxicity.keep_clean(docs, fitted()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's certified rules."""
    return staged(spark, lambda: quality.keep_good(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked by five-word-shingle similarity of 0.8 or more."""
    return staged(spark, lambda: shingles.keep_one(docs, words=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return staged(spark, lambda: decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids of what is left."""
    return staged(spark, lambda: packing.pack(docs, 2048), last=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: fitting, shingle sets and tokenizing can't be expressed in it; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
