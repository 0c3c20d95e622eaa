"""Scoring of texts by a pluggable model: pending rows, batches with a fallback, a second pass, result rows.

A scorer takes a list of rows (dicts with id, prompt and whatever else) and gives a list
of dicts with id, raw_output, safe and unsafe probability.  ``mock`` stands for a
model: it needs none and is the same on every run.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import records
from tidewatch.functions.numbers import even
from tidewatch.sources import jsonl, sinks

SCORES = "id string, raw_output string, safe_probability double, unsafe_probability double, error string"


def mock(rows: list[dict]) -> list[dict]:
    """Probabilities from the checksum of the prompt."""
    out = []
    for r in rows:
        unsafe = zlib.crc32(r["prompt"].encode()) / 2**32
        out.append({"id": r["id"], "raw_output": "UNSAFE" if unsafe >= 0.5 else "SAFE", "safe_probability": 1 - unsafe, "unsafe_probability": unsafe})
    return out


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id is not among the ids done before."""
    return rows.join(done.select(F.col("id").cast("string").alias("_done")), F.col("id").cast("string") == F.col("_done"), "left_anti")


def result(safe: Column, unsafe: Column, raw: Column) -> dict[str, Column]:
    """The columns of a scored row: label, probabilities (eight places), confidence and failure."""
    s, u = (even(x, 8) for x in (safe, unsafe))
    top = F.greatest(F.coalesce(safe, F.lit(0.0)), F.coalesce(unsafe, F.lit(0.0)))
    failed = safe.isNull() & unsafe.isNull()
    return {
        "pred_label": records.decode_label(raw), "safe_probability": s, "unsafe_probability": u, "unsafe_confidence": u,
        "pred_confidence": F.when(~failed, even(top, 8)), "raw_output": raw, "prob_extraction_failed": failed,
    }


def score(rows: DataFrame, scorer=mock, size: int = 16) -> DataFrame:
    """Rows (id, text, language, label, source, modality) with the columns of ``result`` and error."""
    asked = rows.select(F.col("id").cast("string").alias("id"), records.prompt(F.coalesce("text", F.lit("")), F.col("language")).alias("prompt"))
    got = jsonl.batched(asked, scorer, SCORES, size)
    out = got.select("id", "error", *[c.alias(k) for k, c in result(F.col("safe_probability"), F.col("unsafe_probability"), F.coalesce("raw_output", F.lit(""))).items()])
    own = rows.select(
        F.col("id").cast("string").alias("id"), F.coalesce("language", F.lit("unknown")).alias("lang"), F.coalesce("modality", F.lit("text")).alias("modality"), "label",
        F.coalesce("source", F.lit("unknown")).alias("source"),
    )
    return own.join(out, "id")


def second_pass(first: DataFrame, again: DataFrame, threshold: float = 0.7) -> DataFrame:
    """First results; those under ``threshold`` that ``again`` (id, label, confidence) has evidence for take its label and confidence."""
    later = again.select("id", F.col("label").alias("_label"), F.col("confidence").alias("_confidence"))
    low = F.coalesce(F.col("confidence") < threshold, F.lit(False)) & F.col("_label").isNotNull()
    return first.join(later, "id", "left").select(
        "id", F.when(low, F.col("_label")).otherwise(F.col("label")).alias("label"), F.when(low, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.col("label").alias("first_pass_label"), low.alias("rag_used"),
    )


def top_evidence(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` nearest pieces of evidence of each id, of rows (id, evidence, score); equal scores go by evidence."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "evidence"))), 1, k)
    # a bounded heap per task before the shuffle: only the k best of each id and task travel
    return pairs.groupBy("id", F.spark_partition_id().alias("_task")).agg(best.alias("b")).select("id", F.inline("b")).select("id", "evidence", (-F.col("far")).alias("score")).groupBy("id").agg(
        best.alias("b")
    ).select("id", F.posexplode("b").alias("rank", "b")).select("id", F.col("rank"), "b.evidence", (-F.col("b.far")).alias("score"))


def run(rows: DataFrame, path: str, scorer=mock, size: int = 16) -> DataFrame:
    """Score what ``path`` doesn't hold yet, append it there, and return all of it."""
    spark = rows.sparkSession
    done = jsonl.completed_ids(spark, path)
    scored = score(pending(rows, done), scorer, size)
    sinks.append_lines(scored, path)
    return spark.read.schema(scored.schema).json(path)
