"""The driver's tables as prediction streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import records
from tidewatch.operators import windows

SIZE = 200


def raw_label():
    """A label as the files spell it, of every kind the normaliser knows."""
    return F.element_at(F.array(*map(F.lit, ("Hate", " safe ", "1", "0", "maybe", "UNSAFE", "toxic"))), (F.col("user_id") % 8 + 1).cast("int"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one stream of predictions, without order."""
    uc = F.least(F.col("value") / F.lit(100.0), F.lit(1.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.lit("events").alias("stream"), "ts", "event_id", uc.alias("uc"), F.col("event_type").alias("source"), "user_id",
        F.element_at(F.array(*map(F.lit, ("en", "ms", "zh", "ta"))), (F.col("user_id") % 4 + 1).cast("int")).alias("language"),
        F.when(uc >= 0.5, "UNSAFE").otherwise("SAFE").alias("predicted"),
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.positions(predictions(spark, sf_dir), "ts", "event_id")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` written as JSON prediction lines with varying field names; every 50th is malformed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.element_at(F.array(*map(F.lit, ("Hate", " safe ", "1", "maybe"))), (F.col("user_id") % 4 + 1).cast("int"))
    number = F.least(F.col("value") / 100.0, F.lit(1.0)).cast("string")
    name = F.element_at(F.array(*map(F.lit, ("unsafe_probability", "safe_probability", "score"))), (F.col("event_id") % 3 + 1).cast("int"))
    line = F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('","pred":"'), label, F.lit('","'), name, F.lit('":'), number, F.lit("}"))
    return e.select("event_id", F.when(F.col("event_id") % 50 == 7, "{bad").otherwise(line).alias("value"))
