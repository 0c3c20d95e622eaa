"""Queries of the drift engine by name; their SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import divergence, records
from tidewatch.functions.numbers import even
from tidewatch.operators import audit, decisions, windows

from . import bindings, extended, oracles
from .bindings import SIZE

QUERIES: dict = {**extended.QUERIES}
ORACLE_SQL = {**oracles.SQL, **extended.SQL}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: even(F.col(n), 6) for n in names})


def assigned(spark: SparkSession, sf_dir: str, step: int = SIZE, size: int = SIZE) -> DataFrame:
    return windows.assign(bindings.stream(spark, sf_dir), size, step)


@query
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", records.text_label(F.when(F.col("user_id") % 8 < 7, bindings.raw_label())).alias("label"))


@query
def label_normalise_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    digit = (F.col("user_id") % 3).cast("string")
    return e.select("event_id", records.audit_label(F.when(F.col("user_id") % 2 == 0, F.concat(digit, F.lit(".0"))).otherwise(digit)).alias("label"))


@query
def normalise_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.normalise(bindings.json_lines(spark, sf_dir))
    return rounded(got.select("event_id", "id", "language", "true_label", "predicted", "unsafe_confidence", "confidence_source", "source"), "unsafe_confidence")


@query
def conf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.statistics(bindings.predictions(spark, sf_dir), "uc", "source"), "mean", "std")


@query
def conf_summary_sample_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.statistics(bindings.predictions(spark, sf_dir), "uc", "source", sample=True), "mean", "std")


@query
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distribution(bindings.predictions(spark, sf_dir), "language", "source")


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distribution(bindings.predictions(spark, sf_dir), "predicted")


@query
def constant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bindings.predictions(spark, sf_dir).groupBy("user_id")
    return got.agg(audit.is_constant(F.col("uc")).alias("constant"), audit.is_near_constant(F.col("uc")).alias("near_constant"))


@query
def audit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.warnings(bindings.predictions(spark, sf_dir), "uc", "user_id", "source")


@query
def preflight_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.preflight(bindings.predictions(spark, sf_dir), "uc", "source")


@query
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.summaries(assigned(spark, sf_dir), SIZE)


@query
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.summaries(assigned(spark, sf_dir, SIZE // 2), SIZE)


@query
def hist_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = windows.histograms(assigned(spark, sf_dir), 20)
    return hist.select("stream", "idx", F.posexplode("counts").alias("bin", "n"))


@query
def hist_bin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(divergence.bin_index(F.col("l_quantity").cast("double") / 50, 20).alias("bin"))
    return lines.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _divergences(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(windows.divergences(windows.histograms(assigned(spark, sf_dir), 20), mode), "kl", "js")

    return run


for _mode in ("fixed_first", "rolling", "multi_reference"):
    QUERIES[f"divergence_{_mode}"] = _divergences(_mode)


def _distances(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(windows.distances(assigned(spark, sf_dir), mode), "ks_stat", "wasserstein")

    return run


for _mode in ("fixed_first", "rolling", "multi_reference"):
    QUERIES[f"distance_{_mode}"] = _distances(_mode)


@query
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.metrics(bindings.stream(spark, sf_dir), SIZE)
    return rounded(got.select("stream", "idx", "n", "kl", "js", "ks_stat", "ks_p", "wasserstein"), "kl", "js", "ks_stat", "ks_p", "wasserstein")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decide(windows.metrics(bindings.stream(spark, sf_dir), SIZE))


@query
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("stream", "idx", "rule", "drift", "severity")


@query
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.summarise(decided(spark, sf_dir), F.lit(600), SIZE, SIZE)


@query
def best_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.best_per_stream(report_summary(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_metrics(spark, sf_dir)
