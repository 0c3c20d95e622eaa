"""Decision rules over window metrics, and what a stream's decisions add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import even

RULES = ("KL_only", "KS_only", "KL_AND_KS", "JS_only", "Wasserstein_only", "Ensemble_majority")
# Thresholds in use without calibration.
DEFAULTS = {"kl": 0.05, "kl_critical": 0.15, "alpha": 0.05, "js": 0.03, "wasserstein": 0.05}


def thresholds(over: dict | None = None) -> dict:
    """The defaults with those of ``over`` that are set."""
    return DEFAULTS | {k: v for k, v in (over or {}).items() if k in DEFAULTS and v is not None}


# The names of thresholds in a file; the critical KL is three times the warning one.
FILE_KEYS = {"kl": "kl_threshold_95", "alpha": "ks_alpha", "js": "js_threshold_95", "wasserstein": "wasserstein_threshold_95"}


def overlay(found: dict) -> dict:
    """The defaults with a file's thresholds; the critical KL follows a KL that the file sets."""
    t = thresholds(found)
    return t | ({"kl_critical": 3 * t["kl"]} if found.get("kl") is not None else {})


def votes(t: dict) -> dict[str, Column]:
    return {
        "KL": F.col("kl") >= t["kl"],
        "KS": F.coalesce((F.col("ks_p") < t["alpha"]) & ~F.isnan("ks_p"), F.lit(False)),
        "JS": F.col("js") >= t["js"],
        "W": F.col("wasserstein") >= t["wasserstein"],
    }


def decide(metrics: DataFrame, over: dict | None = None) -> DataFrame:
    """A row per window and rule: drift and severity."""
    t = thresholds(over)
    v = votes(t)
    count = sum((x.cast("int") for x in v.values()), F.lit(0))
    says = {"KL_only": v["KL"], "KS_only": v["KS"], "KL_AND_KS": v["KL"] & v["KS"], "JS_only": v["JS"], "Wasserstein_only": v["W"], "Ensemble_majority": count >= 2}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), says[k].alias("drift")) for k in RULES)))
    out = metrics.withColumn("_d", each).select("*", "_d.rule", "_d.drift").drop("_d")
    return out.withColumn("severity", F.when(~F.col("drift"), "none").when(F.col("kl") >= t["kl_critical"], "critical").otherwise("warning"))


def summarise(decided: DataFrame, drift_point: Column, size: int, step: int) -> DataFrame:
    """Per stream and rule: detection, delay, alarms before and after the drift point, extreme metrics."""
    rows = decided.withColumn("_dp", drift_point)
    got = rows.groupBy("stream", "rule").agg(
        F.bool_or("drift").alias("drift_detected"),
        F.min(F.when(F.col("drift"), F.col("idx") - 1)).alias("first_detection"),
        F.count_if(F.col("severity") == "warning").alias("n_warning"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("drift") & (F.col("end") < F.col("_dp"))).alias("false_alarms"),
        F.coalesce(F.bool_or(F.col("drift") & (F.col("start") >= F.col("_dp"))), F.lit(False)).alias("true_detection"),
        F.max(even(F.col("kl"), 6)).alias("max_kl"),
        F.max(even(F.col("js"), 6)).alias("max_js"),
        F.max(even(F.col("wasserstein"), 6)).alias("max_wasserstein"),
        F.coalesce(F.min(F.when(~F.isnan("ks_p"), even(F.col("ks_p"), 6))), F.lit(1.0)).alias("min_ks_p"),
        F.count(F.lit(1)).alias("n_windows"),
        F.max("_dp").alias("_dp"),
    )
    due = F.greatest(F.lit(0), F.floor((F.col("_dp") - size) / step))
    return got.withColumn("detection_delay", F.col("first_detection") - due).drop("_dp")


def best_per_stream(summary: DataFrame) -> DataFrame:
    """One row per stream: with detections after the point first, then least delay, then fewest false alarms, then rule order."""
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    key = F.struct((~F.col("true_detection")).cast("int"), F.coalesce(F.col("detection_delay"), F.lit(2**31)), F.col("false_alarms"), order)
    return summary.groupBy("stream").agg(F.min_by(F.struct("rule", "detection_delay", "false_alarms", "true_detection"), key).alias("b")).select("stream", "b.*")
