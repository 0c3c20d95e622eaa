"""Thresholds from a bootstrap null distribution: pairs of windows drawn from a stream without drift.

Each replicate shuffles the values by a hash and takes the first and the second
``size`` of them; rows whose hash is far beyond the first 2 x size are dropped before
the shuffle, so a replicate moves a few windows' worth of rows however long the
stream is.  With fewer values than two windows, both are drawn with replacement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import deviation_of, even, mean_of
from tidewatch.functions.rng import below, draw
from tidewatch.operators import windows

METRICS = ("kl", "js", "wasserstein", "ks_stat")
PERCENTILES = (50, 75, 90, 95, 99)


def replicates(values: DataFrame, times: int, size: int, seed: int = 42) -> DataFrame:
    """Rows (stream: the replicate, idx: 0 or 1, uc) from ``values`` (rid, uc); null confidences are left out."""
    spark = values.sparkSession
    known = values.where("uc is not null")
    n = known.count()
    if not n:
        raise ValueError("no values to calibrate on")
    turns = spark.range(times).select(F.col("id").alias("turn"))
    if n < 2 * size:
        numbered = windows.positions(known.withColumn("stream", F.lit("all")), "rid").select(F.col("pos").alias("_pick"), "uc")
        slots = turns.crossJoin(spark.range(2 * size).select(F.col("id").alias("slot")))
        drawn = slots.withColumn("_pick", below(draw(seed, "bootstrap", F.col("turn"), F.col("slot")), n))
        return drawn.join(numbered, "_pick").select(F.col("turn").alias("stream"), F.expr(f"slot div {size}").alias("idx"), "uc")
    order = draw(seed, "bootstrap", F.col("turn"), F.col("rid"))
    enough = min(1.0, (3 * size + 200) / n)  # 2 x size are among them but for a chance under 1e-9, and then it is an error
    near = known.crossJoin(F.broadcast(turns)).withColumn("_order", order).where(F.col("_order") < enough)  # ``times`` rows
    ranked = near.withColumn("_rn", F.row_number().over(Window.partitionBy("turn").orderBy("_order", "rid"))).where(F.col("_rn") <= 2 * size)
    whole = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("turn")))
    checked = F.when(F.col("_n") == 2 * size, F.expr(f"(_rn - 1) div {size}")).otherwise(F.raise_error(F.lit("a replicate has too few rows")).cast("long"))
    return whole.select(F.col("turn").alias("stream"), checked.alias("idx"), "uc")


def null_distribution(values: DataFrame, times: int = 500, size: int = 200, bins: int = 20, seed: int = 42) -> DataFrame:
    """The four metrics of each replicate; bins are of equal width."""
    rows = replicates(values, times, size, seed)
    far = windows.distances(rows).select("stream", "ks_stat", "wasserstein")
    return windows.divergences(windows.histograms(rows, bins)).select("stream", "kl", "js").join(far, "stream").withColumnRenamed("stream", "replicate")


def thresholds(null: DataFrame, false_positive_rate: float = 0.05) -> DataFrame:
    """A row per metric: the quantile at 1 - rate, mean, deviation and percentiles, six places."""
    share = ", ".join([f"{1 - false_positive_rate!r}D", *(f"{p / 100!r}D" for p in PERCENTILES)])
    rows = null.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")).select("x.*")
    got = rows.groupBy("metric").agg(F.expr(f"percentile(v, array({share}))").alias("q"), mean_of(F.col("v")).alias("mean"), deviation_of(F.col("v")).alias("std"))
    names = ["threshold", *(f"p{p}" for p in PERCENTILES)]
    return got.select("metric", *[even(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)], even(F.col("mean"), 6).alias("mean_null"), even(F.col("std"), 6).alias("std_null"))


def document(table: DataFrame, false_positive_rate: float, times: int, size: int, bins: int, n: int) -> DataFrame:
    """One JSON object of the thresholds, as the detector reads them."""
    cells = table.groupBy().pivot("metric", list(METRICS)).agg(F.first(F.struct("threshold", "mean_null", "std_null", *[f"p{p}" for p in PERCENTILES])))
    name = {"kl": ("kl", "kl"), "js": ("js", "js"), "wasserstein": ("wasserstein", "wasserstein"), "ks_stat": ("ks_stat", "ks")}
    fixed = {"target_fpr": F.lit(false_positive_rate), "n_bootstrap": F.lit(times), "window_size": F.lit(size), "bins": F.lit(bins), "binning": F.lit("equal_width"), "n_records_used": F.lit(n)}
    made = [v.alias(k) for k, v in fixed.items()]
    for m, (a, b) in name.items():
        made += [F.col(f"{m}.threshold").alias(f"{a}_threshold_95"), F.col(f"{m}.mean_null").alias(f"{a}_mean_null"), F.col(f"{m}.std_null").alias(f"{a}_std_null")]
        made.append(F.struct(*[F.col(f"{m}.p{p}").alias(str(p)) for p in PERCENTILES]).alias(f"{b}_null_percentiles"))
    made.append(F.lit(false_positive_rate).alias("ks_alpha"))
    return cells.select(F.to_json(F.struct(*made)).alias("value"))


def all_streams(made: dict[str, DataFrame]) -> DataFrame:
    """Streams under each other, by name."""
    return reduce(lambda a, b: a.unionByName(b), made.values())
