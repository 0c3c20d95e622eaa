"""Audit statistics and gates of prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import deviation_of, mean_of


def statistics(df: DataFrame, value: str, *by: str, sample: bool = False) -> DataFrame:
    """n, least, greatest, mean, deviation and distinct values (6 decimals) of a column."""
    x = F.col(value)
    return df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), mean_of(x).alias("mean"),
        deviation_of(x, sample).alias("std"), F.count_distinct(F.bround(x, 6)).alias("n_unique"),
    )


def distribution(df: DataFrame, field: str, *by: str) -> DataFrame:
    """Share of each value, 4 decimals; null and empty count as unknown."""
    name = F.when(F.col(field).cast("string") != "", F.col(field).cast("string")).otherwise("unknown")
    counts = df.groupBy(*by, name.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    joined = counts.join(totals, list(by)) if by else counts.join(F.broadcast(totals))  # one row
    return joined.select(*by, "key", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share"))


def is_constant(value: Column, digits: int = 6) -> Column:
    """Aggregate: one distinct value at so many decimals; false without values."""
    return F.count_distinct(F.bround(value, digits)) == 1


def is_near_constant(value: Column) -> Column:
    return F.coalesce(F.stddev_pop(value) < 0.01, F.lit(False))


def warnings(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group: the audit's warnings as one row each; groups without any are absent."""
    got = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), is_constant(F.col(value)).alias("constant"),
        F.min(value).alias("low"), F.count_distinct(F.bround(value, 4)).alias("distinct4"),
    )
    said = F.array(
        F.when(F.col("n") <= 3, "few_rows"),
        F.when(F.col("constant") & (F.bround("low", 6) == 0.5), "stop_constant_half"),
        F.when(F.col("constant"), "constant"),
        F.when((F.col("n_values") > 0) & (F.col("distinct4") < 4), "few_distinct"),
        F.when(F.col("n_values") == 0, "no_confidence"),
    )
    return got.select(*by, F.explode(F.filter(said, lambda x: x.isNotNull())).alias("warning"))


def preflight(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group: stop (few rows, no values, one value), warn (under 4000 rows) or ok."""
    got = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), is_constant(F.col(value)).alias("constant"))
    verdict = F.when((F.col("n") < 100) | (F.col("n_values") == 0) | F.col("constant"), "stop").when(F.col("n") < 4000, "warn").otherwise("ok")
    return got.select(*by, "n", verdict.alias("verdict"))


# The row counts that complete files have, and what each warning is called.
COMPLETE = (4217, 4282)
SECOND_PHASE_LEAST = 400


def file_warnings(name: Column, n: Column, pred: dict[str, Column], unsafe: dict[str, Column], has_unsafe: Column) -> Column:
    """Array of warnings of one file.

    ``pred`` and ``unsafe``: n, distinct (six places), distinct4 and low of the two confidences; ``has_unsafe``: an
    unsafe_confidence column exists.  Files of the second phase are named phase2 or transfer.
    """
    second = name.contains("phase2") | name.contains("transfer")
    stem = F.lower(name)
    one = lambda stats: (stats["n"] > 0) & (stats["distinct"] == 1)
    said = F.array(
        F.when(n <= 3, F.concat(F.lit("CRITICAL: only "), n.cast("string"), F.lit(" rows"))),
        F.when(~second & ~n.isin(*COMPLETE), F.concat(F.lit("row count mismatch: "), n.cast("string"))),
        F.when(second & (n < SECOND_PHASE_LEAST), F.concat(F.lit("second phase too small: windows below "), F.floor(n / 3).cast("string"))),
        F.when(one(pred), "pred_confidence is constant"),
        F.when(one(pred) & (F.abs(pred["low"] - 0.5) < 1e-6), "STOP: pred_confidence is 0.5 in all rows"),
        F.when(one(unsafe), "unsafe_confidence is constant"),
        F.when((pred["n"] > 0) & (pred["distinct4"] < 4), "pred_confidence has few distinct values"),
        F.when((unsafe["n"] == 0) & ~has_unsafe, "no unsafe_confidence column"),
        F.when(stem.contains("lg3") | stem.contains("lg4") | stem.contains("e5"), "fairness: off-the-shelf baseline"),
        F.when(stem.contains("xlmr"), "fairness: other architecture"),
    )
    return F.filter(said, lambda x: x.isNotNull())


def audit_files(rows: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Per file of JSON lines (file, line, value): rows, errors, key union, label, language and confidence statistics, warnings.

    A file that ``listed`` (file) names and that has no good line gets a row of nulls and no warnings.
    The columns of a file are those of its first good record.
    """
    from tidewatch.functions import records
    from tidewatch.sources import jsonl

    good = rows.where(F.try_parse_json("value").isNotNull() & (F.trim("value") != ""))
    errors = rows.where(F.try_parse_json("value").isNull() & (F.trim("value") != "")).groupBy("file").agg(F.count(F.lit(1)).alias("parse_errors"))
    counts = good.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    keys = good.select("file", F.explode(F.json_object_keys("value")).alias("key")).distinct().groupBy("file").agg(F.sort_array(F.collect_list("key")).alias("columns"))

    def stats(names: tuple[str, ...], prefix: str) -> DataFrame:
        x = F.col("number")
        found = jsonl.numbers_of(good, "value", names)
        return found.groupBy("file").agg(
            F.count(x).alias(f"{prefix}_n"), mean_of(x).alias(f"{prefix}_mean"), deviation_of(x).alias(f"{prefix}_std"), F.min(x).alias(f"{prefix}_min"), F.max(x).alias(f"{prefix}_max"),
            F.count_distinct(F.bround(x, 6)).alias(f"{prefix}_n_unique"), F.count_distinct(F.bround(x, 4)).alias(f"{prefix}_n_unique4"),
        )

    def shares(names: tuple[str, ...], to: str, label: bool) -> DataFrame:
        picked = jsonl.column_of(good, "value", names).where("column is not null")
        raw = F.expr("get_json_object(value, concat('$.', column))")
        key = records.audit_label(raw) if label else F.coalesce(raw, F.lit("unknown"))
        cells = good.join(picked, "file").groupBy("file", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        return cells.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias(to))

    pred, unsafe = "pred_confidence", "unsafe_confidence"
    out = counts.join(errors, "file", "left").join(keys, "file", "left")
    out = out.join(stats(("pred_confidence", "confidence", "score"), pred), "file", "left").join(stats(records.ALIASES["unsafe"], unsafe), "file", "left")
    out = out.join(shares(("label", "true_label", "ground_truth"), "true_label_distribution", True), "file", "left")
    out = out.join(shares(("pred_label", "predicted_label", "prediction", "predicted"), "pred_label_distribution", True), "file", "left")
    out = out.join(shares(("lang", "language", "lang_code"), "language_distribution", False), "file", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("parse_errors", f"{pred}_n", f"{unsafe}_n", f"{pred}_n_unique", f"{unsafe}_n_unique")}
    out = out.withColumns(zero)
    name = F.element_at(F.split("file", "/"), -1)
    of = lambda p: {"n": F.col(f"{p}_n"), "distinct": F.col(f"{p}_n_unique"), "distinct4": F.coalesce(f"{p}_n_unique4", F.lit(0)), "low": F.col(f"{p}_min")}
    has = F.coalesce(F.array_contains("columns", unsafe), F.lit(False))
    out = out.withColumns({"experiment_label": records.experiment(name), "warnings": file_warnings(name, F.col("n_rows"), of(pred), of(unsafe), has)})
    if listed is not None:
        out = listed.select("file").join(out, "file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    return out


def exit_status(audited: DataFrame) -> int:
    """2 if some file must not be used, else 0."""
    return 2 if audited.where(F.exists("warnings", lambda w: w.startswith("STOP"))).limit(1).count() else 0


def valid_scores(rows: DataFrame, value: str = "unsafe_confidence") -> DataFrame:
    """One row: values, distinct values at six places, and whether there is more than one."""
    got = rows.agg(F.count(value).alias("n"), F.count_distinct(F.bround(value, 6)).alias("n_unique"))
    return got.withColumn("valid", F.col("n_unique") > 1)


def missing_artefacts(spark, paths: list[str]) -> list[str]:
    """The paths, of any store that Spark knows, that hold nothing."""
    def holds(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    return [p for p in paths if not holds(p)]
