"""Writers: streams with metadata, tables, reports, audits, thresholds, appended results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import grid
from tidewatch.operators.audit import distribution

# The fields of a stream line and of an audit row, in order.
STREAM_FIELDS = "id lang label pred_label pred_confidence unsafe_confidence confidence_source source stream_name drift_type".split()
AUDIT_FIELDS = (
    "file experiment_label n_rows parse_errors pred_confidence_n pred_confidence_mean pred_confidence_std pred_confidence_n_unique unsafe_confidence_n"
    " unsafe_confidence_mean unsafe_confidence_std unsafe_confidence_n_unique true_label_distribution language_distribution warnings"
).split()


def json_line(fields: list[Column], keep_nulls: bool = True) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": str(not keep_nulls).lower()})


def stream_lines(rows: DataFrame) -> DataFrame:
    """stream_name, pos and the JSON line of each row: ``STREAM_FIELDS``, and text where there is any."""
    line = json_line([F.col(c) for c in STREAM_FIELDS])
    text = json_line([F.col("text")])
    joined = F.when(F.length("text") > 0, F.concat(F.expr("left(_line, length(_line) - 1)"), F.lit(","), F.substring(text, F.lit(2), F.length(text)))).otherwise(F.col("_line"))
    return rows.withColumn("_line", line).select("stream_name", "pos", joined.alias("value"))


def write_streams(rows: DataFrame, path: str) -> None:
    """A folder for each stream, lines in order of ``pos`` within and across its files."""
    stream_lines(rows).repartitionByRange("stream_name", "pos").sortWithinPartitions("stream_name", "pos").select("stream_name", "value").write.partitionBy("stream_name").text(path)


def stream_profile(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Per stream, side of the drift point and field (language, predicted): the share of each value."""
    sides = rows.join(F.broadcast(points), "stream_name", "left")  # a row per stream
    sides = sides.withColumn("side", F.when(F.col("pos") >= F.col("drift_point"), "after").otherwise("before"))
    of = lambda field: distribution(sides, field, "stream_name", "side").withColumn("field", F.lit(field))
    return of("language").unionByName(of("predicted"))


def metadata_lines(rows: DataFrame, points: DataFrame) -> DataFrame:
    """One JSON object for each stream: drift point, rows, and shares and mean confidence on both sides."""
    from tidewatch.operators.synthesis import profile

    shares = stream_profile(rows, points).groupBy("stream_name", "field", "side").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "share")))).alias("m"))
    shares = shares.groupBy("stream_name").pivot("field", ["language", "predicted"]).agg(
        F.max_by("m", F.when(F.col("side") == "before", 1)).alias("before"), F.max_by("m", F.when(F.col("side") == "after", 1)).alias("after")
    )
    means = profile(rows, points).groupBy("stream_name").agg(
        F.sum("n").alias("n_records"), F.max(F.when(F.col("side") == "before", F.col("confidence_mean"))).alias("b"), F.max(F.when(F.col("side") == "after", F.col("confidence_mean"))).alias("a")
    )
    got = points.join(means, "stream_name").join(shares, "stream_name")
    fields = [
        F.col("stream_name"), F.col("drift_point"), F.col("n_records"), F.lit("prediction-level (no model re-inference)").alias("simulation_level"),
        F.col("language_before").alias("language_distribution_before"), F.col("language_after").alias("language_distribution_after"),
        F.col("predicted_before").alias("label_distribution_before"), F.col("predicted_after").alias("label_distribution_after"),
        F.col("b").alias("confidence_mean_before"), F.col("a").alias("confidence_mean_after"),
    ]
    return got.select("stream_name", json_line(fields).alias("value"))


def write_csv(table: DataFrame, path: str, columns: list[str] = grid.COLUMNS) -> None:
    """Header and columns in their fixed order; other columns are left out, nulls are empty."""
    table.select(*columns).write.option("header", True).csv(path)


def report_lines(table: DataFrame) -> DataFrame:
    """One JSON array for each stream: all its rows, skipped ones with their reason, in order of the configurations.

    A stream has as many rows as there are configurations, which doesn't grow with data.
    """
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*grid.COLUMNS, F.col("skip_reason").alias("_skip_reason")).alias("r")))), lambda x: x["r"])
    return table.groupBy("stream_name").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("value"))


def window_reports(folded: DataFrame) -> DataFrame:
    """One JSON object a row for each window of a detector's report; ``stream`` and ``idx`` order them."""
    fields = ["idx", "reference_window_idx", "n", "start", "end", "kl", "js", "ks_stat", "ks_p", "wasserstein", "drift"]
    return folded.select("stream", "detector_rule", "idx", F.to_json(F.struct(*fields)).alias("value"))


def audit_table(audited: DataFrame) -> DataFrame:
    """``AUDIT_FIELDS`` as plain columns: maps as JSON, warnings joined by `` | ``."""
    as_text = {"map": F.to_json, "array": lambda c: F.concat_ws(" | ", c)}
    kinds = {f.name: f.dataType.typeName() for f in audited.schema}
    return audited.select(*[(as_text[kinds[c]](F.col(c)) if kinds[c] in as_text else F.col(c)).alias(c) for c in AUDIT_FIELDS])


def append_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to what the folder holds."""
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def merge_failures(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Earlier failures and new ones, to be written in place of the earlier file."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def confidence_summary(rows: DataFrame) -> DataFrame:
    """One row of the scoring run: statistics (sample deviation) of both confidences, failures and rows."""
    from tidewatch.functions.numbers import deviation_of, even, mean_of

    made = []
    for name in ("unsafe_confidence", "pred_confidence"):
        x = F.col(name)
        made += [
            F.count(x).alias(f"{name}_n"), even(F.min(x), 6).alias(f"{name}_min"), even(F.max(x), 6).alias(f"{name}_max"), even(mean_of(x), 6).alias(f"{name}_mean"),
            even(deviation_of(x, sample=True), 6).alias(f"{name}_std"), F.count_distinct(F.bround(x, 6)).alias(f"{name}_n_unique"),
        ]
    return rows.agg(*made, F.count_if("prob_extraction_failed").alias("prob_extraction_failed_count"), F.count(F.lit(1)).alias("total_records"))


def summary_text(summary: DataFrame) -> DataFrame:
    """A printable line for each stream and rule of ``decisions.summarise``."""
    first = F.coalesce(F.col("first_detection").cast("string"), F.lit("-"))
    line = F.format_string("%-28s %-18s drift=%-5s first=%s warn=%d crit=%d KL=%.6f JS=%.6f W=%.6f p=%.6f", "stream", "rule", F.col("drift_detected").cast("string"), first, "n_warning", "n_critical", "max_kl", "max_js", "max_wasserstein", "min_ks_p")
    return summary.select("stream", "rule", line.alias("line"))


def audit_text(audited: DataFrame) -> DataFrame:
    """A tag (STOP, CRIT, WARN or OK) and a printable line for each audited file."""
    said = F.concat_ws(" ", "warnings")
    tag = F.when(said.contains("STOP"), "STOP").when(said.contains("CRITICAL"), "CRIT").when(F.size("warnings") > 0, "WARN").otherwise("OK")
    return audited.select("file", tag.alias("tag"), F.format_string("[%s] %s: %d rows, %d errors, %d warnings", tag, "experiment_label", "n_rows", "parse_errors", F.size("warnings")).alias("line"))
