"""Detector configurations by the dozen, and references that depend on earlier windows.

``fold`` walks the windows of one (stream, size, step) in order and holds the windows
that some configuration refers to: the prefix, the last one, the last clean one of
each configuration, and for ``multi_reference`` the counts of all earlier distinct
values.  A pair of windows is compared once, whatever the number of bins, modes and
rules that ask for it.  Groups are independent tasks; a stream of n windows
takes n steps, where all pairs would be n squared.

Defined cases: null confidences count as rows of a window but not as values; a
window without values has KS (0, 1), Wasserstein 0 and a uniform window's KL; an
unknown mode keeps the prefix, an unknown rule is ``KL_only``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import vectors
from tidewatch.functions.divergence import ks_p
from tidewatch.functions.numbers import even
from tidewatch.operators import windows
from tidewatch.operators.decisions import RULES, thresholds

MODES = ("fixed_first", "rolling", "multi_reference", "adaptive_clean")


@dataclass(frozen=True)
class Axes:
    """Values of each parameter; a configuration's number counts through them, the last axis fastest."""

    sizes: tuple[int, ...] = (50, 100, 200, 500)
    bins: tuple[int, ...] = (10, 20, 30, 50)
    binnings: tuple[str, ...] = ("equal_width", "quantile")
    steps: tuple[float, ...] = (1.0, 0.5)
    modes: tuple[str, ...] = MODES
    rules: tuple[str, ...] = RULES
    over: dict = field(default_factory=dict)

    def each(self) -> list[tuple]:
        return list(product(self.sizes, self.bins, self.binnings, self.steps, self.modes, self.rules))

    def table(self, spark: SparkSession) -> DataFrame:
        """All configurations; a few thousand rows."""
        rows = [(i, w, b, k, s, max(1, int(w * s)), m, r) for i, (w, b, k, s, m, r) in enumerate(self.each())]
        return spark.createDataFrame(rows, "ord long, window_size int, bins int, binning string, step_fraction double, step_size int, reference_mode string, detector_rule string")


def says(rule: str, kl: float, p: float, js: float, w: float, t: dict) -> bool:
    votes = {"KL_only": kl >= t["kl"], "KS_only": p < t["alpha"], "JS_only": js >= t["js"], "Wasserstein_only": w >= t["wasserstein"]}
    if rule == "KL_AND_KS":
        return votes["KL_only"] and votes["KS_only"]
    if rule == "Ensemble_majority":
        return sum(votes.values()) >= 2
    return votes.get(rule, votes["KL_only"])


FOLDED = (
    "stream string, window_size int, step_size int, bins int, binning string, reference_mode string, detector_rule string, idx long, reference_idx long, reference_window_idx long,"
    " n long, start long, `end` long, n1 long, n2 long, k long, kl double, js double, ks_stat double, ks_p double, wasserstein double, drift boolean"
)


class _Fold:
    """State of one group's walk."""

    def __init__(self, key: tuple, axes: Axes):
        self.key, self.axes, self.t = key, axes, thresholds(axes.over)
        self.far: dict = {}
        self.p: dict = {}

    def first(self, v: np.ndarray, n: np.ndarray) -> None:
        values = np.repeat(v, n)
        self.edges = {c: vectors.edges(values, *c) for c in product(self.axes.bins, self.axes.binnings)}
        self.held = {0: (v, n)}
        self.before, self.stack, self.past = 0, None, (v, n)
        self.clean = {(c, r): (0, 0) for c in self.edges for r in self.axes.rules}

    def _pair(self, ref, v, n, cache: dict, name) -> tuple:
        if name not in cache:
            far = vectors.distance(*ref, v, n)
            if far[:3] not in self.p:
                self.p[far[:3]] = ks_p(*far[:3])
            cache[name] = (far, self.p[far[:3]], {c: (vectors.shares(vectors.histogram(ref[0], e, ref[1])), vectors.shares(vectors.histogram(v, e, n))) for c, e in self.edges.items()})
        return cache[name]

    def window(self, idx: int, rows: int, start: int, end: int, v: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        cache: dict = {}
        metric: dict = {}
        for mode in self.axes.modes:
            for c in self.edges:
                for rule in self.axes.rules:
                    name, nth = {"rolling": (self.before, idx - 1), "multi_reference": ("all", idx - 1), "adaptive_clean": self.clean[c, rule]}.get(mode, (0, 0))
                    far, p, both = self._pair(self.past if name == "all" else self.held[name], v, n, cache, name)
                    if (name, c) not in metric:
                        metric[name, c] = (vectors.kl(*both[c]), vectors.js(*both[c]))
                    kl, js = metric[name, c]
                    drift = says(rule, kl, p, js, far[4], self.t)
                    yield (*self.key, *c, mode, rule, idx, idx - 1 if name == "all" else name, nth, rows, start, end, *far[:3], kl, js, far[3], p, far[4], drift)
                    if mode == "adaptive_clean" and not drift:
                        self.clean[c, rule] = (idx, nth + 1)
        if "multi_reference" in self.axes.modes:  # a window joins the references one window late
            if self.stack is not None:
                values = np.union1d(self.past[0], self.stack[0])
                counts = np.zeros(values.size, np.int64)
                for x, k in (self.past, self.stack):
                    counts[np.searchsorted(values, x)] += k
                self.past = values, counts
            self.stack = (v, n)
        self.held[idx] = (v, n)
        self.before = idx
        used = {0, idx, *(at for at, _ in self.clean.values())}
        self.held = {k: x for k, x in self.held.items() if k in used}


def fold(arrays: DataFrame, axes: Axes) -> DataFrame:
    """A row per window after the prefix and configuration: its reference, the metrics and the decision.

    ``arrays``: stream, window_size, step_size, idx, n, start, end and values (sorted, without nulls).
    """
    names = [c.split()[0].strip("`") for c in FOLDED.replace(",", ", ").split(", ") if c.strip()]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in FOLDED.replace(",", ", ").split(", ") if c.strip()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for stream, size, step, idx, n, start, end, values in zip(*(c.to_pylist() for c in b.slice(at, 64).columns)):
                    v, counts = np.unique(np.array(values, np.float64), return_counts=True)
                    if state is None or state.key != (stream, size, step):
                        state = _Fold((stream, size, step), axes)
                    if idx == 0:
                        state.first(v, counts)
                    else:
                        out.extend(state.window(idx, n, start, end, v, counts))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    keys = ["stream", "window_size", "step_size"]
    dealt = arrays.select(*keys, "idx", "n", "start", "end", "values").repartition(*keys).sortWithinPartitions(*keys, "idx")
    return dealt.mapInArrow(run, FOLDED)


def arrays(rows: DataFrame, axes: Axes) -> DataFrame:
    """Windows of all sizes and steps as sorted arrays of values; streams of under two windows and short tails are left out."""
    spark = rows.sparkSession
    shapes = spark.createDataFrame(sorted({(w, max(1, int(w * s))) for w in axes.sizes for s in axes.steps}), "window_size int, step_size int")
    lengths = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("_rows"))
    long = lengths.join(F.broadcast(shapes), F.col("_rows") >= 2 * F.col("window_size")).drop("_rows")  # few shapes
    each = windows.assign(rows.select("stream", "pos", "uc").join(long, "stream"), F.col("window_size"), F.col("step_size"))
    got = each.groupBy("stream", "window_size", "step_size", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"), F.max("pos").alias("end"), F.sort_array(F.collect_list("uc")).alias("values")
    )
    return got.where(F.col("n") >= F.greatest(F.lit(5), F.expr("window_size div 10")))


COLUMNS = (
    "stream_name detector_rule window_size step_size step_fraction bins binning reference_mode calibrated_threshold_used drift_detected first_detection_window detection_delay"
    " false_alarm_count_before_drift true_detection_after_drift max_kl min_ks_pvalue max_js max_wasserstein n_windows n_records constant_confidence_warning"
).split()


def results(rows: DataFrame, meta: DataFrame, axes: Axes) -> DataFrame:
    """A row per stream and configuration (``COLUMNS`` and ord); where a stream is too short, nulls and the reason in skip_reason.

    ``rows``: stream, pos, uc.  ``meta``: stream, drift_point (null: none).
    """
    spark = rows.sparkSession
    folded = fold(arrays(rows, axes), axes).join(meta.select("stream", "drift_point"), "stream", "left")
    dp = F.col("drift_point")
    keys = ["stream", "window_size", "step_size", "bins", "binning", "reference_mode", "detector_rule"]
    got = folded.groupBy(*keys).agg(
        F.bool_or("drift").alias("drift_detected"),
        F.min(F.when(F.col("drift"), F.col("idx") - 1)).alias("first_detection_window"),
        F.count_if(F.col("drift") & (F.col("end") < dp)).alias("false_alarm_count_before_drift"),
        F.coalesce(F.bool_or(F.col("drift") & (F.col("start") >= dp)), F.lit(False)).alias("true_detection_after_drift"),
        F.max(even(F.col("kl"), 6)).alias("max_kl"),
        F.min(even(F.col("ks_p"), 6)).alias("min_ks_pvalue"),
        F.max(even(F.col("js"), 6)).alias("max_js"),
        F.max(even(F.col("wasserstein"), 6)).alias("max_wasserstein"),
        F.count(F.lit(1)).alias("n_windows"),
        F.max("drift_point").alias("_dp"),
    )
    due = F.greatest(F.lit(0), F.floor((F.col("_dp") - F.col("window_size")) / F.col("step_size")))
    got = got.withColumn("detection_delay", F.col("first_detection_window") - due).drop("_dp")
    streams = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n_records"), (F.count_distinct(F.bround("uc", 6)) == 1).alias("_constant"))
    table = streams.crossJoin(F.broadcast(axes.table(spark)))  # every stream meets every configuration
    out = table.join(got, keys, "left")
    short = F.col("n_records") < 2 * F.col("window_size")
    reason = F.when(short, F.format_string("n_records(%d) < window_size*2(%d)", "n_records", F.col("window_size") * 2))
    out = out.withColumns(
        {
            "stream_name": F.col("stream"),
            "calibrated_threshold_used": F.lit(True),  # the defaults hold the key, so the mark is always set
            "n_windows": F.coalesce("n_windows", F.lit(0).cast("long")),
            "constant_confidence_warning": F.when(~short, F.col("_constant")),
            "skip_reason": reason,
        }
    )
    return out.select(*COLUMNS, "skip_reason", "ord")


def sensitivity(table: DataFrame) -> DataFrame:
    """Rows with a decision."""
    return table.where("drift_detected is not null")


def ablation(table: DataFrame, size: int = 200, bins: int = 20) -> DataFrame:
    """Rules by modes at one window size, number of equal bins and whole steps."""
    return sensitivity(table).where((F.col("window_size") == size) & (F.col("bins") == bins) & (F.col("binning") == "equal_width") & (F.col("step_fraction") == 1.0))


def primary(table: DataFrame, rule: str = "Ensemble_majority", mode: str = "fixed_first") -> DataFrame:
    """The ablation's row of one rule and mode for each stream."""
    return ablation(table).where((F.col("detector_rule") == rule) & (F.col("reference_mode") == mode))


def matrix(table: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Per mode and stream a cell for each rule: a tick, FA (alarms but no true detection), a dash, or N/A."""
    cell = F.when(F.col("true_detection_after_drift"), "✓").when(F.col("drift_detected"), "FA").otherwise("—")
    got = table.groupBy("reference_mode", "stream_name").pivot("detector_rule", sorted(rules)).agg(F.first(cell))
    return got.fillna("N/A")


def best_per_stream(table: DataFrame) -> DataFrame:
    """One decided row per stream: of those with a true detection (else of all) and a delay the least delay, then false
    alarms, then the first configuration; without any delay the first configuration."""
    rows = sensitivity(table)
    true = F.col("true_detection_after_drift")
    late = F.col("detection_delay").isNull()
    fields = F.struct(*[c for c in table.columns if c != "stream_name"])
    known = F.when(late, F.lit(0)).otherwise(F.col("detection_delay"))
    alarms = F.when(late, F.lit(0)).otherwise(F.col("false_alarm_count_before_drift"))
    key = F.struct((~true).cast("int"), late.cast("int"), known, alarms, "ord")
    return rows.groupBy("stream_name").agg(F.min_by(fields, key).alias("b")).select("stream_name", "b.*").select(*table.columns)


def rule_summary(table: DataFrame, drifting: Column, mode: str = "fixed_first") -> DataFrame:
    """Per rule: streams with a true detection, alarms on the control stream, false alarms before drift, mean delay (two places)."""
    rows = ablation(table).where(F.col("reference_mode") == mode)
    return rows.groupBy("detector_rule").agg(
        F.concat(F.count_if(drifting & F.col("true_detection_after_drift")).cast("string"), F.lit("/"), F.count_if(drifting).cast("string")).alias("detected_drift_streams"),
        F.when(F.coalesce(F.bool_or(~drifting & F.col("drift_detected")), F.lit(False)), "Yes").otherwise("No").alias("iid_control_false_alarm"),
        F.sum("false_alarm_count_before_drift").alias("total_false_alarms_before_drift"),
        even(F.avg("detection_delay"), 2).alias("mean_detection_delay_windows"),
    )
