"""Records and metrics with known values, and windows against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import divergence, records
from tidewatch.operators import decisions, windows


@pytest.mark.parametrize(
    "line, predicted, uc, origin",
    [
        ('{"pred":"Hate","score":0.9}', "UNSAFE", 0.9, "derived_from_pred_confidence"),
        ('{"pred_label":" safe ","confidence":0.9}', "SAFE", 0.1, "derived_from_pred_confidence"),
        ('{"prediction":1,"prob":"0.6"}', "UNSAFE", 0.6, "derived_from_pred_confidence"),
        ('{"predicted":"maybe","prob":0.6}', "MAYBE", 0.6, "derived_from_pred_confidence"),
        ('{"safe_probability":0.3}', "UNKNOWN", 0.7, "direct_unsafe_probability"),
        ('{"unsafe_confidence":"abc","unsafe_probability":0.8}', "UNKNOWN", None, "missing"),
        ('{"unsafe_confidence":null,"unsafe_probability":0.8}', "UNKNOWN", 0.8, "direct_unsafe_probability"),
        ('{"pred_label":2}', "UNKNOWN", None, "missing"),
        ('{"pred_label":true,"score":0.2}', "UNSAFE", 0.2, "derived_from_pred_confidence"),
    ],
)
def test_normalise(spark, line, predicted, uc, origin):
    (r,) = records.normalise(spark.createDataFrame([(line,), ("{bad",), ("",), (None,)], "value string")).collect()
    assert (r.predicted, r.confidence_source) == (predicted, origin)
    assert r.unsafe_confidence == (None if uc is None else pytest.approx(uc))


@pytest.mark.parametrize(
    "n, h, p",
    [(200, 34, 0.006094), (200, 35, 0.004305), (200, 33, 0.008539), (200, 29, 0.029715), (200, 25, 0.087838), (200, 22, 0.177934)]
    + [(50, 10, 0.271914), (50, 11, 0.178587), (50, 12, 0.112385), (50, 15, 0.021708), (50, 17, 0.005842), (50, 18, 0.002835)],
)
def test_ks_p_of_equal_sizes(n, h, p):
    assert divergence.ks_p(n, n, h * n) == pytest.approx(p, abs=1e-6)


def test_ks_p_of_unequal_sizes_and_empty_ones():
    assert divergence.ks_p(400, 200, 62 * 200) == pytest.approx(0.003142, abs=1e-6)
    assert divergence.ks_p(200, 0, 0) == divergence.ks_p(5, 5, 0) == 1.0


def test_bins_on_edges(spark):
    xs = [0.15, 0.30, 0.35, 0.60, 0.70, 0.85, 0.95, 1.0, 1.2, -0.1, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(divergence.bin_index(F.col("x"), 20).alias("b")).collect()
    edges = np.append(np.arange(20) * (1 / 20), 1.0)
    assert [r.b for r in got] == [2, 5, 6, 11, 13, 16, 18, 19, None, None, None]
    assert all(r.b == min((edges <= x).sum() - 1, 19) for r, x in zip(got, xs) if r.b is not None)


def test_windows_against_a_loop(spark):
    rng = np.random.default_rng(3)
    uc = [None if u < 0.02 else float(u) for u in rng.random(437)]
    rows = spark.createDataFrame([("s", i, u) for i, u in enumerate(uc)], "stream string, pos long, uc double")
    got = {r.idx: r for r in windows.metrics(rows, 50, 25).collect()}
    k, start = 1, 50
    ref = np.array([u for u in uc[:50] if u is not None])
    while start < len(uc) and len(uc[start : start + 50]) >= 5:
        win = np.array([u for u in uc[start : start + 50] if u is not None])
        both = np.sort(np.concatenate([ref, win]))
        cdf = lambda a: np.searchsorted(np.sort(a), both, "right") / a.size
        assert got[k].ks_stat == pytest.approx(np.abs(cdf(ref) - cdf(win)).max())
        assert got[k].wasserstein == pytest.approx((np.abs(cdf(ref) - cdf(win))[:-1] * np.diff(both)).sum())
        p, q = (np.histogram(a, np.append(np.arange(20) / 20, 1.0))[0] / a.size for a in (ref, win))
        cp, cq = np.maximum(p, 1e-10), np.maximum(q, 1e-10)
        assert got[k].kl == pytest.approx((cp / cp.sum() * np.log(cp / cp.sum() / (cq / cq.sum()))).sum())
        k, start = k + 1, start + 25
    assert sorted(got) == list(range(1, k))


def test_positions_across_hours_and_empty(spark):
    rows = [("s", f"2024-01-01 0{h}:00:0{s}", h * 10 + s) for h in (3, 0, 2) for s in (5, 1)] + [("s", None, 99), ("t", None, 1)]
    df = spark.createDataFrame(rows, "stream string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.stream, r.pos): r.event_id for r in windows.positions(df, "ts", "event_id").collect()}
    assert got == {("s", i): e for i, e in enumerate([99, 1, 5, 21, 25, 31, 35])} | {("t", 0): 1}
    assert windows.metrics(spark.createDataFrame([], "stream string, pos long, uc double")).collect() == []


def test_thresholds_overlay():
    assert decisions.thresholds({"kl": 0.2, "js": None, "other": 1}) == decisions.DEFAULTS | {"kl": 0.2}
