"""The grid and its fold against a plain walk over Python lists."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.divergence import ks_p
from tidewatch.operators import decisions, grid, windows


def bins_of(values, edges):
    counts = [0] * (len(edges) - 1)
    for v in values:
        if edges[0] <= v <= edges[-1]:
            counts[min(sum(e <= v for e in edges) - 1, len(counts) - 1)] += 1
    total = sum(counts)
    return [c / total if total else 0.0 for c in counts]


def compare(ref, win, edges):
    p, q = bins_of(ref, edges), bins_of(win, edges)
    cp, cq = [max(x, 1e-10) for x in p], [max(x, 1e-10) for x in q]
    sp, sq = sum(cp), sum(cq)
    kl = sum(a / sp * math.log((a / sp) / (b / sq)) for a, b in zip(cp, cq))
    m = [max((a + b) / 2, 1e-10) for a, b in zip(p, q)]
    js = sum(a * math.log(a / c) + b * math.log(b / c) for a, b, c in zip(cp, cq, m)) / 2
    if not ref or not win:
        return kl, js, 1.0, 0.0
    points = sorted(set(ref) | set(win))
    gaps = [abs(sum(x <= v for x in ref) * len(win) - sum(x <= v for x in win) * len(ref)) for v in points]
    w1 = sum(g * (b - a) for g, a, b in zip(gaps, points, points[1:])) / (len(ref) * len(win))
    return kl, js, ks_p(len(ref), len(win), max(gaps)), w1


def walk(stream, size, step, bins, binning, mode, rule):
    known = lambda xs: [x for x in xs if x is not None]
    prefix = known(stream[:size])
    edges = [k * (1.0 / bins) for k in range(bins)] + [1.0]
    if binning == "quantile" and len(set(np.quantile(prefix, [k / bins for k in range(bins + 1)]))) > 1:
        edges = sorted(set(np.quantile(prefix, [k / bins for k in range(bins + 1)])))
    t, out, ref, stack, start = decisions.DEFAULTS, [], prefix, [prefix], size
    clean = 0
    while start < len(stream):
        chunk = stream[start : start + size]
        if len(chunk) < max(5, size // 10):
            break
        win = known(chunk)
        kl, js, p, w1 = compare(ref, win, edges)
        votes = [kl >= t["kl"], p < t["alpha"], js >= t["js"], w1 >= t["wasserstein"]]
        drift = {"KL_only": votes[0], "KS_only": votes[1], "KL_AND_KS": votes[0] and votes[1], "JS_only": votes[2], "Wasserstein_only": votes[3]}.get(rule, sum(votes) >= 2)
        out.append((kl, js, p, w1, drift, clean if mode == "adaptive_clean" else None))
        if mode == "rolling" or (mode == "adaptive_clean" and not drift):
            ref, clean = win, clean + 1
        elif mode == "multi_reference":
            ref = [x for s in stack for x in s]
            if len(out) > 0:
                stack.append(win)
        start += step
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    streams = {}
    for s, n in (("a", 130), ("b", 97), ("short", 30)):
        level = 0.0
        streams[s] = []
        for i in range(n):
            level = 0.4 if i > n // 2 else 0.0
            streams[s].append(None if rng.random() < 0.05 else round(min(1.0, rng.random() * 0.6 + level), 3))
    rows = spark.createDataFrame([(s, i, v) for s, vs in streams.items() for i, v in enumerate(vs)], "stream string, pos long, uc double")
    axes = grid.Axes(sizes=(20,), bins=(5,), binnings=("equal_width", "quantile"), steps=(1.0, 0.5), modes=grid.MODES, rules=decisions.RULES)
    got = {}
    for r in grid.fold(grid.arrays(rows, axes), axes).collect():
        got.setdefault((r.stream, r.step_size, r.binning, r.reference_mode, r.detector_rule), {})[r.idx] = r
    assert {k[0] for k in got} == {"a", "b"}
    for (s, step, binning, mode, rule), seen in got.items():
        want = walk(streams[s], 20, step, 5, binning, mode, rule)
        assert sorted(seen) == list(range(1, len(want) + 1))
        for i, (kl, js, p, w1, drift, clean) in enumerate(want, 1):
            r = seen[i]
            assert np.allclose((r.kl, r.js, r.ks_p, r.wasserstein), (kl, js, p, w1), atol=1e-9), (s, step, binning, mode, rule, i)
            assert r.drift == drift and (clean is None or r.reference_window_idx == clean)
    table = grid.results(rows, spark.createDataFrame([("a", 65), ("b", None)], "stream string, drift_point long"), axes).collect()
    assert len(table) == 3 * len(axes.each()) and all(r.skip_reason for r in table if r.stream_name == "short")
    for r in table:
        if r.skip_reason is None:
            want = walk(streams[r.stream_name], 20, r.step_size, 5, r.binning, r.reference_mode, r.detector_rule)
            fired = [i for i, w in enumerate(want) if w[4]]
            assert r.first_detection_window == (fired[0] if fired else None) and r.n_windows == len(want)
            late = [i for i in fired if r.stream_name == "a" and 20 + i * r.step_size >= 65]
            assert r.true_detection_after_drift == bool(late)


def test_multi_reference_histograms_and_runs(spark, monkeypatch):
    monkeypatch.setattr(windows, "_RUN", 3)
    rng = random.Random(7)
    values = [round(rng.random(), 2) for _ in range(240)]
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "stream string, pos long, uc double")
    got = {r.idx: r for r in windows.divergences(windows.histograms(windows.assign(rows, 20, 20), 5), "multi_reference").collect()}
    want = walk(values, 20, 20, 5, "equal_width", "multi_reference", "KL_only")
    assert sorted(got) == list(range(1, len(want) + 1))
    assert all(np.allclose((got[i].kl, got[i].js), w[:2], atol=1e-9) for i, w in enumerate(want, 1))


def test_positions_with_equal_and_null_times(spark):
    rows = spark.range(1000).select(F.lit("s").alias("stream"), F.when(F.col("id") % 3 > 0, F.lit(5)).alias("time"), F.col("id"))
    got = windows.positions(rows, "time", "id").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1000)) and [r.id for r in got] == sorted(range(1000), key=lambda i: (i % 3 > 0, i))


def test_published_rule_summary(spark):
    """The roll-up of a table whose published summary is known: 7 drifting streams and a control."""
    rows = []
    for k in range(8):
        control = k == 0
        rows.append(("iid_control" if control else f"d{k}", "KS_only", 200, 20, "equal_width", 1.0, "fixed_first", True, 1, None if control else (1 if k == 1 else 0), 0, not control))
    table = spark.createDataFrame(
        rows, "stream_name string, detector_rule string, window_size int, bins int, binning string, step_fraction double, reference_mode string, drift_detected boolean, first_detection_window int, detection_delay int, false_alarm_count_before_drift int, true_detection_after_drift boolean"
    )
    (r,) = grid.rule_summary(table, F.col("stream_name") != "iid_control").collect()
    assert (r.detected_drift_streams, r.iid_control_false_alarm, r.total_false_alarms_before_drift, r.mean_detection_delay_windows) == ("7/7", "Yes", 0, 0.14)


def test_distances_from_many_references_take_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(s, i, None if s == "gaps" and (i < 30 or 60 <= i < 110) else float(rng.integers(0, 25) / 20 if s == "few" else round(float(rng.random()), 6))) for s, n in (("few", 300), ("gaps", 400), ("short", 25), ("fine", 350)) for i in range(n)]
    assigned = windows.assign(spark.createDataFrame(rows, "stream string, pos long, uc double"), 20, 10)
    names = ["stream", "idx", "n1", "n2", "k", "area"]
    want = {(r.stream, r.idx): r for r in windows._paired(assigned, "multi_reference").select(names).collect()}
    sql = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesce in ("true", "false"):  # one range of values, and several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = {(r.stream, r.idx): r for r in windows._walked(assigned).select(names).collect()}
        assert got.keys() == want.keys() and len(got) > 90
        for key, r in got.items():
            w = want[key]
            assert (r.n1 or 0, r.n2) == (w.n1 or 0, w.n2) and (not r.n1 or (r.k == w.k and r.area == pytest.approx(w.area, rel=1e-12))), key
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", sql)
    small = pd.DataFrame([(0, i, None, None, 0, 7) for i in range(40)] + [(1, i, v / 10, 1 + (v == 3), None, None) for i in range(40) for v in rng.choice(20, 6, False)], columns=["kind", "idx", "v", "n", "below", "n2"])
    small["stream"] = "s"
    whole = windows._part_distances(small)
    monkeypatch.setattr(windows, "_ROWS", 3)
    monkeypatch.setattr(windows, "_COLUMNS", 4)
    cut = windows._part_distances(small)
    assert (whole[["n1", "n2", "k"]] == cut[["n1", "n2", "k"]]).to_numpy().all() and (whole["high"] * 2**20 + whole["low"] == cut["high"] * 2**20 + cut["low"]).all()
    monkeypatch.setattr(windows, "sample_pairs", None)
    assert windows.distances(assigned, "multi_reference").count() == len(want)
