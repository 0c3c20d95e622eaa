"""Count-based windows of ordered streams, their references and the distances between them.

A stream is rows (stream, pos, uc).  Window 0 is the reference prefix, the first
``size`` rows; window k >= 1 starts ``step`` rows after window k - 1.  Work is
keyed by (stream, window), so one long stream spreads over all tasks, but for the
references that depend on earlier decisions or all earlier values (``grid``).
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import divergence
from tidewatch.functions.numbers import even, exact, mean_of
from tidewatch.storage import stored

#: Windows whose histograms one task adds up for ``multi_reference``.
_RUN = 256
#: Windows and distinct values in a block of ``_part_distances``.
_ROWS, _COLUMNS = 256, 1024


def positions(df: DataFrame, time: str, *ties: str, by: str = "stream") -> DataFrame:
    """Add ``pos``, the row's place in its stream from 0.

    Rows are dealt into sampled ranges of (stream, time, ties), ranked within a range,
    and ranges follow each other by their counts.  A range is a task's share of the
    rows whatever their times are, so neither a busy hour nor equal or null times
    land in one task unless the ties are equal too.
    """
    ranged = stored(df.repartitionByRange(by, time, *ties).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per stream and range
    offsets = ranged.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(by, "_range").orderBy(time, *ties)
    ranked = ranged.withColumn("_rn", F.row_number().over(within))
    return ranked.join(offsets, [by, "_range"]).withColumn("pos", F.col("_base") + F.col("_rn") - 1).drop("_range", "_base", "_rn")


def assign(rows: DataFrame, size: int | Column, step: int | Column) -> DataFrame:
    """A row per (row, window that holds it); column idx."""
    at = F.col("pos") - size
    last = F.floor(at / step)
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step))
    ids = F.when(at < 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(first, last), lambda k: k + 1))
    return rows.withColumn("idx", F.explode(ids))


def summaries(assigned: DataFrame, size: int) -> DataFrame:
    """Per window: rows, missing, and mean, population deviation, least and greatest (four places; NaN without values).

    Short tails are left out.  The deviation is of the distances from the mean, both
    from sums that are exact to ten places.
    """
    means = assigned.groupBy("stream", "idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("uc").isNull()).alias("n_missing"),
        mean_of(F.col("uc")).alias("mean"),
        F.sum(exact(F.col("uc")) * exact(F.col("uc"))).cast("double").alias("squares"),
        F.min("uc").alias("min"),
        F.max("uc").alias("max"),
        F.min("pos").alias("start"),
        F.max("pos").alias("end"),
    )
    got = means.withColumn("std", F.sqrt(F.greatest(F.col("squares") / (F.col("n") - F.col("n_missing")) - F.col("mean") * F.col("mean"), F.lit(0.0))))
    seen = lambda c: F.coalesce(even(F.col(c), 4), F.lit(float("nan"))).alias(c)
    return got.where(F.col("n") >= max(5, size // 10)).select("stream", "idx", "n", "n_missing", seen("mean"), seen("std"), seen("min"), seen("max"), "start", "end")


def value_counts(assigned: DataFrame, field: str) -> DataFrame:
    """Rows of each value of a column in each window; null and empty count as unknown."""
    name = F.when(F.col(field).cast("string") != "", F.col(field).cast("string")).otherwise("unknown")
    return assigned.groupBy("stream", "idx", name.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def edges_by_quantile(prefix: DataFrame, bins: int) -> DataFrame:
    """Per stream: edges at the quantiles of the prefix's values, each once; equal widths if fewer than two are left."""
    shares = ", ".join(f"{k / bins!r}D" for k in range(bins + 1))
    even_widths = F.array(*[F.lit(k * (1.0 / bins) if k < bins else 1.0) for k in range(bins + 1)])
    got = prefix.where("uc is not null").groupBy("stream").agg(F.array_sort(F.array_distinct(F.expr(f"percentile(uc, array({shares}))"))).alias("edges"))
    return got.withColumn("edges", F.when(F.size("edges") < 2, even_widths).otherwise(F.col("edges")))


def histograms_by_quantile(assigned: DataFrame, bins: int) -> DataFrame:
    """Counts of each window over the edges of its stream's prefix; values outside them are in no bin."""
    edges = edges_by_quantile(assigned.where("idx = 0"), bins)  # a row per stream
    rows = assigned.join(edges, "stream")
    x, at = F.col("uc"), F.size(F.filter("edges", lambda e: e <= F.col("uc"))) - 1
    inside = (x >= F.col("edges")[0]) & (x <= F.element_at("edges", -1))
    rows = rows.withColumn("bin", F.when(inside, F.least(at, F.size("edges") - 2)))
    cells = rows.groupBy("stream", "idx", F.size("edges").alias("m"), "bin").agg(F.count(F.lit(1)).alias("n"))
    maps = cells.groupBy("stream", "idx", "m").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("c"))
    dense = F.transform(F.sequence(F.lit(0), F.col("m") - 2), lambda k: F.coalesce(F.try_element_at("c", k), F.lit(0).cast("long")))
    return maps.select("stream", "idx", dense.alias("counts"))


def histograms(assigned: DataFrame, bins: int) -> DataFrame:
    """Per window: counts, an array over the bins."""
    cells = assigned.groupBy("stream", "idx", divergence.bin_index(F.col("uc"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    maps = cells.groupBy("stream", "idx").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long")))
    return maps.select("stream", "idx", dense.alias("counts"))


def referenced(hist: DataFrame, mode: str) -> DataFrame:
    """Add ``ref``, the reference's counts, and ``reference_idx``: fixed_first (also any unknown mode), rolling or multi_reference."""
    if mode == "rolling":
        last = hist.select("stream", (F.col("idx") + 1).alias("idx"), F.col("counts").alias("ref"))
        out = hist.join(last, ["stream", "idx"]).withColumn("reference_idx", F.col("idx") - 1)
    elif mode == "multi_reference":
        # all windows up to the one before the last, and the prefix: sums within runs of windows, and of the runs before
        long = hist.select("stream", "idx", F.expr(f"idx div {_RUN}").alias("run"), F.posexplode("counts").alias("bin", "n"))
        inner = Window.partitionBy("stream", "run", "bin").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("stream", "bin").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        runs = long.groupBy("stream", "run", "bin").agg(F.sum("n").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
        sums = long.withColumn("upto", F.sum("n").over(inner)).join(runs, ["stream", "run", "bin"]).select("stream", "idx", "bin", (F.col("upto") + F.col("base")).alias("r"))
        whole = sums.groupBy("stream", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "r"))), lambda x: x.r).alias("ref"))
        later = whole.select("stream", F.explode(F.when(F.col("idx") == 0, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).otherwise(F.array(F.col("idx") + 2))).alias("idx"), "ref")
        out = hist.join(later, ["stream", "idx"]).withColumn("reference_idx", F.col("idx") - 1)
    else:
        first = hist.where("idx = 0").select("stream", F.col("counts").alias("ref"))
        out = hist.join(first, "stream").withColumn("reference_idx", F.lit(0).cast("long"))  # one row a stream: broadcast below the size limit, else shuffled
    return out.where("idx > 0")


def divergences(hist: DataFrame, mode: str = "fixed_first") -> DataFrame:
    """Per window: kl and js of the reference and the window."""
    p, q = divergence.shares(F.col("ref")), divergence.shares(F.col("counts"))
    both = referenced(hist, mode).select("stream", "idx", p.alias("p"), q.alias("q"))
    return both.select("stream", "idx", divergence.kl(F.col("p"), F.col("q")).alias("kl"), divergence.js(F.col("p"), F.col("q")).alias("js"))


def sample_pairs(assigned: DataFrame, mode: str = "fixed_first") -> DataFrame:
    """Rows (stream, idx, v, r, w): each window's values and its reference's.

    A ``multi_reference`` takes the values of all earlier windows, so rows grow with the square
    of a stream's windows; ``distances`` does without them in that mode.
    """
    rows = assigned.where("uc is not null").select("stream", "idx", F.col("uc").alias("v"))
    mine = rows.where("idx > 0").select("*", F.lit(0).alias("r"), F.lit(1).alias("w"))
    if mode == "multi_reference":
        ids = rows.where("idx > 0").select("stream", F.col("idx").alias("of")).distinct()
        past = (F.col("idx") == 0) | (F.col("idx") <= F.col("of") - 2)
        theirs = ids.join(rows, "stream").where(past).select("stream", F.col("of").alias("idx"), "v")
    elif mode == "rolling":
        last = rows.groupBy("stream").agg(F.max("idx").alias("top"))
        theirs = rows.join(last, "stream").where("idx < top").select("stream", (F.col("idx") + 1).alias("idx"), "v")
    else:
        prefix = rows.where("idx = 0").select("stream", "v")  # ``size`` rows a stream
        ids = rows.where("idx > 0").select("stream", "idx").distinct()
        theirs = ids.join(prefix, "stream")
    return mine.unionByName(theirs.select("*", F.lit(1).alias("r"), F.lit(0).alias("w")))


def _ranged(assigned: DataFrame) -> DataFrame:
    """Rows (stream, part, kind, idx, v, n, below, n2), stored: a part is a range of a stream's values.

    Kind 0: one row for each window of the stream with values, the number of its values
    below the part, and of all (n2).  Kind 1: how often (n) a window has a value (v) of the part.
    Kind 2: the first value (v) of the next part.
    """
    cells = assigned.where("uc is not null").groupBy("stream", "idx", F.col("uc").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells.repartitionByRange("stream", "v").withColumn("part", F.spark_partition_id()), "cells")
    parts = cells.groupBy("stream", "part").agg(F.min("v").alias("low"))  # a row per range
    after = parts.select("stream", "part", F.lead("low").over(Window.partitionBy("stream").orderBy("part")).alias("v")).where("v is not null")
    held = cells.groupBy("stream", "idx", "part").agg(F.sum("n").alias("n"))
    whole = held.groupBy("stream", "idx").agg(F.sum("n").alias("n2"))
    before = Window.partitionBy("stream", "idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = whole.join(F.broadcast(parts.select("stream", "part")), "stream").join(held, ["stream", "idx", "part"], "left")
    left = every.select("stream", "part", F.lit(0).alias("kind"), "idx", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"), "n2")
    all_rows = left.unionByName(cells.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(after.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return all_rows.select("stream", "part", "kind", "idx", "v", "n", "below", "n2")


def _past(idx: np.ndarray, per_window: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of ``per_window`` (rows by ``idx``, ascending) over each window's references: the prefix and all up to the one before the last."""
    sums = np.concatenate([np.zeros((1, *per_window.shape[1:]), np.int64), np.cumsum(per_window, axis=0)])
    return sums[np.searchsorted(idx, np.maximum(w - 2, 0), side="right")]


def _part_distances(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: each window's n1, n2, the greatest gap k between the scaled counts, and the area between
    them in units of 1e-10, as area = high * 2**20 + low."""
    kind = pdf["kind"].to_numpy()
    windows = pdf[kind == 0].sort_values("idx")
    idx, below, n2 = (windows[c].to_numpy(np.int64) for c in ("idx", "below", "n2"))
    cells, stop = pdf[kind == 1], pdf.loc[kind == 2, "v"].to_numpy(np.float64)
    values, column = np.unique(cells["v"].to_numpy(np.float64), return_inverse=True)
    row, count = np.searchsorted(idx, cells["idx"].to_numpy(np.int64)), cells["n"].to_numpy(np.int64)
    gap = np.diff(np.rint(np.append(values, stop if stop.size else values[-1:]) * 1e10).astype(np.int64))
    n1, ref_below = _past(idx, n2, idx), _past(idx, below, idx)
    k, high, low = (np.zeros(idx.size, np.int64) for _ in range(3))
    order = np.argsort(column, kind="stable")
    column, row, count = column[order], row[order], count[order]
    for a in range(0, values.size, _COLUMNS):  # columns from the left; the sums below them move on
        z = min(a + _COLUMNS, values.size)
        some = slice(*np.searchsorted(column, [a, z]))
        of = np.argsort(row[some], kind="stable")
        c, r, n = column[some][of] - a, row[some][of], count[some][of]
        width, upto = z - a, np.zeros((2, z - a), np.int64)
        for t in range(0, idx.size, _ROWS):
            u = min(t + _ROWS, idx.size)
            got = slice(*np.searchsorted(r, [t, u]))
            own = np.bincount((r[got] - t) * width + c[got], weights=n[got], minlength=(u - t) * width).astype(np.int64).reshape(u - t, width)
            # sums up to each window, after those of the two rows before these: a reference ends one or two rows earlier
            upto = np.concatenate([upto[-2:], upto[-1] + np.cumsum(own, axis=0)])
            last = np.searchsorted(idx, np.maximum(idx[t:u] - 2, 0), side="right") - 1
            ref = upto[last - t + 2]
            ref = np.cumsum(ref, axis=1) + ref_below[t:u, None]
            mine = np.cumsum(own, axis=1) + below[t:u, None]
            below[t:u], ref_below[t:u] = mine[:, -1], ref[:, -1]
            ref *= n2[t:u, None]
            mine *= n1[t:u, None]
            ref -= mine
            np.abs(ref, out=ref)
            k[t:u] = np.maximum(k[t:u], ref.max(axis=1))
            high[t:u] += (ref >> 20) @ gap[a:z]
            low[t:u] += (ref & ((1 << 20) - 1)) @ gap[a:z]
    later = idx > 0
    return pd.DataFrame({"stream": pdf["stream"].iloc[0], "idx": idx, "n1": n1, "n2": n2, "k": k, "high": high, "low": low})[later]


def _walked(assigned: DataFrame) -> DataFrame:
    """Rows (stream, idx, n1, n2, k, area) against ``multi_reference``, without pairs of windows: each task holds a range of
    values and adds up the windows' counts in their order, so work grows with windows times distinct values.
    Gaps between values are those of the values at ten places."""
    made = _ranged(assigned).groupBy("stream", "part").applyInPandas(_part_distances, "stream string, idx long, n1 long, n2 long, k long, high long, low long")
    area = F.sum("high").cast("decimal(24,0)") * F.lit(Decimal("0.0001048576")) + F.sum("low").cast("decimal(27,0)") * F.lit(Decimal("0.0000000001"))
    return made.groupBy("stream", "idx").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("k").alias("k"), area.cast("double").alias("area"))


def _paired(assigned: DataFrame, mode: str) -> DataFrame:
    """The same from sorted pairs of samples."""
    values = sample_pairs(assigned, mode).groupBy("stream", "idx", "v").agg(F.sum("r").alias("r"), F.sum("w").alias("w"))
    group = Window.partitionBy("stream", "idx")
    order = group.orderBy("v")
    run = values.select(
        "stream", "idx", "v",
        F.sum("r").over(order).alias("cr"), F.sum("w").over(order).alias("cw"),
        F.sum("r").over(group).alias("n1"), F.sum("w").over(group).alias("n2"),
        F.lead("v").over(order).alias("next"),
    )
    apart = F.abs(F.col("cr") * F.col("n2") - F.col("cw") * F.col("n1"))
    return run.groupBy("stream", "idx").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(apart).alias("k"), F.sum(apart.cast("decimal(16,0)") * exact(F.col("next") - F.col("v"))).cast("double").alias("area"))


def distances(assigned: DataFrame, mode: str = "fixed_first") -> DataFrame:
    """Per window: n1, n2, the KS numerator k = n1 n2 D, ks_stat and the Wasserstein distance, in one pass."""
    got = _walked(assigned) if mode == "multi_reference" else _paired(assigned, mode)
    whole = (F.col("n1") * F.col("n2")).cast("double")
    some = whole > 0
    return got.select(
        "stream", "idx", "n1", "n2", F.when(some, F.col("k")).otherwise(0).alias("k"),
        F.when(some, F.col("k") / whole).otherwise(0.0).alias("ks_stat"), F.when(some, F.coalesce("area", F.lit(0.0)) / whole).otherwise(0.0).alias("wasserstein"),
    )


def metrics(rows: DataFrame, size: int = 200, step: int | None = None, bins: int = 20, mode: str = "fixed_first") -> DataFrame:
    """All four metrics and the summary of every window but the prefix."""
    assigned = assign(rows, size, step or size)
    far = distances(assigned, mode).withColumn("ks_p", divergence.ks_p_value("n1", "n2", "k"))
    return summaries(assigned, size).join(divergences(histograms(assigned, bins), mode), ["stream", "idx"]).join(far, ["stream", "idx"])
