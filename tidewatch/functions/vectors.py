"""The metrics of ``divergence`` and ``windows.distances`` on numpy vectors, for folds over windows."""

from __future__ import annotations

import numpy as np

from tidewatch.functions.divergence import EPSILON


def edges(prefix: np.ndarray, bins: int, binning: str) -> np.ndarray:
    """Bin edges: equal widths over [0, 1], or the prefix's quantiles, each once."""
    if binning == "quantile" and prefix.size:
        found = np.unique(np.quantile(prefix, [k / bins for k in range(bins + 1)]))
        if found.size > 1:
            return found
    return np.array([k * (1.0 / bins) for k in range(bins)] + [1.0])


def histogram(values: np.ndarray, edge: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts per bin, the last bin closed; values outside the edges are in none."""
    inside = (values >= edge[0]) & (values <= edge[-1])
    at = np.minimum(np.searchsorted(edge, values[inside], "right") - 1, edge.size - 2)
    return np.bincount(at, None if weights is None else weights[inside], edge.size - 1)


def shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    return counts / total if total else counts.astype(float)


def kl(p: np.ndarray, q: np.ndarray) -> float:
    p, q = np.maximum(p, EPSILON), np.maximum(q, EPSILON)
    p, q = p / np.cumsum(p)[-1], q / np.cumsum(q)[-1]
    return float(np.cumsum(p * np.log(p / q))[-1])


def js(p: np.ndarray, q: np.ndarray) -> float:
    m = np.maximum((p + q) / 2, EPSILON)
    half = lambda x: float(np.cumsum(np.maximum(x, EPSILON) * np.log(np.maximum(x, EPSILON) / m))[-1])
    return (half(p) + half(q)) / 2


def distance(rv: np.ndarray, rn: np.ndarray, wv: np.ndarray, wn: np.ndarray) -> tuple[int, int, int, float, float]:
    """(n1, n2, k, KS statistic, Wasserstein distance) of two samples as sorted distinct values and their counts."""
    n1, n2 = int(rn.sum()), int(wn.sum())
    if not n1 or not n2:
        return n1, n2, 0, 0.0, 0.0
    v = np.union1d(rv, wv)
    upto = lambda x, n: np.concatenate([[0], np.cumsum(n)])[np.searchsorted(x, v, "right")]
    apart = np.abs(upto(rv, rn) * n2 - upto(wv, wn) * n1)
    k = int(apart.max())
    gaps = np.rint(np.diff(v) * 1e10)  # ten places, as decimals elsewhere
    small = n1 * n2 < 5e8
    area = int((apart[:-1] * gaps.astype(np.int64)).sum()) if small else float((apart[:-1].astype(float) * gaps).sum())
    return n1, n2, k, k / (n1 * n2), area / 1e10 / (n1 * n2)
