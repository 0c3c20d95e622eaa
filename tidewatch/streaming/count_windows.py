"""Count windows over unbounded streams, and appending results with a checkpoint.

Spark's own windows are of time; windows of ``size`` rows need a row count as state.
``detect`` keeps, per stream, the rows of the window that is filling and the reference
prefix, at most two windows of numbers, and emits each tumbling window when it is full,
compared with the prefix.  Rows are taken in the order of (time, key) within a
micro-batch; state is in Spark's state store, so a lost executor resumes from it.

Defined cases: null confidences count as rows but not as values; a stream of under
two windows emits nothing; the part of a window that isn't full stays in state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import vectors
from tidewatch.functions.divergence import ks_p

WINDOWS = "stream string, idx long, n long, kl double, js double, ks_stat double, ks_p double, wasserstein double"
_STATE = "idx long, held array<double>, reference array<double>"


def compare(reference: np.ndarray, window: np.ndarray, bins: int) -> tuple[float, ...]:
    r, w = reference[~np.isnan(reference)], window[~np.isnan(window)]
    edge = vectors.edges(r, bins, "equal_width")
    p, q = (vectors.shares(vectors.histogram(x, edge)) for x in (r, w))
    n1, n2, k, stat, far = vectors.distance(*np.unique(r, return_counts=True), *np.unique(w, return_counts=True))
    return vectors.kl(p, q), vectors.js(p, q), stat, ks_p(n1, n2, k), far


def detect(rows: DataFrame, size: int = 200, bins: int = 20) -> DataFrame:
    """Windows of a streaming DataFrame (stream, time, key, uc) as they fill up."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, held, reference = state.get if state.exists else (0, [], [])
        held, reference = list(held), np.array(reference, float)
        got = pd.concat(list(parts)).sort_values(["time", "key"], kind="stable")["uc"].to_numpy(float)
        values, out = np.concatenate([held, got]), []
        while values.size >= size:
            window, values = values[:size], values[size:]
            if idx == 0:
                reference = window
            else:
                out.append((key[0], idx, size, *compare(reference, window, bins)))
            idx += 1
        state.update((idx, values.tolist(), reference.tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return rows.groupBy("stream").applyInPandasWithState(step, WINDOWS, _STATE, "append", GroupStateTimeout.NoTimeout)


def append_scores(rows: DataFrame, path: str, checkpoint: str, scorer=None, size: int = 16):
    """Score a streaming DataFrame's micro-batches and append them to ``path``; ids there already are skipped, so a replayed batch adds nothing."""
    from tidewatch.operators import scoring
    from tidewatch.sources import jsonl, sinks

    def add(batch: DataFrame, _: int) -> None:
        todo = scoring.pending(batch, jsonl.completed_ids(batch.sparkSession, path))
        sinks.append_lines(scoring.score(todo, scorer or scoring.mock, size), path)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
