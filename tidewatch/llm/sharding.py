"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on a 32-bit ring is a hash of its id; each shard owns ``vnodes``
places and a row's home is the shard of the first one at or clockwise after it.
A shard holds at most its capacity; first every shard takes home rows in ring
order until it is full, then the overflow continues clockwise, row by row in
ring order, to the next shard with room.  With load factor 1 the capacities are
n/shards rounded down or up and sum to n, so shard sizes differ by one at most;
the rows away from home are exactly the excess over capacity, the fewest there
can be.

Placing depends only on how many rows lie between neighbouring ring places, so
the driver plans on counts by ring cell (``cells`` + shards x vnodes numbers at
most, whatever the input).  Rows then need their rank on the ring: counts before
their cell plus their rank within it, one shuffle by cell.

Defined cases: a null id has a fixed place; rows with the same id are ordered by
size and text digest, and equal rows are interchangeable; an empty table gives
no rows.  Copies of a text are spread like other rows: their ids decide.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RING = 1 << 32


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in ring order and their shards; a shard's places don't depend on the others."""
    places = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 0) >> 32, s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in places], np.int64), np.array([s for _, s in places], np.int64)


def place(key: Column) -> Column:
    """Ring place of a key, 0 to 2**32 - 1."""
    return F.shiftrightunsigned(F.xxhash64(key), 32)


def capacities(n: int, shards: int, load_factor: float = 1.0) -> list[int]:
    """Most rows of each shard; for factor 1 they sum to n."""
    if load_factor <= 1:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [int(np.ceil(load_factor * n / shards))] * shards


def plan(counts: list[int], owner: list[int], caps: list[int]) -> list[tuple[int, int, int]]:
    """Runs (first rank, shard, first slot) of ring-ordered rows.

    ``counts[i]`` rows lie on the arc that ends at virtual node i, with shard
    ``owner[i]``; ranks count rows along the arcs.
    """
    free, used = list(caps), [0] * len(caps)
    runs, waiting, rank = [], [], 0
    for arc, n in enumerate(counts):
        s, take = owner[arc], min(n, free[owner[arc]])
        if take:
            runs.append((rank, s, used[s]))
            free[s] -= take
            used[s] += take
        if n > take:
            waiting.append((arc, rank + take, n - take))
        rank += n
    for arc, first, n in waiting:
        at = arc
        while n:
            at = (at + 1) % len(owner)
            s = owner[at]
            if take := min(n, free[s]):
                runs.append((first, s, used[s]))
                free[s] -= take
                used[s] += take
                first, n = first + take, n - take
    return sorted(runs)


def ring_shards(
    df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 128, load_factor: float = 1.0, cells: int = 4096
) -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    ``slot`` is gapless from 0 in each shard.  The law is ``rows`` (row counts at
    most one apart), which holds for load factor 1.
    """
    places, owner = ring(shards, vnodes)
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    width = RING // cells

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, at.to_numpy(), "left").astype(np.int32))

    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = stored(rows.withColumn("at", place(F.col("doc_id"))).withColumn("arc", arc_of("at")), "ring")
    cell = F.col("at").bitwiseAND(-width).alias("cell")
    found = sorted((r.arc, r.cell, r.n) for r in rows.groupBy("arc", cell).agg(F.count(F.lit(1)).alias("n")).collect())

    arcs = [0] * (len(owner) + 1)
    before, total = {}, 0
    for arc, at, n in found:
        before[(arc, at)] = total
        total += n
        arcs[arc] += n
    # rows beyond the last virtual node go on to the first: an arc of their own, with its shard
    runs = plan(arcs, [*owner.tolist(), int(owner[0])], capacities(total, shards, load_factor))
    firsts, to, slots = (np.array([r[k] for r in runs] or [0], np.int64) for k in range(3))
    keys = np.array(sorted(a * RING + c for a, c in before), np.int64)
    bases = np.array([before[divmod(int(k), RING)] for k in keys], np.int64)
    homes = np.append(owner, owner[0])

    @F.pandas_udf("shard int, slot long, home_shard int")
    def placed(arc: pd.Series, at: pd.Series, rn: pd.Series) -> pd.DataFrame:
        rank = bases[np.searchsorted(keys, arc.to_numpy().astype(np.int64) * RING + at.to_numpy())] + rn.to_numpy() - 1
        run = np.searchsorted(firsts, rank, "right") - 1
        return pd.DataFrame({"shard": to[run].astype(np.int32), "slot": slots[run] + rank - firsts[run], "home_shard": homes[arc.to_numpy()].astype(np.int32)})

    order = Window.partitionBy("arc", "cell").orderBy("at", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("cell", cell).withColumn("rn", F.row_number().over(order))
    got = ranked.withColumn("got", placed("arc", "cell", "rn"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "got.shard", "got.slot", F.lit(None).cast("int").alias("grown_shard"), "got.home_shard")


def shard_of(key_place: int, places: list[int], owner: list[int]) -> int:
    """Home shard of one ring place."""
    return owner[bisect_left(places, key_place) % len(owner)]
