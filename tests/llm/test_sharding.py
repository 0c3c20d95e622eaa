import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import sharding


def brute(places, owner, keys, caps):
    """Row by row: home rows in ring order first, then the overflow clockwise."""
    free, slot, out, late = list(caps), [0] * len(caps), {}, []
    for k in sorted(range(len(keys)), key=lambda k: (int(np.searchsorted(places, keys[k][0])), keys[k])):
        at = int(np.searchsorted(places, keys[k][0]))
        s = owner[at % len(owner)]
        if free[s]:
            free[s] -= 1
            out[k] = s
        else:
            late.append((k, at % len(owner)))
    for k, at in late:
        while not free[owner[at]]:
            at = (at + 1) % len(owner)
        free[owner[at]] -= 1
        out[k] = owner[at]
    return out


@pytest.mark.parametrize("n,shards,vnodes", [(500, 5, 4), (97, 16, 8), (3, 7, 2)])
def test_matches_row_by_row_ring(spark, n, shards, vnodes):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id")).alias("text"), F.lit(1).alias("shard"))
    rows = sharding.ring_shards(df, shards, vnodes=vnodes, cells=64).collect()
    assert len(rows) == n
    at = {r.doc_id: r.p for r in df.select("doc_id", sharding.place(F.col("doc_id")).alias("p")).collect()}
    places, owner = sharding.ring(shards, vnodes)
    want = brute(places, owner.tolist(), [(at[i], i) for i in range(n)], sharding.capacities(n, shards))
    assert {r.doc_id: r.shard for r in rows} == want
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    over = sum(r.shard != r.home_shard for r in rows)
    homes = [sum(r.home_shard == s for r in rows) for s in range(shards)]
    assert over == sum(max(0, h - c) for h, c in zip(homes, sharding.capacities(n, shards)))


def test_a_new_shard_takes_places_only_for_itself():
    places, owner = sharding.ring(8, 16)
    more, owner2 = sharding.ring(9, 16)
    for at in range(0, sharding.RING, sharding.RING // 997):
        new = sharding.shard_of(at, more.tolist(), owner2.tolist())
        assert new == 8 or new == sharding.shard_of(at, places.tolist(), owner.tolist())


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, None)]
    got = sharding.ring_shards(spark.createDataFrame(rows, "doc_id long, text string"), 2, vnodes=2).collect()
    assert sorted(r.size for r in got) == [1] * 5 and all(r.text_crc32 == 0 for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert sharding.ring_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
