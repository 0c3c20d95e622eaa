import zlib
from collections import Counter, defaultdict

import numpy as np

from tidewatch.llm import packing, tokens


def test_patterns_hold_every_length_once():
    rng = np.random.default_rng(3)
    for max_len in (16, 64):
        hist = Counter(rng.integers(1, max_len + 1, 4000).tolist())
        patterns = packing.shortest_pack_first(hist, max_len)
        got = Counter()
        for pattern, n in patterns:
            assert sum(pattern) <= max_len
            for length in pattern:
                got[length] += n
        assert got == hist
        packs = sum(n for _, n in patterns)
        assert sum(k * n for k, n in hist.items()) > 0.9 * packs * max_len  # uniform lengths are hard for the method: about 95 % here, 99.9 % on documents


def test_shortest_pack_gets_the_next_length():
    assert packing.shortest_pack_first({6: 1, 5: 1, 4: 1, 1: 1}, 10) == [((6, 1), 1), ((5, 4), 1)]


def test_one_length_alone_fills_packs():
    assert packing.shortest_pack_first({100: 1000}, 2048) == [((100,) * 20, 50)]
    assert sorted(packing.shortest_pack_first({700: 7}, 2048)) == [((700,), 1), ((700, 700), 3)]
    assert packing.shortest_pack_first({64: 3}, 64) == [((64,), 3)] and packing.shortest_pack_first({}, 64) == []


def check(rows, docs, max_len, spark):
    t = tokens.encoder(tokens.default_vocabulary()).tokenizer
    want = Counter()
    for d, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), max_len):
            part = ids[at : at + max_len]
            want[(d, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for held in seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= max_len
    assert sorted(seq) == list(range(len(seq)))


def test_packs_every_id_once(spark):
    docs = [(None if i % 50 == 0 else i // 2, [None, "", "Hello wörld " * (i % 37), "a b c", "x" * 300][i % 5]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "'x' as cell")
    check(packing.pack(df, 64).collect(), docs, 64, spark)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
