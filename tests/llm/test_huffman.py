import heapq
import zlib

import numpy as np
import pytest

from tidewatch.llm import huffman, tokens


def optimal(counts):
    heap = list(counts.values())
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 300):
        counts = {i: int(c) for i, c in enumerate(rng.zipf(1.4, n).clip(max=10**6))}
        free = huffman.code_lengths(counts, 30)
        assert n == 1 or sum(counts[i] * k for i, k in free.items()) == optimal(counts)
        limit = max(1, int(np.ceil(np.log2(n)))) + 1
        tight = huffman.code_lengths(counts, limit)
        assert max(tight.values()) <= limit and sum(2.0**-k for k in tight.values()) <= 1
    # free, 1 1 2 3 5 costs 25 with 4 bits; within 3 bits the best lengths are 3 3 2 2 2: 3+3+4+6+10
    assert sum(c * k for c, k in zip((1, 1, 2, 3, 5), huffman.code_lengths(dict(enumerate((1, 1, 2, 3, 5))), 3).values())) == 26


@pytest.mark.parametrize("n", [1, 5, 511, 512, 513, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(max=700)
    lengths = huffman.code_lengths(dict(zip(*[x.tolist() for x in np.unique(ids, return_counts=True)])), 12)
    code, lens = huffman.canonical(lengths, 701)
    bits, offsets = huffman.encode_block(ids, code, lens)
    assert (huffman.decode_block(bits, offsets, n, *huffman.decode_table(code, lens, 12), 12) == ids).all()


def test_file_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(huffman, "BLOCK", 40)
    texts = [None, "", "Hello  wörld", "it's <|endoftext|> 'tis", "a\x1fb\nß " * 30, "x " * 500, "同じ é"]
    rows = [(None if i == 9 else i // 2, texts[i % len(texts)]) for i in range(40)]
    huffman.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "f"), parts=3)
    got = huffman.read(spark, str(tmp_path / "f")).collect()
    t = tokens.encoder(tokens.default_vocabulary()).tokenizer
    want = []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((d, len(ids) // 4, zlib.crc32(ids), ids))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])
    want.sort(key=key)
    got.sort(key=lambda r: r.start)
    start = 0
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (w[0], start, w[1], w[2], w[3])
        start += w[1]


def test_empty(spark, tmp_path):
    huffman.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "f"))
    assert huffman.read(spark, str(tmp_path / "f")).count() == 0
