import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import simhash
from tidewatch.llm.common import WORD, lower_ascii, table

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, n=4):
    words = WORD.findall(lower_ascii(text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    ones = Counter(i for g in grams for i in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def brute(docs):
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def fixture(spark):
    rng = random.Random(4)
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    docs |= {9001: None, 9002: "", 9003: "one two", 9004: "One  two\n", 9005: "É x\x1fy \x85", 9006: "long " * 50_000}
    long = [f"w{rng.randint(0, 500)}" for _ in range(900)]
    for i in range(40):
        docs[9100 + i] = " ".join(long[:i] + ["changed"] + long[i + 1 :])
    return docs


def test_components_equal_brute_force_also_in_small_blocks(spark):
    docs = fixture(spark)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute(docs)
    for block in (2048, 3):
        got = simhash.near_duplicates(df, block=block).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(docs)


def test_every_pair_within_the_radius_agrees_under_a_mask():
    rng, masks = random.Random(1), simhash.masks(4)
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)


def test_keep_one_keeps_a_row_of_each_component(spark):
    docs = fixture(spark)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [(None, "one two", "y"), (9003, "one two", "z")], "doc_id long, text string, fp string")
    got = simhash.keep_one(df).collect()
    want = brute(docs)
    assert len(got) == len({c for _, c in want.values()}) and got[0].__fields__ == ["doc_id", "text", "fp"]
    assert simhash.keep_one(df.where(F.lit(False))).collect() == []


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    made = []
    real = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name, **o: made.append(name) or real(df, name, **o))
    n = 300
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (1000, 1002)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert len(got) == n + 4 and len({got[i] for i in range(n + 1)}) == 1 and len({got[i] for i in (1000, 1001, 1002)}) == 1 and got[0] != got[1000]
    assert made.count("edges") <= 9


def test_components_of_a_star_take_one_round(spark, monkeypatch):
    made = []
    real = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name, **o: made.append(name) or real(df, name, **o))
    pairs = spark.createDataFrame([(500, i) for i in range(1000) if i != 500], "a long, b long")
    got = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert len(got) == 1000 and len(set(got.values())) == 1 and made == ["edges", "up", "edges"]


def test_one_hot_bucket(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << i for i in rng.sample(range(20), rng.randint(0, 4))) for _ in range(800)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    some = sorted(fps)
    for n, a in enumerate(some):
        for b in some[n + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want = {}
    for f in fps:
        want.setdefault(find(f), set()).add(f)
    for block in (2048, 16):
        got = {}
        for r in simhash.components(simhash.links(nodes, 4, block)).collect():
            got.setdefault(r.root, set()).add(r.node % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_no_join_broadcasts_a_table_that_grows(spark, monkeypatch):
    plans = []

    def kept(df, *args, real=simhash.stored, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **options)

    monkeypatch.setattr(simhash, "stored", kept)
    texts = [(i, " ".join(f"w{(i // 4 * 31 + k) % 97}" for k in range(60)) + f" {i % 2}") for i in range(40)]
    out = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 40 and sum("Join" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)
