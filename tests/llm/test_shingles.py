import random

import corpus_pipeline
from pyspark.sql import functions as F

from tidewatch.llm import shingles, simhash
from tidewatch.llm.common import WORD, lower_ascii, table

SF = "/root/testdata/sf0.001"


def gram_set(text):
    words = WORD.findall(lower_ascii(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def components(docs):
    """Sets of row numbers linked at similarity 0.8, by comparing all pairs."""
    sets, root = [gram_set(t) for t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and near(sets[i], sets[j]):
                was, now = root[i], root[j]
                root = [now if r == was else r for r in root]
    return root


def fixture(spark):
    rng = random.Random(8)
    docs = [r.text for r in table(spark, SF, "documents").collect()] + [None, "", " \t", "one two", "One  two\n", "one two three"]
    shared = [f"s{i}" for i in range(60)]
    for length in (9, 40, 200, 1500):
        for _ in range(25):  # replaced words: similarity about 0.7 to 1
            base = [f"w{rng.randint(0, 3000)}" for _ in range(length)]
            docs.append(" ".join(base))
            for _ in range(2):
                changed = list(base)
                for i in rng.sample(range(length), rng.randint(0, max(1, length // 35))):
                    changed[i] = "changed"
                docs.append(" ".join(changed))
    docs += [" ".join(shared + [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(5, 90))]) for _ in range(60)]
    return docs


def test_stage_keeps_one_of_each_component_at_similarity_four_fifths(spark):
    docs = fixture(spark)
    root = components(docs)
    sets = [gram_set(t) for t in docs]
    pairs = [len(a & b) / len(a | b) for n, a in enumerate(sets) for b in sets[:n] if a and a != b]
    assert sum(0.8 <= j < 0.95 for j in pairs) > 20 and sum(0.7 < j < 0.8 for j in pairs) > 5
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()]
    assert sorted(root[i] for i in kept) == sorted(set(root))
    assert corpus_pipeline.drop_near_copies(spark, df.where(F.lit(False)), SF).collect() == []


def test_near_links_have_the_components_of_all_near_pairs(spark):
    rng = random.Random(3)
    base = [f"w{n}" for n in range(160)]
    docs = fixture(spark)
    for _ in range(150):  # one group: most pairs are not near, chains of near ones join many
        changed = list(base)
        for i in rng.sample(range(160), rng.choice([1, 2, 3, 4, 5, 6, 30])):
            changed[i] = f"x{rng.randint(0, 9999)}"
        docs.append(" ".join(changed))
    df = spark.createDataFrame(list(enumerate(docs)), "row long, text string").select("row", F.col("text").cast("binary").alias("text"))
    sets = shingles._sets(df, 5)
    node = {r.row: r.node for r in sets.collect()}
    found = shingles.near_links(sets).collect()
    grams = {node[i]: gram_set(t) for i, t in enumerate(docs)}
    assert all(near(grams[r.a], grams[r.b]) for r in found)
    every = sum(near(grams[a], grams[b]) for a in grams for b in grams if a < b)
    assert len(found) < every / 3
    root = {n: n for n in grams}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for r in found:
        root[top(r.a)] = top(r.b)
    want = components(docs)
    assert len({top(n) for n in grams}) == len(set(want))
    assert len({(top(node[i]), w) for i, w in enumerate(want)}) == len(set(want))


def test_near_pairs_equal_all_pairs(spark):
    docs = fixture(spark)
    df = spark.createDataFrame(list(enumerate(docs)), "row long, text string").select("row", F.col("text").cast("binary").alias("text"))
    sets = shingles._sets(df, 5)
    node = {r.row: r.node for r in sets.collect()}
    grams = {node[i]: gram_set(t) for i, t in enumerate(docs)}
    want = {(a, b) for a in grams for b in grams if a < b and near(grams[a], grams[b])}
    got = shingles.near_pairs(sets).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_fingerprints_link_before_prefixes_and_sets_confirm(spark):
    base = [f"w{i}" for i in range(900)]
    near = base[:450] + ["changed"] + base[451:]
    docs = [" ".join(base), " ".join(near), " ".join(f"x{i}" for i in range(900))]
    rows = spark.createDataFrame(list(enumerate(docs)), "row long, text string").select("row", F.col("text").cast("binary"))
    sets = shingles._sets(rows, 5).cache()
    of = {r.row: r for r in sets.select("row", "node", "fp").collect()}
    assert [r.fp % 2**64 for _, r in sorted(of.items())] == [simhash.fingerprint(t.encode(), 5) for t in docs]
    assert 0 < ((of[0].fp ^ of[1].fp) % 2**64).bit_count() + (of[0].node != of[1].node) and ((of[0].fp ^ of[1].fp) % 2**64).bit_count() <= shingles.RADIUS
    (link,) = shingles.simhash_links(sets).collect()
    assert {link.a, link.b} == {of[0].node, of[1].node}
    apart = sets.withColumn("fp", F.lit(5).cast("long"))  # equal fingerprints of unlike sets
    got = {(r.a, r.b) for r in shingles.simhash_links(apart).collect()}
    assert got <= {(min(of[0].node, of[1].node), max(of[0].node, of[1].node))}
