"""Each stage of the corpus pipeline, and all of them, against brute force on a small corpus."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from test_decontaminate import by_hand
from test_quality import brute as counts_of
from test_toxicity import brute_score
from tidewatch.llm import queries, tokens, toxicity
from tidewatch.llm.common import stored, table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of small tables: documents with near copies, exact copies, benchmark passages and odd rows."""
    rng = random.Random(8)
    sf = str(tmp_path_factory.mktemp("corpus"))
    docs = [tuple(r) for r in table(spark, SF, "documents").orderBy("doc_id").limit(250).select(*COLUMNS).collect()]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    extra = []
    for k, d in enumerate([d for d in docs if d[1] and 80 < len(d[1].split()) < 1500][:20]):
        words = d[1].split()
        for _ in range(k % 4):  # similarity about 0.8 to 1
            words = list(words)
            for _ in range(max(1, len(words) // 100)):
                words[rng.randrange(len(words))] = "changed"
            extra.append((5000 + len(extra), " ".join(words), d[2], d[3], 0))
    filler = [d[1] for d in docs if d[1]]
    extra += [(6000 + k, f"{filler[k]} {items[k]} {filler[k + 30]}", "en", "planted", 0) for k in range(12)]
    extra += [(7000, None, None, None, None), (7001, "", "en", "s", 0), (7002, " \n ", "en", "s", 0), (None, filler[0], "en", "s", 0), (docs[3][0], docs[3][1], "en", "again", 0), (7003, "word " * 30_000, "en", "s", 0)]
    spark.createDataFrame(docs + extra, table(spark, SF, "documents").select(*COLUMNS).schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{sf}/{name}.parquet")
    return sf


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_stages(spark, corpus):
    docs = table(spark, corpus, "documents").cache()
    before = rows_of(docs)
    # toxicity
    model = toxicity.fit(toxicity.sample(docs, table(spark, corpus, "labels"), F.lit(True), queries.TOXICITY_ROWS))
    kept = pipeline.drop_toxic(spark, docs, corpus)
    assert kept.columns == docs.columns
    assert rows_of(kept) == Counter({r: n for r, n in before.items() if len(r[1] or "") > 20_000 or brute_score(r[1], model) < 0.5} | {r: n for r, n in rows_of(kept).items() if len(r[1] or "") > 20_000})
    # quality: nothing that fails the base rules, and little else of what is labelled good
    kept = rows_of(pipeline.keep_quality(spark, docs, corpus))
    good = {r.doc_id for r in table(spark, corpus, "labels").where("quality = 1").collect()}
    passes = Counter()
    for r, n in before.items():
        words, *_, repeated = counts_of(r[1])
        if words >= 20 and 100 * repeated <= 30 * words:
            passes[r] = n
    assert all(n <= passes[r] for r, n in kept.items())
    fine = [r for r in passes if r[0] in good]
    assert sum(kept[r] > 0 for r in fine) >= 0.95 * len(fine)
    # near copies: components of pairs with similarity 0.8 or more, one row of each
    got = pipeline.drop_near_copies(spark, docs, corpus)
    sets = {}
    for r in before:
        sets.setdefault(shingles(r[1]), []).append(r)
    distinct = list(sets)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if a and b and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    near = sum(find(i) != i for i in range(len(distinct)))
    assert near >= 15  # planted near copies are among them
    left = Counter(find(distinct.index(shingles(r[1]))) for r, n in rows_of(got).items() for _ in range(n))
    assert set(left) == {find(i) for i in range(len(distinct))} and set(left.values()) == {1}
    # benchmark passages
    kept = rows_of(pipeline.drop_contaminated(spark, docs, corpus))
    items = [(r.item_id, r.text) for r in table(spark, corpus, "benchmark").collect()]
    lost = before - kept
    assert {6000 + k for k in range(12)} <= {r[0] for r in lost} and not kept - before
    sample = list(lost) + random.Random(2).sample([r for r in kept if len(r[1] or "") < 4000], 25)
    for r in sample:
        if len(r[1] or "") < 20_000:
            assert bool(by_hand(items, r[1], 0.5, 0.6)) == (r in lost)
    # packing
    t = tokens.encoder(tokens.default_vocabulary())
    want = Counter()
    for (d, x, *_), n in before.items():
        ids = np.append(np.frombuffer(t.encode_many([(x or "").encode()])[0], "<u4"), 1).astype("<u4")
        for at in range(0, ids.size, 2048):
            want[(d, at, ids[at : at + 2048].size, zlib.crc32(ids[at : at + 2048].tobytes()))] += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pipeline.pack(spark, docs, corpus).collect()) == want


def test_run_is_its_stages_and_keeps_extra_columns(spark, corpus):
    docs = table(spark, corpus, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, corpus), "kept")
    want = Counter(r.doc_id for r in docs.collect())
    first, second = pipeline.run(spark, corpus), pipeline.run(spark, corpus)  # a run deletes nothing that an earlier result reads
    got = Counter(r.doc_id for r in first.where("start = 0").collect())
    assert got == want and second.count() == first.count() and sum(want.values()) > 100
    odd = table(spark, corpus, "documents").limit(60).withColumns({"row": F.lit(1), "fp": F.lit("x"), "kept": F.lit(False), "stratum": F.lit("s"), "label": F.lit(2), "_row_of": F.lit(3), "place": F.lit(4)})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, corpus)
        assert out.columns == odd.columns and out.count() >= 0
        assert stage(spark, odd.limit(0), corpus).count() == 0


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
