import math
import random
from collections import Counter

from tidewatch.llm import decontaminate as D
from tidewatch.llm import queries
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.01"


def index_of(items, threshold=0.5, block=64):
    words = [D.words_of(t) for _, t in items]
    return D.Index(items, Counter(w.encode() for ws in words for w in set(ws)), len(items), sum(map(len, words)) / len(items), threshold, block=block)


def test_search_finds_all_items_above_the_threshold():
    rng = random.Random(4)
    for block in (1, 2, 64):
        items = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 25)))) for i in range(120)]
        for threshold in (0.05, 0.3, 0.6):
            index = index_of(items, threshold, block)
            (held,) = index.classes
            for _ in range(100):
                terms = sorted({rng.randrange(len(index.vocabulary)) for _ in range(rng.randint(1, 25))})
                want = {}
                for t in terms:
                    for i, w in zip(held.items[t], held.impacts[t]):
                        want[i] = want.get(i, 0) + w
                want = {i: s for i, s in want.items() if s >= threshold - 1e-9}
                got = dict(held.search(terms))
                assert got.keys() == want.keys()
                assert all(math.isclose(got[i], want[i]) for i in got)


def by_hand(items, text, threshold, overlap):
    """Every passage against every item, without an index."""
    words = [D.words_of(t) for _, t in items]
    df, mean = Counter(w for ws in words for w in set(ws)), sum(map(len, words)) / len(items)
    said, best = D.words_of(text), {}
    for i, ws in enumerate(words):
        norm = 1.2 * (0.25 + 0.75 * len(ws) / mean)
        weight = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + norm) for t, n in Counter(ws).items()}
        stride = 64
        while stride < len(ws):
            stride *= 2
        for a in range(0, max(1, len(said) - stride), stride):
            passage = said[a : a + 2 * stride]
            score = sum(w for t, w in weight.items() if t in set(passage)) / sum(weight.values())
            parts = [D.shingles(p, 5) for p in D.parts_of(items[i][1])]
            shares = [len(p & D.shingles(passage, len(next(iter(p))))) / len(p) for p in parts]
            if score >= threshold - 1e-9 and min(shares) >= overlap:
                best[i] = max(best.get(i, (0,)), (round(score, 9), *shares, -a))
    return best


def test_hits_equal_passages_by_hand(monkeypatch):
    monkeypatch.setattr(D, "_SEGMENTS", 3)
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 400}"
    lengths = [1, 2, 5, 12, 30, 64, 65, 120, 500, *[rng.randint(3, 40) for _ in range(300)]]
    items = [(i, " ".join(word() for _ in range(k)) + rng.choice([".", "? " + word(), "? " + " ".join(word() for _ in range(7))])) for i, k in enumerate(lengths)]
    bodies = [None, "", "  "]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 300)))]
        for i in rng.sample(range(len(items)), 3) + [rng.randrange(9)]:
            said = items[i][1].split()
            parts += [" ".join(said[: rng.randint(len(said) // 2, len(said))]) if rng.random() < 0.5 else items[i][1].upper(), " ".join(word() for _ in range(rng.randint(0, 90)))]
        bodies.append(" ".join(parts))
    bodies.append(" ".join(word() for _ in range(30_000)))
    index = index_of(items)
    got = index.hits([b if b is None else b.encode() for b in bodies], 0.6)
    found = 0
    for b, hits in zip(bodies, got):
        want = by_hand(items, b, 0.5, 0.6)
        assert {i: (round(s, 9), q, r, -a) for i, s, q, r, a in hits} == want
        found += len(want)
    assert found > 60


def test_terms():
    for text in ("Abc_9 d'e-F\tg\x1fh", "ÀÉÎ ßÿ Ñandú × ÷ naïve", "“Qué” – Ünï İstanbul ΑΒΓ ª µ", "a\x00b\x7fc", "ΣΑΣ x́y"):
        assert D.terms_of(text.encode()) == [w.encode() for w in D.words_of(text)]


def test_own_text_scores_one():
    items = [(7, "What is the red thing? A large barn."), (8, "something else. entirely new words here")]
    index = index_of(items)
    one = lambda text: index.hits([text], 0.6)[0]
    got = one(b"noise " * 500 + b"what is the RED thing, a large barn " + b"noise " * 500)
    assert [(index.ids[i], round(s, 6)) for i, s, *_ in got] == [(7, 1.0)]
    assert not one(b"what is the red thing it is unknown to us all")  # no answer
    assert not one(b"a large barn") and not one(None) and not one(b"")


def test_halves_far_apart_are_no_hit_beside_a_long_item(spark):
    far = "red green blue white black orange " + "noise " * 300 + "one two three four five six"
    items = [(1, "red green blue white black orange. One two three four five six"), (2, " ".join(f"long{i}" for i in range(500)))]
    df = spark.createDataFrame([(1, far), (2, items[1][1]), (3, items[0][1])], "doc_id long, text string")
    for held in (items[:1], items):
        for chars in (10, 1_000_000):
            got = D.contaminated(df, spark.createDataFrame(held, "item_id long, text string"), block_chars=chars)
            assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [x for x in [(2, 2), (3, 1)] if x[1] <= len(held)]


def test_parts():
    assert D.parts_of("Who? Me.") == (["who"], ["me"])
    assert D.parts_of("Question: how many Answer: two") == (["question", "how", "many"], ["two"])
    assert D.parts_of("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert D.parts_of("single") == (["single"], ["single"])


def test_documents_equal_brute_force(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = set()
    for d, t in docs:
        has = D.shingles(D.words_of(t), 5)
        for i, x in items:
            own = D.shingles(D.words_of(x), 5)
            if len(own & has) >= 0.8 * len(own):
                want.add((d, i))
    got = queries.op1_bm25_decontamination(spark, SF).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = D.keep_uncontaminated(table(spark, SF, "documents"), table(spark, SF, "benchmark"), block_chars=2000)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    blocks = D.contaminated(table(spark, SF, "documents"), table(spark, SF, "benchmark"), block_chars=2000)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got))


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as item_id")
    items = spark.createDataFrame([(None, "Alpha, beta gamma DELTA."), (2, None), (3, " ")], "item_id long, text string")
    got = D.contaminated(df, items).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(1, None, 1.0)] * 2
    assert D.contaminated(df, items.limit(0)).count() == 0 and D.contaminated(df.limit(0), items).count() == 0
    assert D.keep_uncontaminated(df, items).collect()[0].doc_id is None
