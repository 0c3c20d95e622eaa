import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import quality
from tidewatch.llm.common import WORD, table

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, "é ß 🙂 x\x1fy\x85z\n#<>\n#<>\n\r#<>"]
    texts += ["".join(rng.choice("ab \n|é") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += [r.text for r in table(spark, SF, "documents").limit(200).collect()] + ["w " * 3000 + " ".join(f"u{i}" for i in range(20000))]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = quality.risk_controlled(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    for r in got:
        assert tuple(r)[1:6] == brute(texts[r.doc_id]), repr(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept != r.base_failed
    assert len(got) == len(texts)


def test_binomial_tail(spark):
    cases = [(0, 0, 0.05), (0, 10, 0.05), (3, 100, 0.05), (40, 1000, 0.05), (900, 20000, 0.05), (0, 20000, 0.05), (5, 50, 0.1)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in df.select("*", quality.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("got")).collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(r.p) + (r.n - j) * math.log(1 - r.p) for j in range(r.k + 1)]
        assert math.isclose(r.got, math.fsum(map(math.exp, logs)), rel_tol=1e-6, abs_tol=1e-300)


def test_steps_are_certified_and_useful(spark):
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        bad = i % 10 == 0
        words = [f"w{rng.randint(0, 10**6)}" + ("$$$" if bad and rng.random() < 0.6 else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i % 2 else None, 0 if bad else 1))
    rows += [(6000 + i, " ".join(f"v{i}x{j}" for j in range(30)), "rare", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = {r.doc_id: r.kept for r in quality.risk_controlled(df, df.select("doc_id", "quality")).collect()}
    good = [got[r[0]] for r in rows if r[3] == 1]
    assert sum(good) >= 0.97 * len(good)
    assert not any(got[r[0]] for r in rows if r[3] == 0)
    assert all(got[r[0]] for r in rows if r[2] == "rare")
    kept = quality.keep_good(df, df.select("doc_id", "quality"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, k in got.items() if k}


def test_one_telling_feature_among_noisy_ones_is_certified(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        word = lambda: rng.choice("AbCdEfgh") * rng.randint(1, 9)
        lines = [" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(12)]
        lines += rng.choices(lines, k=rng.randint(0, 3))
        rows.append((i, "\n".join(lines) + (" ## $$ ##" if bad else ""), "de", 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = {r.doc_id: (r.kept, r.base_failed) for r in quality.risk_controlled(df, df.select("doc_id", "quality")).collect()}
    assert not any(got[r[0]][0] for r in rows if r[3] == 0)
    good = [got[r[0]] for r in rows if r[3] == 1 and not got[r[0]][1]]
    assert len(good) > 200 and sum(not kept for kept, _ in good) <= 0.05 * len(good)


def test_ties_at_a_cutoff_are_kept(spark):
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(30)) + " #" * (i % 2), "en", 1) for i in range(300)] + [(1000 + i, " ".join(f"b{i}x{j}" for j in range(30)) + " # #", "en", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = {r.doc_id: r.kept for r in quality.risk_controlled(df, df.select("doc_id", "quality")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(60))


def test_repeats_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a " * 5, "en", 1), (1, "a " * 5, "en", 2), (None, None, None, 3)], "doc_id long, text string, lang string, n_words int").withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.risk_controlled(df, labels).count() == 3
    assert quality.keep_good(df, labels).count() == 0
    assert quality.risk_controlled(df.limit(0), labels).count() == 0
