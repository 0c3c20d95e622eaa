import math

from pyspark.sql import functions as F

from tidewatch.llm import queries, toxicity
from tidewatch.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def test_folding():
    for written in ("idiot", "1D10T", "ІDІОT", "ｉｄｉöｔ", "id​iot", "ïdiot!!", "idiot$$$"):
        assert toxicity.fold(f"an {written} here") == " an idiot here ", written
    assert toxicity.fold("$tupid ca$h 5") == " stupid cash s "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" \n ").replace("  ", " ") == " "


def naive(folded, model):
    words = folded.split()
    spans = []
    for e in model.exceptions:
        at = folded.find(e)
        while at >= 0:
            spans.append((at, at + len(e)))
            at = folded.find(e, at + 1)
    total = 0.0
    for at, c in enumerate(folded):
        if c == " ":
            best = max([w for e, w in model.entries.items() if folded.startswith(e, at)], default=0.0)
            if best > 0 and not any(a <= at and at + 1 < b for a, b in spans):
                total += best
    return total, len(words)


def test_hits_equal_a_plain_search():
    model = toxicity.Lexicon({" bad ": 2.0, " ba": 1.0, " awful": 3.0}, [" not bad ", " bad luck "])
    automaton = model.automaton()
    for text in ("bad", "not bad at all", "bad luck, bad day", "awfully bad band", "", "good", "bad bad bad luck", "BAD\nB4D", "bad " * 5000):
        folded = toxicity.fold(text)
        got, want = toxicity.weigh(folded, automaton), naive(folded, model)
        assert math.isclose(got[0], want[0]) and got[1] == want[1], text


def test_fit_finds_words_beginnings_and_exceptions():
    rows = [(f"w{i} you bad{'xyz'[i % 3]} x{i % 7} thing n{i}", 1) for i in range(60)]
    rows += [(f"w{i} a scum n{i}", 1) for i in range(60)]
    rows += [(f"w{i} you are a fine thing x{i % 7} day n{i} bath bade", 0) for i in range(400)]
    rows += [(f"w{i} pond scum n{i}", 0) for i in range(20)]
    model = toxicity.fit(rows + [(None, None), ("", 0)])
    assert " scum " in model.entries and " pond scum " in model.exceptions
    automaton = model.automaton()
    said = lambda t: model.score(*toxicity.weigh(toxicity.fold(t), automaton))
    assert said("you 5cum there") > 0.5 and said("you b4dx there") > 0.5
    assert said("a pond scum lake") < 0.5 and said("fine") < 0.5 and said("") < 0.5 and said(None) < 0.5


def test_no_or_only_toxic_labels():
    assert toxicity.fit([]).score(0, 0) == toxicity.fit([("a", 0)]).score(0, 0) < 1e-9
    assert toxicity.fit([("a", 1)]).score(0, 0) > 0.5


def test_held_out_rows_are_told_apart(spark):
    got = queries.op4_toxicity_lexicon(spark, SF)
    labels = table(spark, SF, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    assert got.count() == table(spark, SF, "documents").count()


def test_filter_keeps_columns(spark):
    df = spark.createDataFrame([(1, "you scum", "a"), (2, None, None), (2, None, None)], "doc_id long, text string, score string")
    model = toxicity.Lexicon({" scum ": 5.0}, [], (2.0, 0.0, -1.0))
    kept = toxicity.keep_clean(df, model)
    assert kept.schema == df.schema and [r.doc_id for r in kept.collect()] == [2, 2]
    empty = table(spark, SF, "documents").limit(0)
    assert toxicity.keep_clean(empty, model).count() == 0
    assert toxicity.score_rows(empty, model).count() == 0
    assert list(toxicity.sample(empty, table(spark, SF, "labels"), ~held_out(5), 10)) == []
    assert toxicity.fit_sample(empty, table(spark, SF, "labels"), ~held_out(5), 10) == toxicity.fit([])


def brute_score(text, model):
    """Hits by trying every entry at every place, without an automaton."""
    folded = toxicity.fold(text)
    words = max(folded.count(" ") - 1, 0)
    spans = [(i, i + len(p) - 1) for p in model.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    total = 0.0
    for i in range(len(folded)):
        weight = max((w for p, w in model.entries.items() if folded.startswith(p, i)), default=0.0)
        if weight > 0 and not any(a <= i and i + 1 <= b for a, b in spans):
            total += weight
    return model.score(total if words else 0.0, words)


def test_fit_and_scores_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(toxicity.sample(docs, labels, ~held_out(5), 20_000))
    got = {r.doc_id: r.score for r in toxicity.score_rows(docs, model).collect()}
    rows = docs.join(labels.where("toxic is not null"), "doc_id").where(held_out(5)).select("doc_id", "text", "toxic").collect()
    for r in rows[:150]:
        assert abs(got[r.doc_id] - brute_score(r.text, model)) < 1e-9
    caught, wrong = [got[r.doc_id] >= 0.5 for r in rows if r.toxic], [got[r.doc_id] >= 0.5 for r in rows if not r.toxic]
    assert sum(caught) >= 0.85 * len(caught) > 50 and sum(wrong) <= 0.01 * len(wrong)


def test_long_words_and_repeated_ids(spark):
    rows = [("x" * 50_000 + " bad", 1)] * 5 + [(f"a{chr(97 + i % 26)}b{chr(97 + i // 26)} awful{chr(97 + i % 26)}{chr(97 + i // 26)} z{chr(97 + i % 26)}q{chr(97 + i // 26)}", 1) for i in range(40)] + [(f"a{chr(97 + i % 26)}b{chr(97 + i // 26)} fine z{chr(97 + i % 26)}q{chr(97 + i // 26)}", 0) for i in range(200)]
    model = toxicity.fit(rows)
    assert " awful" in model.entries and sum(map(len, model.entries)) < 200_000
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = [list(toxicity.sample(df.orderBy(F.rand(k)), labels, F.lit(True), 10)) for k in range(3)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2


def test_fit_in_a_task_equals_fit_of_the_sample(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    for rows, size in ((20_000, 128 << 20), (400, 128 << 20), (20_000, 200_000)):
        want = toxicity.fit(toxicity.sample(docs, labels, ~held_out(5), rows, max_bytes=size))
        assert toxicity.fit_sample(docs, labels, ~held_out(5), rows, max_bytes=size) == want
