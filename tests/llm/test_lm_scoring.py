import math
import resource
import sys
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import attention, lm_scoring
from tidewatch.llm.common import WORD, lower_ascii, table

SF = "/root/testdata/sf0.001"
NAMES = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def brute(docs):
    said = {i: [*WORD.findall(lower_ascii(t or "")), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i in docs if not held[i] for w in said[i])
    bottom = c.total() + 0.1 * (len(c) + 1)
    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), c.total(), sum(math.log10((c[x] + 0.1) / bottom) for x in w)) for i, w in said.items()}


def tiny():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, 40)
    v = attention.Vocabulary(counts, 5, 4)
    p = {k: a.astype(float) for k, a in attention.start(v, 6, 5, 8).items()}
    return rng, v, p


def test_base_equals_brute_force_and_held_out_text_is_likelier(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows |= {10**6: None, 10**6 + 1: "", 10**6 + 2: " \t\x0b", 10**6 + 3: "É\x85x \x1fY \x1fy", 10**6 + 4: "Long words " * 20_000}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lm_scoring.score(df, chunk_bytes=50_000, share=1.0, rounds=1).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert [got[i][k] for k in NAMES[:-1]] == list(w[:-1]) and got[i].base_score == pytest.approx(w[-1])
        assert got[i].score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_ids for r in held) > -2.6


def test_training_reads_every_window_once_and_held_out_text_is_likely(spark, tmp_path):
    df = table(spark, SF, "documents")

    def counted(self, x, y, count):
        with open(tmp_path / f"{uuid.uuid4().hex}", "w") as f:
            f.write(str(int(count.sum())))
        return self.plain(x, y, count)

    def run(batches):
        if not hasattr(attention.Trainer, "plain"):  # workers serve several tasks
            attention.Trainer.plain = attention.Trainer.step
        attention.Trainer.step = counted
        yield from batches

    # Python workers are told to count by a step in the plan before training.
    docs = lm_scoring.stored(df.select(F.col("doc_id"), F.col("text").cast("binary")).mapInArrow(lambda b: lm_scoring._chunks(b, lm_scoring.tokens.default_vocabulary(), 8 << 20, 10), lm_scoring.ROWS), "chunks").where("kind = 1 and not held_out")
    lm_scoring.train(docs.mapInArrow(run, docs.schema), 49_408)
    want = sum(len(r.ids) // 4 for r in docs.collect())
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == want
    held = [r for r in lm_scoring.score(df).collect() if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_ids for r in held) > -2.6


def test_ids_past_the_first_window_see_at_least_32_inputs():
    width, d = attention.start(attention.Vocabulary(np.ones(200, np.int64)))["P"].shape
    stride = width - width // lm_scoring.STRIDE_OF
    _, first = attention.windows(1000, width, stride)
    assert width >= 64 and d >= 32 and first[1:].min() >= 32


def test_empty_table_and_repeated_rows(spark):
    shape = "doc_id long, text string, score string"
    assert lm_scoring.score(spark.createDataFrame([], shape)).collect() == []
    got = lm_scoring.score(spark.createDataFrame([(7, "a b", "x"), (7, "a b", "x"), (None, None, None)], shape)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "7", "None"]


def test_only_held_out_rows_give_an_even_model(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm_scoring.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-r.n_ids * math.log10(49_408), rel=1e-6)


def test_shares_of_all_ids_add_to_one():
    _, v, p = tiny()
    x = np.repeat(v.index[[1, 3, 9]][None], 40, axis=0)
    y = x.copy()
    y[:, 2] = v.index[np.arange(40)]
    last = np.zeros(x.shape, bool)
    last[:, 2] = True
    assert np.exp(attention.log_probs(p, v, x, y, last)).sum() == pytest.approx(1)


def test_masked_windows_see_no_later_id_and_each_target_counts_once():
    rng, v, p = tiny()
    docs = [rng.integers(0, 40, n) for n in (1, 5, 8, 9, 31, 200)]
    seen = np.zeros(len(docs), int)
    for _, _, _, doc in attention.batches(docs, v, 8, 6, 7):
        seen += np.bincount(doc, minlength=len(docs))
    assert seen.tolist() == [d.size for d in docs]
    x, y, count, _ = next(attention.batches(docs[2:3], v, 8, 6, 7))
    a = attention.log_probs(p, v, x, y, count)
    x[0, 5], y[0, 4] = x[0, 5] ^ 1, y[0, 4]
    assert np.allclose(attention.log_probs(p, v, x, y, count)[:5], a[:5])


def test_gradients_equal_differences():
    rng, v, p = tiny()
    x, y, count, _ = next(attention.batches([rng.integers(0, 40, n) for n in (1, 5, 20)], v, 8, 6, 99))
    _, dense, sparse = attention.gradients(p, v, x, y, count)
    for k, a in p.items():
        grad = np.zeros(a.shape)
        if k in dense:
            grad[...] = dense[k]
        else:
            grad[sparse[k][0]] = sparse[k][1]
        for _ in range(3):
            i = tuple(int(rng.integers(0, s)) for s in a.shape)
            was, loss = a[i], []
            for e in (1e-5, -1e-5):
                a[i] = was + e
                loss.append(attention.gradients(p, v, x, y, count)[0])
            a[i] = was
            assert (loss[0] - loss[1]) / 2e-5 / count.sum() == pytest.approx(grad[i], abs=1e-8)


def test_places_without_counted_targets_are_keys_alone():
    rng, v, p = tiny()
    docs = [rng.integers(0, 40, n) for n in (3, 8, 9, 31, 50, 200)]
    mixed = 0
    for x, y, count, _ in attention.batches(docs, v, 8, 4, 4):
        lo = attention._first(count)
        mixed += len(set(count.argmax(axis=1))) > 1
        whole, part = attention._body(p, x)[0], attention._body(p, x, lo)[0]
        assert part.shape[1] == x.shape[1] - lo and np.allclose(part, whole[:, lo:])
        assert not count[:, :lo].any()
    assert mixed <= 1  # windows of one first target come together


def test_inputs_as_keys_and_values_equal_a_head_with_matrices():
    rng, v, p = tiny()
    d = p["Q"].shape[0]
    x = v.index[rng.integers(0, 40, (2, 7))]
    query, key, value, out = rng.normal(size=(4, d, d))
    assert not {"K", "V"} & set(p)
    got = attention._body(p | {"Q": query @ key.T, "W": value @ out}, x)[0]
    for b in range(2):
        e = p["E"][x[b]] + p["P"][:7]
        for i in range(7):
            s = np.exp((e[: i + 1] @ key) @ (e[i] @ query) / np.sqrt(d))
            h = e[i] + (s / s.sum()) @ (e[: i + 1] @ value) @ out
            assert np.allclose(got[b, i], h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"])


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="counts page faults of glibc's allocator")
def test_steps_reuse_memory():
    rng = np.random.default_rng(0)
    v = attention.Vocabulary(rng.integers(1, 99, 2000))
    attention.keep_heap()
    t = attention.Trainer(attention.start(v), v)
    x, y, count, _ = next(attention.batches([rng.integers(0, 2000, 5000)], v, 64, 32, 64))
    for _ in range(5):
        t.step(x, y, count)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(10):
        t.step(x, y, count)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 1000  # else over 1000 a step


def test_trainers_report_every_id_of_the_training_texts_once(spark, monkeypatch):
    df = table(spark, SF, "documents").select("doc_id", F.col("text").cast("binary"))
    docs = lm_scoring.stored(df.mapInArrow(lambda b: lm_scoring._chunks(b, lm_scoring.tokens.default_vocabulary(), 8 << 20, 10), lm_scoring.ROWS), "chunks").where("kind = 1 and not held_out")
    plain, said = type(docs).repartition, []

    def repartition(self, *by):
        if self.columns == ["part", "total", "n"]:  # what a round's trainers report
            said.append(self.where("part = 0").agg(F.sum("n")).first()[0])
        return plain(self, *by)

    monkeypatch.setattr(type(docs), "repartition", repartition)
    lm_scoring.train(docs, 49_408)
    assert len(said) == 3 and sum(said) == sum(len(r.ids) // 4 for r in docs.collect())


def test_softmax_within_classes_equals_each_row_alone_also_beyond_the_range_of_exp():
    rng, v, p = tiny()
    g, y = rng.normal(size=(300, 6)), rng.integers(0, v.seen, 300)
    cls = v.class_of[y]
    for scale in (1, 1e4):
        q = p | {"O": p["O"] * scale}
        rows, logs, _, flat, place, total, parts = attention._within(q, v, g, cls, y)
        assert sorted(rows) == np.flatnonzero((cls >= v.heads) & (cls < v.classes - 1)).tolist()
        assert len(parts) == len(set(cls[rows])) and sum(u.size for _, _, u in parts) == flat.size
        assert np.allclose(flat[place] / total, np.exp(logs))
        for i, got in zip(rows, logs):
            a, b = v.first[cls[i]], v.first[cls[i] + 1]
            z = q["O"][a:b] @ g[i] + q["o"][a:b]
            z -= z.max()
            assert got == pytest.approx(z[y[i] - a] - np.log(np.exp(z).sum()), rel=1e-9, abs=1e-9)
