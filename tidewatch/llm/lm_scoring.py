"""Scores of whole texts by a causal self-attention model, beside a word unigram base.

One pass reads the texts: it stores each document's subword ids and, in chunks of
bounded text, the chunk's distinct words once, with each document's words as
places in that list.  Word counts come from these lists by one shuffle and go
back to the chunks by another, so no word table is ever broadcast or collected
and a frequent word costs a row per chunk.

The model (``attention``) takes its classes and first biases from the id counts
of all training documents.  Its weights learn in ``rounds``: each trainer steps
through its part of the round's windows from the same weights, and the results
are averaged, weighted by ids.  There is a trainer for every ``per_trainer`` ids,
so training grows with the input.  Every training window is read once: a round
takes the windows that a hash of document content and place deals to it (``share``
below 1 takes that part of them over all rounds; no query does).

Defined cases: null and empty text have the end token alone; a document without
an id is in training or held out by the checksum of an empty string; repeated rows are
scored each; an empty table gives no rows.  A text is held by one task at a time,
whatever its length; its windows are scored in groups of bounded size.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, tokens
from .common import grows, stored, texts

ROWS = "chunk long, kind int, pos int, word binary, n long, doc_id long, held_out boolean, n_tokens long, at binary, tf binary, ids binary"
STRIDE_OF = 2  # windows overlap by half their width, so a later id sees at least that much
_GROUP = 1024
_SLICE = 1 << 16


def _places() -> dict[bytes, int]:
    """A word that is looked up and not there gets the next place."""
    places = defaultdict()
    places.default_factory = places.__len__
    return places


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: str, limit: int, mod: int) -> Iterator[pa.RecordBatch]:
    encoder = tokens.encoder(vocabulary)
    end = np.array([tokens.END_ID], "<u4").tobytes()
    chunk, size, words, train = TaskContext.get().partitionId() << 32, 0, _places(), []
    schema = pa.schema(
        [("chunk", pa.int64()), ("kind", pa.int32()), ("pos", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_())]
        + [("n_tokens", pa.int64()), ("at", pa.binary()), ("tf", pa.binary()), ("ids", pa.binary())]
    )

    def close() -> Iterator[pa.RecordBatch]:
        said = list(words)
        at, n = map(np.concatenate, zip(*train)) if train else ([], [])
        times = np.bincount(at, n, len(said)).astype(np.int64) if train else np.zeros(len(said), np.int64)  # exact below 2**53
        for a in range(0, len(said), 10_000):
            part = said[a : a + 10_000]
            k = len(part)
            cols = [np.full(k, chunk), np.zeros(k, np.int32), np.arange(a, a + k, dtype=np.int32), pa.array(part, pa.binary()), times[a : a + k]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols] + [pa.nulls(k, f.type) for f in list(schema)[5:]], schema=schema)

    for b in texts(batches, 64):
        bodies = [t or b"" for t in b.column(1).to_pylist()]
        out = []
        for doc, body, ids in zip(b.column(0).to_pylist(), bodies, encoder.encode_many(bodies)):
            held = zlib.crc32(b"" if doc is None else str(doc).encode()) % mod == 0
            said = body.lower().split()
            said.append(b"")  # the end, which no word equals
            at, n = np.unique(np.fromiter(map(words.__getitem__, said), np.uint32, len(said)), return_counts=True)
            n = n.astype(np.uint32)
            if not held:
                train.append((at, n))
            out.append((chunk, 1, 0, None, None, doc, held, len(said), at.tobytes(), n.tobytes(), ids + end))
            size += len(body)
            if size > limit:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                yield from close()
                chunk, size, words, train, out = chunk + 1, 0, _places(), [], []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if words:
        yield from close()


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column.to_pylist()]


def id_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; at most ``size`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in texts(batches):
            for d in _ids(b.column(0)):
                total += np.bincount(d, minlength=size) if d.size > size else 0
                if d.size <= size:
                    np.add.at(total, d, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = docs.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in found.collect():
        counts[r.id] = r.n
    return counts


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(docs: DataFrame, size: int, rounds: int = 3, share: float = 1.0, per_trainer: int = 1_000_000, **shape: int) -> tuple[attention.Vocabulary, dict]:
    """Classes and weights from the rows of ``docs`` (ids)."""
    counts = id_counts(docs, size)
    v = attention.Vocabulary(counts)
    p = attention.start(v, **shape)
    width = p["P"].shape[0]
    stride = width - width // STRIDE_OF
    trainers = max(1, int(counts.sum() * share / rounds) // per_trainer)
    sc = docs.sparkSession.sparkContext
    for turn in range(rounds if v.seen else 0):
        sent = sc.broadcast(p)  # at most (size x (2d + 1)) numbers, whatever the input

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            attention.keep_heap()
            t = attention.Trainer(sent.value, v)
            for b in texts(batches, 200):
                ids = _ids(b.column(0))
                seeds = [zlib.crc32(d[:4096].tobytes(), d.size) for d in ids]

                def pick(i: int, starts: np.ndarray) -> np.ndarray:
                    place = (starts.astype(np.uint64) * 2654435761 + seeds[i]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                    u = place / 2**24 / share * rounds
                    return (u >= turn) & (u < turn + 1)

                for x, y, count, _ in attention.batches(ids, v, width, stride, 64, pick):
                    t.step(x, y, count)
            if t.tokens:
                flat = _flat(t.p).astype(np.float64) * t.tokens
                cut = [flat[a : a + _SLICE].tobytes() for a in range(0, flat.size, _SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary()), pa.array([t.tokens] * len(cut), pa.int64())], ["part", "total", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for part, total, n in zip(*(c.to_pylist() for c in b.columns)):
                    have = sums.setdefault(part, [0.0, 0])
                    have[0] = have[0] + np.frombuffer(total)
                    have[1] += n
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / n).tobytes() for s, n in sums.values()], pa.binary())], ["part", "mean"])

        learnt = docs.select("ids").coalesce(trainers).mapInArrow(run, "part int, total binary, n long")
        means = sorted(learnt.repartition("part").mapInArrow(add, "part int, mean binary").collect())
        if means:
            p = _shaped(np.concatenate([np.frombuffer(m.mean) for m in means]), p)
    return v, p


def score_ids(docs: list[np.ndarray], v: attention.Vocabulary, p: dict) -> np.ndarray:
    """Log10 probability of each id sequence, its end id included."""
    width = p["P"].shape[0]
    out = np.zeros(len(docs))
    for x, y, count, doc in attention.batches(docs, v, width, width - width // STRIDE_OF, _GROUP):
        out += np.bincount(doc, weights=attention.log_probs(p, v, x, y, count), minlength=len(docs))
    return out / np.log(10)


def score(
    df: DataFrame,
    vocabulary: str | None = None,
    hold_mod: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 8 << 20,
    **training,
) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids."""
    path = vocabulary or tokens.default_vocabulary()
    size = tokens.encoder(path).size
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    made = stored(rows.mapInArrow(lambda b: _chunks(b, path, chunk_bytes, hold_mod), ROWS), "chunks", compression="zstd")
    docs = made.where("kind = 1")
    v, p = train(docs.where("not held_out"), size, **training)

    lists = made.where("kind = 0").select("chunk", "pos", "word", "n")
    counts = stored(lists.groupBy("word").agg(F.sum("n").alias("c")), "word_counts")
    total = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train = total.n
    bottom = n_train + 0.1 * (total.v + 1)
    sent = df.sparkSession.sparkContext.broadcast((v, p))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attention.keep_heap()
        vocab, weights = sent.value
        for b in texts(batches, 200):
            ids = _ids(b.column(5))
            got = score_ids(ids, vocab, weights)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(6), pa.array(got), pa.array([d.size for d in ids], pa.int64())], names)

    names = ["chunk", "doc_id", "held_out", "n_tokens", "at", "tf", "score", "n_ids"]
    types = "chunk long, doc_id long, held_out boolean, n_tokens long, at binary, tf binary, score double, n_ids long"
    scored = docs.select("chunk", "doc_id", "held_out", "n_tokens", "at", "ids", "tf").mapInArrow(model, types)
    known = lists.join(grows(counts), "word").select("chunk", "pos", "c")
    both = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [known.withColumn("kind", F.lit(0)), scored.withColumn("kind", F.lit(1))],
    ).select("chunk", "kind", "pos", "c", *names[1:])

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, table = None, [], np.empty(0, np.int64)
        for b in texts(batches, 4096):
            of, kind, c = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, of.size]):
                if of[a] != chunk:
                    chunk, parts = of[a], []
                if kind[a] == 0:
                    parts.append(c[a:z].astype(np.int64))
                    continue
                table = np.concatenate(parts)  # places come in order, without gaps
                parts = [table]
                logs = np.log10((table + 0.1) / bottom)
                part, got = b.slice(a, z - a), []
                for at, tf in zip(part.column(7).to_pylist(), part.column(8).to_pylist()):
                    at, tf = np.frombuffer(at, np.uint32), np.frombuffer(tf, np.uint32)
                    got.append((float(logs[at] @ tf), int(tf[table[at] > 0].sum())))
                sums, hits = zip(*got)
                col = [part.column(k) for k in (4, 5, 6)]
                yield pa.RecordBatch.from_arrays(
                    [*col, pa.array(hits, pa.int64()), pa.array([n_train] * (z - a), pa.int64()), pa.array(sums, pa.float64()), part.column(9), part.column(10)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_ids"],
                )

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind", "pos").mapInArrow(
        base, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_ids long"
    )
