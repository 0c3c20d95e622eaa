"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items are the indexed documents, training passages are the queries.
Impacts are BM25 weights divided by the item's own score, so a passage's score is
the share of the item's BM25 mass that its distinct words hold and one threshold
serves all items.  Items are put into classes by length (powers of two, ``LEAST`` words
at least); a class's passages are windows of twice its length that overlap by half,
so an item that a document quotes lies whole in some passage, and a passage's width
depends on the items it is compared with alone.

Every passage is queried and all items at or above the threshold are retrieved,
exactly.  A first pass bounds all passages of a batch at once: items are put into
at most ``BLOCKS`` blocks, frequent terms whose impacts sum to at most half the
threshold in every item are set aside, and a passage whose other words' block
maxima stay under the rest of the threshold in every block can't reach it.
Block-max WAND retrieves the items of the other passages.  A hit counts only if the
item's question and its answer both overlap the passage by word shingles.

An item's answer follows a question mark or an ``Answer:`` mark; without either it
is the last sentence.  An item of one sentence is question and answer at once.

Indexes hold at most ``block_chars`` characters of items (and one item) each and
are broadcast one by one, with document frequencies over all items from a table of
Spark's; each is one pass over the documents, and results don't depend on it.

Defined cases: null, empty and wordless texts and items match nothing; repeated
rows are judged each; an item id may be null; without items no row is hit; of
passages with equal scores and overlaps the first is named.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"(?i)\banswer\s*:|\?")
_SENTENCE = re.compile(r"[.!?](?=\s)|\n")
K1, B = 1.2, 0.75
LEAST = 64
BLOCKS = 256
_SEGMENTS = 4096  # half passages whose bounds are held at a time

_ASCII = bytes(range(128))
#: Of texts of ASCII and the letters À to ÿ only: words in lower case, all else blank (second bytes of À to Þ are 0x80 to 0x9E).
_TABLE = bytes(ord(chr(c).lower()) if chr(c).isalnum() or c == 95 else 32 for c in range(128)) + bytes(c + 32 if c < 0x9F else c for c in range(128, 256))
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(text: bytes | None) -> list[bytes]:
    """``words_of`` in UTF-8."""
    if not text:
        return []
    if _LATIN.fullmatch(text.translate(None, _ASCII)):
        return text.translate(_TABLE).split()
    return [w.encode() for w in words_of(text.decode("utf-8", "replace"))]


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer."""
    marks = [m for m in _ANSWER.finditer(text)]
    for m in marks:
        question, answer = words_of(text[: m.start()]), words_of(text[m.end() :])
        if question and answer:
            return question, answer
    for m in reversed(list(_SENTENCE.finditer(text))):
        question, answer = words_of(text[: m.end()]), words_of(text[m.end() :])
        if question and answer:
            return question, answer
    return words_of(text), words_of(text)


def shingles(words: list, n: int) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Class:
    """Items of one length class over a common vocabulary of ``size`` terms.

    Postings by term: items ascending, impacts and the largest impact of each
    ``block`` postings; beside them what the bounds need.
    """

    def __init__(self, stride: int, items: list[tuple[int, list[int], list[int], dict[int, float]]], size: int, threshold: float, shingle: int, block: int):
        self.stride, self.block, self.threshold = stride, block, threshold
        self.at = [i for i, _, _, _ in items]
        self.question = [shingles(q, shingle) for _, q, _, _ in items]
        self.answer = [shingles(a, shingle) for _, _, a, _ in items]
        self.items: dict[int, list[int]] = {}
        self.impacts: dict[int, list[float]] = {}
        for i, (_, _, _, impacts) in enumerate(items):
            for t, w in impacts.items():
                self.items.setdefault(t, []).append(i)
                self.impacts.setdefault(t, []).append(w)
        self.block_max = {t: [max(p[k : k + block]) for k in range(0, len(p), block)] for t, p in self.impacts.items()}
        self.most = np.zeros(size + 1)  # the last stands for unknown words
        for t, p in self.impacts.items():
            self.most[t] = max(p)
        self._bounds(len(items), size)

    def _bounds(self, n: int, size: int) -> None:
        """Terms set aside, and the block maxima of the others as flat lists by term."""
        slack = np.zeros(n)
        aside = set()
        for t in sorted(self.items, key=lambda t: (-len(self.items[t]), t)):
            with_it = slack[self.items[t]] + self.impacts[t]
            if len(self.items[t]) > 1 and with_it.max() <= self.threshold / 2:
                slack[self.items[t]] = with_it
                aside.add(t)
        per = -(-n // BLOCKS)
        self.blocks = -(-n // per)
        self.need = self.threshold - 1e-6 - np.array([slack[k * per : (k + 1) * per].max() for k in range(self.blocks)])
        count, blk, imp = np.zeros(size + 1, np.int64), [], []
        for t in sorted(self.items):
            if t not in aside:
                best: dict[int, float] = {}
                for i, w in zip(self.items[t], self.impacts[t]):
                    best[i // per] = max(w, best.get(i // per, 0.0))
                count[t] = len(best)
                blk.extend(best)
                imp.extend(best.values())
        self.count, self.first = count, np.cumsum(count) - count
        self.blk, self.imp = np.array(blk, np.int64), np.array(imp)

    def passages(self, ids: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, word after the last) of the passages that may reach the threshold; ``ids``: the texts' terms, ``n`` words each."""
        s = self.stride
        starts = np.cumsum(n) - n
        halves = -(-n // s)
        base = np.cumsum(halves) - halves
        total = int(halves.sum())
        if not total:
            return
        text = np.repeat(np.arange(n.size), halves)
        nth = np.arange(total) - base[text]
        at = np.flatnonzero(self.count[ids])
        of = np.searchsorted(starts, at, "right") - 1
        # an empty text begins where the next one does: the last of them has the word
        half, term = base[of] + (at - starts[of]) // s, ids[at]
        for a in range(0, total, _SEGMENTS):
            z = min(a + _SEGMENTS + 1, total)
            lo, hi = np.searchsorted(half, [a, z])
            k = self.count[term[lo:hi]]
            entry = np.repeat(self.first[term[lo:hi]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            cell = np.repeat(half[lo:hi] - a, k) * self.blocks + self.blk[entry]
            sums = np.bincount(cell, self.imp[entry], (z - a) * self.blocks).reshape(-1, self.blocks)
            whole = sums.copy()
            whole[:-1] += sums[1:] * (text[a + 1 : z] == text[a : z - 1])[:, None]
            some = (whole >= self.need).any(axis=1) & (nth[a:z] < np.maximum(halves[text[a:z]] - 1, 1))
            for g in (np.flatnonzero(some[: min(_SEGMENTS, z - a)]) + a).tolist():
                d, begin = int(text[g]), int(nth[g]) * s
                yield d, begin, min(begin + 2 * s, int(n[d]))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose impacts over ``terms`` sum to the threshold or more, by block-max WAND."""
        from bisect import bisect_left

        found, cursors = [], [[self.items[t][0], t, 0] for t in terms]
        near = self.threshold - 1e-9  # sums in another order may differ by a rounding
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= near:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            held = cursors[: pivot + 1]
            # bounds of the blocks that would hold the pivot item
            blocks = [bisect_left(self.items[t], item, at) // self.block for _, t, at in held]
            if sum(self.block_max[t][b] for (_, t, _), b in zip(held, blocks) if b < len(self.block_max[t])) >= near:
                if cursors[0][0] == item:
                    score = math.fsum(self.impacts[t][at] for _, t, at in held)
                    if score >= near:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                # no item up to the end of these blocks, or before the next cursor, can reach it
                ends = [self.items[t][min((b + 1) * self.block, len(self.items[t])) - 1] + 1 for (_, t, _), b in zip(held, blocks) if b < len(self.block_max[t])]
                if pivot + 1 < len(cursors):
                    ends.append(cursors[pivot + 1][0])
                target = max(min(ends, default=item + 1), item + 1)
            for c in held:
                c[2] = bisect_left(self.items[c[1]], target, c[2])
                c[0] = self.items[c[1]][c[2]] if c[2] < len(self.items[c[1]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def hits(self, ids: np.ndarray, n: np.ndarray, overlap: float, best: list[dict]) -> None:
        """Put the verified items of each text into its ``best``: item to (score, overlaps, -first word) of its best passage."""
        starts = np.cumsum(n) - n
        for d, a, z in self.passages(ids, n):
            passage = ids[starts[d] + a : starts[d] + z]
            inside = np.unique(passage)
            inside = inside[self.most[inside] > 0]
            # the same bounds with each word once
            k = self.count[inside]
            entry = np.repeat(self.first[inside] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            if not (np.bincount(self.blk[entry], self.imp[entry], self.blocks) >= self.need).any():
                continue
            has: dict[int, set] = {}
            for item, score in self.search(inside.tolist()):
                shares = []
                for part in (self.question[item], self.answer[item]):
                    size = len(next(iter(part)))
                    if size not in has:
                        has[size] = shingles(passage.tolist(), size)
                    shares.append(len(part & has[size]) / len(part))
                if min(shares) >= overlap and (got := (score, *shares, -a)) > best[d].get(self.at[item], (-1, 0, 0, 0)):
                    best[d][self.at[item]] = got


class Index:
    """Classes of items (id, text) and the vocabulary they share; ``frequency`` has the items with each term, of ``total`` in all."""

    def __init__(
        self, items: list[tuple[int | None, str]], frequency: dict[bytes, int], total: int, mean_length: float, threshold: float = 0.5, shingle: int = 5, block: int = 64
    ):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        classes: dict[int, list] = {}

        def number(words: list[str]) -> list[int]:
            return [self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in words]

        for at, (_, text) in enumerate(items):
            words = words_of(text)
            question, answer = (number(part) for part in parts_of(text))
            norm = K1 * (1 - B + B * len(words) / mean_length)
            said = Counter(words)
            weights = {t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in ((w.encode(), n) for w, n in said.items())}
            own = sum(weights.values())
            impacts = {self.vocabulary.setdefault(t, len(self.vocabulary)): w / own for t, w in weights.items()}
            classes.setdefault(max(LEAST, 1 << (len(words) - 1).bit_length()), []).append((at, question, answer, impacts))
        self.classes = [Class(stride, held, len(self.vocabulary), threshold, shingle, block) for stride, held in sorted(classes.items())]

    def hits(self, bodies: list[bytes | None], overlap: float) -> list[list[tuple[int, float, float, float, int]]]:
        """Verified items of each text: (item, score, question overlap, answer overlap, first word of the passage), best passage of each."""
        said = [terms_of(t) for t in bodies]
        n = np.array([len(w) for w in said], np.int64)
        best: list[dict] = [{} for _ in bodies]
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(said), repeat(-1)), np.int64, int(n.sum()))
        for c in self.classes:
            c.hits(ids, n, overlap, best)
        return [[(i, s, q, r, -a) for i, (s, q, r, a) in sorted(b.items())] for b in best]


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in texts(batches):
        words = [words_of(t) for t in b.column(1).to_pylist()]
        terms = [[t.encode() for t in set(w)] for w in words]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(w) for w in words], pa.int64()), pa.array(terms, pa.list_(pa.binary()))], ["i", "t", "n", "terms"])


def indexes(items: DataFrame, threshold: float = 0.5, id_col: str = "item_id", text_col: str = "text", block_chars: int = 2_000_000, shingle: int = 5) -> Iterator[Index]:
    """Indexes of blocks of items, ordered by id and text; statistics are over all items and only a block's reach the driver."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(_said, "i long, t string, n long, terms array<binary>")
    rows = stored(rows.where("n > 0"), "items")
    sums = rows.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("words")).first()
    if not sums.total:
        return
    frequency = stored(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")

    def made(held: list[tuple[int | None, str]]) -> Index:
        terms = sorted({w.encode() for _, t in held for w in words_of(t)})
        of = spark.createDataFrame([(t,) for t in terms], "term binary")  # at most block_chars characters and an item's
        seen = {bytes(r.term): r.df for r in frequency.join(F.broadcast(of), "term").collect()}
        return Index(held, seen, sums.total, sums.words / sums.total, threshold, shingle)

    held, size = [], 0
    for r in rows.select("i", "t").orderBy("i", "t").toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t)
        if size >= block_chars:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"


def contaminated(
    df: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2_000_000
) -> DataFrame:
    """One row per row of ``df`` and item that it holds: doc_id, item_id, score, overlaps and the passage's first word."""
    names = [c.split()[0] for c in HITS.split(", ")]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sc = df.sparkSession.sparkContext
    out = None
    for index in indexes(items, threshold, block_chars=block_chars):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in texts(batches):
                found = index.hits(b.column(1).to_pylist(), overlap)
                got = [(d, index.ids[i], *rest) for d, hits in zip(b.column(0).to_pylist(), found) for i, *rest in hits]
                if got:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)

        part = rows.mapInArrow(run, HITS)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], HITS)


def keep_uncontaminated(df: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.6, text_col: str = "text", block_chars: int = 2_000_000) -> DataFrame:
    """The rows of ``df`` that hold no item, columns unchanged."""
    at = df.columns.index(text_col)
    sc = df.sparkSession.sparkContext
    for index in indexes(items, threshold, block_chars=block_chars):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in texts(batches):
                found = sent.value.hits(b.column(at).cast(pa.binary()).to_pylist(), overlap)
                yield b.filter(pa.array([not hits for hits in found], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
