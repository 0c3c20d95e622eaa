"""Near copies by SimHash, completed by exact Jaccard similarity of word-shingle sets.

A document is its set of distinct word shingles, each by its XXH64; documents link
if their sets have similarity ``NEAR`` (four fifths) or more.  Fingerprints within
``RADIUS`` bits come first: their documents link if the sets confirm it.  SimHash can't
find all pairs: at 0.8 about a seventh of a fingerprint's bits differ, and covering
masks for that many bits run into the tens of thousands.  What is not linked then
meets by prefixes, which miss no pair: if all sets are put into one common order,
two sets with an overlap of four fifths of the larger share a shingle among the
first ``n - ceil(4n/5) + 1`` of each.  The order is by a sketch of shingle counts, rare
ones first, so text that many documents share makes few candidates.  Each
candidate is confirmed on the whole sets.

Equal sets collapse to one node, the digest of the set, before the pairs.  Where only
components matter, a group of near copies links through leaders, not in all pairs.

Defined cases: a text of fewer words than a shingle is one shingle; null and
wordless texts have the empty set and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, grows, put, release, stored, texts
from .simhash import SEED, components, hashes, links, majority, rank

NEAR = (4, 5)
RADIUS = 4  # bits in which linked fingerprints differ, at most
_SLOTS = 1 << 20
_BROADCAST = 2_000_000  # node ids (8 bytes each)
_PARITY = ("x0", "x1", "x2", "x3")  # 256 bits of a set
_COUNTERS = 64  # tasks that count for the sketch, at most


def shingles(text: bytes, words: int = 5, hasher=xxhash.xxh64_intdigest) -> np.ndarray:
    """Sorted hashes of the distinct shingles of UTF-8 ``text``."""
    return np.unique(hashes(text, words, hasher))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """Columns row, node, fp (SimHash of the shingles, repeats included), grams and ``_PARITY`` of rows (row, text): a parity bit is set if an odd number of shingles falls on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches, 64):
            said = [hashes(t or b"", words) for t in b.column(1).to_pylist()]
            grams, fps = [np.unique(h) for h in said], np.array([majority(h) for h in said], np.uint64).view(np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in grams], np.uint64).view(np.int64)
            ends = np.cumsum([0, *(g.size for g in grams)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams).view(np.int64)))
            parity = np.array([np.packbits(np.bincount((g & np.uint64(255)).astype(np.int64), minlength=256) & 1) for g in grams], np.uint8)
            bits = [pa.array(c) for c in np.ascontiguousarray(parity.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes), pa.array(fps), lists, *bits], ["row", "node", "fp", "grams", *_PARITY])

    return rows.mapInArrow(run, f"row long, node long, fp long, grams array<long>, {', '.join(f'{c} long' for c in _PARITY)}")


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(44)).astype(np.int64)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values and the offsets into them."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def sketch(sets: DataFrame) -> np.ndarray:
    """How often shingles of each slot occur; ``_COUNTERS`` rows of ``_SLOTS`` numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for b in batches:
            total += np.bincount(_slot(_lists(b.column(0))[0]), minlength=_SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for b in batches:
            for c in b.column(0):
                total += np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    made = sets.select("grams").coalesce(_COUNTERS).mapInArrow(run, "counts binary").repartition(1).mapInArrow(add, "counts binary")
    return np.frombuffer(made.first().counts, np.int64)


def _prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """Columns gram, node, n (shingles of the set) and pos (place in the common order)."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    over, under = NEAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches):
            values, at = _lists(b.column(1))
            n = np.diff(at)
            doc = np.repeat(np.arange(n.size), n)
            values = values[np.lexsort((values, sent.value[_slot(values)], doc))]
            pos = np.arange(values.size) - at[:-1][doc]
            first = pos <= n[doc] - (over * n[doc] + under - 1) // under
            cols = [values[first], b.column(0).to_numpy()[doc[first]], n[doc[first]].astype(np.int32), pos[first].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "node", "n", "pos"])

    return sets.select("node", "grams").mapInArrow(run, "gram long, node long, n int, pos int")


def _shared(sets: DataFrame) -> DataFrame:
    """Rows (gram, node, n, pos) of prefixes whose shingle another node's prefix has too."""
    gram = Window.partitionBy("gram")
    found = (
        _prefixes(sets, sketch(sets))
        .withColumns({"lo": F.min("node").over(gram), "hi": F.max("node").over(gram)})
        .where("lo < hi")
        .select("gram", "node", "n", "pos")
        .dropDuplicates(["gram", "node"])
    )
    return stored(found, "prefixes")


def _fits(a: tuple[str, str], b: tuple[str, str]) -> str:
    """Condition on (n, pos) of two sets: what both hold from a shared shingle on, which bounds the overlap at the first one they share."""
    over, under = NEAR
    return f"{over + under} * least({a[0]} - {a[1]}, {b[0]} - {b[1]}) >= {over} * ({a[0]} + {b[0]})"


def _alike() -> str:
    """Condition on (n, parities) of two sets: each differing bit takes a shingle that only one of them holds, and near sets have few."""
    over, under = NEAR
    return f"{over + under} * ({' + '.join(f'bit_count({c}_a ^ {c}_b)' for c in _PARITY)}) <= {under - over} * (n_a + n_b)"


def _side(rows: DataFrame, end: str) -> DataFrame:
    return rows.select("gram", *(F.col(c).alias(c + end) for c in rows.columns if c != "gram"))


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of nodes that may be near; every near pair is among them."""
    shared = _shared(sets)
    both = _side(shared, "_a").join(_side(shared, "_b"), "gram").where("node_a < node_b")
    return both.where(_fits(("n_a", "pos_a"), ("n_b", "pos_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _few(ids: DataFrame) -> DataFrame:
    """Stored ids, marked for a broadcast if there are few; more meet their rows in a shuffle."""
    return F.broadcast(ids) if ids.count() <= _BROADCAST else ids


def confirmed(sets: DataFrame, maybe: DataFrame) -> DataFrame:
    """The rows of ``maybe`` (a, b and more), stored, whose sets have similarity ``NEAR`` or more."""
    over, under = NEAR
    ends = maybe.select(F.col("a").alias("node")).union(maybe.select("b")).distinct()
    low = sets.groupBy("node").agg(F.min("row").alias("row"))  # one row of each set
    named = stored(low.join(grows(ends), "node", "left_semi").select("row"), "candidate_rows")
    picked = sets.select("row", "node", "grams").join(_few(named), "row", "left_semi").drop("row")
    grams, at = put(picked, "candidate_sets")
    both = maybe.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    found = stored(both.where(f"{over + under} * size(array_intersect(x, y)) >= {over} * (size(x) + size(y))").select(maybe.columns), "near_pairs")
    discard(sets.sparkSession, at)
    release(sets.sparkSession)
    return found


def near_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes of similarity ``NEAR`` or more: all of them, so k * k / 2 for k near copies."""
    return confirmed(sets, stored(candidates(sets), "candidates"))


def _mixed(rows: DataFrame, turn: int) -> DataFrame:
    """The rows (gram, node, n, pos, label) of buckets with several labels, with top: the bucket's commonest label
    and its lead, the last node of that label in an order by hash that changes with ``turn``."""
    lead = F.max(F.struct(rank("node", turn).alias("at"), "node", "n", "pos")).alias("lead")
    by_label = rows.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("size"), lead)
    tops = by_label.groupBy("gram").agg(F.max(F.struct("size", "lead", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    return rows.join(tops.where("labels > 1").drop("labels"), "gram")


def simhash_links(sets: DataFrame) -> DataFrame:
    """Near pairs (a < b) of nodes whose fingerprints differ in at most ``RADIUS`` bits, by one node of each fingerprint."""
    nodes = stored(sets.groupBy("node").agg(F.min("fp").alias("fp")), "fingerprints")
    leads = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    same = nodes.join(grows(leads), "fp").where("node <> lead").select("lead", "node")
    far = links(leads, RADIUS).join(grows(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x"))), "a").join(grows(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y"))), "b").select("x", "y")
    alike = stored(same.union(far).select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct(), "alike")
    release(sets.sparkSession)
    return confirmed(sets, alike)


def near_links(sets: DataFrame) -> DataFrame:
    """Near pairs whose graph has the components of all near pairs, without all pairs of a group.

    SimHash's links come first; what they join has one label.  In rounds, nodes are held against one node of their bucket's commonest label (its
    own node at first), and labels merge along the links found.  When less than a tenth
    of a round's pairs are links, the rest follows: in each bucket the nodes outside its
    commonest label against all with unlike labels whose parity bits don't rule them out.  Nodes known to be linked are never
    paired, and no pair of unlike labels is left out.
    """
    spark, found = sets.sparkSession, [simhash_links(sets)]
    joined = stored(components(found[0]), "joined")
    rows = _shared(sets).join(_few(joined), "node", "left").select("gram", "node", "n", "pos", F.coalesce("root", "node").alias("label"))
    release(spark)
    held: list[str] = []
    while True:
        mixed, at = put(_mixed(rows, len(found)), "mixed")
        discard(spark, *held)  # the rows before these
        held = [at]
        led = mixed.where("label <> top.label").where(_fits(("n", "pos"), ("top.lead.n", "top.lead.pos")))
        ends = F.struct("node", "label"), F.struct(F.col("top.lead.node").alias("node"), F.col("top.label").alias("label"))
        tried = led.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).distinct()
        tried = stored(tried.selectExpr("x.node as a", "y.node as b", "x.label as of_a", "y.label as of_b"), "tried")
        links = confirmed(sets, tried)
        found.append(links.select("a", "b"))
        merged = stored(components(links.selectExpr("of_a as a", "of_b as b")).withColumnRenamed("node", "label"), "merged")
        rows = mixed.drop("top").join(_few(merged), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")
        if links.count() * 10 < tried.count() or links.isEmpty():
            break
    parity = sets.select("node", *_PARITY).dropDuplicates(["node"])
    mixed = stored(_mixed(rows, len(found)).join(parity, "node"), "mixed")
    both = _side(mixed.where("label <> top.label"), "_a").join(_side(mixed.drop("top"), "_b"), "gram")
    unlike = both.where("label_a <> label_b and (label_b = top_a.label or node_a < node_b)")
    maybe = unlike.where(_fits(("n_a", "pos_a"), ("n_b", "pos_b"))).where(_alike())
    rest = maybe.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    return reduce(DataFrame.union, [*found, confirmed(sets, stored(rest, "candidates"))])


def keep_one(df: DataFrame, text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``df`` without near copies: of each component its first row stays, with all columns."""
    spark = df.sparkSession
    rows = stored(df.withColumn("_row_of_dedup", F.monotonically_increasing_id()), "numbered", compression="zstd")
    sets, at = put(_sets(rows.select(F.col("_row_of_dedup").alias("row"), F.col(text_col).cast("binary").alias("text")), words), "sets")
    nodes = stored(sets.groupBy("node").agg(F.min("row").alias("low")), "nodes")
    links = stored(near_links(sets), "near_links")
    discard(spark, at)  # nodes and links are stored
    rooted = nodes.join(components(links).withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    kept = rooted.groupBy(F.coalesce("root", "node")).agg(F.min("low").alias("_row_of_dedup")).select("_row_of_dedup")
    return rows.join(kept, "_row_of_dedup", "left_semi").select(*df.columns)
