"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit for each bit of XXH64: set if more than half
of its shingles' hashes set it.  Fingerprints link if they differ in at most
``radius`` bits.  Candidate pairs come from ``2**(radius+1) - 1`` bit masks: bit
``i`` carries a non-zero vector ``m(i)`` of ``radius+1`` bits and mask ``v`` keeps
the bits with odd ``<m(i), v>``.  Any ``radius`` differing bits give ``radius``
linear equations in ``radius+1`` unknowns, so some ``v != 0`` drops them all: every
pair within the radius agrees under some mask, with certainty.

Copies collapse to one fingerprint before the masks.  A bucket of more than
``block`` fingerprints is compared in pairs of blocks, each pair its own group of
bounded size; every group emits only a spanning forest of its links.  Components
come from contracting the link graph round by round; nothing is collected.

Defined cases: null or wordless text has fingerprint zero and links like any
other; repeated rows keep a row each; a null id takes part and its component is
named by the smallest non-null id, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grows, stored, texts

BITS = 64
SEED = 42
_PIECE = 1 << 15
_SALTS = 16


def fingerprint(text: bytes, shingle: int = 4, hasher=xxhash.xxh64_intdigest) -> int:
    """Fingerprint of UTF-8 ``text``; zero without words."""
    return majority(hashes(text, shingle, hasher))


def hashes(text: bytes, shingle: int, hasher=xxhash.xxh64_intdigest) -> np.ndarray:
    """Hashes of the shingles of UTF-8 ``text`` in their order, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([hasher(joined, SEED)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.fromiter((hasher(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])), np.uint64, n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of ``hashes``; zero of none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, _PIECE):
        part = hashes[at : at + _PIECE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > hashes.size, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Columns doc_id and fp (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches):
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The covering masks, as signed longs."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    made = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of unsigned values, for numpy counts a signed value's magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, chunk: np.ndarray, cross: bool, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links within one group; of those between chunks only, if ``cross``."""
    label = np.arange(fps.size)
    for i in range(fps.size - 1):
        rest = fps[i + 1 :]
        near = _apart(rest, fps[i]) <= radius
        if cross:
            near &= chunk[i + 1 :] != chunk[i]
        near = np.flatnonzero(near) + i + 1
        if near.size:
            others = label[near]
            new, first = np.unique(others, return_index=True)
            for other, at in zip(new, near[first]):
                mine = label[i]
                if other != mine:
                    yield fps[i], fps[at]
                    label[label == max(mine, other)] = min(mine, other)
                    # labels in ``new`` stay valid: each is a set of its own until merged here


def links(nodes: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """Distinct pairs (a < b) of distinct fingerprints; their graph has the components of all links."""
    keys = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "key"))
    keys = keys.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int"))
    # ranks within a bucket from counts by salt, so no task ranks or counts a whole bucket
    bucket = Window.partitionBy("t", "key")  # of at most _SALTS rows
    counts = keys.groupBy("t", "key", "salt").agg(F.count(F.lit(1)).alias("n"))
    based = counts.select("t", "key", "salt", F.sum("n").over(bucket).alias("cnt"), (F.sum("n").over(bucket.orderBy("salt")) - F.col("n")).alias("base")).where("cnt > 1")
    chunk, chunks = F.expr(f"int((rn - 1) div {block})"), F.expr(f"int((cnt - 1) div {block})")
    dealt = (
        keys.join(grows(based), ["t", "key", "salt"])
        .withColumn("rn", F.col("base") + F.row_number().over(Window.partitionBy("t", "key", "salt").orderBy("fp")))
        .select("t", "key", "fp", chunk.alias("c"), F.explode(F.sequence(F.lit(0), chunks)).alias("d"))
        .select("t", "key", "fp", "c", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"))
        .repartition("t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        for last, b in _with_end(batches):
            if b is not None:
                held = [np.concatenate([h, b.column(n).to_numpy(zero_copy_only=False)]) for h, n in zip(held, ("t", "key", "i", "j", "fp"))]
                c = b.column("c").to_numpy(zero_copy_only=False)
                held_c = c if last is None else np.concatenate([last, c])
            else:
                held_c = last
            t, key, i, j, fp = held
            if not fp.size:
                continue
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.r_[starts[1:], fp.size]
            if b is not None:
                starts, ends = starts[:-1], ends[:-1]
            two = ends - starts == 2
            x, y = fp[starts[two]], fp[starts[two] + 1]
            apart = i[starts[two]] == j[starts[two]]
            near = (_apart(x, y) <= radius) & (apart | (held_c[starts[two]] != held_c[starts[two] + 1]))
            a, z = [x[near]], [y[near]]
            for s, e in zip(starts[~two], ends[~two]):
                found = list(_forest(fp[s:e], held_c[s:e], i[s] != j[s], radius)) if e - s > 2 else []
                if found:
                    pair = np.array(found, np.int64)
                    a.append(pair[:, 0])
                    z.append(pair[:, 1])
            a, z = np.concatenate(a), np.concatenate(z)
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], ["a", "b"])
            cut = ends[-1] if ends.size else 0
            held = [h[cut:] for h in held]
            run.rest = held_c[cut:]

    def _with_end(batches):
        run.rest = None
        for b in batches:
            if b.num_rows:
                yield run.rest, b
        yield run.rest, None

    return dealt.mapInArrow(run, "a long, b long").distinct()


def rank(node: str, turn: int = 0) -> Column:
    """Struct (h, v) of a node's place in the order by hash of a round, and the node."""
    return F.struct(F.xxhash64(F.lit(turn), F.col(node)).alias("h"), F.col(node).alias("v"))


def components(pairs: DataFrame) -> DataFrame:
    """Columns node and root for every node of ``pairs`` (a, b): root is the same in a component.

    Each round every node points to the first of the nodes at most two links away, in an
    order by hash that changes with the round, and the graph is contracted along these
    pointers: a star in one round, a chain to about a third.  The rounds' maps are joined
    at the end.
    """
    rounds: list[DataFrame] = []
    edges = stored(pairs.select("a", "b"), "edges")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        own = rank("u", len(rounds))
        near = both.groupBy("u").agg(F.min(rank("v", len(rounds))).alias("n")).select(F.col("u").alias("v"), F.least("n", own).alias("n"))
        far = both.join(grows(near), "v").groupBy("u").agg(F.min("n").alias("n"))
        up = stored(far.select("u", F.least("n", own)["v"].alias("p")), "up")
        rounds.append(up)
        ends = edges.join(grows(up.select(F.col("u").alias("a"), F.col("p").alias("pa"))), "a").join(grows(up.select(F.col("u").alias("b"), F.col("p").alias("pb"))), "b")
        edges = stored(ends.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for up in rounds[1:]:
        out = out.join(grows(up), out.root == up.u, "left").select("node", F.coalesce("p", "root").alias("root"))
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, block: int = 2048) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id."""
    docs = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = components(links(nodes, radius, block))
    rooted = nodes.join(grows(found), nodes.fp == found.node, "left").select("fp", "low", "root")
    named = rooted.where("root is not null").groupBy("root").agg(F.min("low").alias("named"))
    named = stored(rooted.join(grows(named), "root", "left").select("fp", F.coalesce("named", "low").alias("component_id")), "named")
    return docs.join(grows(named), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text_col: str = "text", radius: int = 4, shingle: int = 4, block: int = 2048) -> DataFrame:
    """The rows of ``df`` without near copies: of each component its first row stays, with all columns.

    Rows are numbered, so repeated and null ids need no rule of their own.
    """
    rows = stored(df.withColumn("_row_of_dedup", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, "_row_of_dedup", text_col, radius, shingle, block)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_row_of_dedup"))
    return rows.join(grows(kept), "_row_of_dedup", "left_semi").select(*df.columns)
