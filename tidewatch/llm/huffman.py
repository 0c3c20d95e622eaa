"""Token ids in files of canonical length-limited Huffman codes.

A file is a folder of two Parquet tables, written and read by Spark alone:
``codes`` (code length of each id, from counts over all documents) and
``blocks``.  A block is independent: the ids of consecutive documents as one
bit string, most significant bit first, with the bit offset of every
``CHECKPOINT``-th id, the documents' ids and lengths, and its number of ids
before in its part.  Parts are ranges of ascending doc_id, so a document's start
is the ids of the parts before, of its part's blocks before and of its block's
documents before.  Decoding looks up ``limit`` bits in a table at a time, in all
runs between checkpoints of a block at once.

Code lengths are optimal for the limit (package-merge).  A lost executor's
blocks are written anew from the sorted range.

Defined cases: null and empty text have the end id alone; a null doc_id sorts
first; equal doc_ids keep their rows, ordered by their ids' checksum and length;
an empty table gives an empty file and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import shared_dir, stored, texts

CHECKPOINT = 512
BLOCK = 1 << 18
BLOCKS = "part int, block int, part_start long, n_ids long, doc_ids binary, doc_null binary, doc_ids_n binary, offsets binary, bits binary"


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Optimal prefix code lengths of at most ``limit`` bits by package-merge."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    n = len(ids)
    if n <= 1:
        return {i: 1 for i in ids}
    if n > 1 << limit:
        raise ValueError("limit too small for the number of ids")
    weights = np.array([counts[i] for i in ids], np.float64)
    # rows of (weight, how many of the first leaves it holds at each level) are never built:
    # only how many leaves each level's first 2n-2 items hold, from the last level back
    merged, is_leaf = [], []
    packages = np.empty(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < n)
        both = both[order]
        merged.append(both)
        packages = both[: both.size // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for level in reversed(is_leaf):
        leaves = int(level[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    return {i: int(k) for i, k in zip(ids, lengths)}


def canonical(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays by id: code and length (0: no code)."""
    code_of, len_of = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
    code = last = 0
    for i in sorted(lengths, key=lambda i: (lengths[i], i)):
        code <<= lengths[i] - last
        last = lengths[i]
        code_of[i], len_of[i] = code, last
        code += 1
    return code_of, len_of


def decode_table(code_of: np.ndarray, len_of: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``limit`` bits: id and code length."""
    ids = np.flatnonzero(len_of)
    ids = ids[np.lexsort((ids, len_of[ids]))]
    spans = np.left_shift(1, limit - len_of[ids].astype(np.int64))
    table, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    filled = int(spans.sum())
    table[:filled] = np.repeat(ids, spans)
    bits[:filled] = np.repeat(len_of[ids], spans)
    return table, bits


def encode_block(ids: np.ndarray, code_of: np.ndarray, len_of: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, bytes]:
    """Bit string (big-endian 32-bit words) and the bit offsets of every ``every``-th id."""
    lens = len_of[ids].astype(np.int64)
    at = np.zeros(ids.size + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    words = int(at[-1] + 31 >> 5) + 1
    start = at[:-1]
    value = code_of[ids] << (64 - lens - (start & 31)).astype(np.uint64)
    low, where = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), start >> 5
    # bits of different ids never overlap, so sums below 2**32 are exact
    out = np.bincount(where, (value >> np.uint64(32)).astype(np.float64), words + 1) + np.bincount(where + 1, low, words + 1)
    return out[:words].astype(np.uint64).astype(">u4").tobytes(), start[::every].astype("<u8").tobytes()


def decode_block(bits: bytes, offsets: bytes, n: int, table: np.ndarray, lens: np.ndarray, limit: int, every: int = CHECKPOINT) -> np.ndarray:
    """The ``n`` ids of a block; each run between checkpoints is a lane."""
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    pair = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    at = np.frombuffer(offsets, "<u8").astype(np.int64)
    out = np.zeros((at.size, every), np.uint32)
    full = n - (at.size - 1) * every
    shift = np.uint64(64 - limit)
    for k in range(min(every, n)):
        if k == full:
            at = at[:-1]
        peek = (pair[at >> 5] << (at & 31).astype(np.uint64)) >> shift
        out[: at.size, k] = table[peek]
        at = at + lens[peek]
    return out.ravel()[:n]


def _binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """Arrow binaries that lie one after the other in ``data``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), ends.size, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def token_ids(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, crc, ids (little-endian unsigned, 16 bits if the vocabulary allows) of each row, end id included.

    A last row of each task has its ids' counts in ``histogram`` (64 bits an id) instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        size = max(encoder.size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        total = np.zeros(size, np.int64)
        for b in texts(batches):
            found = [e + end for e in encoder.encode_many(b.column(1).to_pylist())]
            ids = np.frombuffer(b"".join(found), "<u4")
            total += np.bincount(ids, minlength=size)
            n = np.array([len(e) // 4 for e in found], np.int64)
            ids = ids.astype(kind)
            crc = pa.array([zlib.crc32(e) for e in found], pa.int64())
            cols = [b.column(0), pa.array(n), crc, _binaries(ids.tobytes(), np.cumsum(n) * ids.itemsize), pa.array([kind == "<u2"] * len(found)), pa.nulls(len(found), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())), pa.array([total.tobytes()], pa.binary())], names)

    names = ["doc_id", "n", "crc", "ids", "short", "histogram"]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, crc long, ids binary, short boolean, histogram binary")


def _ids(data: bytes, short: bool) -> np.ndarray:
    return np.frombuffer(data, "<u2" if short else "<u4")


def counts(ids: DataFrame) -> dict[int, int]:
    """How often each id occurs, from the tasks' histograms; at most one number for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for data in b.column(0):
                got = np.frombuffer(data.as_buffer(), np.int64)
                total = got + (0 if total is None else total)
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    found = ids.where("histogram is not null").select("histogram").mapInArrow(run, "id int, n long")
    return {r.id: r.n for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write(df: DataFrame, path: str, vocabulary: str | None = None, end_id: int = tokens.END_ID, limit: int = 16, parts: int | None = None) -> None:
    """Encode every row's text to a file at ``path``.

    Codes have at most ``limit`` bits; where more than half of 2**limit different ids
    occur, so that few codes could be shorter, the limit is raised to two bits above the
    logarithm of their number, and the file states the one used.
    """
    spark = df.sparkSession
    made = stored(token_ids(df, vocabulary or tokens.default_vocabulary(), end_id), "ids", compression="zstd")
    seen, ids = counts(made), made.where("histogram is null")
    limit = max(limit, len(seen).bit_length() + 1) if len(seen) > 1 << (limit - 1) else limit
    lengths = code_lengths(seen, limit)
    spark.createDataFrame([(i, k, limit) for i, k in sorted(lengths.items())], "id int, length int, limit int").coalesce(1).write.parquet(f"{path}/codes")
    code_of, len_of = canonical(lengths, max(lengths, default=0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0

        def made() -> pa.RecordBatch:
            all_ids = np.concatenate(held)
            bits, offsets = encode_block(all_ids, code_of, len_of)
            numbers = np.array([d or 0 for d, _ in docs], "<i8").tobytes()
            nulls = np.array([d is None for d, _ in docs], "u1").tobytes()
            lens = np.array([n for _, n in docs], "<i8").tobytes()
            cells = [part, block, before, all_ids.size, numbers, nulls, lens, offsets, bits]
            return pa.RecordBatch.from_pydict({f.name: pa.array([c], f.type) for f, c in zip(_SCHEMA, cells)}, schema=_SCHEMA)

        for b in texts(batches):
            for doc, data, short in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = _ids(data, short)
                docs.append((doc, got.size))
                held.append(got)
                size += got.size
                if size >= BLOCK:
                    yield made()
                    block, before = block + 1, before + size
                    docs, held, size = [], [], 0
        if docs:
            yield made()

    order = ["doc_id", "crc", "n"]
    ranged = ids.repartitionByRange(parts, *order) if parts else ids.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("doc_id", "ids", "short").mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64())]
    + [(n, pa.binary()) for n in ("doc_ids", "doc_null", "doc_ids_n", "offsets", "bits")]
)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode a file: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    codes = spark.read.parquet(f"{path}/codes").collect()
    limit = codes[0].limit if codes else 1
    code_of, len_of = canonical({r.id: r.length for r in codes}, max((r.id for r in codes), default=0) + 1)
    blocks = spark.read.parquet(f"{path}/blocks")
    bases, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("n")).collect()):
        bases[r.part] = total
        total += r.n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lens = decode_table(code_of, len_of, limit)
        for batch in batches:
            for at in range(batch.num_rows):
                r = {k: v[0] for k, v in batch.slice(at, 1).to_pydict().items()}
                data = decode_block(r["bits"], r["offsets"], r["n_ids"], table, lens, limit).astype("<u4").tobytes()
                n = np.frombuffer(r["doc_ids_n"], "<i8")
                cuts = np.concatenate([[0], np.cumsum(n)])
                pieces = [data[4 * a : 4 * z] for a, z in zip(cuts.tolist(), cuts[1:].tolist())]
                ids = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["doc_null"], "u1").astype(bool))
                out = [ids, pa.array(bases[r["part"]] + r["part_start"] + cuts[:-1]), pa.array(n), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *[pa.array(pieces, pa.binary())] * with_ids], names)

    names = [f.split()[0] for f in schema.split(", ")]
    return blocks.mapInArrow(run, schema)


def round_trip(df: DataFrame, name: str = "ids") -> DataFrame:
    """Write ``df`` to a new file in the shared folder and return what its documents read back as."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/tidewatch/{name}-{uuid.uuid4().hex}"
    write(df, path)
    return read(df.sparkSession, path, with_ids=False)
