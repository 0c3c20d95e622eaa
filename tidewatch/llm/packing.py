"""Packing documents into sequences by shortest-pack-first over the length histogram.

A document longer than a sequence is cut into full sequences and a rest.  Rests
and short documents are packed by their length histogram alone: lengths are
placed longest first, each into the pack with the most room (the shortest pack),
and a whole count of equal packs moves at once, so the work depends on the
sequence length and not on the number of documents.  Patterns join back to
documents by rank: the pieces of a length are numbered, and every slot of a
pattern takes the next run of numbers.

Numbering never puts a length into one task: pieces are dealt by length and id
hash (``spread`` ways), and the counts of these cells, at most ``max_len`` x
``spread`` numbers, are all that reaches the driver.

Defined cases: null and empty text are the end id alone; repeated rows are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import stored, texts


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and their counts."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=-1)
            if room < length:
                # new packs fill up one after the other: full ones of this length alone, and one with the rest
                fit = max_len // length
                for k, packs in ((fit, left // fit), (left % fit, 1)):
                    if k and packs:
                        by_room.setdefault(max_len - k * length, []).append(((length,) * k, packs))
                break
            pattern, count = by_room[room].pop()
            moved = min(count, left)
            if count > moved:
                by_room[room].append((pattern, count - moved))
            by_room.setdefault(room - length, []).append(((*pattern, length), moved))
            left -= moved
    return sorted((p for packs in by_room.values() for p in packs), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset): rank r of a length lies in sequence ``first sequence + r - first rank``."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            runs.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return sorted(runs)


def pieces(df: DataFrame, max_len: int, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every row's ids, the end id included: doc_id, start, length, ids_crc32, doc_tokens."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for b in texts(batches):
            rows: list[tuple] = []
            for doc, data in zip(b.column(0).to_pylist(), encoder.encode_many(b.column(1).to_pylist())):
                data += end
                n = len(data) // 4
                for at in range(0, n, max_len):
                    part = data[4 * at : 4 * (at + max_len)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(
    df: DataFrame,
    max_len: int = 2048,
    vocabulary: str | None = None,
    end_id: int = tokens.END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    spread: int = 32,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(spread)).cast("int").alias("cell")
    cut = stored(pieces(df, max_len, vocabulary or tokens.default_vocabulary(), end_id, id_col, text_col).select("*", key), "pieces")
    cells = {(r.length, r.cell): r.n for r in cut.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram: dict[int, int] = {}
    base = np.zeros((max_len + 1) * spread, np.int64)
    for (length, cell), n in sorted(cells.items()):
        base[length * spread + cell] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    runs = np.array(slots(shortest_pack_first(histogram, max_len)) or [(0, 0, 0, 0)], np.int64)
    wide = np.int64(max(histogram.values(), default=0) + 1)
    keys = runs[:, 0] * wide + runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, cell: pd.Series, rn: pd.Series) -> pd.DataFrame:
        rank = base[length.to_numpy() * spread + cell.to_numpy()] + rn.to_numpy() - 1
        at = np.searchsorted(keys, length.to_numpy() * wide + rank, "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 2] + rank - runs[at, 1], "offset": runs[at, 3]})

    order = Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32")
    got = cut.withColumn("rn", F.row_number().over(order)).withColumn("got", placed("length", "cell", "rn"))
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "got.sequence_id", "got.offset")
