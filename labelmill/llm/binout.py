"""Packed id matrices: best-fit-decreasing over shards, with binary columns for training readers.

A shard is what a task reads until it holds shard_tokens ids, so packing needs no shuffle,
its memory is bounded, and a lost task is simply run again. Within a shard pieces go
longest first to the fullest row that still has room, found by descending a segment tree
over remaining capacities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.tokens import default_path, tokenizer


class Rooms:
    """Open rows by remaining capacity; the tree's nodes count the rows below them."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the smallest room of at least `need`, removed; None if there is none."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up, until a right neighbour has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._count(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into lengths, each row's lengths adding up to at most capacity."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            found = (capacity, len(rows))
            rows.append([])
        rows[found[1]].append(i)
        if found[0] > lengths[i]:
            rooms.add(found[0] - lengths[i], found[1])
    return rows


def packed_matrix(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, pad_id: int = 0, shard_tokens: int = 1_000_000) -> DataFrame:
    """One row for each row of the id matrices.

    Returns part, shard, row; ids (capacity little-endian unsigned 32-bit integers, padded
    with pad_id), n_tokens, cu_seqlens (from 0 to n_tokens), positions (as many 32-bit
    integers, from 0 again at each segment; 0 in the padding), and the segments' doc_ids,
    pieces (from 0) and starts (the document's ids before the piece). A null text counts as
    empty: the end id alone. Documents longer than a row are cut without loss. Rows that
    repeat and null ids are packed like any other; an empty table gives no rows. Other
    columns are ignored.
    """
    kind, spot = docs.schema["doc_id"].dataType, path or default_path()
    out = T.StructType([T.StructField(*f) for f in (("part", T.IntegerType()), ("shard", T.IntegerType()), ("row", T.IntegerType()), ("ids", T.BinaryType()), ("n_tokens", T.IntegerType()), ("cu_seqlens", T.ArrayType(T.IntegerType())), ("positions", T.BinaryType()), ("doc_ids", T.ArrayType(kind)), ("pieces", T.ArrayType(T.IntegerType())), ("starts", T.ArrayType(T.LongType())))])

    def pack(held: list[tuple], part: int, shard: int) -> pd.DataFrame:
        rows = []
        for n, own in enumerate(best_fit_decreasing([len(h[3]) // 4 for h in held], capacity)):
            lengths = np.array([len(held[i][3]) // 4 for i in own])
            cu = np.concatenate([[0], np.cumsum(lengths)])
            ids, positions = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
            ids[: cu[-1]] = np.frombuffer(b"".join(held[i][3] for i in own), "<u4")
            positions[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], lengths)
            rows.append((part, shard, n, ids.tobytes(), int(cu[-1]), cu.tolist(), positions.tobytes(), *([held[i][j] for i in own] for j in range(3))))
        return pd.DataFrame(rows, columns=out.names)

    def run(batches):
        enc, part, end = tokenizer(spot), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        held, size, shard = [], 0, 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype(object), b["text"], strict=True):
                ids = enc.encode(text) + end
                held += [(None if pd.isna(doc_id) else doc_id, k, at // 4, ids[at : at + 4 * capacity]) for k, at in enumerate(range(0, len(ids), 4 * capacity))]
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield pack(held, part, shard)
                    held, size, shard = [], 0, shard + 1
        if held:
            yield pack(held, part, shard)

    return docs.select("doc_id", "text").mapInPandas(run, out)


def write_packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes packed_matrix(docs, **options) under path and returns what is read from there."""
    made = packed_matrix(docs, **options)
    made.write.option("compression", "zstd").parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """packed_matrix's rows with CRC-32 in place of the binary columns."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).withColumn("positions_crc32", F.crc32("positions")).drop("ids", "positions")
