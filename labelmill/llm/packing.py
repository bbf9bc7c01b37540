"""Best-fit packing with linear grouping.

All that packing depends on is how many pieces have each length, and there are at most
`capacity` lengths. So Spark counts lengths over all pieces, the plan is made on that
bounded histogram, and tasks look their pieces up in the plan by (length, rank):

1. pieces longer than capacity/8 are sorted and cut into groups of equal cardinality;
   each group's lengths are rounded up to its longest;
2. bins for the few rounded sizes are optimised: column generation over configurations;
3. the actual lengths take the configurations' slots, which leaves room in the bins;
4. what is left, large then small, goes best-fit, longest first.

Bins of equal content stay together as runs, so the plan does not grow with the corpus.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from labelmill.llm.common import cut
from labelmill.llm.tokens import default_path, tokenizer


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its partition."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("nth", T.LongType()))]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    names = [f.name for f in fields]

    def run(batches):
        enc, part, seen, end = tokenizer(path), TaskContext.get().partitionId(), defaultdict(int), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n], *([own] * with_ids)))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": batch["doc_id"].dtype})

    return docs.select("doc_id", "text").mapInPandas(run, T.StructType(fields))


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Whole numbers of bins for each configuration of the sizes: the column-generation optimum, rounded down."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    want = np.array(demand, float)
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        value = inverse.sum(axis=0)
        best, took = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):  # one more piece in the bin each time
            offer = np.full((k, capacity + 1), -1.0)
            for i, s in enumerate(sizes):
                offer[i, s:] = best[:-s] + value[i]
            pick = offer.argmax(axis=0)
            gain = offer[pick, np.arange(capacity + 1)]
            took.append(np.where(gain > best + 1e-12, pick, -1))
            best = np.maximum(best, gain)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for step in reversed(took):
            if step[room] >= 0:
                column[step[room]] += 1
                room -= sizes[step[room]]
        have, rate = inverse @ want, inverse @ column
        ratio = np.where(rate > 1e-9, have / np.where(rate > 1e-9, rate, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    bins = np.floor(np.linalg.inv(basis) @ want + 1e-7).astype(int)
    return [(basis[:, j].round().astype(int).tolist(), int(n)) for j, n in enumerate(bins) if n > 0]


class Plan:
    """Where the pieces of each length go. A placement: pieces first.. of a length, per_bin in each of bins at.., from offset on."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int):
        self.capacity, self.bins, self.placed = capacity, 0, []
        self.left, self.next = dict(counts), defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of bins (first, how many)
        self.rooms: list[int] = []
        self._large(groups)
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _put(self, length: int, count: int, at: int, per_bin: int, offset: int) -> None:
        self.placed.append((length, self.next[length], at, per_bin, offset))
        self.next[length] += count
        self.left[length] -= count

    def _keep(self, room: int, at: int, n: int) -> None:
        if room and n:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((at, n))

    def _large(self, groups: int) -> None:
        lengths = sorted((x for x in self.left if x > self.capacity // 8), reverse=True)
        total = sum(self.left[x] for x in lengths)
        if total < 2 * groups:
            return
        share, own, sizes = -(-total // groups), [[]], []
        for x in lengths:
            n = self.left[x]
            while n:
                free = share - sum(c for _, c in own[-1])
                if not free:
                    own.append([])
                    free = share
                own[-1].append([x, min(n, free)])
                n -= min(n, free)
        merged: dict[int, list[list[int]]] = {}
        for g in own:  # groups that round up to the same length are one size
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        for column, n in configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], self.capacity):
            runs = [(self.bins, n, 0)]
            self.bins += n
            for s, times in zip(sizes, column, strict=True):
                for _ in range(times):
                    after = []
                    for at, m, used in runs:
                        while m and merged[s]:
                            x, have = merged[s][0]
                            t = min(m, have)
                            self._put(x, t, at, 1, used)
                            after.append((at, t, used + x))
                            at, m, merged[s][0][1] = at + t, m - t, have - t
                            if have == t:
                                merged[s].pop(0)
                        if m:
                            after.append((at, m, used))
                    runs = after
            for at, m, used in runs:
                self._keep(self.capacity - used, at, m)

    def _best_fit(self, length: int) -> None:
        while n := self.left[length]:
            i = bisect.bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                at, m = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(i)
            else:
                room, at, m = self.capacity, self.bins, -(-n // (self.capacity // length))
                self.bins += m
            each = room // length
            full = min(m, n // each)
            if full:
                self._put(length, full * each, at, each, self.capacity - room)
                self._keep(room - each * length, at, full)
            rest = self.left[length] if full < m else 0
            if rest:
                self._put(length, rest, at + full, rest, self.capacity - room)
                self._keep(room - rest * length, at + full, 1)
            self._keep(room, at + full + bool(rest), m - full - bool(rest))


def best_plan(counts: dict[int, int], capacity: int, groups: tuple[int, ...] = (12, 24, 48)) -> Plan:
    return min((Plan(counts, capacity, g) for g in groups), key=lambda p: p.bins)


def best_fit_pack(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `capacity` token ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, as
    little-endian unsigned 32-bit integers, if with_ids). Null text counts as empty: the
    end id alone. Longer documents are cut; nothing is dropped. Repeated rows are packed
    as often as they occur, null ids like any other; an empty table gives an empty table.
    Other columns are ignored.
    """
    made = cut(pieces(docs, path or default_path(), capacity, end_id, with_ids), "pieces")
    counts = {int(r[0]): int(r[1]) for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_plan(counts, capacity)
    placed = np.array(sorted(plan.placed), "int64").reshape(-1, 5)
    keys = placed[:, 0] << 44 | placed[:, 1]
    before = W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    base = made.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    out = T.StructType([f for f in made.schema if f.name not in ("part", "nth")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches):
        for b in batches:
            rank = (b["base"] + b["nth"]).to_numpy()
            own = placed[np.searchsorted(keys, b["length"].to_numpy() << 44 | rank, "right") - 1] if len(b) else placed[:0]
            k = rank - own[:, 1]
            yield b.assign(sequence_id=own[:, 2] + k // own[:, 3], offset=own[:, 4] + k % own[:, 3] * own[:, 0])[out.names]

    return made.join(base, ["length", "part"]).select(*made.columns, "base").mapInPandas(assign, out)
