"""The N best items of every group, by a mergeable aggregation of bounded heaps.

Each task keeps at most N items a group while it reads its rows and hands on only those; after the shuffle the
same heaps are merged. A group of millions of rows therefore sends at most N rows per task, and no task ever
holds more of a group than that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items held by one task before its heaps are handed on early; any partial result can be merged later.
HELD = 500_000


class _Item:
    """Orders a heap so that its root is the worst item: lowest score, then largest identifier."""

    __slots__ = ("key",)

    def __init__(self, key: tuple):
        self.key = key

    def __lt__(self, other: _Item) -> bool:
        return other.key < self.key


class BoundedHeap:
    """The N best (score, identifier) of what was offered; an identifier counts once, with its best score."""

    __slots__ = ("ids", "items", "n")

    def __init__(self, n: int):
        self.n, self.items, self.ids = n, [], set()

    def offer(self, score: float | None, ident: str) -> int:
        """Takes the item if it is among the N best so far; returns by how many the heap grew."""
        key = (score is None, 0 if score is None else -score, ident)
        if len(self.items) == self.n and key >= self.items[0].key:
            return 0
        if ident in self.ids:
            for i, held in enumerate(self.items):
                if held.key[2] == ident:
                    if key < held.key:
                        self.items[i] = _Item(key)
                        heapq.heapify(self.items)
                    return 0
        self.ids.add(ident)
        if len(self.items) < self.n:
            heapq.heappush(self.items, _Item(key))
            return 1
        self.ids.discard(heapq.heapreplace(self.items, _Item(key)).key[2])
        return 0

    def best(self) -> list[tuple]:
        return sorted(i.key for i in self.items)


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """(group, rank_no, ident, score): ranks 1..n of each group by score descending, null scores last, then identifier.

    Rows with a null group or identifier belong to no ranking. A score that is NaN counts as null. An identifier
    repeated within a group counts once with its best score. Groups of fewer than n items give what they have; an
    empty table gives no rows. Other columns of ``df`` are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(f"`{score}`").cast("double")
    rows = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.when(F.isnan(s), None).otherwise(s).alias("s"), F.col(f"`{ident}`").cast("string").alias("i")).where("g IS NOT NULL AND i IS NOT NULL")

    def before(batches: Iterator) -> Iterator:
        import pyarrow as pa

        heaps: dict[str, BoundedHeap] = {}
        held = 0

        def handed() -> pa.RecordBatch:
            flat = [(g, None if k[0] else -k[1], k[2]) for g, h in heaps.items() for k in h.best()]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.string())], names=["g", "s", "i"])

        for b in batches:
            for g, v, i in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                heap = heaps.get(g)
                if heap is None:
                    heap = heaps[g] = BoundedHeap(n)
                held += heap.offer(v, i)
            if held > HELD:
                yield handed()
                heaps, held = {}, 0
        yield handed()

    def after(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, heap, out = None, BoundedHeap(n), []

        def ended() -> None:
            out.extend((current, rank, k[2], None if k[0] else -k[1]) for rank, k in enumerate(heap.best(), 1))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.float64()))], names=["g", "rank_no", "i", "s"])

        for b in batches:
            for g, v, i in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if g != current:
                    ended()
                    current, heap = g, BoundedHeap(n)
                heap.offer(v, i)
            if len(out) > 20_000:
                yield batch()
                out = []
        ended()
        yield batch()

    merged = rows.mapInArrow(before, "g string, s double, i string").repartition("g").sortWithinPartitions("g").mapInArrow(after, "g string, rank_no int, i string, s double")
    return merged.select(F.col("g").alias(group), "rank_no", F.col("i").alias(ident), F.col("s").alias(score))
