"""Filling containers of fixed token capacity with documents, balanced by compute cost.

A document longer than the container is cut into full pieces, which fill containers of their own, and a rest;
all others stay whole. Items are taken by descending length, and each goes to the container of the lowest cost
so far (linear plus quadratic attention cost of what it holds) that has room; a new container is opened only if
none has. Costs are compared in steps; among equal ones the tightest container is taken. Fine steps balance the
cost best, coarse ones waste least room: several are tried on the histogram, and of those that need at most
``TOLERANCE`` more containers than the fewest the finest is taken. The coarsest still tells four costs apart.

Items of one length are interchangeable, so the assignment is worked out on the histogram of lengths, which has
at most ``capacity`` entries however many documents there are: containers in the same state form one range, and
one step gives items of one length to a whole range. The steps are then applied to the documents in parallel,
by the rank of each within its length. Nothing but the histogram reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Documents of one length that one task ranks.
RANKED = 50_000
#: What is tried: into how many steps a full container's cost is divided (costs within one step count as equal, and
#: the least room that suffices is taken there), and shares of spare containers at the start.
COST_STEPS = (64, 32, 16, 8, 4)
SPARE = (0.0, 0.005, 0.02)
TOLERANCE = 0.005


@dataclass(frozen=True)
class Plan:
    """Steps: items [item_from, item_from + count) of a length go to containers [container_from, ...)."""

    containers: int
    steps: dict[int, tuple[np.ndarray, np.ndarray]]
    fullest: float
    cost_steps: int


def cost_of(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class _States:
    """Ranges of containers in equal state, found by cost step, then by the least room that suffices."""

    def __init__(self, step: float):
        self.step, self.rooms, self.ranges = step, {}, {}

    def add(self, cost: float, first: int, many: int, room: int) -> None:
        at = int(cost // self.step)
        held = self.ranges.setdefault((at, room), [])
        if not held:
            insort(self.rooms.setdefault(at, []), room)
        held.append((first, many, cost))

    def take(self, length: int) -> tuple[float, int, int, int] | None:
        for at in sorted(self.rooms):
            rooms = self.rooms[at]
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, many, cost = self.ranges[at, room].pop()
                if not self.ranges[at, room]:
                    rooms.pop(i)
                    if not rooms:
                        del self.rooms[at]
                return cost, first, many, room
        return None


def _assign(histogram: dict[int, int], capacity: int, containers: int, step: float) -> tuple[int, dict[int, list[tuple[int, int]]], float]:
    states = _States(step)
    if containers:
        states.add(0.0, 0, containers, capacity)
    used, steps, fullest = containers, {}, 0.0
    for length in sorted(histogram, reverse=True):
        left, given, cost = histogram[length], 0, cost_of(length)
        while left:
            state = states.take(length)
            if state is None:
                # No room anywhere: as many new containers as the items of this length need.
                fresh = -(-left // (capacity // length))
                states.add(0.0, used, fresh, capacity)
                used += fresh
                continue
            c, first, many, room = state
            n = min(many, left)
            steps.setdefault(length, []).append((given, first))
            if n < many:
                states.add(c, first + n, many - n, room)
            if room > length:
                states.add(c + cost, first, n, room - length)
            fullest = max(fullest, c + cost)
            given, left = given + n, left - n
    empty = sum(many for (_, room), held in states.ranges.items() if room == capacity for _, many, _ in held)
    return used - empty, steps, fullest


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The assignment of ``histogram`` (length -> items, lengths 1..capacity) with the finest steps within the tolerance."""
    least = -(-sum(length * n for length, n in histogram.items()) // capacity)
    whole = cost_of(capacity)
    tried = [(n, *_assign(histogram, capacity, least + int(least * s), whole / n)) for n in COST_STEPS for s in SPARE]
    fewest = min(t[1] for t in tried)
    cost_steps, used, steps, fullest = min((t for t in tried if t[1] <= fewest * (1 + TOLERANCE)), key=lambda t: (-t[0], t[1], t[3]))
    return Plan(used, {length: (np.array([a for a, _ in s], np.int64), np.array([b for _, b in s], np.int64)) for length, s in steps.items()}, fullest, cost_steps)


def pack(items: DataFrame, ident: str, tokens: str, capacities: DataFrame) -> DataFrame:
    """(capacity_id, container_id, item_id, piece_no, token_from, token_to, n_tokens): where every piece lies.

    ``items`` has one row per item with its number of tokens; ``capacities`` has capacity_id and capacity_tokens.
    Items of no tokens (or null) take no room: one row without a container. Capacities below 1 or null are left
    out. piece_no counts from 1; token_to is exclusive. Equal lengths are ordered by the item's hash, then id.
    """
    sizes = [(int(r.capacity_id), int(r.capacity_tokens)) for r in capacities.select("capacity_id", "capacity_tokens").where("capacity_tokens >= 1 AND capacity_id IS NOT NULL").distinct().collect()]
    spark = items.sparkSession
    table = F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in sorted(sizes)])
    n = F.greatest(F.coalesce(F.col(f"`{tokens}`"), F.lit(0)), F.lit(0)).cast("long")
    item = items.select(F.col(f"`{ident}`").alias("item_id"), n.alias("n"))
    if not sizes:
        return item.limit(0).select(F.lit(0).alias("capacity_id"), F.lit("").alias("container_id"), "item_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("token_from"), F.lit(0).cast("long").alias("token_to"), F.lit(0).cast("long").alias("n_tokens"))
    each = item.select("item_id", "n", F.explode(table).alias("c")).select("item_id", "n", "c.*")
    # A rest is what is left after the full pieces; an item of exactly the capacity is one full piece.
    each = each.withColumn("full", F.floor(F.col("n") / F.col("capacity"))).withColumn("rest", F.col("n") % F.col("capacity"))

    counted = each.where("rest > 0").groupBy("capacity_id", "capacity", "rest").count().collect()  # at most `capacity` lengths each
    histograms: dict[int, dict[int, int]] = {}
    for r in counted:
        histograms.setdefault(r.capacity_id, {})[int(r.rest)] = int(r["count"])
    plans = {i: plan(histograms.get(i, {}), c) for i, c in sizes}
    shared = spark.sparkContext.broadcast({i: p.steps for i, p in plans.items()})
    buckets = max([-(-n // RANKED) for h in histograms.values() for n in h.values()], default=1)

    rests = each.where("rest > 0").withColumn("h", F.xxhash64("item_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    key = ["capacity_id", "rest"]
    within = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("h", "item_id")) - 1
    ranked = rests.withColumn("rank", within.cast("long"))
    if buckets > 1:  # rank = documents of the length in earlier buckets + place in the own bucket
        before = F.sum("n_bucket").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        offsets = rests.groupBy(*key, "bucket").agg(F.count("*").alias("n_bucket")).withColumn("before", F.coalesce(before, F.lit(0)))
        ranked = ranked.join(offsets.select(*key, "bucket", "before"), [*key, "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("item_id", "capacity_id", "capacity", "full", "rest", "rank")
    schema = ranked.select("item_id", "capacity_id", "capacity", "full", "rest").withColumn("container", F.lit(0).cast("long")).schema

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        steps = shared.value
        for b in batches:
            cap, rest, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("capacity_id", "rest", "rank"))
            out = np.empty(len(rank), np.int64)
            both = cap.astype(np.int64) << 40 | rest.astype(np.int64)
            order = np.argsort(both, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(both[order])) + 1):
                if len(group):
                    item_from, container_from = steps[int(cap[group[0]])][int(rest[group[0]])]
                    at = np.searchsorted(item_from, rank[group], side="right") - 1
                    out[group] = container_from[at] + rank[group] - item_from[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("item_id", "capacity_id", "capacity", "full", "rest")), pa.array(out)], names=schema.names)

    placed = ranked.mapInArrow(place, schema)
    tail = placed.select(
        "capacity_id", F.concat_ws("-", F.lit("p"), "container").alias("container_id"), "item_id", (F.col("full") + 1).cast("int").alias("piece_no"),
        (F.col("full") * F.col("capacity")).alias("token_from"), (F.col("full") * F.col("capacity") + F.col("rest")).alias("token_to"), F.col("rest").alias("n_tokens"),
    )
    whole = each.where("full > 0").select("capacity_id", "capacity", "item_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))).alias("k"))
    full = whole.select(
        "capacity_id", F.concat_ws("-", F.lit("f"), "item_id", "k").alias("container_id"), "item_id", F.col("k").cast("int").alias("piece_no"),
        ((F.col("k") - 1) * F.col("capacity")).alias("token_from"), (F.col("k") * F.col("capacity")).alias("token_to"), F.col("capacity").cast("long").alias("n_tokens"),
    )
    zero = F.lit(0).cast("long")
    none = each.where("n = 0").select("capacity_id", F.lit(None).cast("string").alias("container_id"), "item_id", F.lit(1).alias("piece_no"), zero.alias("token_from"), zero.alias("token_to"), zero.alias("n_tokens"))
    return tail.unionByName(full).unionByName(none)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, capacity_tokens, pieces, containers, tokens, fill, mean_cost, max_cost), one row a capacity.

    fill is the share of all room that is used; the costs are those of containers.
    """
    n = F.col("n_tokens").cast("double")
    sums = packed.where("container_id IS NOT NULL").groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"), F.sum(LINEAR * n + QUADRATIC * n * n).alias("c"))
    per = sums.groupBy("capacity_id").agg(F.sum("p").alias("pieces"), F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.avg("c"), 3).alias("mean_cost"), F.round(F.max("c"), 3).alias("max_cost"))
    fill = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return per.join(F.broadcast(capacities.select("capacity_id", "capacity_tokens").distinct()), "capacity_id").select("capacity_id", "capacity_tokens", "pieces", "containers", "tokens", fill.alias("fill"), "mean_cost", "max_cost")
