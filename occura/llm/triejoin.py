"""Near-duplicate texts by a distributed prefix-tree join (exact, any Jaccard threshold).

Every text is the set of its two-character pieces, written in one global order, rare pieces first. The tree's nodes
are paths of shared pieces: all texts below a node share that partial overlap (its depth). A text enters a child only
while the pieces that it skipped on the way still allow the threshold, and a pair is dropped as soon as depth plus the
shorter remaining length can no longer reach the overlap that the two sizes demand.

Stages, all distributed:
  1. texts with the same key text form a class (``min`` id); only classes are joined;
  2. pieces are counted in a table of 2**18 slots, which is all that the driver sees (about 1 MB); the order
     of the slots by count is the global order (any total order keeps the join exact);
  3. each class is sent to the first-level nodes of its prefix with the pieces that follow within its reach; a node
     with very many members is cut into blocks of bounded size, one task row per pair of blocks, so no task and no
     node grows with the data;
  4. every first-level node is split by the next shared piece, whatever its size, and nodes further down while that
     lessens the comparisons; below, pairs are pruned by remaining length and by the bit difference of two small
     bitmaps (a lower bound of the set difference), both in numpy over whole partitions;
  5. surviving pairs are verified on the exact pieces of the texts.
No candidate is capped or sampled. Texts with fewer than two letters have no pieces and match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occura.llm.common import Files, bigram_hashes, exact_similarities, materialize, partitions_for, scratch_path, write_table

SLOT_BITS = 18


@dataclass(frozen=True)
class Limits:
    """What bounds the work in memory; none of it changes the result.

    ``block``: members of one first-level node that are compared with each other in one task. ``levels``: deepest
    level of the tree. ``worth``: a node below the second level is opened if that leaves less than this share of its
    comparisons (an entry costs as much as ``entry`` comparisons). ``chunk``: pairs or entries handled at once.
    """

    block: int = 20_000
    levels: int = 3
    worth: float = 0.7
    entry: float = 5.0
    chunk: int = 250_000


def classes_of(df: DataFrame, id_column: str, key_column: str) -> DataFrame:
    """(id, class_key, class_hash) of every distinct id; rows without a key text are left out.

    An id delivered several times counts once, with its smallest key text.
    """
    return (
        df.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{key_column}`").alias("class_key"))
        .where("id IS NOT NULL AND class_key IS NOT NULL")
        .groupBy("id").agg(F.min("class_key").alias("class_key"))
        .withColumn("class_hash", F.xxhash64("class_key"))
    )


def _slot_counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    counts, docs, pieces = np.zeros(1 << SLOT_BITS, np.int64), 0, 0
    for b in batches:
        _, h, distinct = bigram_hashes(b.column(0).to_pylist())
        counts += np.bincount(h >> np.uint32(32 - SLOT_BITS), minlength=1 << SLOT_BITS)
        docs += len(distinct)
        pieces += int(distinct.sum())
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(counts[at], [docs, pieces]))], names=["slot", "n"])


class _Prefixes:
    """The ordered pieces of a batch of texts, and the prefix within which a match must start."""

    def __init__(self, texts: list[str], rank: np.ndarray, threshold: float):
        owner, h, distinct = bigram_hashes(texts)
        shift = np.uint32(32 - SLOT_BITS)
        code = (rank[h >> shift] << shift) | (h & np.uint32((1 << int(shift)) - 1))
        packed = (owner.astype(np.uint64) << np.uint64(32)) | code
        packed.sort()
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed  # pieces whose hashes clash count once
        self.owner = (packed >> np.uint64(32)).astype(np.int64)
        self.code = packed.astype(np.uint32)
        self.size = distinct
        counts = np.bincount(self.owner, minlength=len(texts))
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        least = np.ceil(threshold * self.size - 1e-9).astype(np.int64)
        self.skips = np.maximum(self.size - least, 0)

    def bitmaps(self, words: int) -> np.ndarray:
        bits = np.zeros(len(self.size) * words, np.uint64)
        mixed = ((self.code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(words * 64)
        np.bitwise_or.at(bits, self.owner * words + (mixed >> np.uint64(6)).astype(np.int64), np.uint64(1) << (mixed & np.uint64(63)))
        return bits.reshape(-1, words)


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: the run of each place, and its place within the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class _Tree:
    """The nodes of one partition. Members are first-level entries; ``ahead`` holds the pieces that follow each.

    An entry of the frontier is (node, member, used): the member stands in the node with its ``used``-th piece ahead
    as the last shared one (0: the first-level piece itself). Pieces passed over on the way count as skipped.
    """

    def __init__(self, members: dict[str, np.ndarray], threshold: float, limits: Limits):
        self.m, self.t, self.limits = members, threshold, limits
        self.share = threshold / (1 + threshold)
        self.opened = [0] * (limits.levels + 1)  # nodes opened per level, for tests
        self.found: list[np.ndarray] = []

    def pairs(self) -> np.ndarray:
        """Distinct pairs (hash, hash) that pass the length and bitmap bounds."""
        m, chunk = self.m, self.limits.chunk
        _, names = np.unique(m["hash"], return_inverse=True)
        self.names = names.astype(np.int64)
        order = np.argsort(m["node"], kind="stable")
        node = m["node"][order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(node)])
        many = np.flatnonzero(sizes > 1)
        # Whole nodes are taken together until their entries fill a chunk.
        weight = np.cumsum(np.add.reduceat(m["window"][order] + 1, starts)[many]) if len(many) else np.empty(0, np.int64)
        for part in np.split(many, np.searchsorted(weight, np.arange(chunk, weight[-1], chunk), side="right")) if len(many) else ():
            if len(part):
                run, place = _runs(sizes[part])
                entry = order[starts[part][run] + place]
                self._open(run, entry, np.zeros(len(entry), np.int64), 1)
        if not self.found:
            return np.empty((0, 2), np.int64)
        both = np.unique(np.concatenate(self.found))
        by_name = np.empty(int(self.names.max()) + 1, np.int64)
        by_name[self.names] = m["hash"]
        a, b = by_name[both >> 32], by_name[both & 0xFFFFFFFF]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)

    def _open(self, node: np.ndarray, entry: np.ndarray, used: np.ndarray, depth: int) -> None:
        """Splits nodes by their next shared piece; the children are opened in turn or compared."""
        m = self.m
        self.opened[depth] += len(np.unique(node))
        # The next shared piece lies within the skips that are left: skips + depth - (pieces passed so far).
        # A member may already have all it needs: then the pair is due here.
        due = m["size"][entry] - m["skips"][entry] <= depth
        if due.any():
            held = np.isin(node, node[due])
            self._compare(node[held], entry[held], used[held], depth)
        window = np.clip(m["skips"][entry] + depth - m["pos"][entry] - used, 0, m["window"][entry] - used)
        parent, step = _runs(window)
        if not len(parent):
            return
        deeper = used[parent] + step + 1
        piece = m["ahead"][m["at"][entry[parent]] + deeper - 1].astype(np.uint64)
        key = (node[parent].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (piece * np.uint64(0xC2B2AE3D27D4EB4F))
        key ^= key >> np.uint64(29)
        # Child (32 bits of its hash; a clash only adds comparisons) and place in one number: one sort groups children.
        packed = ((key * np.uint64(0xBF58476D1CE4E5B9)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
        packed.sort()
        child, place = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = child[1:] != child[:-1]
        group = np.concatenate(([0], np.cumsum(edge)))
        sizes = np.bincount(group)
        held = sizes[group] > 1
        group, place = group[held], place[held]
        entry, used = entry[parent[place]], deeper[place]
        if depth + 1 < self.limits.levels:
            self._lessen(group, entry, used, depth + 1)
        else:
            self._compare(group, entry, used, depth + 1)

    def _lessen(self, node: np.ndarray, entry: np.ndarray, used: np.ndarray, depth: int) -> None:
        """Opens the nodes where that pays, and compares the members of the others."""
        if not len(node):
            return
        m = self.m
        sizes = np.bincount(node)
        window = np.clip(m["skips"][entry] + depth - m["pos"][entry] - used, 0, m["window"][entry] - used)
        cost = np.bincount(node, weights=window) * self.limits.entry
        big = cost < self.limits.worth * sizes * (sizes - 1.0) / 4
        opens = big[node]
        self._compare(node[~opens], entry[~opens], used[~opens], depth)
        if opens.any():
            # What opening leaves is known only when tried; members that share all they have gain nothing from it.
            again = self._children(node[opens], entry[opens], used[opens], window[opens], len(sizes))
            good = (big & (again + cost < self.limits.worth * sizes * (sizes - 1.0) / 2))[node]
            kept = opens & ~good
            self._compare(node[kept], entry[kept], used[kept], depth)
            if good.any():
                self._open(node[good], entry[good], used[good], depth)

    def _children(self, node: np.ndarray, entry: np.ndarray, used: np.ndarray, window: np.ndarray, nodes: int) -> np.ndarray:
        """Pairs within the children of each node."""
        parent, step = _runs(window)
        piece = self.m["ahead"][self.m["at"][entry[parent]] + used[parent] + step].astype(np.int64)
        child, n = np.unique((node[parent] << 32) | piece, return_counts=True)
        return np.bincount(child >> 32, weights=n * (n - 1.0) / 2, minlength=nodes)

    def _compare(self, node: np.ndarray, entry: np.ndarray, used: np.ndarray, depth: int) -> None:
        """Pairs within each node whose sizes and remaining lengths allow the threshold, then by their bitmaps."""
        m, n = self.m, len(node)
        if n < 2:
            return
        size = m["size"][entry]
        order = np.argsort(node * (int(size.max()) + 1) + size, kind="stable")
        node, entry, size = node[order], entry[order], size[order]
        rest = size - m["pos"][entry] - used[order] - 1
        reach = np.floor((depth + rest) / self.share + 1e-9).astype(np.int64) - size
        # Sizes ascend within a node: one search over (node, size) finds how far each row reaches.
        span = int(size.max()) + 1
        ends = np.searchsorted(node * span + size, node * span + np.minimum(reach, span - 1), side="right")
        counts = np.maximum(ends - np.arange(n) - 1, 0)
        total = np.cumsum(counts)
        block, diagonal, names = m["block"][entry], m["diagonal"][entry], self.names[entry]
        bits = [np.ascontiguousarray(m["bits"][entry, w]) for w in range(m["bits"].shape[1])]
        sums = np.arange(2 * span)
        most_of = (sums - 2 * np.ceil(self.share * sums - 1e-9)).astype(np.int32)  # by the sum of both sizes
        size, reach = size.astype(np.int32), np.minimum(reach, 2**31 - 1).astype(np.int32)
        done = 0
        while done < n:
            upto = min(max(int(np.searchsorted(total, (total[done - 1] if done else 0) + self.limits.chunk, side="right")), done + 1), n)
            c = counts[done:upto]
            right = np.arange(int(c.sum())) + np.repeat(np.arange(done + 1, upto + 1) - (np.cumsum(c) - c), c)
            near = np.flatnonzero(np.bitwise_count(np.repeat(bits[0][done:upto], c) ^ bits[0][right]) <= most_of[np.repeat(size[done:upto], c) + size[right]])
            left, right = np.repeat(np.arange(done, upto), c)[near], right[near]
            done = upto
            fits = reach[right] >= size[left]
            left, right = left[fits], right[fits]
            apart = sum(np.bitwise_count(w[left] ^ w[right]).astype(np.int32) for w in bits)
            ok = (apart <= most_of[size[left] + size[right]]) & (diagonal[left] | (block[left] != block[right])) & (names[left] != names[right])
            if ok.any():
                a, b = names[left[ok]], names[right[ok]]
                self.found.append(np.unique((np.minimum(a, b) << 32) | np.maximum(a, b)))


MEMBER = "node long, hash long, size int, pos int, skips int, block int, diagonal boolean, bits binary, ahead array<int>"


def _flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)


def tree_of(table, threshold: float, limits: Limits) -> _Tree:
    """The tree of an Arrow table of members."""
    table = table.combine_chunks()
    one = {k: table.column(k).chunk(0) for k in table.schema.names}
    plain = {k: one[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("node", "hash", "size", "pos", "skips", "block")}
    offsets, ahead = _flat_lists(one["ahead"])
    lengths = np.diff(np.frombuffer(one["bits"].buffers()[1], np.int32)[: len(one["bits"]) + 1])
    words = int(lengths[0]) // 8
    bits = np.frombuffer(one["bits"].buffers()[2], np.uint64)[: len(lengths) * words].reshape(-1, words)
    return _Tree(plain | {"diagonal": one["diagonal"].to_numpy(zero_copy_only=False).astype(bool), "bits": bits, "at": offsets[:-1], "window": np.diff(offsets), "ahead": ahead.view(np.uint32)}, threshold, limits)


def members_of(batch, blocks: np.ndarray):
    """Members of the first-level nodes from rows (hash, size, skips, bits, prefix); ``blocks`` counts those of a slot.

    A slot with at most one member counts 0 blocks: nothing can match there.
    """
    import pyarrow as pa

    offsets, prefix = _flat_lists(batch.column("prefix"))
    prefix = prefix.view(np.uint32)
    names, size, skips = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("hash", "size", "skips"))
    owner, pos = _runs(np.minimum(np.diff(offsets), skips + 1))
    code = prefix[offsets[owner] + pos]
    n_blocks = blocks[code >> (32 - SLOT_BITS)].astype(np.int64)
    row, other = _runs(n_blocks)
    if not len(row):
        return None
    owner, pos, code = owner[row], pos[row], code[row].astype(np.int64)
    own = (names[owner] & 0x7FFFFFFF) % n_blocks[row]
    low, high = np.minimum(own, other), np.maximum(own, other)
    ahead = np.diff(offsets)[owner] - pos - 1
    run, step = _runs(ahead)
    window = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ahead))).astype(np.int32)), pa.array(prefix[(offsets[owner] + pos)[run] + 1 + step].view(np.int32)))
    small = lambda a: pa.array(a.astype(np.int32))
    arrays = [pa.array((code << 30) ^ (low << 15) ^ high), pa.array(names[owner]), small(size[owner]), small(pos), small(skips[owner]), small(own), pa.array(low == high), batch.column("bits").take(pa.array(owner)), window]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in MEMBER.split(", ")])


def similar_classes(classes: DataFrame, threshold: float, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Pairs (key_a, key_b, similarity) of different class keys at or above ``threshold``.

    ``classes`` has one row per (class_key, class_hash). The hash only names a text in transit: what it finds is
    joined back to the texts and compared piece by piece.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = classes.sparkSession
    counted = classes.select("class_key").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    table = {int(r.slot): int(r.n) for r in counted}  # at most 2**18 + 2 rows
    docs, pieces = table.pop(-1, 0), table.pop(-2, 0)
    count = np.zeros(1 << SLOT_BITS, np.int64)
    count[list(table)] = list(table.values())
    rank = np.empty(1 << SLOT_BITS, np.uint32)
    rank[np.argsort(count, kind="stable")] = np.arange(1 << SLOT_BITS, dtype=np.uint32)
    words = int(np.clip(math.ceil(2 * pieces / max(docs, 1) / 64), 2, 16))
    shared_rank = spark.sparkContext.broadcast(rank)  # 1 MB, whatever the data

    def prefixes(batches: Iterator) -> Iterator:
        """(hash, size, skips, bits, prefix): the pieces of each text as far as the tree's levels may look."""
        import pyarrow as pa

        for b in batches:
            p = _Prefixes(b.column(0).to_pylist(), shared_rank.value, threshold)
            n = np.minimum(p.skips + limits.levels, p.end - p.start)
            run, place = _runs(n)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(p.code[p.start[run] + place].view(np.int32)))
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(words * 8), len(n), [None, pa.py_buffer(np.ascontiguousarray(p.bitmaps(words)))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(p.size.astype(np.int32)), pa.array(p.skips.astype(np.int32)), bits, listed], names=["hash", "size", "skips", "bits", "prefix"])

    texts = classes.select("class_key", "class_hash")
    path = scratch_path(spark, "prefixes")
    written = write_table(texts.mapInArrow(prefixes, "hash long, size int, skips int, bits binary, prefix array<int>"), path)
    slot = F.explode(F.transform(F.slice("prefix", 1, F.col("skips") + 1), lambda c: F.shiftrightunsigned(c, 32 - SLOT_BITS)))
    members = np.zeros(1 << SLOT_BITS, np.int64)
    for r in written.select(slot.alias("slot")).groupBy("slot").count().where("count > 1").collect():
        members[int(r.slot)] = int(r["count"])
    blocks = -(-members // limits.block)
    rows_sent = int((members * blocks).sum())
    shared_blocks = spark.sparkContext.broadcast(blocks.astype(np.int32))  # 1 MB, whatever the data

    def postings(batches: Iterator) -> Iterator:
        for b in batches:
            sent = members_of(b, shared_blocks.value)
            for lo in range(0, sent.num_rows if sent else 0, 50_000):
                yield sent.slice(lo, 50_000)

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrived = [b for b in batches if b.num_rows]
        if arrived:
            pairs = tree_of(pa.Table.from_batches(arrived), threshold, limits).pairs()
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["ha", "hb"])

    found = written.mapInArrow(postings, MEMBER).repartition(partitions_for(spark, rows_sent, 250_000), "node").mapInArrow(join, "ha long, hb long").distinct()
    near_path = scratch_path(spark, "candidates")
    found = write_table(found, near_path)
    Files(spark).remove(path)
    a = texts.select(F.col("class_hash").alias("ha"), F.col("class_key").alias("key_a"))
    b = texts.select(F.col("class_hash").alias("hb"), F.col("class_key").alias("key_b"))
    candidates = found.join(a, "ha").join(b, "hb").select("key_a", "key_b")

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            s = exact_similarities(x, y)
            take = pa.array([i for i in np.flatnonzero(s >= threshold - 1e-12) if x[i] != y[i]], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(s).take(take)], names=["key_a", "key_b", "similarity"])

    return candidates.mapInArrow(verify, "key_a string, key_b string, similarity double")


def similar_pairs(df: DataFrame, id_column: str, key_column: str, threshold: float) -> DataFrame:
    """All pairs (id_a, id_b, similarity), id_a < id_b, of different ids whose key texts are similar.

    Nulls and texts of fewer than two letters give no pair; equal texts give similarity 1; repeated rows of an
    id count once; an empty table gives no rows. The result is as large as the pairs that exist: for one row a
    text use :func:`similarity_classes`.
    """
    member = materialize(classes_of(df, id_column, key_column).where("length(class_key) > 1"))
    near = similar_classes(member.select("class_key", "class_hash").distinct(), threshold)
    left, right = (member.select(F.col("class_key").alias(f"key_{s}"), F.col("id").alias(f"i{s}")) for s in "ab")
    between = near.join(left, "key_a").join(right, "key_b").select("ia", "ib", "similarity")
    within = left.select("key_a", F.col("ia")).join(right.withColumnRenamed("key_b", "key_a"), "key_a").where("ia < ib").select("ia", "ib", F.lit(1.0).alias("similarity"))
    return between.unionByName(within).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")


def similarity_classes(df: DataFrame, id_column: str, key_column: str, threshold: float) -> DataFrame:
    """One row an id: (id, class_id, class_size, links).

    class_id is the smallest id with the same key text and class_size their number; links counts the different
    texts (classes) that are similar. Copies are never expanded into pairs, so a group of copies that holds a
    third of all rows costs one row each.
    """
    member = materialize(classes_of(df, id_column, key_column))
    classes = member.groupBy("class_key", "class_hash").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    near = similar_classes(classes.where("length(class_key) > 1").select("class_key", "class_hash"), threshold)
    links = near.select(F.explode(F.array("key_a", "key_b")).alias("class_key")).groupBy("class_key").agg(F.count("*").alias("links"))
    summary = classes.join(links, "class_key", "left").select("class_key", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    return member.select("id", "class_key").join(summary, "class_key").select("id", "class_id", "class_size", "links")
