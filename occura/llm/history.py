"""Checking new batches for repeats of anything accepted before, without working out its keys again.

The history is a store in the shared folder, in two tables that are bucketed by hash and partitioned by batch:
  * ``bands``: one row per band key (a hash of ``ROWS`` minwise values) with the text's signature (one bit of each
    minwise value) and its hash, bucketed by the key;
  * ``classes``: every distinct text once, with its first arrival (lowest batch, then lowest id), bucketed by its hash.
A batch computes its own keys and joins them with the buckets of ``bands`` as they lie: the store is read where keys
can meet and is never shuffled or sorted. Pairs whose signatures agree too little are dropped at once; the others read
the texts that they met from their buckets of ``classes`` and are compared exactly. Then the keys of the batch's new
texts are appended. Exact copies of a text in the history meet through its hash and add nothing, however many there are.

A small batch (at most ``FEW`` keys) names its keys in the scan, so that buckets, row groups and pages without them are
skipped. Buckets grow in number with the store (``BUCKET_ROWS`` rows each; the tables are rewritten when these double).
Each batch is accepted by one marker written last; what an interrupted batch left is overwritten when it comes again,
and a batch that was accepted appends nothing the second time. A store that exists is opened with all it holds.

With 28 bands of 4 rows two texts of similarity 0.7 meet with probability 0.9995, of 0.8 with 0.9999996; texts of
similarity 0.2 with 0.04. Kinds marked exact (file hashes) match on equality only and have no bands.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura.functions.text import normal_hash  # noqa: F401, part of this module's interface
from occura.llm.common import Files, bigram_hashes, exact_similarities, scratch_path, write_table

BANDS, ROWS, SEED = 28, 4, 20240117
#: Rows of one bucket of a store table, and the most keys that a batch names in its scan.
BUCKET_ROWS, FEW = {"bands": 500_000, "classes": 50_000}, 1_000
#: Rows of one page, the least that a scan with named keys reads.
PAGE_ROWS = 250
STORE = {
    "bands": ("band_key", "band_key long, class_hash long, sign_a long, sign_b long"),
    "classes": ("class_hash", "class_hash long, kind string, class_key string, first_batch int, first_id string"),
}
NEW = "kind string, exact boolean, class_hash long, class_key string, first_batch int, first_id string, sign_a long, sign_b long, band_keys array<long>"


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minwise(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x functions, uint32) and which texts have pieces at all."""
    owner, h, distinct = bigram_hashes(texts)
    has = distinct > 0
    sig = np.zeros((len(texts), BANDS * ROWS), np.uint32)
    if has.any():
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for f, (a, b) in enumerate(zip(*_functions(), strict=True)):
            mixed = h * a
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            mixed ^= b
            sig[has, f] = np.minimum.reduceat(mixed, starts)
    return sig, has


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), (b + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for r in range(ROWS):
            key = (key ^ sig[:, b * ROWS + r].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out.view(np.int64)


def sign_bits(sig: np.ndarray) -> np.ndarray:
    """One bit of every minwise value, as two 64-bit numbers per text."""
    bits = np.zeros((len(sig), 128), np.uint8)
    bits[:, : sig.shape[1]] = (sig * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits, axis=1).view(np.int64)


def least_agreement(threshold: float) -> int:
    """Bits that two texts of similarity ``threshold`` have in common, less six deviations."""
    n, p = BANDS * ROWS, (1 + threshold) / 2
    return int(n * p - 6 * (n * p * (1 - p)) ** 0.5)


def _signed(batches: Iterator) -> Iterator:
    """(kind, exact, class_hash, class_key, first_batch, first_id) -> the same with signature and band keys."""
    import pyarrow as pa

    for b in batches:
        keys = b.column("class_key").to_pylist()
        sig, has = minwise(["" if e else k for e, k in zip(b.column("exact").to_pylist(), keys, strict=True)])
        signs, bands = sign_bits(sig), band_keys(sig)
        ends = np.concatenate(([0], np.cumsum(np.where(has, BANDS, 0)))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[has].ravel()))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signs[:, 0]), pa.array(signs[:, 1]), listed], names=[*b.schema.names, "sign_a", "sign_b", "band_keys"])


class History:
    """A growing store of accepted records; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, threshold: float):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.files = Files(spark)
        self.name, self.results = uuid.uuid4().hex, []
        self.accepted = [int(n) for n in self.files.names(f"{self.path}/accepted")]
        self.layout: dict[str, int] = {}
        if self.accepted:
            self.layout = json.loads(self.files.text(f"{self.path}/layout-{max(self.files.numbers(self.path, 'layout-'))}"))
            self._open()
            for table in STORE:
                spark.sql(f"ALTER TABLE {self._table(table)} RECOVER PARTITIONS")

    # -------------------------------------------------------------- tables

    def _table(self, table: str) -> str:
        return f"history_{table}_{self.name}_{self.layout['generation']}"

    def _open(self) -> None:
        for table, (key, columns) in STORE.items():
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._table(table)} ({columns}, batch int) USING parquet OPTIONS ('parquet.page.row.count.limit' = '{PAGE_ROWS}') PARTITIONED BY (batch) CLUSTERED BY ({key}) SORTED BY ({key})"
                f" INTO {self.layout[table]} BUCKETS LOCATION '{self.path}/{table}-{self.layout['generation']}'"
            )

    def stored(self, table: str, keys: list[int] | None = None) -> DataFrame:
        """Rows of all accepted batches; with ``keys`` only those, by a filter that reaches buckets and pages."""
        rows = self.spark.table(self._table(table)).where(F.col("batch").isin(self.accepted))
        if keys is not None:
            tests = [F.col(STORE[table][0]) == F.lit(k) for k in keys] or [F.lit(False)]
            while len(tests) > 1:  # a balanced tree of tests
                tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
            rows = rows.where(tests[0])
        return rows

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        key, columns = STORE[table]
        rows = rows.select(*[c.split()[0] for c in columns.split(", ")]).repartition(self.layout[table], key)
        rows.createOrReplaceTempView(f"rows_{self.name}")
        self.spark.sql(f"INSERT OVERWRITE {self._table(table)} PARTITION (batch = {batch}) SELECT * FROM rows_{self.name}")
        self.spark.catalog.dropTempView(f"rows_{self.name}")

    def _room(self, texts: int, banded: int) -> None:
        """Makes sure that buckets stay of bounded size with more texts; a new layout has twice the room needed."""
        held = {k: self.layout.get(k, 0) for k in ("texts", "banded")}
        rows = {"bands": (held["banded"] + banded) * BANDS, "classes": held["texts"] + texts}
        if self.layout and all(rows[t] <= 2 * BUCKET_ROWS[t] * self.layout[t] for t in STORE):
            return
        old = dict(self.layout), [self._table(t) for t in STORE] if self.layout else []
        need = {t: max(8, 1 << (2 * rows[t] // BUCKET_ROWS[t]).bit_length()) for t in STORE}
        self.layout = {"generation": old[0].get("generation", 0) + 1, **need, **held}
        self._open()
        for table, was in zip(STORE, old[1], strict=False):
            for batch in self.accepted:
                self._write(self.spark.table(was).where(F.col("batch") == batch), table, batch)
        self.files.write(f"{self.path}/layout-{self.layout['generation']}", json.dumps(self.layout))
        for was in old[1]:
            self.spark.sql(f"DROP TABLE {was}")
        if old[0]:
            self.files.remove(f"{self.path}/layout-{old[0]['generation']}")
            for table in STORE:
                self.files.remove(f"{self.path}/{table}-{old[0]['generation']}")

    def close(self, remove: bool = False) -> None:
        """Forgets the tables; ``remove`` deletes the store too."""
        for table in STORE if self.layout else ():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(table)}")
        for path in [*self.results, self.path] if remove else ():
            self.files.remove(path)

    # -------------------------------------------------------------- batches

    def arrive(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Checks one batch (kind, id, batch_no, key, exact) and then accepts it as batch ``number`` of the store.

        Returns (kind, id, match_id): of each row that repeats something accepted before, the match of the lowest
        batch, then lowest id. Rows without a key, or whose text has no two letters, match nothing. Rows of the
        same batch are not compared with each other. Every row is accepted, duplicates too: a later row may
        resemble only the duplicate. ``number`` defaults to the next free one; the same number again is a retry.
        """
        rows = members(batch)
        return rows.join(self.hits(rows, max(self.accepted, default=0) + 1 if number is None else number), ["kind", "class_hash", "key"]).select("kind", "id", "match_id")

    def hits(self, rows: DataFrame, number: int) -> DataFrame:
        """(kind, class_hash, key, match_id) of the texts of a batch's members that the history has; accepts the batch."""
        spark, again = self.spark, number in self.accepted
        self.accepted = [n for n in self.accepted if n != number]
        classes = rows.groupBy("kind", "exact", "class_hash", F.col("key").alias("class_key")).agg(F.min(F.struct("batch_no", "id")).alias("f"))
        classes = classes.select("kind", "exact", "class_hash", "class_key", F.col("f.batch_no").alias("first_batch"), F.col("f.id").alias("first_id"))
        source, spent = scratch_path(spark, "batch"), scratch_path(spark, "matches")
        new = write_table(classes.mapInArrow(_signed, NEW), source)
        counted = new.agg(F.count("*").alias("texts"), F.count(F.when(~F.col("exact"), 1)).alias("banded")).first()
        texts, banded, best = counted.texts, counted.banded, None
        if not again:
            self._room(texts, banded)
        if self.accepted and texts:
            met = self._met(new, banded)
            best = write_table(met.groupBy("kind", "class_hash", "class_key").agg(F.min(F.struct("first_batch", "first_id")).alias("m"), F.max("is_known").alias("is_known")), spent)
            self.results.append(spent)
        if not again:
            fresh = new if best is None else new.join(best.where("is_known").select("kind", "class_hash", "class_key"), ["kind", "class_hash", "class_key"], "left_anti")
            self._write(fresh, "classes", number)
            self._write(fresh.select("class_hash", "sign_a", "sign_b", F.explode("band_keys").alias("band_key")), "bands", number)
            self.layout["texts"], self.layout["banded"] = self.layout["texts"] + texts, self.layout["banded"] + banded
            self.files.write(f"{self.path}/layout-{self.layout['generation']}", json.dumps(self.layout))
            self.files.write(f"{self.path}/accepted/{number}", "")
        self.accepted = sorted({*self.accepted, number})
        self.files.remove(source)
        if best is None:
            return spark.createDataFrame([], "kind string, class_hash long, key string, match_id string")
        return best.select("kind", "class_hash", F.col("class_key").alias("key"), F.col("m.first_id").alias("match_id"))

    def _met(self, new: DataFrame, banded: int) -> DataFrame:
        """(class_hash, class_key, first_batch, first_id, is_known) of every stored text that a new one equals or resembles."""
        mine = new.select("class_hash", "sign_a", "sign_b", F.explode("band_keys").alias("band_key"))
        few = [r.band_key for r in mine.select("band_key").distinct().collect()] if banded * BANDS <= FEW else None
        apart = F.bit_count(F.col("sign_a").bitwiseXOR(F.col("old_a"))) + F.bit_count(F.col("sign_b").bitwiseXOR(F.col("old_b")))
        theirs = self.stored("bands", few).select("band_key", F.col("class_hash").alias("old_hash"), F.col("sign_a").alias("old_a"), F.col("sign_b").alias("old_b"))
        near = theirs.join(mine.hint("shuffle_hash"), "band_key").where((F.col("class_hash") != F.col("old_hash")) & (apart <= BANDS * ROWS - least_agreement(self.threshold)))
        pairs = near.select("class_hash", "old_hash").distinct().unionByName(new.select("class_hash", F.col("class_hash").alias("old_hash")))
        named = None
        if few is not None:
            hashes = [r.old_hash for r in pairs.select("old_hash").distinct().limit(FEW + 1).collect()]
            named = hashes if len(hashes) <= FEW else None
        wanted = pairs.join(new.select("class_hash", "kind", "exact", "class_key"), "class_hash")
        old = self.stored("classes", named).select(F.col("class_hash").alias("old_hash"), F.col("kind").alias("old_kind"), F.col("class_key").alias("old_key"), "first_batch", "first_id")
        both = old.join(wanted, "old_hash").where("kind = old_kind AND (NOT exact OR class_key = old_key)")
        return both.select("kind", "class_hash", "class_key", "old_key", "first_batch", "first_id").mapInArrow(self._verify(), "kind string, class_hash long, class_key string, first_batch int, first_id string, is_known boolean")

    def _verify(self):
        threshold = self.threshold

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                same = np.array([x == y for x, y in zip(*(b.column(c).to_pylist() for c in ("class_key", "old_key")), strict=True)], bool)
                ok = np.flatnonzero(same | (exact_similarities(b.column("class_key").to_pylist(), b.column("old_key").to_pylist()) >= threshold - 1e-12))
                take = pa.array(ok, pa.int64())
                columns = ("kind", "class_hash", "class_key", "first_batch", "first_id")
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in columns), pa.array(same[ok])], names=[*columns, "is_known"])

        return run


def members(batch: DataFrame) -> DataFrame:
    """(kind, id, batch_no, key, exact, class_hash): every id once, without rows that can match nothing."""
    return (
        batch.where("id IS NOT NULL AND key IS NOT NULL AND (exact OR length(key) > 1)")
        .groupBy("kind", "id").agg(F.min(F.struct("batch_no", "key", "exact")).alias("r"))
        .select("kind", "id", "r.*").withColumn("class_hash", F.xxhash64("kind", "key"))
    )


def repeats_by_batch(spark: SparkSession, rows: DataFrame, path: str, threshold: float) -> DataFrame:
    """Lets the batches of ``rows`` (kind, id, batch_no, key, exact) arrive one by one at a new store in ``path``.

    Returns (kind, id, match_id) of all rows that repeat a row of an earlier batch. Rows without a batch number
    belong to no batch. The loop is over batches (the order of arrival), never over records. The store is removed
    at the end; what was found stays as a table in the shared folder.
    """
    arrived = scratch_path(spark, "rows")
    rows = write_table(members(rows.where("batch_no IS NOT NULL")), arrived, "batch_no")
    history = History(spark, path, threshold)
    hits = spark.createDataFrame([], "batch_no int, kind string, class_hash long, key string, match_id string")
    for r in sorted(rows.select("batch_no").distinct().collect()):
        one = history.hits(rows.where(F.col("batch_no") == r.batch_no), r.batch_no)
        hits = hits.unionByName(one.withColumn("batch_no", F.lit(r.batch_no)))
    found = rows.join(hits, ["batch_no", "kind", "class_hash", "key"]).select("kind", "id", "match_id")
    found = write_table(found, scratch_path(spark, "repeats"))
    history.close(remove=True)
    history.files.remove(arrived)
    return found
