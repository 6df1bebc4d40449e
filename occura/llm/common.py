"""Helpers shared by the text and near-duplicate operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table (in rows) that may be shipped whole to every task. Callers count first.
SMALL_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data directory, narrowed to ``columns`` so that the scan reads nothing else."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        configured = tempfile.mkdtemp(prefix="occura-shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/occura-{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Compute ``df`` once into a table at ``path`` and read it from there; readers fetch only the columns they name."""
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few things asked of the shared file system itself: list, read, write and remove small files."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def numbers(self, path: str, prefix: str) -> list[int]:
        return [int(n.removeprefix(prefix)) for n in self.names(path) if n.startswith(prefix)]

    def write(self, path: str, text: str) -> None:
        where, fs = self._at(path)
        out = fs.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()

    def text(self, path: str) -> str:
        where, fs = self._at(path)
        source = fs.open(where)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def remove(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)


def broadcast_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``limit`` rows; a larger side joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions for ``rows`` at a bounded number of rows each, never below the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


# ---------------------------------------------------------------- vectorised character pieces


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offset of each text (one more than there are texts)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum(lengths)))


def bigram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct two-character pieces per text.

    Returns (owner, hash32, distinct) where owner/hash32 list every (text, piece hash) once, sorted, and
    ``distinct`` counts exactly distinct pieces of each text (before hashing to 32 bits).
    """
    n = len(texts)
    if n > 1 << 22:
        raise ValueError("at most 4,194,304 texts at once")
    flat, offs = code_points(texts)
    if len(flat) < 2:
        return np.empty(0, np.int64), np.empty(0, np.uint32), np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offs))
    same = owner[1:] == owner[:-1]
    # Owner (22 bits) and both code points (21 bits each) in one number: one sort puts equal pieces side by side.
    packed = ((owner[:-1] << np.uint64(42)) | (flat[:-1].astype(np.uint64) << np.uint64(21)) | flat[1:])[same]
    packed.sort()
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed
    owner = (packed >> np.uint64(42)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    h = (((packed & np.uint64((1 << 42) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return owner, h, distinct


def exact_similarities(xs: list[str], ys: list[str]) -> np.ndarray:
    """Exact similarity of every pair (x, y) over two-character pieces; -1 where neither has a piece."""
    pieces: dict[str, set] = {}
    out = np.empty(len(xs))
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        if len(pieces) > 2_000:  # the sets kept for texts that come again are bounded
            pieces.clear()
        for t in (x, y):
            if t not in pieces:
                pieces[t] = {t[j : j + 2] for j in range(len(t) - 1)}
        a, b = pieces[x], pieces[y]
        both = len(a & b)
        out[i] = both / ((len(a) + len(b) - both) or -1) if a or b else -1.0
    return out


def jaccard_bigrams(a: str, b: str) -> float | None:
    """Exact similarity of two key texts over two-character pieces; None if neither has a piece."""
    x = {a[i : i + 2] for i in range(len(a) - 1)}
    y = {b[i : i + 2] for i in range(len(b) - 1)}
    union = len(x | y)
    return len(x & y) / union if union else None
