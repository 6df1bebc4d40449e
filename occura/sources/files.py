"""Sources and sinks: Markdown corpora, JSON lines, content-addressed snapshots, versioned index directories.

Everything is written and read through Spark, so paths may lie on any file system it knows.
"""

from __future__ import annotations

import json
import math
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 2_000_000
#: Names that are never part of a corpus when they lie at its root.
ROOT_SKIPPED = ("issue.md",)


def contained(root: str, relative: str) -> str:
    """``relative`` under ``root``; absolute and escaping paths are refused."""
    clean = posixpath.normpath(relative)
    if posixpath.isabs(relative) or clean == ".." or clean.startswith("../"):
        raise ValueError(f"{relative!r} leaves the corpus")
    return posixpath.join(root, clean)


def markdown_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, content_hash, text, valid) of all Markdown files below ``root``, in case-folded order of path.

    Texts lose a byte-order mark and have LF line ends; a file that is not UTF-8, or longer than MAX_BYTES, has no
    text and is not valid.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = F.replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), F.lit(base), F.lit(""))
    valid = (F.col("length") <= MAX_BYTES) & F.expr("is_valid_utf8(CAST(content AS STRING))")
    text = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), "^\\x{FEFF}", ""), r"\r\n?", "\n")
    out = files.select(path.alias("relative_path"), F.sha2("content", 256).alias("content_hash"), F.when(valid, text).alias("text"), valid.alias("valid"))
    return out.where(~F.col("relative_path").isin(*ROOT_SKIPPED)).orderBy(F.lower("relative_path"), "relative_path")


def save_snapshots(documents: DataFrame, path: str) -> int:
    """Appends texts whose content hash is not stored yet and returns how many; the same hash is the same text."""
    spark = documents.sparkSession
    new = documents.where("text IS NOT NULL").select("content_hash", "text").dropDuplicates(["content_hash"])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select("content_hash"), "content_hash", "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return n


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; malformed lines fail the read, and so do NaN and infinite numbers."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(f.name) | (F.abs(F.col(f.name)) == F.lit(math.inf))
            df = df.withColumn(f.name, F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)).otherwise(F.col(f.name)))
    return df


def export_lines(df: DataFrame, path: str) -> int:
    """Gzip JSON lines; returns the number of rows read back, which must equal what was written."""
    written = df.count()
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    read = df.sparkSession.read.schema(df.schema).json(path).count()
    if read != written:
        raise OSError(f"{written} rows were written and {read} can be read")
    return read


class Versions:
    """Immutable revision directories and one small pointer that names the published one.

    A revision is written whole before the pointer moves, so readers see the old or the new one, never a mixture.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, df: DataFrame, revision: int, expected_rows: int | None = None) -> None:
        """Writes ``revision`` and publishes it; publishing it again changes nothing, and an older one is refused."""
        now = self.current()
        if now is not None and revision <= now:
            if revision == now:
                return
            raise ValueError(f"revision {revision} is older than {now}")
        where = f"{self.path}/revision={revision}"
        df.write.mode("overwrite").parquet(where)
        rows = self.spark.read.parquet(where).count()
        if expected_rows is not None and rows != expected_rows:
            raise ValueError(f"{rows} rows instead of {expected_rows}; nothing was published")
        pointer = self.spark.createDataFrame([(json.dumps({"revision": revision, "rows": rows}),)], "value string")
        pointer.coalesce(1).write.mode("append").text(f"{self.path}/pointer")

    def current(self) -> int | None:
        """The published revision, None before the first."""
        if not _exists(self.spark, f"{self.path}/pointer"):
            return None
        return self.spark.read.text(f"{self.path}/pointer").agg(F.max(F.get_json_object("value", "$.revision").cast("long"))).first()[0]

    def read(self, revision: int | None = None) -> DataFrame:
        """A revision, by default the published one; one that does not exist is an error."""
        wanted = self.current() if revision is None else revision
        where = f"{self.path}/revision={wanted}"
        if wanted is None or not _exists(self.spark, where):
            raise LookupError(f"revision {wanted} was never published")
        return self.spark.read.parquet(where)


def cached(keys: DataFrame, path: str, compute, key: str) -> DataFrame:
    """``compute`` of those rows whose key is not in the cache at ``path``, appended to it; all rows of ``keys`` from the cache."""
    spark = keys.sparkSession
    missing = keys.dropDuplicates([key])
    if _exists(spark, path):
        missing = missing.join(spark.read.parquet(path).select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return keys.join(spark.read.parquet(path), key)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
