"""Token counts by a public tokenizer, in Arrow batches. Vocabulary files are read from a folder, never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@cache
def _encoding(folder: str, vocabulary: str):
    """One encoder a worker process."""
    import sys

    import tiktoken

    if folder not in sys.path:
        sys.path.append(folder)
    parent = folder.rstrip("/").rpartition("/")[0]
    try:
        import public_tokenizers
    except ImportError:
        sys.path.append(parent)
        import public_tokenizers
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[int]:
    return _encoding(folder, vocabulary).encode_ordinary(text)


def with_token_count(df: DataFrame, text: str, out: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with the number of its tokens in ``out`` (0 for null and empty texts)."""
    others = [c for c in df.columns if c not in (text, out)]
    names = [f"c{i}" for i in range(len(others))]
    kept = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)], F.col(f"`{text}`").alias("text"))
    schema = kept.withColumn("tokens", F.lit(None).cast("int")).drop("text").schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = _encoding(folder, vocabulary)
        for b in batches:
            texts = b.column(len(others)).to_pylist()
            counts = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], counts], names=[*names, "tokens"])

    return kept.mapInArrow(run, schema).toDF(*others, out)
