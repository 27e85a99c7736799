"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks file of a byte-level BPE; pass another path to measure with another vocabulary.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file that lies on the driver's machine to all executors."""
    if os.path.isfile(path):
        spark.sparkContext.addFile(path)


def shipped(path: str) -> str:
    """Where a task finds a vocabulary: the file that was sent, or else the path itself."""
    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.isfile(sent) else path


def count_tokens(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def with_token_counts(df: DataFrame, keep: list[str], text: str, out: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns plus the number of tokens of ``text`` (null and empty texts have 0). The text itself stays in
    the scan stage: only the count leaves it."""
    fields = [df.select(*keep).schema[c] for c in keep]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` bigint"])

    ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped(path)).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ddl)
