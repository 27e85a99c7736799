"""Latest row per key: late and repeated rows of an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], version: str, cols: list[str]) -> DataFrame:
    """Per key the row with the greatest ``version``; of equal versions the one with the greatest values.

    Rows with a null in a key take no part. A null version is older than any other. Only the named columns are
    read and returned. A partial maximum is taken before the shuffle, so a key that repeats in a third of
    all rows moves a row per task."""
    rest = [c for c in cols if c not in keys]
    known = df.select(*[F.col(k) for k in keys], F.struct(F.col(version).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"))
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    best = known.groupBy(*keys).agg(F.max("row").alias("row"))
    return best.select(*keys, *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)])
