"""Session-level helpers every operator may use: table access, lineage cuts and two-level prefix scans."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back, so that later branches share one
    computation and lost executors cost no recomputation of it.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and everything runs on one machine is a
    temporary one made."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; on one machine a temporary one where it is unset. On a cluster
    that is an error, since other machines can't read a local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quern-checkpoint-")


def null_last_key(*cols: Column) -> list[Column]:
    """Sort keys with nulls after all values."""
    return [c.asc_nulls_last() for c in cols]


def exclusive_scan(df: DataFrame, keys: list[str], order: list[str], shard: str, value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in ``order``, without sorting a whole key in one task.

    ``shard`` is a column that is monotone in ``order`` within a key. Sums per (key, shard) are scanned in a
    small window; rows are only sorted within their own shard, so a key with a third of all rows is
    spread over as many tasks as it has shards. Nulls of ``value`` count as 0."""
    v, base = f"__v_{out}", f"__base_{out}"
    df = df.withColumn(v, F.coalesce(value, F.lit(0)))
    per_shard = df.groupBy(*keys, shard).agg(F.sum(v).alias(base))
    w_shard = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_shard.select(*keys, shard, F.coalesce(F.sum(base).over(w_shard), F.lit(0)).alias(base))
    w_row = Window.partitionBy(*keys, shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn(out, F.coalesce(F.sum(v).over(w_row), F.lit(0)))
    joined = local.join(offsets, [*keys, shard], "inner")
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(v, base)


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def data_dir(default: str) -> str:
    return os.environ.get("BENCH_SF_DIR", default)


def carry(df: DataFrame, keys: list[str], shard: str, order: list[str], value: str, out: str, inclusive: bool) -> DataFrame:
    """Last non-null ``value`` per ``keys`` in ``order``, up to the row (inclusive) or before it (exclusive).

    Two levels, as in :func:`exclusive_scan`: rows are sorted within their ``shard`` only, and the last value of
    each shard is handed on by a window over one row per (key, shard)."""
    c = f"__carry_{out}"
    last = df.where(F.col(value).isNotNull()).groupBy(*keys, shard).agg(F.max_by(value, F.struct(*order)).alias(c))
    present = df.groupBy(*keys, shard).agg(F.count(F.lit(1)).alias("__n")).join(last, [*keys, shard], "left")
    w_shard = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    handed = present.select(*keys, shard, F.last(c, True).over(w_shard).alias(c))
    w_row = Window.partitionBy(*keys, shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df.withColumn(out, F.last(value, True).over(w_row))
    return local.join(handed, [*keys, shard], "inner").withColumn(out, F.coalesce(out, c)).drop(c)
