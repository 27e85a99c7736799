"""Overlapping and gapped time intervals: merge them into continuous periods and list the gaps.

Time is cut into exact units (milliseconds by default) and, per entity, into shards of ``2**22`` units. Each
shard's covered units are kept as a *run bitmap*: a run container of little-endian ``uint32`` pairs (first unit,
number of units), as compressed bitmaps store dense stretches. Containers are built per Arrow batch (the map-side
combine), united first per salt and then per (entity, shard), and read out as set runs (periods) and clear runs
(gaps). Only the first and the last run of a shard can continue in another shard; those are stitched by a
window over at most two rows per shard. No task ever holds more of an entity than one shard's container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.runtime import cut_lineage

SHARD_UNITS = 1 << 22
SALTS = 16
#: By default, times beyond this many seconds from the start (a year) are no times of a recording.
MAX_SECONDS = 366.0 * 86_400


def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open unit ranges; ranges that overlap or touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.concatenate(([True], start[1:] > reach[:-1]))
    closes = np.concatenate((opens[1:], [True]))
    return start[opens], reach[closes]


def encode(start: np.ndarray, end: np.ndarray) -> bytes:
    """A run container: pairs of first unit and number of units."""
    runs = np.empty((len(start), 2), dtype="<u4")
    runs[:, 0], runs[:, 1] = start, end - start
    return runs.tobytes()


def decode(container: bytes) -> tuple[np.ndarray, np.ndarray]:
    runs = np.frombuffer(container, dtype="<u4").reshape(-1, 2).astype(np.int64)
    return runs[:, 0], runs[:, 0] + runs[:, 1]


def merge_containers(containers: list[bytes]) -> bytes:
    parts = [decode(c) for c in containers]
    return encode(*unite(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        names = pa.array(batch.column(0)).dictionary_encode()
        key = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start = batch.column(1).to_numpy(zero_copy_only=False)
        end = batch.column(2).to_numpy(zero_copy_only=False)
        first, last = start // SHARD_UNITS, (end - 1) // SHARD_UNITS
        times = last - first + 1
        row = np.repeat(np.arange(len(key)), times)
        shard = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times))
        lo = np.maximum(start[row], shard * SHARD_UNITS) - shard * SHARD_UNITS
        hi = np.minimum(end[row], (shard + 1) * SHARD_UNITS) - shard * SHARD_UNITS
        group = np.unique(np.stack([key[row], shard], axis=1), axis=0, return_inverse=True)
        pairs, g = group[0], np.asarray(group[1]).reshape(-1)
        # one stride per group, a unit wider than a shard, so that runs of different groups never touch
        stride = SHARD_UNITS + 1
        a, b = unite(g * stride + lo, g * stride + hi)
        owner = a // stride
        cuts = np.searchsorted(owner, np.arange(len(pairs) + 1))
        a, b = a - owner * stride, b - owner * stride
        values = names.dictionary.take(pa.array(pairs[:, 0]))
        yield pa.RecordBatch.from_arrays(
            [values, pa.array(pairs[:, 1]), pa.array([encode(a[i:j], b[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
            names=["entity", "shard", "runs"],
        )


def _merge_column(containers: pd.Series) -> pd.Series:
    return containers.map(lambda c: merge_containers(list(c)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for entity, shard, containers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = decode(merge_containers(containers))
            a, b, n = a + shard * SHARD_UNITS, b + shard * SHARD_UNITS, len(a)
            edge = np.zeros(n, dtype=bool)
            edge[0] = edge[-1] = True
            # set runs, then the clear runs between them
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([entity] * (2 * n - 1)),
                    pa.array(np.full(2 * n - 1, shard)),
                    pa.array(["period"] * n + ["gap"] * (n - 1)),
                    pa.array(np.concatenate([a, b[:-1]])),
                    pa.array(np.concatenate([b, a[1:]])),
                    pa.array(np.concatenate([edge, np.zeros(n - 1, dtype=bool)])),
                    pa.array(np.concatenate([np.arange(n) == 0, np.zeros(n - 1, dtype=bool)])),
                ],
                names=["entity", "shard", "kind", "start_u", "end_u", "edge", "opens"],
            )


def shard_runs(df: DataFrame, entity: str, start_u: str, end_u: str) -> DataFrame:
    """Per (entity, shard) the set and clear runs of the united bitmap: (entity, shard, kind, start_u, end_u, edge, opens)."""
    usable = df.select(F.col(entity).cast("string").alias("entity"), F.col(start_u).cast("bigint").alias("a"), F.col(end_u).cast("bigint").alias("b")).where("entity is not null and a < b")
    built = usable.mapInArrow(_build, "entity string, shard bigint, runs binary")
    merge = F.pandas_udf(_merge_column, "binary")
    salted = built.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("entity", "shard", "salt").agg(merge(F.collect_list("runs")).alias("runs"))
    united = salted.groupBy("entity", "shard").agg(F.collect_list("runs").alias("runs"))
    return united.mapInArrow(_extract, "entity string, shard bigint, kind string, start_u bigint, end_u bigint, edge boolean, opens boolean")


def _stitch(runs: DataFrame) -> DataFrame:
    """Runs at a shard's edges, with the period that each belongs to: adds island_start, island_end, gap_before."""
    w = Window.partitionBy("entity").orderBy("start_u", "end_u")
    edges = runs.where("edge and kind = 'period'").withColumn("before", F.lag("end_u").over(w))
    edges = edges.withColumn("new", F.coalesce(F.col("start_u") > F.col("before"), F.lit(True)))
    edges = edges.withColumn("island", F.sum(F.col("new").cast("int")).over(w))
    whole = Window.partitionBy("entity", "island")
    return edges.withColumns({"island_start": F.min("start_u").over(whole), "island_end": F.max("end_u").over(whole)})


def _sound(start: str, end: str, max_seconds: float) -> Column:
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    return (F.abs(s) <= max_seconds) & (F.abs(e) <= max_seconds) & (e > s)


def beyond_bounds(df: DataFrame, start: str, end: str, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """(rows): how many rows with known, finite times in order are left out because a time lies beyond ``max_seconds``."""
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    finite = (F.abs(s) < float("inf")) & (F.abs(e) < float("inf")) & (e > s)
    return df.where(finite & ~_sound(start, end, max_seconds)).agg(F.count(F.lit(1)).alias("rows"))


def continuous_periods(df: DataFrame, entity: str, start: str, end: str, units_per_second: int = 1000, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Periods covered by the rows' intervals and the gaps between successive periods, per entity.

    ``start`` and ``end`` are seconds; they are rounded to ``1 / units_per_second``. Intervals that overlap or
    exactly touch belong to one period. Rows with a null entity, a null, infinite or not-a-number time, or an end
    that isn't after the start take no part, nor do rows with a time beyond ``max_seconds``, which bounds the shards that one row can fall
    into (:func:`beyond_bounds` counts such rows); repeated rows change nothing; an empty table gives an empty result.
    Only the three named columns are read, so other columns may have any name.

    Returns (entity string, kind string, start_u bigint, end_u bigint), one row per period and gap."""
    a, b = F.col(start).cast("double") * units_per_second, F.col(end).cast("double") * units_per_second
    sound = _sound(start, end, max_seconds)
    units = df.where(sound).select(F.col(entity).alias("entity"), F.round(a).cast("bigint").alias("a"), F.round(b).cast("bigint").alias("b"))
    runs = cut_lineage(shard_runs(units, "entity", "a", "b"))
    edges = _stitch(runs)
    out = ["entity", "kind", "start_u", "end_u"]
    inner = runs.where("not edge").select(*out)
    stitched = edges.where("new").select("entity", F.lit("period").alias("kind"), F.col("island_start").alias("start_u"), F.col("island_end").alias("end_u"))
    # between shards, the clear run reaches from the last run of one to the first run of the next
    across = edges.where("opens and new and before is not null").select("entity", F.lit("gap").alias("kind"), F.col("before").alias("start_u"), F.col("start_u").alias("end_u"))
    return inner.unionByName(stitched).unionByName(across)


def period_members(df: DataFrame, entity: str, key: str, start: str, end: str, payload: list[str], units_per_second: int = 1000, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Every usable interval with the period it lies in: (entity, key, start_u, end_u, payload..., period_start_u, period_end_u).

    In order of (start_u, end_u, key) within a period, the rows give its contents in order. Each interval meets
    only the runs of its own first shard: runs and intervals are sorted together there and the latest run's
    period is carried forward, so nothing is paired."""
    a, b = F.col(start).cast("double") * units_per_second, F.col(end).cast("double") * units_per_second
    sound = _sound(start, end, max_seconds) & F.col(entity).isNotNull()
    items = df.where(sound).select(F.col(entity).cast("string").alias("entity"), F.col(key).alias("key"), F.round(a).cast("bigint").alias("start_u"), F.round(b).cast("bigint").alias("end_u"), F.struct(*payload).alias("load"))
    runs = cut_lineage(shard_runs(items, "entity", "start_u", "end_u"))
    edges = _stitch(runs).select("entity", "shard", "start_u", F.col("island_start").alias("ps"), F.col("island_end").alias("pe"))
    inner = runs.where("not edge and kind = 'period'").select("entity", "shard", "start_u", F.col("start_u").alias("ps"), F.col("end_u").alias("pe"))
    marks = edges.unionByName(inner).select("entity", "shard", "start_u", F.lit(0).alias("rank"), "ps", "pe", F.lit(None).cast(items.schema["key"].dataType).alias("key"), F.lit(None).cast("bigint").alias("end_u"), F.lit(None).cast(items.schema["load"].dataType).alias("load"))
    rows = items.select("entity", F.floor(F.col("start_u") / SHARD_UNITS).alias("shard"), "start_u", F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("ps"), F.lit(None).cast("bigint").alias("pe"), "key", "end_u", "load")
    w = Window.partitionBy("entity", "shard").orderBy("start_u", "rank").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumns({"ps": F.last("ps", True).over(w), "pe": F.last("pe", True).over(w)})
    return both.where("rank = 1").select("entity", "key", "start_u", "end_u", *[F.col(f"load.{p}").alias(p) for p in payload], F.col("ps").alias("period_start_u"), F.col("pe").alias("period_end_u"))
