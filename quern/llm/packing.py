"""Filling fixed-capacity containers with whole items: minimum bin slack over the multiset of lengths.

What matters of an item is its length, and no length exceeds the capacity, so the whole collection is a histogram of at
most ``capacity`` counts however many items there are. Containers are filled one pattern at a time: the longest
remaining item opens it, and a bitset subset-sum dynamic program over the remaining lengths (one big integer, bit s =
"a sum of s can be reached") finds the fill closest to the capacity; its counts are found by tracing the bitsets
back. A pattern is repeated as often as the remaining counts allow, so there are about as many patterns as
lengths. Items then find their container by their rank among the items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from quern.runtime import cut_lineage, exclusive_scan

RANK_SHARDS = 256


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest to ``room`` from below, as length -> count."""
    full, reach = (1 << (room + 1)) - 1, 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted((x for x, n in counts.items() if n > 0 and x <= room), reverse=True):
        trail.append((length, counts[length], reach))
        left, step = min(counts[length], room // length), 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (length * take)) & full
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, n, before in reversed(trail):
        k = 0
        while not before >> total & 1:
            total, k = total - length, k + 1
        if k:
            chosen[length] = k
    return chosen


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how often, length -> count) that use every item once; lengths are 1 to ``capacity``."""
    left, patterns = {x: n for x, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = best_fill(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        often = min(left[x] // n for x, n in pattern.items())
        patterns.append((often, pattern))
        for x, n in pattern.items():
            left[x] -= often * n
            if not left[x]:
                del left[x]
    return patterns


def _placements(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: from which rank on, into which first container, how many to a container."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for often, pattern in patterns:
        for length, n in pattern.items():
            rows.setdefault(length, []).append((used.get(length, 0), base, n))
            used[length] = used.get(length, 0) + often * n
        base += often
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}  # type: ignore[misc]


def token_items(documents: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every document with a key, written once for all capacities."""
    return cut_lineage(with_token_counts(documents.where(F.col(key).isNotNull()), [key], text, path=vocabulary))


def fill_containers(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Assign every item to a container: (key, piece bigint, offset bigint, length bigint, container string).

    An item of at most ``capacity`` is one piece. A larger one is cut into full containers of its own and a
    rest that is packed like an item. An item of size 0 (null or empty text) takes no room and goes to the first
    container. ``key`` must be unique and not null; sizes that are null count as 0. An empty table gives an empty result."""
    whole = items.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    pieces = whole.select("key", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1))).alias("piece"))
    pieces = pieces.select("key", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * F.lit(capacity)).cast("bigint").alias("offset"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece") * capacity).alias("length"), (F.col("size") > capacity).alias("oversized"))
    alone = F.col("oversized") & (F.col("length") == capacity)
    packed = pieces.where(~alone)
    histogram = {r["length"]: r["n"] for r in packed.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = items.sparkSession.sparkContext.broadcast(_placements(pack_histogram(histogram, capacity)))  # bounded by the capacity

    ranked = exclusive_scan(packed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(RANK_SHARDS))), ["length"], ["key", "piece"], "shard", F.lit(1), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = shared.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            container = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                if x > 0:
                    at, (first, base, n) = np.flatnonzero(length == x), placed[int(x)]
                    i = np.searchsorted(first, rank[at], side="right") - 1
                    container[at] = base[i] + (rank[at] - first[i]) // n[i]
            names = pa.array([f"c{c}" for c in container.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], names], names=["key", "piece", "offset", "length", "container"])

    kind = ranked.schema["key"].dataType.simpleString()
    together = ranked.select("key", "piece", "offset", "length", F.col("rank").cast("bigint").alias("rank")).mapInArrow(place, f"key {kind}, piece bigint, offset bigint, length bigint, container string")
    own = pieces.where(alone).select("key", "piece", "offset", "length", F.concat(F.lit("own-"), F.col("key").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"))
    return together.unionByName(own).withColumnRenamed("key", key)


def fill_report(assigned: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, least, fill): containers used, tokens held, the fewest any packing could use, share filled."""
    used = assigned.groupBy("container").agg(F.sum("length").alias("n")).agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return used.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))
