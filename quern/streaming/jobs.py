"""Structured Streaming jobs: resumable buffers per document, status counts, and sinks that write each batch once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.runtime import checkpoint_folder
from quern.sources import ingest as steps_of

ROWS_PER_BUFFER = 50
# Attempts before a message is given up, chunks per enrichment batch, and the events that webhooks get.
MAX_ATTEMPTS, BATCH_CHUNKS = 3, 30
WEBHOOK_EVENTS = ("PROCESSED", "FAILED")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder (see ``runtime.checkpoint_folder``)."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4()}"


def file_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, whether the table is one file or a folder of them; a stream takes a path that may be a file only
    as a pattern."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{directory}/{name}.parque[t]")


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available and return what it wrote. Appended batches are written under their number, so a
    batch that runs again replaces itself; in complete mode the last batch is the result."""
    out, state = shared_folder(spark), shared_folder(spark)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def advance_buffers(rows: DataFrame, key: str, order: str, size: int = ROWS_PER_BUFFER) -> DataFrame:
    """(key, buffer, first, last, n): per key, a micro-batch's rows in order cut into buffers; the cursor is state, so a restarted query goes on
    where it stopped. A buffer that one micro-batch leaves open is continued, and written again with its new end, by the next. The order values
    of one key in one micro-batch, whose size the trigger bounds, are sorted together."""
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, first = state.get if state.exists else (0, 0)
        held = [part[order].dropna().to_numpy() for part in parts]
        values = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.int64)
        out, at = [], 0
        while at < len(values):
            room = size - start % size
            if room == size:
                first = int(values[at])
            take = min(room, len(values) - at)
            start, at = start + take, at + take
            out.append((k[0], (start - 1) // size, first, int(values[at - 1]), (start - 1) % size + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "buffer", "first", "last", "n"])
        state.update((start, first))

    return rows.select(key, order).where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, buffer bigint, first bigint, last bigint, n bigint", "start bigint, first bigint", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, spark: SparkSession, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text, handler) through their handlers' steps: (states, points), what was published and what was injected.

    Both are written per micro-batch under its number, so a batch that runs again after a failure replaces itself; with the ``folder`` of an earlier
    run the job goes on where that stopped."""
    base = folder or shared_folder(spark)
    states = "key bigint, handler string, step bigint, cursor bigint, next_cursor bigint, is_last boolean, publishes string, n_units bigint"
    points = "key bigint, step bigint, chunk bigint, text string, terms array<string>"

    def sink(batch: DataFrame, number: int) -> None:
        done = steps_of.steps(batch)
        steps_of.chunks_of_steps(done).write.mode("overwrite").parquet(f"{base}/points/batch={number}")
        done.drop("body").write.mode("overwrite").parquet(f"{base}/states/batch={number}")

    query = stream.select("doc_id", "text", "handler").writeStream.option("checkpointLocation", f"{base}/progress").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(states).parquet(f"{base}/states/batch=*"), spark.read.schema(points).parquet(f"{base}/points/batch=*")


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and value of rows with a time; rows later than ``late`` are dropped from running streams."""
    zoned = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return zoned.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), by, "n")
