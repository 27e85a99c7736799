"""Tabular and line-based scans: buffers of rows, byte caps, row serialisation, text windows and paragraph batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.runtime import exclusive_scan

ROWS_PER_BUFFER = 500
ROWS_PER_SHARD = 1 << 16
CARRY_CHARS = 500


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited file with a header: all columns strings, empty cells '', bad lines dropped."""
    df = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).option("mode", "DROPMALFORMED").option("encoding", "UTF-8").csv(path)
    return df.na.fill("")


def drop_empty_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with at least one cell that is neither null nor blank; row numbers taken before stay those of the sheet."""
    return df.where(F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), lambda x: F.trim(x) != ""))


def number_rows(df: DataFrame, key: str, out: str = "row_number") -> DataFrame:
    """Rows numbered from 0 in order of a unique integer ``key``: counted per range of keys, then added up, so no task sorts
    the whole table. Rows with a null key are dropped."""
    known = df.where(F.col(key).isNotNull()).withColumns({"__all": F.lit(0), "__shard": F.floor(F.col(key) / ROWS_PER_SHARD)})
    return exclusive_scan(known, ["__all"], [key], "__shard", F.lit(1), out).drop("__all", "__shard")


def row_text(cols: list[str]) -> Column:
    """A row as stored: ``c1: v1, c2: v2``; nulls are empty."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])


def row_terms(cols: list[str]) -> Column:
    """A row as clustered: ``c1 v1 c2 v2``."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])


def assign_buffers(df: DataFrame, row: str = "row_number", size: int = ROWS_PER_BUFFER) -> DataFrame:
    return df.withColumn("buffer", F.floor(F.col(row) / size).cast("bigint"))


def cap_bytes(df: DataFrame, line: str, cap: int, buffer: str = "buffer", row: str = "row_number") -> DataFrame:
    """Rows of each buffer up to the byte cap on their running sum, the first row always: adds ``bytes_so_far`` and ``kept``."""
    w = Window.partitionBy(buffer).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(buffer).orderBy(row)) == 1
    return df.withColumn("bytes_so_far", F.sum(F.octet_length(line)).over(w)).withColumn("kept", (F.col("bytes_so_far") <= cap) | first)


def rebalance(df: DataFrame, scope: list[str], cluster: str, row: str, cap: int) -> DataFrame:
    """Clusters cut into consecutive groups of at most ``cap`` rows and numbered from 0 per scope in order of cluster: adds ``group_index``."""
    rank = F.row_number().over(Window.partitionBy(*scope, cluster).orderBy(row)) - 1
    cut = df.withColumn("__part", F.floor(rank / cap))
    return cut.withColumn("group_index", F.dense_rank().over(Window.partitionBy(*scope).orderBy(cluster, "__part")) - 1).drop("__part")


def assemble_groups(df: DataFrame, scope: list[str], row: str, line: str, name: str) -> DataFrame:
    """One chunk per group: id, text (rows in order, one to a line), row numbers and count."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(line).alias("t"))))
    grouped = df.groupBy(*scope, "group_index").agg(rows.alias("rows"))
    return grouped.select(*scope, "group_index", F.concat(F.lit(f"{name}-"), F.col("group_index").cast("string")).alias("chunk"), F.array_join(F.transform("rows", lambda x: x["t"]), "\n").alias("text"), F.transform("rows", lambda x: x["r"]).alias("row_numbers"), F.size("rows").alias("row_count"))


def text_windows(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """A text cut into windows of ``size`` characters, each with the last 500 characters of the one before as ``carry``:
    (key, window, carry, body). Whole texts; null and empty texts give no window."""
    n = F.ceil(F.length(text) / size).cast("int")
    cut = df.where(F.length(text) > 0).select(F.col(key), F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    start = F.col("window") * size
    carry = F.when(F.col("window") > 0, F.substring(F.col("__t"), F.greatest(start - CARRY_CHARS, F.lit(0)) + 1, F.least(F.lit(CARRY_CHARS), start))).otherwise("")
    return cut.select(key, "window", carry.alias("carry"), F.substring(F.col("__t"), start + 1, F.lit(size)).alias("body"))


def paragraph_batches(df: DataFrame, key: str, text: str, per_batch: int, separator: str = "\n") -> DataFrame:
    """Non-empty paragraphs in batches of ``per_batch``, each with the tail of the up to three paragraphs before it:
    (key, batch, n_paragraphs, carry, body)."""
    lines = F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")
    held = df.where(F.col(text).isNotNull()).select(F.col(key), lines.alias("p")).where(F.size("p") > 0)
    batches = held.select(key, "p", F.explode(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / per_batch).cast("int"))).alias("batch"))
    first = F.col("batch") * per_batch
    before = F.array_join(F.slice("p", F.greatest(first - 3, F.lit(0)) + 1, F.least(F.lit(3), first)), "\n")
    body = F.slice("p", first + 1, F.lit(per_batch))
    return batches.select(key, "batch", F.size(body).alias("n_paragraphs"), F.when(F.col("batch") > 0, F.right(before, F.lit(CARRY_CHARS))).otherwise("").alias("carry"), F.array_join(body, "\n").alias("body"))


def slide_text(title: Column, shapes: Column) -> Column:
    """Title first, then the shapes' texts; blank parts left out."""
    return F.array_join(F.filter(F.concat(F.array(title), shapes), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "\n")


def slices(df: DataFrame, key: str, seconds: str, core: float, overlap: float = 0.0) -> DataFrame:
    """Recording slices: (key, slice, core_start, core_end, read_start, read_end, is_last)."""
    n = F.greatest(F.ceil(F.col(seconds) / core), F.lit(1)).cast("int")
    cut = df.where(F.col(seconds) > 0).select(key, F.col(seconds).alias("__s"), n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("slice"))
    start, end = F.col("slice") * F.lit(core), F.least((F.col("slice") + 1) * F.lit(core), F.col("__s"))
    return cut.select(key, "slice", start.alias("core_start"), end.alias("core_end"), F.greatest(start - overlap, F.lit(0.0)).alias("read_start"), F.least(end + overlap, F.col("__s")).alias("read_end"), (F.col("slice") == F.col("__n") - 1).alias("is_last"))
