"""Periods of speech of the spoken video segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.intervals import continuous_periods, period_members
from quern.operators.latest import latest_rows
from quern.runtime import table

COLUMNS = ["document_id", "segment_id", "start_time", "end_time", "transcript"]


def spoken_segments(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every segment, if its transcript isn't blank; rows without a segment_id stand for themselves."""
    raw = table(spark, d, "segments")
    once = latest_rows(raw, ["segment_id"], "ingested_at", COLUMNS).select(*COLUMNS).unionByName(raw.where("segment_id is null").select(*COLUMNS))
    return once.where(F.col("transcript").rlike(r"(?U)\S"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    periods = continuous_periods(spoken_segments(spark, d), "document_id", "start_time", "end_time")
    return periods.select(F.col("entity").alias("document_id"), "kind", F.col("start_u").alias("start_ms"), F.col("end_u").alias("end_ms"))


def p2_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Every spoken segment with its period; in order of start, end and segment_id the rows of a period are its transcript."""
    rows = period_members(spoken_segments(spark, d), "document_id", "segment_id", "start_time", "end_time", ["transcript"])
    return rows.select(F.col("entity").alias("document_id"), F.col("period_start_u").alias("period_start_ms"), F.col("period_end_u").alias("period_end_ms"), F.col("start_u").alias("start_ms"), F.col("end_u").alias("end_ms"), F.col("key").alias("segment_id"), "transcript")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_transcripts": p2_transcripts}

_ISLANDS = r"""
    WITH latest AS (SELECT * FROM segments WHERE segment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY ingested_at DESC NULLS LAST) = 1),
    usable AS (SELECT document_id, segment_id, transcript, round(start_time * 1000)::BIGINT AS a, round(end_time * 1000)::BIGINT AS b FROM latest
               WHERE document_id IS NOT NULL AND end_time > start_time AND regexp_matches(transcript, '[^\s]')),
    marked AS (SELECT *, a > max(b) OVER (PARTITION BY document_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opens FROM usable),
    numbered AS (SELECT *, sum(coalesce(opens, true)::INT) OVER (PARTITION BY document_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM marked),
    periods AS (SELECT document_id, k, min(a) AS a, max(b) AS b FROM numbered GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "p2_found": _ISLANDS
    + """
    SELECT document_id, 'period' AS kind, a AS start_ms, b AS end_ms FROM periods
    UNION ALL
    SELECT document_id, 'gap', b, nxt FROM (SELECT document_id, b, lead(a) OVER (PARTITION BY document_id ORDER BY a) AS nxt FROM periods) WHERE nxt IS NOT NULL""",
    "p2_transcripts": _ISLANDS
    + """
    SELECT n.document_id, p.a AS period_start_ms, p.b AS period_end_ms, n.a AS start_ms, n.b AS end_ms, segment_id, transcript
    FROM numbered n JOIN periods p USING (document_id, k)""",
}
