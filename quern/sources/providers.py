"""Responses of transcription, page-reading and video services as rows, by JSON schemas and column expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The part of each service's response that is read, and how its utterances or pages are named.
SPEECH_SCHEMAS = {
    "assemblyai": "struct<utterances: array<struct<speaker: string, text: string, start: double, end: double, confidence: double>>>",
    "deepgram": "struct<results: struct<utterances: array<struct<speaker: string, transcript: string, start: double, end: double, confidence: double>>>>",
    "elevenlabs": "struct<words: array<struct<speaker_id: string, text: string, start: double, end: double, type: string, logprob: double>>>",
    "gladia": "struct<result: struct<transcription: struct<utterances: array<struct<speaker: string, text: string, start: double, end: double, confidence: double>>>>>",
    "groq": "struct<segments: array<struct<text: string, start: double, end: double, no_speech_prob: double>>>",
}
PAGE_SCHEMAS = {
    "mistral": "struct<pages: array<struct<index: int, markdown: string>>>",
    "llamaparse": "struct<pages: array<struct<page: int, md: string>>>",
    "datalab": "struct<markdown: string>",
}
VIDEO_SCHEMA = "array<struct<start_time: double, end_time: double, transcript: string, topic_summary: string>>"
#: What separates pages in a response that is one text.
PAGE_BREAK = r"\n*\{\d+\}-{20,}\n*"


def _each(df: DataFrame, key: str, response: str, service: str, schema: str, rows) -> DataFrame:
    parsed = df.where(F.col("provider") == service).select(F.col(key).alias("key"), "provider", "offset_s", F.from_json(F.col(response), schema).alias("r"))
    return parsed.select("key", "provider", "offset_s", F.posexplode(rows(F.col("r"))).alias("n", "u"))


def parse_transcripts(df: DataFrame, key: str, response: str) -> DataFrame:
    """(key, provider, n, speaker, start_sec, end_sec, text, confidence) of the utterances in services' responses.

    ``df`` has the key, provider, offset_s (where the slice begins in the recording) and the response. Milliseconds become seconds,
    times count from the recording's start, speakers are null where the service has none, confidence is a probability where
    one is given. Words come as one row each (see ``words_to_utterances``), blanks left out. Unknown services, null and malformed responses give no rows."""
    out = []

    def take(service: str, rows, speaker: Column, text: Column, scale: float = 1.0, confidence: Column | None = None, keep: Column | None = None) -> None:
        held = _each(df, key, response, service, SPEECH_SCHEMAS[service], rows)
        held = held if keep is None else held.where(keep)
        time = lambda c: F.col(f"u.{c}") * scale + F.coalesce("offset_s", F.lit(0.0))
        out.append(held.select("key", "provider", F.col("n").cast("bigint").alias("n"), speaker.alias("speaker"), time("start").alias("start_sec"), time("end").alias("end_sec"), text.alias("text"), (F.col("u.confidence") if confidence is None else confidence).alias("confidence")))

    take("assemblyai", lambda r: r["utterances"], F.col("u.speaker"), F.col("u.text"), 0.001)
    take("deepgram", lambda r: r["results"]["utterances"], F.col("u.speaker"), F.col("u.transcript"))
    take("elevenlabs", lambda r: r["words"], F.regexp_replace(F.col("u.speaker_id"), "^speaker_", ""), F.col("u.text"), 1.0, F.exp("u.logprob"), F.coalesce(F.col("u.type"), F.lit("word")) != "spacing")
    take("gladia", lambda r: r["result"]["transcription"]["utterances"], F.col("u.speaker"), F.col("u.text"))
    take("groq", lambda r: r["segments"], F.lit(None).cast("string"), F.col("u.text"), 1.0, 1 - F.col("u.no_speech_prob"))
    return reduce(DataFrame.unionByName, out)


def parse_pages(df: DataFrame, key: str, response: str) -> DataFrame:
    """(key, provider, page from ``first_page`` on, markdown) of page-reading services' responses; ``df`` has key, provider, first_page and the response."""
    base = df.withColumn("offset_s", F.col("first_page"))
    listed = [
        _each(base, key, response, "mistral", PAGE_SCHEMAS["mistral"], lambda r: r["pages"]).select("key", "provider", F.col("u.index").alias("at"), F.col("u.markdown").alias("markdown"), "offset_s"),
        _each(base, key, response, "llamaparse", PAGE_SCHEMAS["llamaparse"], lambda r: r["pages"]).select("key", "provider", (F.col("u.page") - 1).alias("at"), F.col("u.md").alias("markdown"), "offset_s"),
        _each(base, key, response, "datalab", PAGE_SCHEMAS["datalab"], lambda r: F.split(r["markdown"], PAGE_BREAK)).select("key", "provider", F.col("n").alias("at"), F.col("u").alias("markdown"), "offset_s"),
    ]
    pages = reduce(DataFrame.unionByName, listed)
    return pages.select("key", "provider", (F.col("at") + F.coalesce("offset_s", F.lit(0))).cast("bigint").alias("page"), F.trim("markdown").alias("markdown"))


def parse_video(df: DataFrame, key: str, response: str) -> DataFrame:
    """(key, n, start_time, end_time, transcript, topic_summary) of video services' segment lists, given as a JSON array with or without a Markdown fence."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(response), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return df.select(F.col(key).alias("key"), F.posexplode(F.from_json(bare, VIDEO_SCHEMA)).alias("n", "s")).select("key", F.col("n").cast("bigint").alias("n"), "s.*")
