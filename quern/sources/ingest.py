"""Ingestion: every document goes to the handler of its format, which reads it buffer by buffer, and every buffer is chunked, enriched, injected
and followed by the next.

A handler says how a document falls into units (characters, or parts between separators), how many units a step reads, and what its cursor counts.
Steps are planned from the number of units alone, so a document's steps are rows of one plan and a restarted job continues at its cursor.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.lexicon import content_words
from quern.operators.chunking import recursive_split

CHUNK_SIZE, CHUNK_OVERLAP = 1500, 200


class Handler(NamedTuple):
    name: str
    cursor: str
    separator: str | None
    per_step: int


# What each format's cursor counts; buffers of characters, and of parts between separators (as patterns).
HANDLERS = (
    Handler("txt", "file_chunk_number", None, 2000),
    Handler("code", "file_chunk_number", None, 2000),
    Handler("json", "start_object", r"\n", 500),
    Handler("xml", "start_object", r"(?=<record>)", 500),
    Handler("yaml", "start_object", r"\n(?=- )", 500),
    Handler("csv", "start_row", r"\n", 500),
    Handler("excel", "start_row", r"\n", 500),
    Handler("html", "start_unit", r"\n", 50),
    Handler("markdown", "file_chunk_number", r"\n\s*\n", 20),
    Handler("pdf", "file_chunk_number", r"\n\s*\n", 10),
    Handler("docx", "file_chunk_number", r"\n", 50),
    Handler("ppt", "file_chunk_number", r"\n\s*\n", 10),
    Handler("ocr", "start_page", r"\f", 4),
    Handler("audio", "file_chunk_number", r"\n", 40),
    Handler("video", "file_chunk_number", r"\n", 40),
)
ALIASES = {"text": "txt", "doc": "docx", "xlsx": "excel", "md": "markdown", "pptx": "ppt"}


def dispatch(kind: Column, markdown: Column | None = None, pages: Column | None = None) -> Column:
    """The handler of an upload: markdown if it comes with Markdown parameters, ocr with page parameters, else by its file type; null for
    an unknown type."""
    plain = F.lower(F.trim(kind))
    known = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[plain], plain)
    by_type = F.when(known.isin(*[h.name for h in HANDLERS]), known)
    if pages is not None:
        by_type = F.when(pages.isNotNull(), "ocr").otherwise(by_type)
    return by_type if markdown is None else F.when(markdown.isNotNull(), "markdown").otherwise(by_type)


def steps(documents: DataFrame, key: str = "doc_id", text: str = "text", handler: str = "handler") -> DataFrame:
    """(key, handler, step, cursor, next_cursor, is_last, publishes, n_units, body): one row per buffer of every document.

    ``cursor`` is where the step starts in the handler's own unit; ``publishes`` names what it sends on: the handler again, or ``completed``
    with the last step. Blank parts are no units. Documents without a handler, and null or unit-less texts, give no step."""
    by_name = lambda pick: F.create_map(*[F.lit(x) for h in HANDLERS for x in (h.name, pick(h))])[F.col("handler")]
    mine = documents.select(F.col(key).alias("key"), F.col(handler).alias("handler"), F.col(text).alias("t"))
    mine = mine.where(F.col("handler").isin(*[h.name for h in HANDLERS]) & F.col("t").isNotNull()).withColumn("per", by_name(lambda h: h.per_step))

    def buffers(units: Column, body: Callable[[Column], Column]) -> Column:
        last = F.floor((units - 1) / F.col("per")).cast("int")
        return F.when(units > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("step"), last.alias("last"), units.alias("units"), body(i).alias("body"))))

    # all handlers in one pass: the documents are read once, and a document's parts or length, as a lambda's argument, are told once
    cuts = []
    for separator in dict.fromkeys(h.separator for h in HANDLERS):
        if separator is None:
            cut = F.transform(F.array(F.length("t")), lambda n: buffers(n, lambda i: F.substring(F.col("t"), i * F.col("per") + 1, F.col("per"))))
        else:
            parts = F.filter(F.split("t", separator), lambda x: F.trim(x) != "")
            cut = F.transform(F.array(parts), lambda p: buffers(F.size(p), lambda i: F.array_join(F.slice(p, i * F.col("per") + 1, F.col("per")), "\n")))
        cuts.append(F.when(F.col("handler").isin(*[h.name for h in HANDLERS if h.separator == separator]), cut[0]))
    rows = mine.select("key", "handler", "per", F.inline(F.coalesce(*cuts)))
    # the one-character and one-part units of a step; its cursor counts steps where the format's does, else units
    n = F.least(F.col("per"), F.col("units") - F.col("step") * F.col("per"))
    whole = by_name(lambda h: h.cursor == "file_chunk_number")
    start = F.when(whole, F.col("step")).otherwise(F.col("step") * F.col("per"))
    after = start + F.when(whole, 1).otherwise(n)
    is_last = F.col("step") == F.col("last")
    return rows.select("key", "handler", F.col("step").cast("bigint").alias("step"), start.cast("bigint").alias("cursor"), after.cast("bigint").alias("next_cursor"), is_last.alias("is_last"), F.when(is_last, "completed").otherwise(F.col("handler")).alias("publishes"), n.cast("bigint").alias("n_units"), "body")


def chunks_of_steps(done: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, step, chunk, text, terms): every step's buffer chunked and enriched with its distinct words, as injected."""
    import pandas as pd

    pieces = F.pandas_udf(lambda s: pd.Series([recursive_split(t, size, overlap) for t in s], dtype=object), "array<string>")
    cut = done.select("key", "step", F.posexplode(pieces(F.col("body"))).alias("chunk", "text"))
    return cut.select("key", "step", F.col("chunk").cast("bigint").alias("chunk"), "text", F.array_distinct(content_words(F.col("text"))).alias("terms"))


def page_turns(documents: DataFrame, key: str, pages: str, per_batch: Column) -> DataFrame:
    """(key, turn, stage, page_start, page_end): page batches read and turned to Markdown by turns, each batch's Markdown before the next batch is read."""
    n = F.ceil(F.col(pages) / per_batch).cast("int")
    batches = documents.where((F.col(pages) > 0) & (per_batch > 0)).select(F.col(key).alias("key"), F.col(pages).cast("bigint").alias("pages"), per_batch.cast("bigint").alias("per"), F.explode(F.sequence(F.lit(0), n - 1)).alias("b"))
    both = batches.select("key", "pages", "per", "b", F.posexplode(F.array(F.lit("ocr"), F.lit("markdown"))).alias("half", "stage"))
    start = F.col("b") * F.col("per")
    return both.select("key", (F.col("b") * 2 + F.col("half")).cast("bigint").alias("turn"), "stage", start.cast("bigint").alias("page_start"), F.least(start + F.col("per"), "pages").cast("bigint").alias("page_end"))


def multipart_objects(parts: DataFrame, object_id: str, number: str, size: str, digest: str, least_bytes: int) -> DataFrame:
    """(object_id, parts, bytes, complete, etag) of uploads in parts: complete if the numbers run from 1 without a gap and only the last part is
    below ``least_bytes``; the tag is the digest of the parts' digests with their number. A part sent again counts with its greatest digest."""
    once = parts.where(F.col(object_id).isNotNull() & F.col(number).isNotNull()).groupBy(F.col(object_id).alias("object_id"), F.col(number).alias("no")).agg(F.max(F.struct(F.col(digest).alias("d"), F.col(size).alias("b"))).alias("p"))
    lists = F.array_sort(F.collect_list(F.struct("no", F.col("p.d").alias("d"), F.col("p.b").alias("b"))))
    held = once.groupBy("object_id").agg(lists.alias("l"))  # a store allows at most 10,000 parts to an object
    n = F.size("l")
    sound = (F.element_at("l", 1)["no"] == 1) & (F.element_at("l", -1)["no"] == n) & ~F.exists(F.slice("l", 1, F.greatest(n - 1, F.lit(0))), lambda x: x["b"] < least_bytes)
    return held.select("object_id", n.cast("bigint").alias("parts"), F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x["b"]).alias("bytes"), sound.alias("complete"), F.concat(F.md5(F.array_join(F.transform("l", lambda x: x["d"]), "").cast("binary")), F.lit("-"), n.cast("string")).alias("etag"))
