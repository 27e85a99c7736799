"""Scans, flattening, chunking and transcript rendering over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.operators.latest import latest_rows
from quern.plans.catalog_queries import CHUNKS, chunk_rows
from quern.runtime import exclusive_scan, table
from quern.sources import structured, tabular

COLS = ["c_name", "c_nationkey", "c_mktsegment"]
BYTE_CAP = 20_000
GROUP_CAP = 20
SLICE_S, OVERLAP_S = 600.0, 60.0
WINDOW_CHARS, PARAGRAPHS = 2000, 4
PACK_SECONDS, PACK_WORDS = 120, 300
RENDERED = {"topic_summary": "Topic", "keywords": "Keywords", "transcript": "Transcript", "setting": "Setting", "people_present": "People", "speaker_names": "Speakers", "on_screen_text": "On screen", "audio_description": "Audio", "mood": "Mood"}


def _rows(spark, d):
    return tabular.assign_buffers(tabular.number_rows(table(spark, d, "customer"), "c_custkey")).withColumn("line", tabular.row_text(COLS))


def csv_row_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", tabular.row_text(COLS).alias("line"), tabular.row_terms(COLS).alias("terms"))


def io_buffer_assign(spark, d):
    return _rows(spark, d).groupBy("buffer").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


def io_buffer_bytecap(spark, d):
    return tabular.cap_bytes(_rows(spark, d), "line", BYTE_CAP).select("c_custkey", "buffer", "bytes_so_far", "kept")


def rebalance_groups(spark, d):
    groups = tabular.rebalance(_rows(spark, d), ["buffer"], "c_nationkey", "row_number", GROUP_CAP)
    made = tabular.assemble_groups(groups, ["buffer"], "row_number", "line", "customers")
    return made.select("buffer", F.col("group_index").cast("bigint").alias("group_index"), "chunk", "text", F.array_join(F.transform("row_numbers", lambda x: x.cast("string")), "|").alias("row_numbers"), F.col("row_count").cast("bigint").alias("row_count"))


def cluster_rows(spark, d):
    """Parts clustered by their terms within buffers, then rebalanced."""
    parts = tabular.assign_buffers(tabular.number_rows(table(spark, d, "part"), "p_partkey")).withColumn("terms", tabular.row_terms(["p_name", "p_brand", "p_type"]))
    labelled = chunking.cluster_rows(parts, ["buffer"], "row_number", "terms", 10)
    return tabular.rebalance(labelled, ["buffer"], "cluster", "row_number", GROUP_CAP)


def json_flatten_props(spark, d):
    return structured.flat_json_entries(table(spark, d, "events"), "event_id", "props")


def _lines(spark, d):
    rows = chunk_rows(spark, d, "text").where("text is not null")
    return rows.select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def ndjson_objects(spark, d):
    """The fields of every JSON line in the chunks; other lines are passed over and keep their numbers."""
    held = structured.valid_ndjson(_lines(spark, d).where(F.startswith("text", F.lit("{"))), "text")
    return held.select("chunk_id", F.col("line").cast("bigint").alias("line"), F.explode(F.from_json("text", "map<string,string>")).alias("k", "v"))


def json_deep_flatten(spark, d):
    """Nested objects made of suppliers, flattened with dotted keys, counts and samples."""
    s = table(spark, d, "supplier")
    doc = F.to_json(F.struct(F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("place")).alias("supplier"), F.array("s_suppkey", F.col("s_suppkey") + 1).alias("ids")))
    flat = s.select("s_suppkey", F.explode(structured.flatten_json(doc)).alias("e"))
    return flat.select("s_suppkey", F.col("e.k").alias("k"), F.col("e.v").alias("v"))


def json_shapes(spark, d):
    """The structure of every chunk's text as a JSON source."""
    import pandas as pd

    sniff = F.pandas_udf(lambda s: pd.Series([structured.sniff_json(t or "")[0] for t in s], dtype=object), "string")
    return chunk_rows(spark, d, "text").select("chunk_id", sniff(F.col("text")).alias("shape"))


def xml_record_fields(spark, d):
    return structured.xml_records(chunk_rows(spark, d, "text"), "chunk_id", "text").select(F.col("key").alias("chunk_id"), F.col("record").cast("bigint").alias("record"), "field", "value")


def xml_record_tags(spark, d):
    edges = structured.xml_edges(chunk_rows(spark, d, "text"), "chunk_id", "text")
    return structured.record_tag(edges, ["key"]).withColumnRenamed("key", "chunk_id")


def yaml_objects(spark, d):
    """Nations written as a YAML sequence per region and read back."""
    item = F.concat(F.lit("- name: "), F.col("n_name"), F.lit("\n  place:\n    key: "), F.col("n_nationkey").cast("string"), F.lit("\n"))
    docs = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("text"))
    return structured.yaml_records(docs, "n_regionkey", "text").select(F.col("key").alias("region"), F.col("object").cast("bigint").alias("object"), "k", "v")


def html_units(spark, d):
    """Parts written as one HTML page with a table per brand and read back."""
    row = F.concat(F.lit("<tr><td>"), F.col("p_name"), F.lit("</td><td><b>"), F.col("p_type"), F.lit("</b></td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("h")))), lambda x: x["h"]), "")
    pages = table(spark, d, "part").groupBy("p_brand").agg(rows.alias("rows"))
    html = F.concat(F.lit("<html><body><p>Parts that are sold under the <i>brand</i> "), F.col("p_brand"), F.lit("</p><p>too short</p><table><tr><th>name</th><th>type</th></tr>"), F.col("rows"), F.lit("</table></body></html>"))
    return structured.html_units(pages.withColumn("html", html), "p_brand", "html").select(F.col("key").alias("brand"), F.col("unit").cast("bigint").alias("unit"), "kind", "rendered")


def markdown_headings(spark, d):
    """Lines under each heading of every chunk: the nearest heading above a line holds for it."""
    from pyspark.sql.window import Window

    heading = F.regexp_extract("text", r"^#{1,6}\s+(.*)$", 1)
    w = Window.partitionBy("chunk_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    held = _lines(spark, d).withColumn("heading", F.last(F.when(heading != "", heading), True).over(w))
    return held.where("heading is not null").groupBy("chunk_id", "heading").agg(F.count(F.lit(1)).alias("n_lines"))


def markdown_pages(spark, d):
    """Markdown parts of every chunk packed into pages of at most 2,000 bytes, never breaking between rows of one table."""
    parts = structured.markdown_rows(chunk_rows(spark, d, "text"), "chunk_id", "text").withColumn("bytes", F.octet_length("text"))
    packed = chunking.greedy_packs(parts.select("key", "number", "kind", "table_index", "bytes"), ["key"], ["number"], {"bytes": 2000}, "table_index")
    return packed.select(F.col("key").alias("chunk_id"), "number", "kind", "bytes", F.col("pack").alias("page"))


def table_row_sentences(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("row"))
    headers = F.array(*[F.lit(x) for x in ("name", "brand", "type")])
    return p.select("p_partkey", structured.sentence_of_row(headers, F.col("row"), F.lit("Parts")).alias("sentence"))


def text_window_carry(spark, d):
    return tabular.text_windows(table(spark, d, "documents"), "doc_id", "text", WINDOW_CHARS).select("doc_id", F.col("window").cast("bigint").alias("window"), "carry", "body")


def docx_paragraph_batches(spark, d):
    return tabular.paragraph_batches(table(spark, d, "documents"), "doc_id", "text", PARAGRAPHS).select("doc_id", F.col("batch").cast("bigint").alias("batch"), F.col("n_paragraphs").cast("bigint").alias("n_paragraphs"), "carry", "body")


def slide_texts(spark, d):
    s = table(spark, d, "segments").where("segment_id is not null").select("segment_id", "topic_summary", "on_screen_text", "setting").distinct()
    return s.select("segment_id", tabular.slide_text(F.col("topic_summary"), F.array("on_screen_text", "setting")).alias("text"))


def split_recursive(spark, d):
    pieces = chunking.split_texts(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return pieces.select(F.col("key").alias("doc_id"), "piece", "text")


def split_code(spark, d):
    code = chunk_rows(spark, d, "text").where(F.contains("text", F.lit("\ndef ")))
    return chunking.split_texts(code, "chunk_id", "text", 600, 0, "python").select(F.col("key").alias("chunk_id"), "piece", "text")


def garbled_text(spark, d):
    return chunk_rows(spark, d, "text").select("chunk_id", structured.is_garbled(F.col("text")).alias("garbled"), F.round(structured.garbled_share(F.col("text")), 6).alias("share"))


def segments(spark, d):
    cols = ["segment_id", "document_id", "file_chunk_number", "start_time", "end_time", *RENDERED]
    return latest_rows(table(spark, d, "segments"), ["segment_id"], "ingested_at", cols)


def utterances(spark, d):
    cols = ["document_id", "utterance_id", "text", "start_sec", "end_sec", "speaker", "confidence", "provider"]
    return latest_rows(table(spark, d, "utterances"), ["document_id", "utterance_id"], "ingested_at", cols)


def media_slices(spark, d):
    lengths = segments(spark, d).where("document_id is not null").groupBy("document_id").agg(F.max("end_time").alias("seconds"))
    return tabular.slices(lengths, "document_id", "seconds", SLICE_S, OVERLAP_S).withColumn("slice", F.col("slice").cast("bigint"))


def clock_format(spark, d):
    return segments(spark, d).select("segment_id", chunking.clock(F.col("start_time")).alias("start_clock"), chunking.clock(F.col("end_time") * 10).alias("end_clock"))


def video_core_window(spark, d):
    kept = chunking.core_window(segments(spark, d), "start_time", "end_time", OVERLAP_S, SLICE_S, F.coalesce("file_chunk_number", F.lit(0)) * SLICE_S)
    return kept.select("segment_id", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


def _sliced_segments(spark, d):
    return segments(spark, d).where("start_time is not null and document_id is not null").withColumn("slice", F.floor(F.col("start_time") / SLICE_S).cast("bigint"))


def transcript_dedupe(spark, d):
    return chunking.drop_repeated_speech(_sliced_segments(spark, d), ["document_id", "slice"], ["start_time", "segment_id"], "transcript").select("segment_id", "fresh")


def segment_render(spark, d):
    return segments(spark, d).select("segment_id", chunking.render_segments(RENDERED).alias("content"))


def segment_packs(spark, d):
    s = _sliced_segments(spark, d).withColumns({"seconds": F.col("end_time") - F.col("start_time"), "words": F.size(F.split(F.coalesce("transcript", F.lit("")), r"\s+"))})
    packed = chunking.greedy_packs(s.select("document_id", "slice", "segment_id", "start_time", "seconds", "words"), ["document_id", "slice"], ["start_time", "segment_id"], {"seconds": PACK_SECONDS, "words": PACK_WORDS})
    return packed.select("document_id", "slice", "segment_id", "pack")


def video_chunk_index(spark, d):
    """Chunk numbers of a video: the overview is 0, segments count from 1 in order of time."""
    s = _sliced_segments(spark, d)
    numbered = exclusive_scan(s, ["document_id"], ["start_time", "segment_id"], "slice", F.lit(1), "before")
    rows = numbered.select("document_id", "segment_id", (F.col("before") + 1).cast("bigint").alias("number"))
    overview = s.select("document_id").distinct().select("document_id", F.lit("overview").alias("segment_id"), F.lit(0).cast("bigint").alias("number"))
    return overview.unionByName(rows)


def _sliced_utterances(spark, d):
    return utterances(spark, d).where("start_sec is not null").withColumn("slice", F.floor(F.col("start_sec") / SLICE_S).cast("bigint"))


def speaker_blocks(spark, d):
    blocks = chunking.speaker_blocks(_sliced_utterances(spark, d), ["document_id", "slice"], ["start_sec", "utterance_id"], "speaker", "text", "start_sec", "end_sec")
    return blocks.select("document_id", "slice", F.col("block").cast("bigint").alias("block"), "speaker", "n", "text")


def utterance_packs(spark, d):
    u = _sliced_utterances(spark, d).withColumns({"seconds": F.col("end_sec") - F.col("start_sec"), "words": F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))})
    packed = chunking.greedy_packs(u.select("document_id", "slice", "utterance_id", "start_sec", "seconds", "words"), ["document_id", "slice"], ["start_sec", "utterance_id"], {"seconds": PACK_SECONDS, "words": PACK_WORDS})
    return packed.select("document_id", "slice", "utterance_id", "pack")


def words_to_utterances(spark, d):
    words = table(spark, d, "words").where("document_id is not null and utterance_id is not null and pos is not null").distinct()
    return chunking.words_to_utterances(words, ["document_id", "utterance_id"], "speaker").select("document_id", "utterance_id", F.col("part").cast("bigint").alias("part"), "speaker", "first_pos", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "n_words", "text", (F.floor(F.col("confidence") * 1000 + 1e-7) / 1000).alias("confidence"))


def stt_normalise(spark, d):
    n = chunking.normalise_utterances(utterances(spark, d))
    return n.select("document_id", "utterance_id", F.round("start_sec", 3).alias("start_sec"), "speaker", F.round("confidence", 4).alias("confidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (csv_row_text, io_buffer_assign, io_buffer_bytecap, rebalance_groups, cluster_rows, json_flatten_props, ndjson_objects, json_deep_flatten, json_shapes, xml_record_fields, xml_record_tags, yaml_objects, html_units, markdown_headings, markdown_pages, table_row_sentences, text_window_carry, docx_paragraph_batches, slide_texts, split_recursive, split_code, garbled_text, media_slices, clock_format, video_core_window, transcript_dedupe, segment_render, segment_packs, video_chunk_index, speaker_blocks, utterance_packs, words_to_utterances, stt_normalise)
}

SEGMENTS = "(SELECT * FROM segments WHERE segment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
UTTERANCES = "(SELECT * FROM utterances WHERE document_id IS NOT NULL AND utterance_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, utterance_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_LINE = "'c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_mktsegment: ' || c_mktsegment"
_BUFFERS = f"(SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r, (row_number() OVER (ORDER BY c_custkey) - 1) // 500 AS buffer, {_LINE} AS line FROM customer)"


def _clock(s: str) -> str:
    return f"CASE WHEN {s} IS NULL THEN '--:--' WHEN floor({s}) >= 3600 THEN lpad((floor({s})::INT // 3600)::VARCHAR, 2, '0') || ':' || lpad((floor({s})::INT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((floor({s})::INT % 60)::VARCHAR, 2, '0') ELSE lpad((floor({s})::INT // 60)::VARCHAR, 2, '0') || ':' || lpad((floor({s})::INT % 60)::VARCHAR, 2, '0') END"


def _packs(scope: str, key: str, start: str, end: str, text: str, rows: str) -> str:
    """Greedy packs by recursion over the rows of each slice in order."""
    return f"""
    WITH RECURSIVE r AS (SELECT document_id, floor({start} / 600)::BIGINT AS slice, {key}, coalesce({end} - {start}, 0) AS s, len(regexp_split_to_array(coalesce({text}, ''), '\\s+')) AS w, row_number() OVER (PARTITION BY document_id, floor({start} / 600) ORDER BY {start}, {key}) AS i FROM {rows} WHERE {start} IS NOT NULL{scope}),
    p AS (SELECT document_id, slice, {key}, i, s, w::DOUBLE AS w, 0 AS pack FROM r WHERE i = 1 UNION ALL
      SELECT r.document_id, r.slice, r.{key}, r.i, CASE WHEN p.s + r.s > {PACK_SECONDS} OR p.w + r.w > {PACK_WORDS} THEN r.s ELSE p.s + r.s END, CASE WHEN p.s + r.s > {PACK_SECONDS} OR p.w + r.w > {PACK_WORDS} THEN r.w ELSE p.w + r.w END, p.pack + (p.s + r.s > {PACK_SECONDS} OR p.w + r.w > {PACK_WORDS})::INT
      FROM p JOIN r ON r.document_id = p.document_id AND r.slice = p.slice AND r.i = p.i + 1)
    SELECT document_id, slice, {key}, pack FROM p"""


ORACLE: dict[str, str] = {
    "segment_packs": _packs(" AND document_id IS NOT NULL", "segment_id", "start_time", "end_time", "transcript", SEGMENTS),
    "utterance_packs": _packs("", "utterance_id", "start_sec", "end_sec", "text", UTTERANCES),
    "garbled_text": rf"""
    SELECT chunk_id, coalesce(regexp_matches(text, '\(cid:\d+\)') OR share >= 0.3, false) AS garbled, round(share, 6) AS share
    FROM (SELECT chunk_id, text, CASE WHEN length(text) > 0 THEN len(regexp_extract_all(left(text, 200), '[\p{{Co}}\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]')) / least(length(text), 200) ELSE 0.0 END AS share FROM {CHUNKS})""",
    "csv_row_text": f"SELECT c_custkey, {_LINE} AS line, 'c_name ' || c_name || ' c_nationkey ' || c_nationkey || ' c_mktsegment ' || c_mktsegment AS terms FROM customer",
    "io_buffer_assign": f"SELECT buffer, count(*) AS n, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM {_BUFFERS} GROUP BY 1",
    "io_buffer_bytecap": f"SELECT c_custkey, buffer, b AS bytes_so_far, b <= {BYTE_CAP} OR k = 1 AS kept FROM (SELECT *, sum(strlen(line)) OVER (PARTITION BY buffer ORDER BY r ROWS UNBOUNDED PRECEDING)::BIGINT AS b, row_number() OVER (PARTITION BY buffer ORDER BY r) AS k FROM {_BUFFERS})",
    "rebalance_groups": f"""
    WITH cut AS (SELECT *, (row_number() OVER (PARTITION BY buffer, c_nationkey ORDER BY r) - 1) // {GROUP_CAP} AS part FROM {_BUFFERS}),
    g AS (SELECT *, dense_rank() OVER (PARTITION BY buffer ORDER BY c_nationkey, part) - 1 AS group_index FROM cut)
    SELECT buffer, group_index, 'customers-' || group_index AS chunk, string_agg(line, chr(10) ORDER BY r) AS text, string_agg(r::VARCHAR, '|' ORDER BY r) AS row_numbers, count(*) AS row_count FROM g GROUP BY buffer, group_index""",
    "json_flatten_props": "SELECT event_id, k, json_extract_string(props, '$.\"' || k || '\"') AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "ndjson_objects": f"""
    WITH l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM {CHUNKS}),
    o AS (SELECT * FROM l WHERE starts_with(t, '{{') AND json_valid(t) AND regexp_matches(trim(t), '(?s)^\\{{.*\\}}$'))
    SELECT chunk_id, line, k, json_extract_string(t, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(t)) AS k FROM o)""",
    "json_deep_flatten": "SELECT s_suppkey, k, v FROM (SELECT s_suppkey, s_name AS a, s_nationkey::VARCHAR AS b, '2' AS c, s_suppkey::VARCHAR AS e FROM supplier), LATERAL (VALUES ('supplier.name', a), ('supplier.place.nation', b), ('ids_count', c), ('ids_sample', e)) x(k, v)",
    "xml_record_fields": f"""
    WITH r AS (SELECT chunk_id, unnest(regexp_extract_all(text, '(?s)<record>(.*?)</record>', 1)) AS body, generate_subscripts(regexp_extract_all(text, '(?s)<record>(.*?)</record>', 1), 1) - 1 AS record FROM {CHUNKS}),
    f AS (SELECT chunk_id, record, unnest(regexp_extract_all(body, '<(\\w+)>([^<]*)</\\w+>', 1)) AS field, unnest(regexp_extract_all(body, '<(\\w+)>([^<]*)</\\w+>', 2)) AS value FROM r)
    SELECT chunk_id, record, field, trim(value) AS value FROM f""",
    "yaml_objects": """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS o FROM nation)
    SELECT n_regionkey AS region, o AS object, k, v FROM n, LATERAL (VALUES ('name', n_name), ('place.key', n_nationkey::VARCHAR)) x(k, v)""",
    "html_units": """
    SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS unit, 'row' AS kind, 'name: ' || p_name || ', type: ' || p_type AS rendered FROM part
    UNION ALL SELECT DISTINCT p_brand, 0, 'content', '[P] Parts that are sold under the brand ' || p_brand FROM part""",
    "markdown_headings": f"""
    WITH l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {CHUNKS}),
    h AS (SELECT *, last_value(nullif(regexp_extract(t, '^#{{1,6}}\\s+(.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM l)
    SELECT chunk_id, heading, count(*) AS n_lines FROM h WHERE heading IS NOT NULL GROUP BY ALL""",
    "table_row_sentences": "SELECT p_partkey, 'Parts — ' || p_name || ': brand: ' || p_brand || ', type: ' || p_type AS sentence FROM part",
    "text_window_carry": f"""
    WITH w AS (SELECT doc_id, text, unnest(range(0, ceil(length(text) / {WINDOW_CHARS}.0)::BIGINT)) AS w FROM documents WHERE length(text) > 0)
    SELECT doc_id, w AS "window", CASE WHEN w = 0 THEN '' ELSE substring(text, w * {WINDOW_CHARS} - 499, 500) END AS carry, substring(text, w * {WINDOW_CHARS} + 1, {WINDOW_CHARS}) AS body FROM w""",
    "docx_paragraph_batches": f"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, unnest(range(0, (len(p) - 1) // {PARAGRAPHS} + 1)) AS b FROM p WHERE len(p) > 0)
    SELECT doc_id, b AS batch, len(p[b * {PARAGRAPHS} + 1 : b * {PARAGRAPHS} + {PARAGRAPHS}]) AS n_paragraphs,
      CASE WHEN b = 0 THEN '' ELSE right(array_to_string(p[greatest(b * {PARAGRAPHS} - 3, 0) + 1 : b * {PARAGRAPHS}], chr(10)), 500) END AS carry,
      array_to_string(p[b * {PARAGRAPHS} + 1 : b * {PARAGRAPHS} + {PARAGRAPHS}], chr(10)) AS body FROM b""",
    "slide_texts": "SELECT DISTINCT segment_id, array_to_string(list_filter([topic_summary, on_screen_text, setting], lambda x: trim(coalesce(x, '')) <> ''), chr(10)) AS text FROM segments WHERE segment_id IS NOT NULL",
    "media_slices": f"""
    WITH l AS (SELECT document_id, max(end_time) AS s FROM {SEGMENTS} WHERE document_id IS NOT NULL GROUP BY 1),
    n AS (SELECT *, unnest(range(0, greatest(ceil(s / 600), 1)::BIGINT)) AS k, greatest(ceil(s / 600), 1) AS n FROM l WHERE s > 0)
    SELECT document_id, k AS slice, k * 600.0::DOUBLE AS core_start, least((k + 1) * 600.0::DOUBLE, s) AS core_end, greatest(k * 600.0::DOUBLE - 60, 0) AS read_start, least(least((k + 1) * 600.0::DOUBLE, s) + 60, s) AS read_end, k = n - 1 AS is_last FROM n""",
    "clock_format": f"SELECT segment_id, {_clock('start_time')} AS start_clock, {_clock('(end_time * 10)')} AS end_clock FROM {SEGMENTS}",
    "video_core_window": f"SELECT segment_id, round(start_time - 60 + coalesce(file_chunk_number, 0) * 600.0::DOUBLE, 3) AS start_time, round(end_time - 60 + coalesce(file_chunk_number, 0) * 600.0::DOUBLE, 3) AS end_time FROM {SEGMENTS} WHERE start_time >= 60 AND start_time < 660",
    "transcript_dedupe": f"""
    WITH s AS (SELECT *, floor(start_time / 600)::BIGINT AS slice, trim(coalesce(transcript, '')) AS t FROM {SEGMENTS} WHERE start_time IS NOT NULL AND document_id IS NOT NULL),
    p AS (SELECT *, coalesce(last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY document_id, slice ORDER BY start_time, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b FROM s)
    SELECT segment_id, CASE WHEN b = '' THEN t WHEN contains(b, t) THEN '' WHEN starts_with(t, b) THEN trim(substring(t, length(b) + 1)) ELSE t END AS fresh FROM p""",
    "segment_render": f"SELECT segment_id, concat_ws(chr(10), {', '.join(f'''CASE WHEN trim({c}) <> '' THEN '{label}: ' || trim({c}) END''' for c, label in RENDERED.items())}) AS content FROM {SEGMENTS}",
    "video_chunk_index": f"""
    WITH s AS (SELECT * FROM {SEGMENTS} WHERE start_time IS NOT NULL AND document_id IS NOT NULL)
    SELECT document_id, segment_id, row_number() OVER (PARTITION BY document_id ORDER BY start_time, segment_id) AS number FROM s
    UNION ALL SELECT DISTINCT document_id, 'overview', 0 FROM s""",
    "speaker_blocks": f"""
    WITH u AS (SELECT *, floor(start_sec / 600)::BIGINT AS slice, coalesce(speaker, 'unknown') AS who FROM {UTTERANCES} WHERE start_sec IS NOT NULL),
    m AS (SELECT *, coalesce(who <> lag(who) OVER w, true)::INT AS n FROM u WINDOW w AS (PARTITION BY document_id, slice ORDER BY start_sec, utterance_id)),
    k AS (SELECT *, sum(n) OVER (PARTITION BY document_id, slice ORDER BY start_sec, utterance_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM m),
    b AS (SELECT document_id, slice, block, who, count(*) AS n, min(start_sec) AS a, max(end_sec) AS z, coalesce(string_agg(text, ' ' ORDER BY start_sec, utterance_id), '') AS said FROM k GROUP BY ALL)
    SELECT document_id, slice, block, regexp_replace(who, '^speaker_', '') AS speaker, n, '[Speaker ' || regexp_replace(who, '^speaker_', '') || ' | ' || {_clock('a')} || ' - ' || {_clock('z')} || ']' || chr(10) || said AS text FROM b""",
    "words_to_utterances": """
    WITH w AS (SELECT DISTINCT * FROM words WHERE document_id IS NOT NULL AND utterance_id IS NOT NULL AND pos IS NOT NULL AND coalesce(type, 'word') <> 'spacing'),
    f AS (SELECT *, coalesce(last_value(speaker IGNORE NULLS) OVER (PARTITION BY document_id, utterance_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'unknown') AS who FROM w),
    m AS (SELECT *, coalesce(who <> lag(who) OVER (PARTITION BY document_id, utterance_id ORDER BY pos), true)::INT AS n FROM f),
    k AS (SELECT *, sum(n) OVER (PARTITION BY document_id, utterance_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM m)
    SELECT document_id, utterance_id, part, who AS speaker, min(pos) AS first_pos, round(min(start_sec), 3) AS start_sec, round(max(end_sec), 3) AS end_sec, count(*) AS n_words, string_agg(coalesce(punctuated_word, word), ' ' ORDER BY pos) AS text, floor(avg(confidence) * 1000 + 1e-7) / 1000 AS confidence FROM k GROUP BY ALL""",
    "stt_normalise": f"""
    SELECT document_id, utterance_id, round(CASE WHEN provider = 'assemblyai' THEN start_sec * 0.001 ELSE start_sec END, 3) AS start_sec,
      CASE WHEN provider = 'groq' OR trim(speaker) IN ('-1', '', '?', 'unknown', 'UNKNOWN') THEN NULL ELSE trim(speaker) END AS speaker,
      round(CASE WHEN provider = 'groq' THEN 1 - confidence ELSE confidence END, 4) AS confidence FROM {UTTERANCES}""",
}
