"""Ingestion jobs, office files, services' responses, tags, model catalogs and uploads in parts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import models, names
from quern.operators import catalog, chunking, graph
from quern.plans.catalog_queries import UP, chunk_rows, uploads
from quern.plans.source_queries import SEGMENTS, UTTERANCES, segments, utterances
from quern.runtime import table
from quern.sources import ingest, office, providers
from quern.streaming import jobs

PAGES_PER_BATCH, LEAST_PART = 4, 20_000
TAG, TAG_PAGE = "budget", 25
SERVICES = ("assemblyai", "deepgram", "elevenlabs", "gladia", "groq")


def _documents(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null")
    return docs.withColumn("handler", ingest.dispatch(F.col("file_type")))


def dispatch_routes(spark, d):
    """The handler of every upload; those read by page services go to ocr, Markdown ones that come with parameters to markdown."""
    up = uploads(spark, d)
    markdown = F.when(F.lower(F.trim("type")) == "markdown", F.col("id"))
    pages = F.when(F.coalesce("is_ocr_needed", F.lit(False)), F.col("id"))
    return up.select("id", ingest.dispatch(F.col("type"), markdown, pages).alias("handler"))


def ingest_steps(spark, d):
    """Every buffer that the handlers read of the documents: cursor, successor and size."""
    return ingest.steps(_documents(spark, d)).select(F.col("key").alias("doc_id"), "handler", "step", "cursor", "next_cursor", "is_last", "publishes", "n_units", F.length("body").cast("bigint").alias("n_chars"))


def stream_ingest(spark, d):
    """The documents as a stream through read, chunk, enrich, inject and advance: how far each got. A batch's states are written after its
    points, so what a state tells is injected; blank units give no points, and their documents are completed without."""
    stream = jobs.file_stream(spark, d, "documents").where("doc_id is not null").withColumn("handler", ingest.dispatch(F.col("file_type")))
    states, _ = jobs.ingest(stream, spark)
    return states.groupBy("key").agg(F.count(F.lit(1)).alias("steps"), F.max(F.struct("step", "publishes"))["publishes"].alias("state"), F.sum("n_units").alias("units")).withColumnRenamed("key", "doc_id")


def ocr_markdown_turns(spark, d):
    """Page batches of uploads that need reading, by turns with their Markdown; an upload has as many pages as chunks."""
    pages = chunk_rows(spark, d, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
    need = uploads(spark, d).where("is_ocr_needed").select("id").join(pages, "id")
    return ingest.page_turns(need, "id", "pages", F.lit(PAGES_PER_BATCH)).withColumnRenamed("key", "document_id")


def multipart_uploads(spark, d):
    """Orders as objects uploaded in parts, one part per line; objects with a gap or a small part before the last aren't complete."""
    parts = table(spark, d, "lineitem").where("l_linenumber is not null").select("l_orderkey", "l_linenumber", F.round("l_extendedprice").cast("bigint").alias("size"), F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary")).alias("etag"))
    return ingest.multipart_objects(parts, "l_orderkey", "l_linenumber", "size", "etag", LEAST_PART)


def excel_rows(spark, d):
    """Nations as one workbook per region, written and read back with the rows' numbers; blank rows are passed over."""
    import pandas as pd

    row = F.array("n_name", F.lit(""), F.col("n_nationkey").cast("string"))
    books = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    write = F.pandas_udf(lambda s: pd.Series([office.write_workbook([["name", "", "key"], ["", " ", ""], *[list(r) for r in rows]]) for rows in s]), "binary")
    read = office.read_workbooks(books.select(F.col("n_regionkey").cast("string").alias("path"), write("rows").alias("content")))
    return read.select(F.col("path").alias("region"), F.col("row").cast("bigint").alias("row"), F.element_at("cells", 1).alias("name"), F.element_at("cells", 3).alias("key"))


def sentence_chunks(spark, d):
    """Every transcript in sentence chunks, with the topic in front where the chunk lacks it."""
    rows = chunking.sentence_chunks(segments(spark, d).where("transcript is not null"), "segment_id", "transcript", "topic_summary")
    return rows.select(F.col("key").alias("segment_id"), F.col("chunk").cast("bigint").alias("chunk"), "text")


def _spoken(spark, d):
    """Utterances by service, each as that service answers: one response per recording and service."""
    u = utterances(spark, d).where("start_sec is not null and end_sec is not null and text is not null and confidence > 0").select("document_id", "utterance_id", "text", "start_sec", "end_sec", "speaker", "confidence")
    return u.withColumn("provider", F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (F.pmod("utterance_id", F.lit(len(SERVICES))) + 1).cast("int")))


def stt_responses(spark, d):
    """Responses of five transcription services made of the utterances, parsed into one form."""
    u = _spoken(spark, d)
    ms = lambda c: F.round(F.col(c) * 1000)
    plain = F.struct("speaker", "text", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "confidence")
    shapes = {
        "assemblyai": F.struct(F.array(F.struct("speaker", "text", ms("start_sec").alias("start"), ms("end_sec").alias("end"), "confidence")).alias("utterances")),
        "deepgram": F.struct(F.struct(F.array(F.struct("speaker", F.col("text").alias("transcript"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "confidence")).alias("utterances")).alias("results")),
        "elevenlabs": F.struct(F.array(F.struct(F.concat(F.lit("speaker_"), "speaker").alias("speaker_id"), "text", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.lit("word").alias("type"), F.log("confidence").alias("logprob")), F.struct(F.lit(None).cast("string").alias("speaker_id"), F.lit(" ").alias("text"), F.col("end_sec").alias("start"), F.col("end_sec").alias("end"), F.lit("spacing").alias("type"), F.lit(0.0).alias("logprob"))).alias("words")),
        "gladia": F.struct(F.struct(F.struct(F.array(plain).alias("utterances")).alias("transcription")).alias("result")),
        "groq": F.struct(F.array(F.struct("text", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), (1 - F.col("confidence")).alias("no_speech_prob"))).alias("segments")),
    }
    said = reduce(DataFrame.unionByName, [u.where(F.col("provider") == s).select(F.concat_ws("/", "document_id", "utterance_id").alias("key"), "provider", F.lit(600.0).alias("offset_s"), F.to_json(shape).alias("response")) for s, shape in shapes.items()])
    return providers.parse_transcripts(said, "key", "response").select("key", "provider", "n", "speaker", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "text", F.round("confidence", 4).alias("confidence"))


def ocr_responses(spark, d):
    """Responses of three page-reading services made of segments' two descriptions, parsed into pages."""
    s = segments(spark, d).where("topic_summary is not null and setting is not null").select("segment_id", F.trim("topic_summary").alias("a"), F.trim("setting").alias("b"))
    page = lambda i, at, c, text: F.struct(F.lit(i).alias(at), F.col(c).alias(text))
    shapes = {
        "mistral": F.struct(F.array(page(0, "index", "a", "markdown"), page(1, "index", "b", "markdown")).alias("pages")),
        "llamaparse": F.struct(F.array(page(1, "page", "a", "md"), page(2, "page", "b", "md")).alias("pages")),
        "datalab": F.struct(F.concat("a", F.lit("\n\n{1}" + "-" * 48 + "\n\n"), "b").alias("markdown")),
    }
    made = reduce(DataFrame.unionByName, [s.select("segment_id", F.lit(p).alias("provider"), F.lit(8).alias("first_page"), F.to_json(shape).alias("response")) for p, shape in shapes.items()])
    return providers.parse_pages(made, "segment_id", "response").withColumnRenamed("key", "segment_id")


def video_responses(spark, d):
    """Segment lists of videos as a service writes them, in a Markdown fence, parsed back."""
    s = segments(spark, d).where("start_time is not null and end_time is not null and document_id is not null and file_chunk_number is not null")
    one = F.struct("start_time", "end_time", "transcript", "topic_summary", "segment_id")
    lists = s.groupBy("document_id", "file_chunk_number").agg(F.array_sort(F.collect_list(one)).alias("l"))
    made = lists.select(F.concat_ws("/", "document_id", F.col("file_chunk_number").cast("string")).alias("key"), F.concat(F.lit("```json\n"), F.to_json("l"), F.lit("\n```")).alias("response"))
    return providers.parse_video(made, "key", "response").select("key", "n", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"), "transcript", "topic_summary")


def query_expansion(spark, d):
    """Every topic as a question, expanded by the local model; where a model gives nothing the question stays."""
    s = segments(spark, d).where("topic_summary is not null")
    return s.select("segment_id", models.expanded(F.col("topic_summary")).alias("expanded"), models.expanded(F.col("topic_summary"), lambda q: F.lit("")).alias("kept"))


def _tags(spark, d):
    tags = segments(spark, d).where("keywords is not null").select(F.col("segment_id").alias("chunk"), F.explode(F.split("keywords", ",")).alias("tag"))
    return tags.select("chunk", graph.clean_tag(F.col("tag")).alias("label")).where("label <> ''").distinct()


def graph_tag_nodes(spark, d):
    """The first page of tags that hold a string, with the chunks of each, most frequent first."""
    nodes = graph.tag_nodes(_tags(spark, d))
    return catalog.page(graph.list_nodes(nodes, "tag", "an"), [F.desc("frequency"), F.asc("value")], TAG_PAGE, 1).select("node_id", "value", "frequency")


def graph_chunks_by_tag(spark, d):
    """Chunks of one tag, by its node id."""
    return graph.chunks_by_node(graph.tag_edges(_tags(spark, d)), md5(TAG.encode()).hexdigest(), "tag")


def _models(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey is not null")
    kind = F.element_at(F.array(*[F.lit(k) for k in catalog.MODEL_KINDS]), (F.pmod("s_suppkey", F.lit(len(catalog.MODEL_KINDS))) + 1).cast("int"))
    return s.select(kind.alias("kind"), F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("provider-"), F.col("s_nationkey").cast("string")).alias("provider"))


def model_catalogs(spark, d):
    """Seven model catalogs (suppliers) after one creation in each, renamings, and removals."""
    every = _models(spark, d)
    new = spark.createDataFrame([(k, -1, f"new-{k}", "provider-new") for k in catalog.MODEL_KINDS], every.schema)
    renamed = every.where("id % 5 = 0").withColumns({"name": F.upper("name"), "provider": F.lit(None).cast("string")})
    gone = every.where("id % 11 = 0")
    return reduce(DataFrame.unionByName, [catalog.ModelCatalog(k, every).create(new).update(renamed).delete(gone).rows for k in catalog.MODEL_KINDS])


def model_catalog_pages(spark, d):
    """Per catalog its providers with their models, and the models of one provider by name."""
    parts = [catalog.ModelCatalog(k, _models(spark, d)).providers() for k in catalog.MODEL_KINDS]
    return reduce(DataFrame.unionByName, parts)


def chunk_crud(spark, d):
    """Chunks of one kind after an update of their numbers and a removal, as the chunk routes do."""
    now = chunk_rows(spark, d, "document_id", "chunk_number")
    changed = now.where("chunk_number % 10 = 3").select("chunk_id", F.lit(None).cast("string").alias("document_id"), (F.col("chunk_number") + 1000).alias("chunk_number"))
    return catalog.remove(catalog.upsert(now, changed, ["chunk_id"], partial=True), now.where("chunk_number % 10 = 7"), ["chunk_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (dispatch_routes, ingest_steps, stream_ingest, ocr_markdown_turns, multipart_uploads, excel_rows, sentence_chunks, stt_responses, ocr_responses, video_responses, query_expansion, graph_tag_nodes, graph_chunks_by_tag, model_catalogs, model_catalog_pages, chunk_crud)
}

_KNOWN = ", ".join(f"'{h.name}'" for h in ingest.HANDLERS)
_ALIAS = "CASE lower(trim({c})) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ingest.ALIASES.items()) + " ELSE lower(trim({c})) END"
_BY_TYPE = f"CASE WHEN {_ALIAS} IN ({_KNOWN}) THEN {_ALIAS} END"


def _steps_sql() -> str:
    parts = []
    for h in ingest.HANDLERS:
        mine = f"SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND {_BY_TYPE.format(c='file_type')} = '{h.name}'"
        if h.separator is None:
            units = f"SELECT doc_id, length(text) AS units, unnest(range(0, (length(text) - 1) // {h.per_step} + 1)) AS step, text FROM ({mine}) WHERE length(text) > 0"
            n, chars = f"least({h.per_step}, units - step * {h.per_step})", f"length(substring(text, step * {h.per_step} + 1, {h.per_step}))"
        elif h.separator.startswith("(?="):
            continue  # no document of these formats in the tables
        elif h.separator.startswith(r"\n(?="):
            continue
        else:
            units = f"SELECT doc_id, len(p) AS units, unnest(range(0, (len(p) - 1) // {h.per_step} + 1)) AS step, p FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{h.separator}'), lambda x: trim(x) <> '') AS p FROM ({mine})) WHERE len(p) > 0"
            cut = f"p[step * {h.per_step} + 1 : step * {h.per_step} + {h.per_step}]"
            n, chars = f"len({cut})", f"length(array_to_string({cut}, chr(10)))"
        last = f"step = (units - 1) // {h.per_step}"
        cursor, after = ("step", "step + 1") if h.cursor == "file_chunk_number" else (f"step * {h.per_step}", f"step * {h.per_step} + {n}")
        parts.append(f"SELECT doc_id, '{h.name}' AS handler, step, {cursor} AS cursor, {after} AS next_cursor, {last} AS is_last, CASE WHEN {last} THEN 'completed' ELSE '{h.name}' END AS publishes, {n} AS n_units, {chars} AS n_chars FROM ({units})")
    return " UNION ALL ".join(parts)


_TAGS = rf"SELECT DISTINCT chunk, tag FROM (SELECT segment_id AS chunk, regexp_replace(lower(trim(unnest(string_split(keywords, ',')))), '\s+', '_', 'g') AS tag FROM {SEGMENTS} WHERE keywords IS NOT NULL) WHERE tag <> ''"
_KIND = "[" + ", ".join(f"'{k}'" for k in catalog.MODEL_KINDS) + f"][s_suppkey % {len(catalog.MODEL_KINDS)} + 1]"
_SERVICE = "[" + ", ".join(f"'{s}'" for s in SERVICES) + f"][(utterance_id % {len(SERVICES)} + {len(SERVICES)}) % {len(SERVICES)} + 1]"

ORACLE: dict[str, str] = {
    "dispatch_routes": f"SELECT id, CASE WHEN lower(trim(type)) = 'markdown' THEN 'markdown' WHEN coalesce(is_ocr_needed, false) THEN 'ocr' ELSE {_BY_TYPE.format(c='type')} END AS handler FROM {UP}",
    "ingest_steps": _steps_sql(),
    "stream_ingest": f"SELECT doc_id, count(*) AS steps, 'completed' AS state, sum(n_units)::BIGINT AS units FROM ({_steps_sql()}) GROUP BY 1",
    "ocr_markdown_turns": f"""
    WITH p AS (SELECT document_id, count(*) AS pages FROM (SELECT DISTINCT chunk_id, arg_max(document_id, updated_at) AS document_id FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id) JOIN {UP} u ON u.id = document_id AND is_ocr_needed GROUP BY 1),
    b AS (SELECT *, unnest(range(0, (pages - 1) // {PAGES_PER_BATCH} + 1)) AS b FROM p)
    SELECT document_id, b * 2 + h AS turn, stage, b * {PAGES_PER_BATCH} AS page_start, least((b + 1) * {PAGES_PER_BATCH}, pages) AS page_end FROM b, (VALUES (0, 'ocr'), (1, 'markdown')) s(h, stage)""",
    "multipart_uploads": f"""
    WITH p AS (SELECT l_orderkey, l_linenumber, max((md5(l_orderkey || '-' || l_linenumber), round(l_extendedprice)::BIGINT)) AS x FROM lineitem WHERE l_linenumber IS NOT NULL AND l_orderkey IS NOT NULL GROUP BY ALL),
    o AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top FROM p)
    SELECT l_orderkey AS object_id, count(*) AS parts, sum(x[2])::BIGINT AS bytes, min(l_linenumber) = 1 AND max(top) = count(*) AND count(*) FILTER (l_linenumber < top AND x[2] < {LEAST_PART}) = 0 AS complete,
      md5(string_agg(x[1], '' ORDER BY l_linenumber)) || '-' || count(*) AS etag FROM o GROUP BY 1""",
    "excel_rows": "SELECT n_regionkey::VARCHAR AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) + 1 AS row, n_name AS name, n_nationkey::VARCHAR AS key FROM nation UNION ALL SELECT DISTINCT n_regionkey::VARCHAR, 0, 'name', 'key' FROM nation",
    "stt_responses": f"""
    SELECT document_id || '/' || utterance_id AS key, provider, 0 AS n, CASE WHEN provider = 'groq' THEN NULL WHEN provider = 'elevenlabs' THEN regexp_replace('speaker_' || speaker, '^speaker_', '') ELSE speaker END AS speaker,
      round(start_sec + 600, 3) AS start_sec, round(end_sec + 600, 3) AS end_sec, text, round(confidence, 4) AS confidence
    FROM (SELECT * REPLACE ({_SERVICE} AS provider) FROM {UTTERANCES} WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND text IS NOT NULL AND confidence > 0)""",
    "ocr_responses": f"SELECT segment_id, provider, page + 8 AS page, trim(CASE page WHEN 0 THEN topic_summary ELSE setting END) AS markdown FROM {SEGMENTS}, (VALUES ('mistral'), ('llamaparse'), ('datalab')) p(provider), (VALUES (0), (1)) n(page) WHERE topic_summary IS NOT NULL AND setting IS NOT NULL",
    "video_responses": f"""
    SELECT document_id || '/' || file_chunk_number AS key, row_number() OVER (PARTITION BY document_id, file_chunk_number ORDER BY start_time, end_time, transcript NULLS FIRST, topic_summary NULLS FIRST, segment_id) - 1 AS n, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time, transcript, topic_summary
    FROM {SEGMENTS} WHERE start_time IS NOT NULL AND end_time IS NOT NULL AND document_id IS NOT NULL AND file_chunk_number IS NOT NULL""",
    "query_expansion": f"SELECT segment_id, trim(topic_summary) AS expanded, trim(topic_summary) AS kept FROM {SEGMENTS} WHERE topic_summary IS NOT NULL",
    "graph_tag_nodes": f"SELECT md5(tag) AS node_id, tag AS value, count(*) AS frequency FROM ({_TAGS}) WHERE contains(tag, 'an') GROUP BY tag ORDER BY frequency DESC, value LIMIT {TAG_PAGE}",
    "graph_chunks_by_tag": f"SELECT chunk FROM ({_TAGS}) WHERE tag = '{TAG}'",
    "model_catalogs": f"""
    SELECT {_KIND} AS kind, s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 5 = 0 THEN upper(s_name) ELSE s_name END AS name, 'provider-' || s_nationkey AS provider FROM supplier WHERE s_suppkey % 11 <> 0
    UNION ALL SELECT k, -1, 'new-' || k, 'provider-new' FROM (SELECT unnest([{', '.join(repr(k) for k in catalog.MODEL_KINDS)}]) AS k)""",
    "model_catalog_pages": f"SELECT {_KIND} AS kind, 'provider-' || s_nationkey AS provider, count(*) AS models FROM supplier GROUP BY ALL",
    "chunk_crud": "SELECT chunk_id, document_id, CASE WHEN chunk_number % 10 = 3 THEN chunk_number + 1000 ELSE chunk_number END AS chunk_number FROM (SELECT chunk_id, arg_max((document_id, chunk_number), updated_at)[1] AS document_id, arg_max((document_id, chunk_number), updated_at)[2] AS chunk_number FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) WHERE chunk_number % 10 IS DISTINCT FROM 7",
}
