"""Listings, page batches and graph lookups that complete the inventory."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import catalog, chunking, graph
from quern.plans.catalog_queries import CHUNKS, UP, chunk_rows, uploads
from quern.plans.lexical_queries import _MAPS, lexical_input, node_maps
from quern.plans.source_queries import SEGMENTS, segments
from quern.plans.vector_queries import _LEGS, K, _hybrid
from quern.runtime import table
from quern.sources import structured

PAGE_LIMIT, PAGE_BYTES = 4, 6000
LOOKUPS = {"entity": "figure", "concept": "warehouse handling", "phrase": "pending", "keyword": "budget"}


def ocr_page_batches(spark, d):
    """Chunks of page formats as pages: batches of at most four pages and 6,000 bytes, at least one page each, within an input buffer."""
    up = uploads(spark, d).where(F.lower(F.trim("type")).isin("pdf", "doc", "ppt")).select(F.col("id").alias("doc"))
    pages = lexical_input(spark, d).join(up, "doc", "left_semi").select("doc", "buf", "chunk", "number", F.octet_length("text").alias("bytes"), F.lit(1).alias("pages"))
    return chunking.greedy_packs(pages, ["doc", "buf"], ["number", "chunk"], {"pages": PAGE_LIMIT, "bytes": PAGE_BYTES}).select("doc", "buf", "chunk", F.col("pack").alias("batch"))


def pdf_document_order(spark, d):
    """Chunks of pdf uploads renumbered: prose before tables, each in order."""
    up = uploads(spark, d).where(F.lower(F.trim("type")) == "pdf").select(F.col("id").alias("doc"))
    rows = lexical_input(spark, d).join(up, "doc", "left_semi").withColumn("is_table", F.startswith(F.ltrim("text"), F.lit("|")))
    w = Window.partitionBy("doc", "buf").orderBy("is_table", "number", "chunk")
    return rows.select("doc", "buf", "chunk", "is_table", (F.row_number().over(w) - 1).cast("bigint").alias("position"))


def pdf_tables(spark, d):
    """Ragged rows of regions and nations as Markdown tables."""
    import pandas as pd

    rows = F.array_sort(F.collect_list(F.array("n_name", F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string")), F.lit("  a  b "))))
    made = table(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("r"))
    as_markdown = F.pandas_udf(lambda s: pd.Series([structured.table_to_markdown([["name", "both"], *[list(r) for r in x], [None, " "]]) for x in s]), "string")
    return made.select(F.col("n_regionkey").cast("bigint").alias("region"), as_markdown("r").alias("markdown"))


def effective_top_k(spark, d):
    """How many results of each document fill a wish for ten, given how many neighbours its chunks have."""
    seq = graph.sequential_edges(lexical_input(spark, d)).groupBy(F.col("src").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    per = lexical_input(spark, d).join(seq, "chunk", "left").groupBy("doc").agg(F.avg(F.coalesce("n", F.lit(0))).alias("neighbours"))
    return per.select("doc", F.greatest(F.lit(1.0), F.bround(10 / (1 + F.col("neighbours")))).cast("bigint").alias("k"))


def response_json(spark, d):
    """Results as the JSON rows of a response."""
    chunks = lexical_input(spark, d).select(F.col("chunk").alias("key"), "doc", F.col("number").cast("bigint").alias("number"))
    return _hybrid(spark, d).join(chunks, "key").select("key", F.to_json(F.struct("key", "doc", "number")).alias("row"))


def _maps(spark, d):
    return node_maps(spark, d)


def graph_chunks_by_nodes(spark, d):
    """Chunks of one node of every type."""
    edges = graph.semantic_edges(_maps(spark, d))
    out = None
    for kind, value in LOOKUPS.items():
        part = graph.chunks_by_node(edges, md5(value.encode()).hexdigest(), kind).select(F.lit(kind).alias("type"), "chunk")
        out = part if out is None else out.unionByName(part)
    return out


def graph_list_chunks(spark, d):
    rows = chunk_rows(spark, d, "document_id", "chunk_number")
    return catalog.page(rows, [F.asc("document_id"), F.asc("chunk_number"), F.asc("chunk_id")], 50, 3)


def graph_chunk_upsert(spark, d):
    """Chunk nodes after all rows are merged in turn: created with the first, updated by the latest."""
    raw = table(spark, d, "chunks").where("chunk_id is not null")
    return raw.groupBy("chunk_id").agg(F.unix_micros(F.min("created_at").cast("timestamp")).alias("created_us"), F.unix_micros(F.max("updated_at").cast("timestamp")).alias("updated_us"), F.count(F.lit(1)).alias("merges"))


def org_list(spark, d):
    """Organisations with their projects and uploads."""
    projects = table(spark, d, "project_variables").groupBy("org_id").agg(F.countDistinct("project_id").alias("projects"))
    ups = uploads(spark, d).groupBy("org_id").agg(F.count(F.lit(1)).alias("uploads"))
    return projects.join(ups, "org_id", "full").select("org_id", F.coalesce("projects", F.lit(0)).cast("bigint").alias("projects"), F.coalesce("uploads", F.lit(0)).cast("bigint").alias("uploads"))


def project_list(spark, d):
    """The second page of projects, with the size of their uploads."""
    size = uploads(spark, d).groupBy("project_id").agg(F.sum("size").alias("bytes"))
    p = table(spark, d, "project_variables").select("project_id", "org_id", "readable_id").join(size, "project_id", "left")
    return catalog.page(p, [F.asc("readable_id"), F.asc("project_id")], 20, 2)


def project_tag_pool(spark, d):
    """Distinct tags of every document, as later batches know them."""
    tags = segments(spark, d).where("document_id is not null").select("document_id", F.explode(F.split(F.coalesce("keywords", F.lit("")), ",")).alias("tag"))
    return tags.select("document_id", graph.clean_tag(F.col("tag")).alias("tag")).where("tag <> ''").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (ocr_page_batches, pdf_document_order, pdf_tables, effective_top_k, response_json, graph_chunks_by_nodes, graph_list_chunks, graph_chunk_upsert, org_list, project_list, project_tag_pool)
}

_TAG = r"regexp_replace(lower(trim(tag)), '\s+', '_', 'g')"
_PDF = f"(SELECT id FROM {UP} WHERE lower(trim(type)) = 'pdf')"
_SC = _MAPS[: _MAPS.index(", ent AS")]

ORACLE: dict[str, str] = {
    "response_json": _LEGS.replace("{k}", str(K)) + """ SELECT key, '{"key":"' || key || '"' || coalesce(',"doc":"' || doc || '"', '') || coalesce(',"number":' || number, '') || '}' AS row FROM rr JOIN sc ON sc.chunk = rr.key""",
    "ocr_page_batches": f"""
    WITH RECURSIVE {_MAPS[_MAPS.index("WITH ") + 5 : _MAPS.index(", ent AS")]},
    r AS (SELECT doc, buf, chunk, strlen(text) AS b, row_number() OVER (PARTITION BY doc, buf ORDER BY number, chunk) AS i FROM sc WHERE doc IN (SELECT id FROM {UP} WHERE lower(trim(type)) IN ('pdf', 'doc', 'ppt'))),
    p AS (SELECT doc, buf, chunk, i, 1 AS n, b, 0 AS batch FROM r WHERE i = 1 UNION ALL
      SELECT r.doc, r.buf, r.chunk, r.i, CASE WHEN p.n + 1 > {PAGE_LIMIT} OR p.b + r.b > {PAGE_BYTES} THEN 1 ELSE p.n + 1 END, CASE WHEN p.n + 1 > {PAGE_LIMIT} OR p.b + r.b > {PAGE_BYTES} THEN r.b ELSE p.b + r.b END, p.batch + (p.n + 1 > {PAGE_LIMIT} OR p.b + r.b > {PAGE_BYTES})::INT
      FROM p JOIN r ON r.doc = p.doc AND r.buf = p.buf AND r.i = p.i + 1)
    SELECT doc, buf, chunk, batch FROM p""",
    "pdf_document_order": f"{_SC} SELECT doc, buf, chunk, starts_with(ltrim(text), '|') AS is_table, row_number() OVER (PARTITION BY doc, buf ORDER BY starts_with(ltrim(text), '|'), number, chunk) - 1 AS position FROM sc WHERE doc IN {_PDF}",
    "pdf_tables": """
    SELECT n_regionkey::BIGINT AS region, '| name | both |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_name || chr(92) || '|' || n_nationkey || ' |', chr(10) ORDER BY n_name) AS markdown FROM nation GROUP BY 1""",
    "effective_top_k": f"""{_SC}, e AS (SELECT a.doc, a.chunk, (SELECT count(*) FROM sc b WHERE b.doc = a.doc AND (b.number = a.number + 1 OR b.number = a.number - 1)) AS n FROM sc a)
    SELECT doc, greatest(1, round_even(10 / (1 + avg(n)), 0))::BIGINT AS k FROM e GROUP BY doc""",
    "graph_chunks_by_nodes": f"{_MAPS} SELECT type, chunk FROM sem WHERE (type, node_id) IN (" + ", ".join(f"('{k}', md5('{v}'))" for k, v in LOOKUPS.items()) + ")",
    "graph_list_chunks": f"SELECT chunk_id, document_id, chunk_number FROM {CHUNKS} ORDER BY document_id, chunk_number, chunk_id LIMIT 50 OFFSET 100",
    "graph_chunk_upsert": "SELECT chunk_id, epoch_us(min(created_at)) AS created_us, epoch_us(max(updated_at)) AS updated_us, count(*) AS merges FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1",
    "org_list": f"SELECT coalesce(p.org_id, u.org_id) AS org_id, coalesce(projects, 0) AS projects, coalesce(uploads, 0) AS uploads FROM (SELECT org_id, count(DISTINCT project_id) AS projects FROM project_variables GROUP BY 1) p FULL JOIN (SELECT org_id, count(*) AS uploads FROM {UP} GROUP BY 1) u ON p.org_id = u.org_id",
    "project_list": f"SELECT project_id, org_id, readable_id, bytes::BIGINT AS bytes FROM project_variables LEFT JOIN (SELECT project_id, sum(size) AS bytes FROM {UP} GROUP BY 1) USING (project_id) ORDER BY readable_id, project_id LIMIT 20 OFFSET 20",
    "project_tag_pool": f"SELECT DISTINCT document_id, {_TAG} AS tag FROM (SELECT document_id, unnest(string_split(coalesce(keywords, ''), ',')) AS tag FROM {SEGMENTS} WHERE document_id IS NOT NULL) WHERE {_TAG} <> ''",
}
