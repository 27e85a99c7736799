"""Names, identities and catalog listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import names
from quern.operators import catalog
from quern.operators.latest import latest_rows
from quern.runtime import table

UP = "(SELECT * FROM uploads WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, name DESC) = 1)"
CHUNKS = "(SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST) = 1)"
EXT = r"lower(regexp_extract(trim(name), '[^./]\.([^./]+)$', 1))"
LIMIT = 25


def uploads(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "uploads"), ["id"], "updated_at", ["id", "name", "org_id", "project_id", "readable_id", "type", "status", "size", "is_ocr_needed"])


def chunk_rows(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Latest row per chunk_id: the columns asked for."""
    return latest_rows(table(spark, d, "chunks"), ["chunk_id"], "updated_at", ["chunk_id", *cols])


def filetype_map(spark, d):
    return uploads(spark, d).select("id", names.extension(F.col("name")).alias("ext"), names.file_type(F.col("name")).alias("file_type"))


def code_language_map(spark, d):
    return uploads(spark, d).select("id", names.code_language(F.col("name")).alias("language"))


def processor_routes(spark, d):
    return uploads(spark, d).select("id", names.processor_route(F.col("type"), F.col("name")).alias("route"))


def identity_rules(spark, d):
    up = uploads(spark, d)
    parts = names.parse_two(F.col("readable_id"), "_doc_")
    return up.select("id", names.slug(F.col("org_id")).alias("org_slug"), names.project_readable_id(F.col("name"), F.col("project_id")).alias("project_readable"), names.chunk_readable_id(F.col("readable_id"), F.lit(7)).alias("chunk_readable"), parts[0].alias("project_part"), parts[1].alias("document_part"), F.startswith("readable_id", F.concat(parts[0], F.lit("_doc_"))).alias("valid"), names.node_id(F.col("name")).alias("node_id"), names.acronym_id(F.col("org_id")).alias("acronym_id"))


def point_ids(spark, d):
    return table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id").distinct().withColumn("point_id", names.point_id(F.col("chunk_id")))


def catalog_documents_page(spark, d):
    """The second page of processed, larger documents in order of size."""
    found = catalog.list_documents(table(spark, d, "uploads"), status="processed", types=[".pdf", "DOC", "text"], min_size=1000)
    return catalog.page(found, [F.desc("size"), F.asc("id")], LIMIT, 2).select("id", "name", "status", "size")


def catalog_total_pages(spark, d):
    found = catalog.list_documents(table(spark, d, "uploads"), name="a")
    return catalog.page_counts(found, LIMIT, 2)


def chunk_list_search(spark, d):
    rows = chunk_rows(spark, d, "document_id", "chunk_number", "text").where(catalog.contains_ignoring_case(F.col("text"), "Warehouse"))
    return rows.select("chunk_id", "document_id", "chunk_number", F.length("text").alias("n_chars"))


def last_chunk_per_document(spark, d):
    return catalog.last_per_group(table(spark, d, "chunks").where("document_id is not null and chunk_number is not null"), "document_id", "chunk_number", ["document_id", "chunk_number", "chunk_id"])


def chunk_id_numbers(spark, d):
    return table(spark, d, "chunks").where("chunk_id is not null").select("document_id", "chunk_id", "chunk_number").distinct()


def next_chunk_numbers(spark, d):
    """Number and id that a chunk added to each document gets."""
    last = catalog.last_per_group(table(spark, d, "chunks").where("document_id is not null and chunk_number is not null"), "document_id", "chunk_number", ["document_id", "chunk_number"])
    up = uploads(spark, d).select(F.col("id").alias("document_id"), "readable_id")
    nxt = F.coalesce("chunk_number", F.lit(-1)) + 1
    return up.join(last, "document_id", "left").select("document_id", nxt.alias("chunk_number"), names.chunk_readable_id(F.col("readable_id"), nxt).alias("chunk_id"))


def _projects(spark, d):
    return table(spark, d, "project_variables").where("project_id is not null")


def catalog_upsert(spark, d):
    """Uploads after a partial update: sizes of pdf files are set where they are missing, and statuses of failed ones."""
    now = uploads(spark, d).select("id", "status", "size")
    changes = now.where("status = 'FAILED' or size is null").select("id", F.when(F.col("status") == "FAILED", "QUEUED").alias("status"), F.when(F.col("size").isNull(), F.lit(0).cast("bigint")).alias("size"))
    return catalog.upsert(now, changes, ["id"], partial=True)


def catalog_delete(spark, d):
    now = uploads(spark, d).select("id", "status")
    return catalog.remove(now, now.where("status = 'FAILED'"), ["id"])


def variables_with_defaults(spark, d):
    """Every project's variables as key and value, defaults in place of nulls."""
    keys = ["chunk_size", "chunk_overlap", "max_chunk_size_mb", "max_pages_per_batch", "gte_edge_vector_similar_threshold", "gte_edge_vector_similar_top_k"]
    filled = _projects(spark, d).select("project_id", *[F.coalesce(F.col(k).cast("double"), F.lit(float(catalog.VARIABLE_DEFAULTS[k]))).alias(k) for k in keys])
    return filled.unpivot("project_id", keys, "key", "value")


def config_detail_join(spark, d):
    """Configurations derived from the projects, joined with region (LLM), nation (embedding, OCR) and supplier (reranker) as model catalogs."""
    pv = _projects(spark, d)
    configs = pv.select("project_id", (F.col("chunk_size") >= 1500).alias("enable_rerank"), F.col("max_pages_per_batch").isNotNull().alias("enable_ocr"), (F.col("chunk_size") % 5).cast("bigint").alias("llm_model_id"), (F.col("chunk_size") % 25).cast("bigint").alias("embedding_model_id"), F.col("chunk_overlap").cast("bigint").alias("ocr_model_id"), (F.col("chunk_overlap") % 7 + 1).cast("bigint").alias("reranker_model_id"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    catalogs = {"llm": table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")), "embedding": nation, "ocr": nation, "reranker": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}
    detail = catalog.config_detail(configs, catalogs, {"ocr": "enable_ocr", "reranker": "enable_rerank"})
    return detail.select("project_id", "llm_model", "embedding_model", "ocr_model", "reranker_model")


def model_readiness(spark, d):
    up, pv = uploads(spark, d), _projects(spark, d).select("project_id", "max_pages_per_batch", "max_chunk_size_mb", "chunk_size")
    joined = up.join(pv, "project_id", "left")
    ready = {"video": F.coalesce(F.col("chunk_size") > 1500, F.lit(False)), "audio": F.col("max_chunk_size_mb").isNotNull(), "ocr": F.col("max_pages_per_batch").isNotNull()}
    return joined.select("id", catalog.readiness(names.file_type(F.col("name")), F.coalesce("is_ocr_needed", F.lit(False)), ready).alias("ready"))


def provider_list(spark, d):
    """Models (customers) of one provider (segment) with the count of the provider's models."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("size"))


def seed_catalogs(spark, d):
    """Providers and models of a JSON catalog, made of nations by region."""
    one = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("p")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("model_id")))).alias("m"))
    raw = one.select(F.to_json(F.create_map("p", "m")).alias("doc"))
    return catalog.flatten_catalog(raw, "doc", ["name", "model_id"], "orgseed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (filetype_map, code_language_map, processor_routes, identity_rules, point_ids, catalog_documents_page, catalog_total_pages, chunk_list_search, last_chunk_per_document, chunk_id_numbers, next_chunk_numbers, catalog_upsert, catalog_delete, variables_with_defaults, config_detail_join, model_readiness, provider_list, seed_catalogs)
}

_TYPES = f"(VALUES {names.values_sql(names.FILE_TYPES)}) t(e, k)"
_LANGS = f"(VALUES {names.values_sql(names.CODE_LANGUAGES)}) l(e, k)"
_ROUTE = "CASE " + " ".join(f"WHEN lower(trim(type)) IN ({', '.join(repr(x) for x in types.split())}) OR {EXT} IN ({', '.join(repr(x) for x in suffixes.split())}) THEN '{name}'" for name, types, suffixes in names.ROUTES) + " WHEN l.k IS NOT NULL THEN 'code' END"

_SHA = f"sha1(unhex('{names.DNS_NAMESPACE}') || encode(chunk_id))"

ORACLE: dict[str, str] = {
    "point_ids": f"""
    SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id
    FROM (SELECT DISTINCT chunk_id, {_SHA} AS h FROM chunks WHERE chunk_id IS NOT NULL)""",
    "filetype_map": f"SELECT id, {EXT} AS ext, t.k AS file_type FROM {UP} u LEFT JOIN {_TYPES} ON t.e = {EXT}",
    "code_language_map": f"SELECT id, l.k AS language FROM {UP} u LEFT JOIN {_LANGS} ON l.e = {EXT}",
    "processor_routes": f"SELECT id, {_ROUTE} AS route FROM {UP} u LEFT JOIN {_LANGS} ON l.e = {EXT}",
    "identity_rules": f"""
    SELECT id, left(regexp_replace(lower(org_id), '[^a-z0-9]', '', 'g'), 15) AS org_slug,
      left(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 10) || '_' || left(translate(md5(project_id), '01oil', '23456'), 4) AS project_readable,
      readable_id || '_chunk_7' AS chunk_readable,
      CASE WHEN len(string_split(readable_id, '_doc_')) = 2 THEN string_split(readable_id, '_doc_')[1] END AS project_part,
      CASE WHEN len(string_split(readable_id, '_doc_')) = 2 THEN string_split(readable_id, '_doc_')[2] END AS document_part,
      CASE WHEN len(string_split(readable_id, '_doc_')) = 2 THEN starts_with(readable_id, string_split(readable_id, '_doc_')[1] || '_doc_') END AS valid,
      md5(lower(trim(name))) AS node_id, md5(upper(org_id)) AS acronym_id FROM {UP}""",
    "catalog_documents_page": f"SELECT id, name, status, size FROM {UP} WHERE upper(status) = 'PROCESSED' AND lower(trim(type)) IN ('pdf', 'doc', 'text') AND size > 1000 ORDER BY size DESC, id LIMIT {LIMIT} OFFSET {LIMIT}",
    "catalog_total_pages": f"SELECT count(*) AS total, greatest(ceil(count(*) / {LIMIT}.0), 1)::BIGINT AS total_pages, 2 < greatest(ceil(count(*) / {LIMIT}.0), 1) AS has_next, true AS has_previous FROM {UP} WHERE contains(lower(name), 'a')",
    "chunk_list_search": f"SELECT chunk_id, document_id, chunk_number, length(text)::INT AS n_chars FROM {CHUNKS} WHERE contains(lower(text), 'warehouse')",
    "last_chunk_per_document": "SELECT document_id, max(chunk_number) AS chunk_number, arg_max(chunk_id, (chunk_number, chunk_id)) AS chunk_id FROM chunks WHERE document_id IS NOT NULL AND chunk_number IS NOT NULL GROUP BY 1",
    "chunk_id_numbers": "SELECT DISTINCT document_id, chunk_id, chunk_number FROM chunks WHERE chunk_id IS NOT NULL",
    "next_chunk_numbers": f"SELECT u.id AS document_id, coalesce(m, -1) + 1 AS chunk_number, readable_id || '_chunk_' || (coalesce(m, -1) + 1) AS chunk_id FROM {UP} u LEFT JOIN (SELECT document_id, max(chunk_number) AS m FROM chunks GROUP BY 1) c ON c.document_id = u.id",
    "catalog_upsert": f"SELECT id, CASE WHEN status = 'FAILED' THEN 'QUEUED' ELSE status END AS status, coalesce(size, 0) AS size FROM {UP}",
    "catalog_delete": f"SELECT id, status FROM {UP} WHERE status IS DISTINCT FROM 'FAILED'",
    "variables_with_defaults": "SELECT project_id, key, value FROM (SELECT project_id, coalesce(chunk_size, 1500)::DOUBLE AS chunk_size, coalesce(chunk_overlap, 200)::DOUBLE AS chunk_overlap, coalesce(max_chunk_size_mb, 5) AS max_chunk_size_mb, coalesce(max_pages_per_batch, 10)::DOUBLE AS max_pages_per_batch, coalesce(gte_edge_vector_similar_threshold, 0.75) AS gte_edge_vector_similar_threshold, coalesce(gte_edge_vector_similar_top_k, 3)::DOUBLE AS gte_edge_vector_similar_top_k FROM project_variables WHERE project_id IS NOT NULL) UNPIVOT (value FOR key IN (chunk_size, chunk_overlap, max_chunk_size_mb, max_pages_per_batch, gte_edge_vector_similar_threshold, gte_edge_vector_similar_top_k))",
    "config_detail_join": """
    SELECT project_id, r_name AS llm_model, e.n_name AS embedding_model, o.n_name AS ocr_model, s_name AS reranker_model FROM project_variables p
    LEFT JOIN region ON r_regionkey = chunk_size % 5 LEFT JOIN nation e ON e.n_nationkey = chunk_size % 25
    LEFT JOIN nation o ON max_pages_per_batch IS NOT NULL AND o.n_nationkey = chunk_overlap
    LEFT JOIN supplier ON chunk_size >= 1500 AND s_suppkey = chunk_overlap % 7 + 1 WHERE project_id IS NOT NULL""",
    "model_readiness": f"""
    SELECT id, CASE WHEN t.k = 'video' THEN coalesce(chunk_size > 1500, false) WHEN t.k = 'audio' THEN max_chunk_size_mb IS NOT NULL
      WHEN t.k = 'image' OR coalesce(is_ocr_needed, false) THEN max_pages_per_batch IS NOT NULL ELSE true END AS ready
    FROM {UP} u LEFT JOIN project_variables v USING (project_id) LEFT JOIN {_TYPES} ON t.e = {EXT}""",
    "provider_list": "SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS size FROM customer WHERE c_mktsegment = 'BUILDING'",
    "seed_catalogs": "SELECT 'orgseed' AS org_id, n_regionkey::VARCHAR AS \"group\", n_name AS name, n_nationkey::VARCHAR AS model_id FROM nation",
}
