"""Lexical engine, query analysis and the graph built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import lexicon
from quern.operators import graph, lexical
from quern.plans.catalog_queries import CHUNKS, UP, chunk_rows, uploads
from quern.plans.source_queries import SEGMENTS, segments
from quern.plans.stored import stored
from quern.runtime import table

# Definitions of acronyms, which the tables lack.
FIXTURE = [
    ("fixture", 0, "fx_0", 0, "Retrieval Augmented Generation (RAG) joins search and models."),
    ("fixture", 0, "fx_1", 1, "Nothing is said here."),
    ("fixture", 0, "fx_2", 2, "RAG needs chunks."),
    ("fixture", 0, "fx_3", 3, "Some like RAG, others do not."),
    ("fixture", 0, "fx_4", 4, "A DRAG force is another thing."),
    ("fixture", 0, "fx_5", 5, "Random Access Grid (RAG) is a later meaning."),
]
FREQUENT = "approved"
HINT = r"(table|figure|section) \d+"
LANE_SAMPLE = "pending"


def lexical_input(spark: SparkSession, d: str) -> DataFrame:
    own = lexical.scoped(chunk_rows(spark, d, "document_id", "file_chunk_number", "chunk_number", "text"))
    return own.unionByName(spark.createDataFrame(FIXTURE, "doc string, buf bigint, chunk string, number int, text string"))


def lex_entities(spark, d):
    return lexical.entities(lexical_input(spark, d))


def lex_concepts(spark, d):
    return lexical.concepts(lexical_input(spark, d))


def lex_phrases(spark, d):
    return lexical.phrases(lexical_input(spark, d))


def lex_tfidf_keywords(spark, d):
    return lexical.keywords(lexical_input(spark, d)).withColumn("weight", F.round("weight", 6))


def lex_noise(spark, d):
    return lexical.noise_words(lexical_input(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


def lex_acronyms(spark, d):
    return lexical.acronyms(lexical_input(spark, d))


def lex_acronym_usage(spark, d):
    return lexical.acronym_usage(lexical_input(spark, d))


def lex_bridge_edges(spark, d):
    """Edges of every label within its buffer: how many, the greatest weight, and the ends of the first and last."""
    edges = lexical.bridge_edges(lexical_input(spark, d))
    return edges.groupBy("doc", "buf", "type", "label").agg(F.count(F.lit(1)).alias("edges"), F.max("weight").alias("weight"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst"))


def lex_edges_dedup(spark, d):
    return lexical.strongest_edges(lexical.bridge_edges(lexical_input(spark, d)))


def _maps(spark, d):
    return lexical.node_maps(lexical.strongest_edges(lexical.bridge_edges(lexical_input(spark, d))))


def lex_node_maps(spark, d):
    return _maps(spark, d)


def node_maps(spark, d):
    """The labels that link chunks, as the graph's lookups read them: written once (see ``stored``)."""
    return stored(spark, d, "node_maps", lambda: _maps(spark, d))


def query_analysis_lanes(spark, d):
    """Lanes of every segment's topic as a query."""
    q = segments(spark, d).where("topic_summary is not null").select("segment_id", F.col("topic_summary").alias("q"))
    lanes = q.select("segment_id", F.size(lexicon.query_tokens(F.col("q"))).cast("bigint").alias("n_tokens"), F.posexplode(lexicon.lane_scores(F.col("q"))).alias("rank", "l"))
    return lanes.select("segment_id", "n_tokens", F.col("rank").cast("bigint").alias("rank"), F.col("l.lane").alias("lane"), F.round("l.score", 4).alias("score"))


def normalize_node_values(spark, d):
    """Names of uploads as values of every lane."""
    up = uploads(spark, d)
    return up.select("id", *[lexicon.lane_value(F.trim(F.col("name")), lane).alias(lane) for lane in lexicon.LANES])


def normalize_queries(spark, d):
    up = uploads(spark, d)
    return up.select("id", *[lexicon.lane_query(F.trim(F.col("name")), lane).alias(lane) for lane in lexicon.LANES])


def graph_semantic_nodes(spark, d):
    return graph.semantic_nodes(node_maps(spark, d))


def graph_semantic_edges(spark, d):
    return graph.semantic_edges(node_maps(spark, d), lexical_input(spark, d))


def graph_acronym_edges(spark, d):
    return graph.acronym_edges(lexical.acronym_usage(lexical_input(spark, d)))


def _sequence(spark, d):
    return graph.sequential_edges(lexical_input(spark, d))


def graph_prev_next(spark, d):
    return _sequence(spark, d)


def graph_prev_next_batches(spark, d):
    return graph.sequential_edges(lexical_input(spark, d), batch_scoped=True)


def _hints(spark, d):
    chunks = lexical_input(spark, d)
    hint = F.regexp_extract(F.lower("text"), HINT, 0)
    return chunks.select("chunk", F.when(hint != "", hint).when(F.contains(F.lower("text"), F.lit("above")), "above").alias("hint")).where("hint is not null")


def graph_references(spark, d):
    return graph.reference_edges(lexical_input(spark, d), _hints(spark, d))


def graph_tag_map(spark, d):
    """Keywords of segments as new tags, moods as similar ones, with the settings as the pool."""
    s = segments(spark, d)
    responses = s.select(F.col("segment_id").alias("chunk"), F.split(F.coalesce("keywords", F.lit("")), ",").alias("new_tags"), F.array(F.struct(F.col("mood").alias("tag"), F.lit(1.7).alias("confidence")), F.struct(F.col("setting").alias("tag"), F.lit(0.456).alias("confidence"))).alias("similar"))
    pool = s.select(F.col("setting").alias("tag")).where("tag is not null")
    return graph.tag_map(responses, pool)


def graph_delete_doc(spark, d):
    """Sequential edges that are left when the documents of failed uploads are deleted."""
    failed = uploads(spark, d).where("status = 'FAILED'").select(F.col("id").alias("doc"))
    chunks = lexical_input(spark, d)
    gone = chunks.join(failed, "doc", "left_semi").select("chunk")
    _, kept = graph.delete_nodes(chunks, _sequence(spark, d), gone)
    return kept.select("src", "dst", "type")


def graph_children(spark, d):
    """Chunks whose upload exists, and uploads whose project exists."""
    projects = table(spark, d, "project_variables").select(F.col("project_id").alias("id"))
    up = graph.upsert_children(uploads(spark, d), projects, "project_id")
    return graph.upsert_children(lexical_input(spark, d).withColumnRenamed("doc", "document_id"), up, "document_id").select("document_id", "chunk")


def graph_unique_ids(spark, d):
    """Nodes per type and how many of their ids occur more than once."""
    nodes = graph.semantic_nodes(node_maps(spark, d))
    dup = graph.duplicate_ids(nodes).groupBy("type").agg(F.count(F.lit(1)).alias("duplicates"))
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("nodes")).join(dup, "type", "left").select("type", "nodes", F.coalesce("duplicates", F.lit(0)).cast("bigint").alias("duplicates"))


def graph_chunks_by_keyword(spark, d):
    from hashlib import md5

    return graph.chunks_by_node(graph.semantic_edges(node_maps(spark, d)), md5(FREQUENT.encode()).hexdigest(), "keyword")


def graph_list_keywords(spark, d):
    from quern.operators.catalog import page

    return page(graph.list_nodes(graph.semantic_nodes(node_maps(spark, d)), "keyword", LANE_SAMPLE[:2]), [F.desc("frequency"), F.asc("value")], 20, 1).select("node_id", "value", "frequency")


def graph_list_counts(spark, d):
    """Nodes of each type whose value contains the needle, with the number of pages."""
    nodes = graph.semantic_nodes(node_maps(spark, d)).where(F.contains("value", F.lit(LANE_SAMPLE[:2])))
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / 20).cast("bigint"))


def graph_lane_mapping(spark, d):
    maps = node_maps(spark, d)
    m = graph.lane_mapping(graph.semantic_nodes(maps), graph.semantic_edges(maps), "entity")
    return m.select("node_id", "value", "frequency", "page", F.array_join(F.transform("chunks", lambda x: x["chunk"]), "|").alias("chunks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (lex_entities, lex_concepts, lex_phrases, lex_tfidf_keywords, lex_noise, lex_acronyms, lex_acronym_usage, lex_bridge_edges, lex_edges_dedup, lex_node_maps, query_analysis_lanes, normalize_node_values, normalize_queries, graph_semantic_nodes, graph_semantic_edges, graph_acronym_edges, graph_prev_next, graph_prev_next_batches, graph_references, graph_tag_map, graph_delete_doc, graph_children, graph_unique_ids, graph_chunks_by_keyword, graph_list_keywords, graph_list_counts, graph_lane_mapping)
}

_STOP = "[" + ", ".join(f"'{w}'" for w in lexicon.STOP_WORDS) + "]"
_FIX = ", ".join(f"('{a}', {b}, '{c}', {n}, '{t}')" for a, b, c, n, t in FIXTURE)
SC = f"""sc AS (SELECT document_id AS doc, coalesce(file_chunk_number::BIGINT + coalesce(chunk_number, 0) // 1000 * 4294967296, -1 - coalesce(chunk_number, 0) // 50) AS buf, chunk_id AS chunk, chunk_number AS number, coalesce(text, '') AS text FROM {CHUNKS} WHERE document_id IS NOT NULL
      UNION ALL SELECT * FROM (VALUES {_FIX}) f(doc, buf, chunk, number, text))"""


def _words(shape: str) -> str:
    return f"list_filter(regexp_extract_all(lower(text), '{lexicon.RUN}'), lambda w: regexp_full_match(w, '{shape}') AND NOT list_contains({_STOP}, w))"


_ENT = f"ent AS (SELECT DISTINCT doc, buf, lower(l) AS label, chunk FROM (SELECT *, unnest(regexp_extract_all(regexp_replace(text, '{lexicon.FOREIGN}', '#', 'g'), '{lexical.ENTITY_RUN}')) AS l FROM sc) WHERE NOT list_contains({_STOP}, lower(l)) AND length(l) >= 4)"
_CON = f"""nouns AS (SELECT doc, buf, chunk, list_filter({_words('[a-z]{4,}')}, lambda w: regexp_full_match(w, '[a-z]{{4,}}(?:{lexicon.TECHNICAL})')) AS w FROM sc),
    con AS (SELECT doc, buf, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS label, chunk FROM nouns WHERE len(w) > 1)"""
_PHR = f"""pw AS (SELECT doc, buf, chunk, {_words('[a-z][\\p{L}\\p{N}_]+')} AS w FROM sc),
    pg AS (SELECT doc, buf, unnest(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) AS label, chunk FROM pw WHERE len(w) >= 4),
    phr AS (SELECT * FROM pg QUALIFY count(*) OVER (PARTITION BY doc, buf, label) BETWEEN 2 AND 3)"""
_TF = f"""tf AS (SELECT doc, buf, chunk, label, count(*) AS tf FROM (SELECT doc, buf, chunk, unnest({_words('[a-z]{4,}')}) AS label FROM sc) GROUP BY ALL),
    ns AS (SELECT doc, buf, count(*) AS n FROM sc GROUP BY ALL),
    vocab AS (SELECT * FROM (SELECT doc, buf, label, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL) JOIN ns USING (doc, buf)
              WHERE n * 0.4 >= 2 AND df >= 2 AND df <= n * 0.4 QUALIFY row_number() OVER (PARTITION BY doc, buf ORDER BY total DESC, label) <= 500)"""
_KEY = f"""{_TF},
    kx AS (SELECT doc, buf, label, chunk, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN vocab USING (doc, buf, label)),
    kw AS (SELECT doc, buf, label, chunk, x / sqrt(sum(x * x) OVER (PARTITION BY doc, buf, chunk)) AS weight FROM kx),
    key AS (SELECT * FROM (SELECT * FROM kw WHERE weight >= 0.05) QUALIFY count(*) OVER (PARTITION BY doc, buf, label) >= 2)"""
_ACR = f"""ax AS (SELECT doc, buf, chunk, number, unnest(regexp_extract_all(regexp_replace(text, '{lexicon.FOREIGN}', '#', 'g'), '{lexical.DEFINITION}', 2)) AS short, unnest(regexp_extract_all(regexp_replace(text, '{lexicon.FOREIGN}', '#', 'g'), '{lexical.DEFINITION}', 1)) AS expansion FROM sc),
    acr AS (SELECT doc, buf, short, trim(arg_max(expansion, number)) AS expansion, arg_max(chunk, number) AS defined_in FROM ax GROUP BY ALL),
    use AS (SELECT doc, buf, short, defined_in, chunk AS used_in FROM acr JOIN (SELECT DISTINCT doc, buf, chunk, unnest(regexp_extract_all(text, '{lexicon.RUN}')) AS short FROM sc) USING (doc, buf, short) WHERE chunk <> defined_in)"""
_EDGES = f"""WITH {SC}, {_ENT}, {_CON}, {_PHR}, {_KEY}, {_ACR},
    maps AS (SELECT doc, buf, 'entity' AS type, label, chunk, 1.0::DOUBLE AS weight FROM ent QUALIFY count(*) OVER (PARTITION BY doc, buf, label) >= 2
      UNION ALL SELECT doc, buf, 'concept', label, chunk, 0.75 FROM con QUALIFY count(*) OVER (PARTITION BY doc, buf, label) >= 2
      UNION ALL SELECT doc, buf, 'phrase', label, chunk, 0.85 FROM phr UNION ALL SELECT doc, buf, 'keyword', label, chunk, weight FROM key),
    edges AS (SELECT a.doc, a.buf, a.chunk AS src, b.chunk AS dst, a.type, a.label, round(sqrt(a.weight * b.weight), 4) AS weight FROM maps a JOIN maps b ON a.doc = b.doc AND a.buf = b.buf AND a.type = b.type AND a.label = b.label AND a.chunk < b.chunk
      UNION ALL SELECT doc, buf, defined_in, used_in, 'acronym', short, 0.9 FROM use)"""
_RANK = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexical.TYPE_RANK.items()) + " END"
_MAPS = f"""{_EDGES},
    best AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY doc, buf, least(src, dst), greatest(src, dst) ORDER BY weight DESC, {_RANK}, label) = 1),
    ends AS (SELECT type, label, src AS chunk, weight FROM best UNION ALL SELECT type, label, dst, weight FROM best),
    nm AS (SELECT type, label, chunk, max(weight) AS weight FROM ends GROUP BY ALL),
    keyed AS (SELECT *, CASE WHEN type = 'acronym' THEN md5(upper(label)) ELSE md5(lower(trim(label))) END AS node_id FROM nm),
    nodes AS (SELECT type, node_id, min(label) AS value, count(*) AS frequency FROM keyed GROUP BY ALL),
    sem AS (SELECT chunk, node_id, type, max(weight) AS weight, count(*) AS frequency FROM keyed GROUP BY ALL)"""
_SEQ = f"""WITH {SC}, pairs AS (SELECT a.chunk AS a, b.chunk AS b, a.buf = b.buf AS same FROM sc a JOIN sc b ON a.doc = b.doc AND b.number = a.number + 1),
    seq AS (SELECT a AS src, b AS dst, 'NEXT' AS type, 1.0::DOUBLE AS weight, same FROM pairs UNION ALL SELECT b, a, 'PREV', 1.0::DOUBLE, same FROM pairs)"""


def _plain(c: str) -> str:
    return f"trim(regexp_replace(lower(translate(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')), '\\s+', ' ', 'g'))"


def _nostop(c: str) -> str:
    return f"array_to_string(list_filter(string_split({c}, ' '), lambda w: NOT list_contains({_STOP}, w)), ' ')"


_N = "trim(name)"
_ACRONYM_TEST = f"regexp_full_match(trim(replace({_N}, '.', '')), '[A-Z]{{2,6}}')"

ORACLE: dict[str, str] = {
    "lex_entities": f"WITH {SC}, {_ENT} SELECT * FROM ent",
    "lex_concepts": f"WITH {SC}, {_CON} SELECT * FROM con",
    "lex_phrases": f"WITH {SC}, {_PHR} SELECT * FROM phr",
    "lex_tfidf_keywords": f"WITH {SC}, {_KEY} SELECT doc, buf, label, chunk, round(weight, 6) AS weight FROM key",
    "lex_noise": f"WITH {SC}, {_TF}, w AS (SELECT DISTINCT doc, buf, label FROM tf ANTI JOIN vocab USING (doc, buf, label)) SELECT doc, buf, rank, label AS word FROM (SELECT *, row_number() OVER (PARTITION BY doc, buf ORDER BY label) AS rank FROM w) WHERE rank <= 15",
    "lex_acronyms": f"WITH {SC}, {_ACR} SELECT * FROM acr",
    "lex_acronym_usage": f"WITH {SC}, {_ACR} SELECT * FROM use",
    "lex_bridge_edges": f"{_EDGES} SELECT doc, buf, type, label, count(*) AS edges, max(weight) AS weight, min(src) AS first_src, max(dst) AS last_dst FROM edges GROUP BY ALL",
    "lex_edges_dedup": f"{_MAPS} SELECT * FROM best",
    "lex_node_maps": f"{_MAPS} SELECT * FROM nm",
    "query_analysis_lanes": f"""
    WITH q AS (SELECT segment_id, topic_summary AS q, list_filter(regexp_split_to_array(lower(trim(topic_summary)), '\\s+'), lambda t: t <> '' AND NOT list_contains({_STOP}, t)) AS t FROM {SEGMENTS} WHERE topic_summary IS NOT NULL),
    s AS (SELECT segment_id, len(t) AS n, len(list_filter(t, lambda x: regexp_matches(x, '{lexicon.TECHNICAL_START}'))) AS h, regexp_full_match(trim(replace(q, '.', '')), '[A-Z]{{2,6}}') AS a FROM q),
    l AS (SELECT segment_id, n, i, lane, round(0.1 + CASE lane WHEN 'tag' THEN (n = 1)::INT * 1.0 WHEN 'keyword' THEN (n = 1)::INT * 2.0 + (n > 2)::INT * 0.5 + h * 0.8 WHEN 'concept' THEN (n > 2)::INT * 1.5 WHEN 'acronym' THEN a::INT * 3.0 ELSE 0 END, 4)::DOUBLE AS score
          FROM s, (VALUES (0, 'tag'), (1, 'keyword'), (2, 'phrase'), (3, 'entity'), (4, 'concept'), (5, 'acronym')) v(i, lane))
    SELECT segment_id, n AS n_tokens, row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, i) - 1 AS rank, lane, score FROM l""",
    "normalize_node_values": f"SELECT id, {_nostop(_plain(_N))} AS tag, {_nostop(_plain(_N))} AS keyword, {_plain(_N)} AS phrase, trim(regexp_replace(translate({_N}, '_-', '  '), '\\s+', ' ', 'g')) AS entity, {_plain(_N)} AS concept, upper(trim(replace({_N}, '.', ''))) AS acronym FROM {UP}",
    "normalize_queries": f"SELECT id, {_nostop(_plain(_N))} AS tag, {_nostop(_plain(_N))} AS keyword, {_plain(_N)} AS phrase, trim(regexp_replace(translate({_N}, '_', ' '), '\\s+', ' ', 'g')) AS entity, {_plain(_N)} AS concept, CASE WHEN {_ACRONYM_TEST} THEN upper(trim(replace({_N}, '.', ''))) ELSE {_N} END AS acronym FROM {UP}",
    "graph_semantic_nodes": f"{_MAPS} SELECT * FROM nodes",
    "graph_semantic_edges": f"{_MAPS} SELECT * FROM sem",
    "graph_acronym_edges": f"WITH {SC}, {_ACR} SELECT DISTINCT md5(upper(short)) AS node_id, defined_in AS chunk, 1.0::DOUBLE AS weight FROM use UNION SELECT md5(upper(short)), used_in, 0.9::DOUBLE FROM use",
    "graph_prev_next": f"{_SEQ} SELECT src, dst, type, weight FROM seq",
    "graph_prev_next_batches": f"{_SEQ} SELECT src, dst, type, weight FROM seq WHERE same",
    "graph_references": f"""
    WITH {SC}, h AS (SELECT *, CASE WHEN regexp_matches(lower(text), '{HINT}') THEN regexp_extract(lower(text), '{HINT}') WHEN contains(lower(text), 'above') THEN 'above' END AS hint FROM sc),
    e AS (SELECT h.chunk AS src, p.chunk AS dst, 'previous' AS label FROM h JOIN sc p ON p.doc = h.doc AND p.number = h.number - 1 WHERE hint IN ('previous', 'above', 'before', 'earlier')
      UNION SELECT h.chunk, o.chunk, hint FROM h JOIN sc o ON o.doc = h.doc AND o.buf = h.buf AND o.chunk <> h.chunk AND contains(lower(o.text), hint) WHERE hint IS NOT NULL AND hint NOT IN ('previous', 'above', 'before', 'earlier'))
    SELECT src, dst, label, CASE WHEN label = 'previous' THEN 0.6::DOUBLE WHEN count(*) OVER (PARTITION BY src) = 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS weight FROM e""",
    "graph_tag_map": f"""
    WITH s AS (SELECT * FROM {SEGMENTS}), n AS (SELECT segment_id AS chunk, unnest(list_filter(list_transform(string_split(coalesce(keywords, ''), ','), lambda t: regexp_replace(lower(trim(t)), '\\s+', '_', 'g')), lambda t: t <> '')[1:2]) AS tag, 1.0 AS confidence FROM s),
    pool AS (SELECT DISTINCT regexp_replace(lower(trim(setting)), '\\s+', '_', 'g') AS tag FROM s WHERE setting IS NOT NULL),
    m AS (SELECT segment_id AS chunk, regexp_replace(lower(trim(mood)), '\\s+', '_', 'g') AS tag, 1.0 AS confidence FROM s UNION ALL SELECT segment_id, regexp_replace(lower(trim(setting)), '\\s+', '_', 'g'), 0.46 FROM s)
    SELECT tag, chunk, max(confidence)::DOUBLE AS confidence FROM (SELECT tag, chunk, confidence FROM n UNION ALL SELECT tag, chunk, confidence FROM m SEMI JOIN pool USING (tag)) GROUP BY ALL""",
    "graph_delete_doc": f"{_SEQ}, gone AS (SELECT chunk FROM sc JOIN {UP} u ON u.id = doc WHERE status = 'FAILED') SELECT src, dst, type FROM seq WHERE src NOT IN (SELECT chunk FROM gone) AND dst NOT IN (SELECT chunk FROM gone)",
    "graph_children": f"WITH {SC} SELECT doc AS document_id, chunk FROM sc WHERE doc IN (SELECT id FROM {UP} WHERE project_id IN (SELECT project_id FROM project_variables))",
    "graph_unique_ids": f"{_MAPS} SELECT type, count(*) AS nodes, 0::BIGINT AS duplicates FROM nodes GROUP BY 1",
    "graph_chunks_by_keyword": f"{_MAPS} SELECT chunk FROM sem WHERE type = 'keyword' AND node_id = md5('{FREQUENT}')",
    "graph_list_keywords": f"{_MAPS} SELECT node_id, value, frequency FROM nodes WHERE type = 'keyword' AND contains(value, '{LANE_SAMPLE[:2]}') ORDER BY frequency DESC, value LIMIT 20",
    "graph_list_counts": f"{_MAPS} SELECT type, count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM nodes WHERE contains(value, '{LANE_SAMPLE[:2]}') GROUP BY 1",
    "graph_lane_mapping": f"{_MAPS} SELECT n.node_id, value, sum(s.frequency)::BIGINT AS frequency, 0 AS page, string_agg(chunk, '|' ORDER BY chunk) AS chunks FROM nodes n JOIN sem s ON s.node_id = n.node_id AND s.type = n.type WHERE n.type = 'entity' GROUP BY ALL",
}
