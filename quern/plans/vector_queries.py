"""Vectors, retrieval stages and whole retrieval plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.lexicon import TECHNICAL_START, content_words
from quern.operators import graph
from quern.operators import vector_search as vs
from quern.plans import retrieval
from quern.plans.catalog_queries import CHUNKS, UP, chunk_rows, uploads
from quern.plans.lexical_queries import _STOP, SC, _MAPS, _words, lexical_input, node_maps
from quern.runtime import cut_lineage, table

DIM, K = 96, 10
QUESTION = "table section mention approved hydraulic budget for the"


def dense_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vs.usable(table(spark, d, "chunk_embeddings"), "chunk_id", "embedding", DIM)


def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vs.sparse_weights(lexical_input(spark, d), "chunk", content_words(F.col("text")))


def sample_vector(dense: DataFrame) -> DataFrame:
    """The vector of the smallest id, as a query."""
    return dense.orderBy("key").limit(1).select("v")


def question_terms(spark: SparkSession, question: str = QUESTION) -> DataFrame:
    return spark.range(1).select(F.explode(F.array_distinct(content_words(F.lit(question)))).alias("term"), F.lit(1.0).alias("weight"))


def asked(rows: DataFrame) -> DataFrame:
    """The rows that ask as queries: those whose id's hash is divisible by 100."""
    digits = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.where(digits % 100 == 0).withColumnRenamed("key", "query")


def asked_terms(sparse: DataFrame) -> DataFrame:
    """The distinct words of the chunks that ask, each of weight 1 as in a question."""
    return asked(sparse).select("query", "term", F.lit(1.0).alias("weight"))


def vec_inject_join(spark, d):
    points = vs.build_points(lexical_input(spark, d).select("chunk", "doc"), dense_vectors(spark, d), sparse_vectors(spark, d))
    return points.select("chunk", "doc", F.col("v").isNotNull().alias("has_dense"), F.coalesce("n_terms", F.lit(0)).cast("bigint").alias("n_terms"))


def vec_inject_strict(spark, d):
    return vs.build_points(lexical_input(spark, d).select("chunk", "doc"), dense_vectors(spark, d), sparse_vectors(spark, d), strict=True).select("chunk", "n_terms")


def vec_cosine_topk(spark, d):
    dense = dense_vectors(spark, d)
    return vs.dense_top(dense, sample_vector(dense), K).select("key", F.round("score", 6).alias("score"))


def vec_sparse_dot_topk(spark, d):
    return vs.sparse_top(sparse_vectors(spark, d), question_terms(spark), K).select("key", F.round("score", 6).alias("score"))


def _hybrid(spark, d, k=K):
    dense = dense_vectors(spark, d)
    return vs.fuse([vs.dense_top(dense, sample_vector(dense), k), vs.sparse_top(sparse_vectors(spark, d), question_terms(spark), k)], k)


def vec_rrf(spark, d):
    return _hybrid(spark, d).select("key", F.round("score", 6).alias("score"))


def vec_cosine_topk_each(spark, d):
    """The K points of greatest cosine for every vector that asks."""
    dense = dense_vectors(spark, d)
    return vs.dense_top(dense, asked(dense), K).select("query", "key", F.round("score", 6).alias("score"))


def vec_sparse_dot_topk_each(spark, d):
    sparse = sparse_vectors(spark, d)
    return vs.sparse_top(sparse, asked_terms(sparse), K).select("query", "key", F.round("score", 6).alias("score"))


def vec_rrf_each(spark, d):
    dense, sparse = dense_vectors(spark, d), sparse_vectors(spark, d)
    legs = [vs.dense_top(dense, asked(dense), K), vs.sparse_top(sparse, asked_terms(sparse), K)]
    return vs.fuse(legs, K).select("query", "key", F.round("score", 6).alias("score"))


def _similar(spark, d, hits: DataFrame | None = None):
    """Similarity edges; with ``hits`` (chunk) only of the documents that hold one of them."""
    docs = chunk_rows(spark, d, "document_id").where("document_id is not null").select(F.col("chunk_id").alias("key"), F.col("document_id").alias("doc"))
    if hits is not None:
        docs = docs.join(docs.join(hits.select(F.col("chunk").alias("key")), "key", "left_semi").select("doc").distinct(), "doc", "left_semi").select("key", "doc")
    return vs.similar_in_document(dense_vectors(spark, d).join(docs, "key"))


def vec_similarity_edges(spark, d):
    return _similar(spark, d)


def vec_neighbour_cosine(spark, d):
    """Cosine of each chunk and the next one of its document."""
    nxt = graph.sequential_edges(lexical_input(spark, d)).where("type = 'NEXT'")
    dense = dense_vectors(spark, d)
    a, b = dense.toDF("src", "va"), dense.toDF("dst", "vb")
    return nxt.join(a, "src").join(b, "dst").select("src", "dst", F.round(vs.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


def vec_collections(spark, d):
    p = table(spark, d, "part")
    dim = F.element_at(F.array(*[F.lit(x) for x in (*vs.DIMENSIONS, 96)]), F.pmod("p_size", F.lit(5)) + 1)
    return p.select("p_partkey", vs.collection_of(F.col("p_brand"), dim).alias("collection"))


def vec_delete(spark, d):
    """Points left, by organisation, after the document of the smallest upload id is deleted."""
    rows = chunk_rows(spark, d, "org_id", "project_id", "document_id")
    first = uploads(spark, d).orderBy("id").limit(1).select("org_id", "project_id", F.col("id").alias("document_id"))
    return rows.join(first, ["org_id", "project_id", "document_id"], "left_anti").groupBy("org_id").agg(F.count(F.lit(1)).alias("points"))


def vec_upsert(spark, d):
    """Points after those without words are written anew with a zero count: merged by id."""
    from quern.operators.catalog import upsert

    rows = vec_inject_join(spark, d).select("chunk", "n_terms")
    return upsert(rows, rows.where("n_terms = 0").select("chunk", F.lit(-1).cast("bigint").alias("n_terms")), ["chunk"])


def score_gate(spark, d):
    return retrieval.gate(_hybrid(spark, d)).select("key", F.round("score", 6).alias("score"))


def minmax_normalize(spark, d):
    """Account balances of suppliers normalised within their nation."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("source"), F.col("s_acctbal").alias("score"))
    return retrieval.min_max(s).select("key", "source", F.round("score", 6).alias("score"))


def expert_fusion(spark, d):
    """Three sources over the customers, fused."""
    c = table(spark, d, "customer")
    src = lambda name, cond, score: c.where(cond).select(F.col("c_custkey").alias("key"), F.lit(name).alias("source"), score.cast("double").alias("score"))
    rows = src("points", "c_acctbal > 5000", F.col("c_acctbal")).unionByName(src("lanes", "c_nationkey < 10", F.col("c_nationkey"))).unionByName(src("equal", "c_mktsegment = 'BUILDING'", F.lit(1.0)))
    return retrieval.fuse_sources(rows, 20)


def _semantic(spark, d):
    maps = node_maps(spark, d)
    return graph.semantic_nodes(maps), graph.semantic_edges(maps)


def lane_scores(spark, d):
    nodes, edges = _semantic(spark, d)
    return retrieval.lane_chunk_scores(nodes, edges, QUESTION, 20)


def graph_expand_prev_next(spark, d):
    return _expanded(spark, d, _hybrid(spark, d)).select("chunk", F.round("score", 6).alias("score"), "number", "prev_chunk", "next_chunk")


def _expanded(spark, d, scores):
    chunks = lexical_input(spark, d)
    return graph.expand_neighbours(scores.withColumnRenamed("key", "chunk"), graph.sequential_edges(chunks), chunks)


def graph_expand_similar(spark, d):
    rows = graph.expand_similar(_hybrid(spark, d).withColumnRenamed("key", "chunk"), _similar(spark, d), retrieval.SIMILAR_GATE)
    return rows.select("chunk", F.round("score", 6).alias("score"), F.array_join(F.transform("similar", lambda x: x["chunk"]), "|").alias("similar"))


def rerank_local(spark, d):
    texts = lexical_input(spark, d).select(F.col("chunk").alias("key"), "text")
    return retrieval.rerank(_hybrid(spark, d, 50).join(texts, "key"), QUESTION, "text", K).select("key", "rerank_score", F.round("score", 6).alias("score"))


def neighbour_dedupe(spark, d):
    rows = _expanded(spark, d, _hybrid(spark, d, 50)).select(F.col("chunk").alias("key"), F.round("score", 6).alias("score"), "prev_chunk", "next_chunk")
    return retrieval.drop_neighbours(rows, [F.desc("score"), F.asc("key")])


def context_islands(spark, d):
    """Chunks that speak of a reactor with their neighbours, merged into runs of successive numbers per document."""
    chunks = lexical_input(spark, d)
    hit = chunks.where(F.contains(F.lower("text"), F.lit("reactor"))).select("doc", "number")
    near = hit.select("doc", F.explode(F.array(F.struct(F.col("number").alias("n"), F.lit(0).alias("p")), F.struct((F.col("number") - 1).alias("n"), F.lit(1).alias("p")), F.struct((F.col("number") + 1).alias("n"), F.lit(1).alias("p")))).alias("x"))
    parts = near.select("doc", F.col("x.n").alias("number"), F.col("x.p").alias("priority")).join(chunks.select("doc", "number", "text"), ["doc", "number"])
    return retrieval.context_islands(parts).select("doc", "first", "last", "n", "text")


def metadata_dedupe(spark, d):
    """Events as tool calls: one row per user."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("source"), F.col("event_id").alias("ord"), F.col("value").alias("score"))
    return retrieval.merge_metadata(e).withColumn("score", F.round("score", 6))


def _plan(spark, d, kind: str, advanced: bool) -> DataFrame:
    """(chunk, score, prev_chunk, next_chunk, similar): one of the six plans, up to the reranker's choice."""
    hybrid = _hybrid(spark, d, 50)
    chunks = lexical_input(spark, d)
    scores = retrieval.gate(hybrid, keep_max=kind == "expert")
    if kind == "expert":
        nodes, edges = _semantic(spark, d)
        sources = [("points", scores), ("lexical", retrieval.lane_chunk_scores(nodes, edges, QUESTION))]
        if advanced:
            from quern.functions.lexicon import lane_scores as lanes

            best = spark.range(1).select(F.explode(F.slice(lanes(F.lit(QUESTION)), 1, retrieval.LANE_COUNT)).alias("l")).select(F.col("l.lane").alias("type"))
            sources.append(("analysis", retrieval.lane_chunk_scores(nodes.join(F.broadcast(best), "type", "left_semi"), edges, QUESTION)))
        union = None
        for name, rows in sources:
            part = rows.select("key", F.lit(name).alias("source"), "score")
            union = part if union is None else union.unionByName(part)
        scores = retrieval.fuse_sources(union).select("key", F.col("total").alias("score"))
    rows = graph.expand_neighbours(scores.withColumnRenamed("key", "chunk"), graph.sequential_edges(chunks), chunks)
    if kind != "quick":
        rows = cut_lineage(rows)  # at most a few hundred hits, which say which documents are compared
        rows = graph.expand_similar(rows, _similar(spark, d, rows), retrieval.SIMILAR_GATE)
    texts = chunks.select("chunk", "text")
    ranked = retrieval.rerank(rows.join(texts, "chunk").withColumnRenamed("chunk", "key"), QUESTION, "text", K)
    return retrieval.drop_neighbours(ranked.drop("text"), [F.desc("rerank_score"), F.asc("key")])


def plan_quick(spark, d):
    rows = cut_lineage(_plan(spark, d, "quick", False))
    return retrieval.quick_context(rows, lexical_input(spark, d)).withColumn("score", F.round("score", 6))


def _assembled(spark, d, kind: str, advanced: bool) -> DataFrame:
    """Context of a smart or expert plan: results, their neighbours, similar chunks and, if advanced, those chunks' neighbours, as runs."""
    rows = cut_lineage(_plan(spark, d, kind, advanced))
    chunks = lexical_input(spark, d)
    similar = rows.select(F.explode("similar").alias("s")).select(F.col("s.chunk").alias("chunk")).distinct()
    wanted = rows.select(F.explode(F.array(F.struct(F.col("key").alias("chunk"), F.lit(0).alias("priority")), F.struct(F.col("prev_chunk").alias("chunk"), F.lit(1).alias("priority")), F.struct(F.col("next_chunk").alias("chunk"), F.lit(2).alias("priority")))).alias("x")).select("x.*")
    wanted = wanted.unionByName(similar.withColumn("priority", F.lit(3)))
    if advanced:
        around = graph.sequential_edges(chunks).join(similar.withColumnRenamed("chunk", "src"), "src", "left_semi")
        wanted = wanted.unionByName(around.select(F.col("dst").alias("chunk"), F.lit(4).alias("priority")))
    parts = wanted.where("chunk is not null").join(chunks.select("chunk", "doc", "number", "text"), "chunk")
    return retrieval.context_islands(parts.select("doc", "number", "text", "priority"))


def plan_smart(spark, d):
    return _assembled(spark, d, "smart", False)


def plan_smart_adv(spark, d):
    return _assembled(spark, d, "smart", True)


def plan_expert(spark, d):
    return _assembled(spark, d, "expert", False)


def plan_expert_adv(spark, d):
    return _assembled(spark, d, "expert", True)


def plan_answer(spark, d):
    """The local model's answer from the quick plan's best context."""
    best = plan_quick(spark, d).orderBy(F.desc("score"), "key").limit(1)
    return retrieval.answer(QUESTION, best, "context")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (vec_inject_join, vec_inject_strict, vec_cosine_topk, vec_sparse_dot_topk, vec_rrf, vec_cosine_topk_each, vec_sparse_dot_topk_each, vec_rrf_each, vec_similarity_edges, vec_neighbour_cosine, vec_collections, vec_delete, vec_upsert, score_gate, minmax_normalize, expert_fusion, lane_scores, graph_expand_prev_next, graph_expand_similar, rerank_local, neighbour_dedupe, context_islands, metadata_dedupe, plan_quick, plan_smart, plan_smart_adv, plan_expert, plan_expert_adv, plan_answer)
}

_Q = "[" + ", ".join(f"'{w}'" for w in sorted({w for w in QUESTION.split() if len(w) > 3 and w not in ("for", "the")})) + "]"
_DENSE = f"""dense AS (SELECT chunk_id AS key, max(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM chunk_embeddings
      WHERE chunk_id IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""
_SPARSE = f"""sparse AS (SELECT key, term, n * 2.2 / (n + 1.2) AS weight FROM (SELECT chunk AS key, term, count(*)::DOUBLE AS n FROM (SELECT chunk, unnest({_words('[a-z]{4,}')}) AS term FROM sc) GROUP BY ALL))"""
_LEGS = f"""WITH {SC}, {_DENSE}, {_SPARSE},
    dt AS (SELECT key, round(list_cosine_similarity(v, (SELECT v FROM dense ORDER BY key LIMIT 1)), 9) AS score FROM dense ORDER BY score DESC, key LIMIT {{k}}),
    st AS (SELECT key, round(sum(weight), 9) AS score FROM sparse WHERE list_contains({_Q}, term) GROUP BY 1 ORDER BY score DESC, key LIMIT {{k}}),
    rr AS (SELECT key, round(sum(s), 9) AS score FROM (SELECT key, 1.0::DOUBLE / (1 + row_number() OVER (ORDER BY score DESC, key)) AS s FROM dt UNION ALL SELECT key, 1.0::DOUBLE / (1 + row_number() OVER (ORDER BY score DESC, key)) FROM st) GROUP BY 1 ORDER BY score DESC, key LIMIT {{k}})"""
_SIM = f"""{_DENSE}, dv AS (SELECT document_id AS doc, key, v FROM dense JOIN {CHUNKS} c ON c.chunk_id = key WHERE document_id IS NOT NULL),
    ap AS (SELECT a.key AS src, b.key AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS weight FROM dv a JOIN dv b ON a.doc = b.doc AND a.key <> b.key),
    sim AS (SELECT * FROM (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3) WHERE weight >= 0.75)"""

_PLAN = f"""x AS (SELECT g.key, g.score, c.number, c.text, p.chunk AS prev_chunk, n.chunk AS next_chunk FROM g JOIN sc c ON c.chunk = g.key LEFT JOIN sc p ON p.doc = c.doc AND p.number = c.number - 1 LEFT JOIN sc n ON n.doc = c.doc AND n.number = c.number + 1),
    rk AS (SELECT *, round(len(list_intersect({_Q}, {_words('[a-z]{4,}')})) / len({_Q}), 6) AS rerank_score FROM x ORDER BY rerank_score DESC, score DESC, key LIMIT {K})"""
_FOLD = """ord AS (SELECT *, row_number() OVER (ORDER BY {by} DESC, key) AS i FROM {rows}),
    fold AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, []::VARCHAR[] AS kept UNION ALL
      SELECT o.i, CASE WHEN list_contains(seen, key) THEN seen ELSE list_concat(seen, list_filter([key, prev_chunk, next_chunk], lambda z: z IS NOT NULL)) END, CASE WHEN list_contains(seen, key) THEN kept ELSE list_append(kept, key) END FROM fold f JOIN ord o ON o.i = f.i + 1),
    kept AS (SELECT * FROM ord WHERE list_contains((SELECT kept FROM fold ORDER BY i DESC LIMIT 1), key))"""
_HITS = _LEGS.replace("WITH ", "WITH RECURSIVE ", 1).replace("{k}", "50")
_GATED = "g AS (SELECT key, score FROM rr WHERE score >= 0.45)"
_SIM_ONLY = _SIM.replace(_DENSE + ", ", "")
_ISLANDS = """wanted AS (SELECT key AS chunk, 0 AS priority FROM kept UNION ALL SELECT prev_chunk, 1 FROM kept UNION ALL SELECT next_chunk, 2 FROM kept UNION ALL SELECT DISTINCT dst, 3 FROM kept JOIN sim ON src = key AND weight >= 0.8{more}),
    once AS (SELECT sc.doc, sc.number, sc.text FROM wanted w JOIN sc ON sc.chunk = w.chunk QUALIFY row_number() OVER (PARTITION BY sc.doc, sc.number ORDER BY priority, text) = 1),
    runs AS (SELECT *, number - row_number() OVER (PARTITION BY doc ORDER BY number) AS run FROM once)
    SELECT doc, min(number) AS first, max(number) AS last, count(*) AS n, string_agg(text, chr(10) ORDER BY number) AS text FROM runs GROUP BY doc, run"""
_AROUND = """ UNION ALL SELECT b.chunk, 4 FROM (SELECT DISTINCT dst FROM kept JOIN sim ON src = key AND weight >= 0.8) s JOIN sc a ON a.chunk = s.dst JOIN sc b ON b.doc = a.doc AND (b.number = a.number + 1 OR b.number = a.number - 1)"""
_RERANKED = _FOLD.format(by="rerank_score", rows="rk")
_LANE_HITS = f"""nw AS (SELECT node_id, type, list_distinct(regexp_split_to_array(value, '[\\s_-]+')) AS w FROM nodes),
    sm AS (SELECT node_id, type, len(list_intersect(w, {_Q})) / sqrt(len(w) * len({_Q})) AS s FROM nw WHERE len(list_intersect(w, {_Q})) > 0),
    lane AS (SELECT chunk AS key, round(max(s * weight), 6) AS score FROM sm JOIN sem USING (node_id, type) WHERE weight >= 0.7 GROUP BY 1 ORDER BY score DESC, key LIMIT {retrieval.LANE_CHUNKS})"""
_ASKS = "('0x' || md5({c})[1:8])::BIGINT % 100 = 0"
_EACH = f"""WITH {SC}, {_DENSE}, {_SPARSE},
    dt AS (SELECT a.key AS query, b.key, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM dense a, dense b WHERE {_ASKS.format(c='a.key')} QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.key) <= {K}),
    sd AS (SELECT a.key AS query, b.key, round(sum(b.weight), 9) AS score FROM sparse a JOIN sparse b USING (term) WHERE {_ASKS.format(c='a.key')} GROUP BY ALL),
    st AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, key) <= {K}),
    rs AS (SELECT query, key, round(sum(s), 9) AS score FROM (SELECT query, key, 1.0::DOUBLE / (1 + row_number() OVER (PARTITION BY query ORDER BY score DESC, key)) AS s FROM dt UNION ALL SELECT query, key, 1.0::DOUBLE / (1 + row_number() OVER (PARTITION BY query ORDER BY score DESC, key)) FROM st) GROUP BY ALL),
    rr AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, key) <= {K})"""
_BEST_LANES = f"""asked AS (SELECT list_filter(string_split('{QUESTION}', ' '), lambda t: NOT list_contains({_STOP}, t)) AS t),
    best_lanes AS (SELECT lane FROM (SELECT i, lane, CASE lane WHEN 'tag' THEN (len(t) = 1)::INT * 1.0 WHEN 'keyword' THEN (len(t) = 1)::INT * 2.0 + (len(t) > 2)::INT * 0.5 + len(list_filter(t, lambda x: regexp_matches(x, '{TECHNICAL_START}'))) * 0.8 WHEN 'concept' THEN (len(t) > 2)::INT * 1.5 ELSE 0 END AS s
      FROM asked, (VALUES (0, 'tag'), (1, 'keyword'), (2, 'phrase'), (3, 'entity'), (4, 'concept'), (5, 'acronym')) v(i, lane)) ORDER BY s DESC, i LIMIT {retrieval.LANE_COUNT}),
    analysed AS (SELECT chunk AS key, round(max(s * weight), 6) AS score FROM sm JOIN sem USING (node_id, type) WHERE weight >= 0.7 AND type IN (SELECT lane FROM best_lanes) GROUP BY 1 ORDER BY score DESC, key LIMIT {retrieval.LANE_CHUNKS})"""
_FUSED = f"""src AS (SELECT key, 'points' AS source, score FROM rr WHERE score >= 0.45 UNION ALL SELECT key, 'lexical', score FROM lane),
    nm2 AS (SELECT key, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS score FROM src WINDOW w AS (PARTITION BY source)),
    g AS (SELECT key, score FROM (SELECT key, count(*) AS sources, round(sum(score), 6) AS score FROM nm2 GROUP BY key) ORDER BY sources DESC, score DESC, key LIMIT {retrieval.EXPERT_CHUNKS})"""
_FUSED_ADV = _FUSED.replace("FROM lane)", "FROM lane UNION ALL SELECT key, 'analysis', score FROM analysed)")

ORACLE: dict[str, str] = {
    "vec_cosine_topk_each": f"{_EACH} SELECT query, key, round(score, 6) AS score FROM dt",
    "vec_sparse_dot_topk_each": f"{_EACH} SELECT query, key, round(score, 6) AS score FROM st",
    "vec_rrf_each": f"{_EACH} SELECT query, key, round(score, 6) AS score FROM rr",
    "rerank_local": f"{_HITS}, g AS (SELECT * FROM rr), {_PLAN} SELECT key, rerank_score, round(score, 6) AS score FROM rk",
    "neighbour_dedupe": f"{_HITS}, g AS (SELECT key, round(score, 6) AS score FROM rr), {_PLAN}, {_FOLD.format(by='score', rows='x')} SELECT key, score, prev_chunk, next_chunk FROM kept",
    "plan_quick": f"""{_HITS}, {_GATED}, {_PLAN}, {_RERANKED}
    SELECT k.key, round(score, 6) AS score, concat_ws(chr(10), CASE WHEN score >= 0.8 THEN '[High]' WHEN score >= 0.5 THEN '[Medium]' ELSE '[Low]' END, b.text, k.text, a.text) AS context
    FROM kept k LEFT JOIN sc b ON b.chunk = prev_chunk AND b.chunk NOT IN (SELECT key FROM kept) LEFT JOIN sc a ON a.chunk = next_chunk AND a.chunk NOT IN (SELECT key FROM kept)""",
    "plan_smart": f"{_HITS}, {_GATED}, {_PLAN}, {_RERANKED}, {_SIM_ONLY}, " + _ISLANDS.format(more=""),
    "plan_smart_adv": f"{_HITS}, {_GATED}, {_PLAN}, {_RERANKED}, {_SIM_ONLY}, " + _ISLANDS.format(more=_AROUND),
    "plan_expert": _MAPS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _HITS.split(f"{SC}, ", 1)[1] + f", {_LANE_HITS}, {_FUSED}, {_PLAN}, {_RERANKED}, {_SIM_ONLY}, " + _ISLANDS.format(more=""),
    "plan_expert_adv": _MAPS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _HITS.split(f"{SC}, ", 1)[1] + f", {_LANE_HITS}, {_BEST_LANES}, {_FUSED_ADV}, {_PLAN}, {_RERANKED}, {_SIM_ONLY}, " + _ISLANDS.format(more=_AROUND),
    "vec_inject_join": f"WITH {SC}, {_DENSE}, {_SPARSE} SELECT chunk, doc, v IS NOT NULL AS has_dense, coalesce(n, 0) AS n_terms FROM sc LEFT JOIN dense ON dense.key = chunk LEFT JOIN (SELECT key, count(*) AS n FROM sparse GROUP BY 1) s ON s.key = chunk",
    "vec_inject_strict": f"WITH {SC}, {_DENSE}, {_SPARSE} SELECT chunk, n AS n_terms FROM sc JOIN dense ON dense.key = chunk JOIN (SELECT key, count(*) AS n FROM sparse GROUP BY 1) s ON s.key = chunk",
    "vec_cosine_topk": _LEGS.replace('{k}', str(K)) + " SELECT key, round(score, 6) AS score FROM dt",
    "vec_sparse_dot_topk": _LEGS.replace('{k}', str(K)) + " SELECT key, round(score, 6) AS score FROM st",
    "vec_rrf": _LEGS.replace('{k}', str(K)) + " SELECT key, round(score, 6) AS score FROM rr",
    "vec_similarity_edges": f"WITH {_SIM} SELECT * FROM sim",
    "vec_neighbour_cosine": f"WITH {SC}, {_DENSE} SELECT a.chunk AS src, b.chunk AS dst, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM sc a JOIN sc b ON a.doc = b.doc AND b.number = a.number + 1 JOIN dense x ON x.key = a.chunk JOIN dense y ON y.key = b.chunk",
    "vec_collections": f"SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN lower(p_brand) || '_' || ([1024, 1536, 2048, 3072, 96])[p_size % 5 + 1] END AS collection FROM part",
    "vec_delete": f"SELECT org_id, count(*) AS points FROM {CHUNKS} WHERE (document_id = (SELECT min(id) FROM {UP}) AND org_id = (SELECT arg_min(org_id, id) FROM {UP}) AND project_id = (SELECT arg_min(project_id, id) FROM {UP})) IS NOT TRUE GROUP BY 1",
    "vec_upsert": f"WITH {SC}, {_SPARSE} SELECT chunk, coalesce(n, -1) AS n_terms FROM sc LEFT JOIN (SELECT key, count(*) AS n FROM sparse GROUP BY 1) s ON s.key = chunk",
    "score_gate": _LEGS.replace('{k}', str(K)) + " SELECT key, round(score, 6) AS score FROM rr WHERE score >= 0.45",
    "minmax_normalize": "SELECT s_suppkey AS key, s_nationkey AS source, round(CASE WHEN max(s_acctbal) OVER w > min(s_acctbal) OVER w THEN (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) ELSE 1.0 END, 6) AS score FROM supplier WINDOW w AS (PARTITION BY s_nationkey)",
    "expert_fusion": """
    WITH r AS (SELECT c_custkey AS key, 'points' AS source, c_acctbal AS score FROM customer WHERE c_acctbal > 5000
      UNION ALL SELECT c_custkey, 'lanes', c_nationkey::DOUBLE FROM customer WHERE c_nationkey < 10 UNION ALL SELECT c_custkey, 'equal', 1.0 FROM customer WHERE c_mktsegment = 'BUILDING'),
    n AS (SELECT key, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS score FROM r WINDOW w AS (PARTITION BY source))
    SELECT key, count(*) AS sources, round(sum(score), 6) AS total FROM n GROUP BY key ORDER BY sources DESC, total DESC, key LIMIT 20""",
    "lane_scores": f"""{_MAPS},
    nw AS (SELECT node_id, type, list_distinct(regexp_split_to_array(value, '[\\s_-]+')) AS w FROM nodes),
    sm AS (SELECT node_id, type, len(list_intersect(w, {_Q})) / sqrt(len(w) * len({_Q})) AS s FROM nw WHERE len(list_intersect(w, {_Q})) > 0)
    SELECT chunk AS key, round(max(s * weight), 6) AS score FROM sm JOIN sem USING (node_id, type) WHERE weight >= 0.7 GROUP BY 1 ORDER BY score DESC, key LIMIT 20""",
    "graph_expand_prev_next": _LEGS.replace('{k}', str(K)) + " SELECT c.chunk, round(score, 6) AS score, c.number, p.chunk AS prev_chunk, n.chunk AS next_chunk FROM rr JOIN sc c ON c.chunk = rr.key LEFT JOIN sc p ON p.doc = c.doc AND p.number = c.number - 1 LEFT JOIN sc n ON n.doc = c.doc AND n.number = c.number + 1",
    "graph_expand_similar": _LEGS.replace('{k}', str(K)) + f", {_SIM.replace(_DENSE + ', ', '')} SELECT key AS chunk, round(score, 6) AS score, coalesce(s, '') AS similar FROM rr LEFT JOIN (SELECT src, string_agg(dst, '|' ORDER BY weight DESC, dst) AS s FROM sim WHERE weight >= 0.8 GROUP BY 1) x ON x.src = key",
    "context_islands": f"""
    WITH {SC}, hit AS (SELECT doc, number FROM sc WHERE contains(lower(text), 'reactor')),
    near AS (SELECT DISTINCT doc, number FROM (SELECT doc, number FROM hit UNION ALL SELECT doc, number - 1 FROM hit UNION ALL SELECT doc, number + 1 FROM hit) JOIN sc USING (doc, number)),
    t AS (SELECT n.doc, n.number, text, n.number - row_number() OVER (PARTITION BY n.doc ORDER BY n.number) AS g FROM near n JOIN sc ON sc.doc = n.doc AND sc.number = n.number)
    SELECT doc, min(number) AS first, max(number) AS last, count(*) AS n, string_agg(text, chr(10) ORDER BY number) AS text FROM t GROUP BY doc, g""",
    "metadata_dedupe": "SELECT user_id AS key, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS sources, round(arg_min(value, (event_id, event_type)), 6) AS score FROM events GROUP BY 1",
}
