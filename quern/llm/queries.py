"""Registered queries of the training-data operators and, where SQL can express them, their equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, neardup, packing, scans, splitting, toxicity, turns, vectors
from quern.runtime import table

DIM, K, LEAST_COSINE = 96, 5, 0.80
SHINGLE, LEAST_JACCARD, LEAST_WORDS = 3, 0.55, 20


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.similar_vectors(table(spark, d, "chunk_embeddings"), "chunk_id", "embedding", DIM, K, LEAST_COSINE)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of all vectors for every chunk whose id, by its MD5, is divisible by 100."""
    every = table(spark, d, "chunk_embeddings")
    digits = F.conv(F.substring(F.md5(F.col("chunk_id").cast("binary")), 1, 8), 16, 10).cast("bigint")
    asked = every.where(digits % 100 == 0)
    return vectors.nearest_for_queries(every, asked, "chunk_id", "embedding", DIM, K).select(F.col("id").alias("chunk_id"), "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "project_variables"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece = 0 and pieces > 1").select("chunk_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.col("updated_at").alias("version"), "text")
    segments = table(spark, d, "segments").select(F.lit("segment").alias("kind"), F.col("segment_id").alias("key"), F.col("ingested_at").alias("version"), F.col("transcript").alias("text"))
    return chunks.unionByName(segments)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_records(spark, d), SHINGLE, LEAST_JACCARD, LEAST_WORDS)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(_records(spark, d), SHINGLE, LEAST_JACCARD, LEAST_WORDS)


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    pages = scans.repair_scans(table(spark, d, "chunks"), table(spark, d, "uploads"))
    return pages.select("chunk_id", "document_id", F.posexplode("paragraphs").alias("paragraph", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = scans.repair_scans(table(spark, d, "chunks"), table(spark, d, "uploads"))
    return pages.select("chunk_id", F.explode("defects").alias("defect"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_starts(table(spark, d, "utterances"), table(spark, d, "words"))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_texts(table(spark, d, "utterances"), table(spark, d, "words"))


def _capacities(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The containers, which are configuration."""
    return sorted((r["container"], r["capacity_tokens"]) for r in table(spark, d, "containers").where("capacity_tokens > 0").collect())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    wide = dict(_capacities(spark, d))["wide_4096"]
    items = packing.token_items(table(spark, d, "documents"), "doc_id", "text")
    placed = packing.fill_containers(items, "doc_id", "n_tokens", wide)
    return placed.groupBy("doc_id").agg(F.max("piece").alias("last")).where("last > 0").select("doc_id")


def _filled(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    items = packing.token_items(table(spark, d, "documents"), "doc_id", "text")
    return [(name, size, packing.fill_containers(items, "doc_id", "n_tokens", size)) for name, size in _capacities(spark, d)]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place for each capacity."""
    out = None
    for name, _, placed in _filled(spark, d):
        part = placed.select(F.lit(name).alias("kind"), "container", "doc_id", "piece", F.col("offset").alias("token_offset"), F.col("length").alias("n_tokens"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, size, placed in _filled(spark, d):
        part = packing.fill_report(placed, size).select(F.lit(name).alias("kind"), "containers", "tokens", "least", F.round("fill", 6).alias("fill"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix_sources(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored_documents(table(spark, d, "documents")).where(F.col("score") >= toxicity.FLAGGED).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_documents(table(spark, d, "documents")).select("doc_id", "source", F.round("score", 6).alias("score"), "flagged")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = toxicity.rates_by_source(toxicity.score_documents(table(spark, d, "documents")))
    return rates.select("source", "documents", "flagged", F.round("rate", 6).alias("rate"), F.round("mean_score", 6).alias("mean_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_nearest, p3_found, p3_pieces, p4_found, p4_groups, p5_found, p5_paragraphs, p6_found, p6_turns, p7_found, p7_containers, p7_fill, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)
}

_USABLE = f"""
    SELECT chunk_id, max(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM chunk_embeddings
    WHERE chunk_id IS NOT NULL AND len(embedding) = {DIM}
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY chunk_id"""

_SHINGLES = rf"""
    WITH texts AS (
      SELECT 'chunk' AS kind, chunk_id AS key, arg_max(text, updated_at) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id
      UNION ALL
      SELECT 'segment', segment_id, arg_max(transcript, ingested_at) FROM segments WHERE segment_id IS NOT NULL AND transcript IS NOT NULL GROUP BY segment_id),
    w AS (SELECT kind, key, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM texts),
    s AS (SELECT kind, key, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= {LEAST_WORDS}),
    t AS (SELECT kind, key, unnest(s) AS t FROM s),
    rare AS (SELECT kind, key, t FROM t),
    shared AS (SELECT a.kind, a.key AS key_a, b.key AS key_b, count(*) AS n FROM rare a JOIN rare b ON a.kind = b.kind AND a.t = b.t AND a.key < b.key GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""
    WITH u AS ({_USABLE}),
    pairs AS (SELECT a.chunk_id AS q, b.chunk_id AS n, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
    top AS (SELECT q, n, s FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 12) DESC, n) <= {K})
    SELECT DISTINCT least(q, n) AS chunk_id_a, greatest(q, n) AS chunk_id_b FROM top WHERE s >= {LEAST_COSINE}""",
    "p1_nearest": f"""
    WITH u AS ({_USABLE}),
    pairs AS (SELECT a.chunk_id, b.chunk_id AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.chunk_id <> b.chunk_id WHERE ('0x' || md5(a.chunk_id)[1:8])::BIGINT % 100 = 0)
    SELECT chunk_id, neighbour, round(s, 6) AS similarity, row_number() OVER (PARTITION BY chunk_id ORDER BY round(s, 12) DESC, neighbour) AS rank FROM pairs
    QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(s, 12) DESC, neighbour) <= {K}""",
    "p3_found": """
    SELECT DISTINCT chunk_id FROM chunks JOIN project_variables USING (project_id)
    WHERE chunk_id IS NOT NULL AND max_chunk_size_mb > 0 AND strlen(text) > floor(max_chunk_size_mb * 1048576)""",
    "p4_found": f"""{_SHINGLES}
    SELECT x.kind, key_a, key_b FROM shared x JOIN s a ON a.kind = x.kind AND a.key = key_a JOIN s b ON b.kind = x.kind AND b.key = key_b
    WHERE n::DOUBLE / (len(a.s) + len(b.s) - n) >= {LEAST_JACCARD}""",
    "p4_groups": rf"""
    WITH RECURSIVE texts AS (
      SELECT 'chunk' AS kind, chunk_id AS key, arg_max(text, updated_at) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id
      UNION ALL
      SELECT 'segment', segment_id, arg_max(transcript, ingested_at) FROM segments WHERE segment_id IS NOT NULL AND transcript IS NOT NULL GROUP BY segment_id),
    w AS (SELECT kind, key, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM texts),
    member AS (SELECT kind, key, w, min(key) OVER (PARTITION BY kind, w) AS rep FROM w WHERE len(w) >= {LEAST_WORDS}),
    s AS (SELECT kind, rep, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM member WHERE key = rep),
    t AS (SELECT kind, rep, unnest(s) AS t FROM s),
    shared AS (SELECT a.kind, a.rep AS a, b.rep AS b, count(*) AS n FROM t a JOIN t b ON a.kind = b.kind AND a.t = b.t AND a.rep < b.rep GROUP BY ALL),
    pairs AS (SELECT x.kind, a, b FROM shared x JOIN s p ON p.kind = x.kind AND p.rep = a JOIN s q ON q.kind = x.kind AND q.rep = b WHERE n::DOUBLE / (len(p.s) + len(q.s) - n) >= {LEAST_JACCARD}),
    edges AS (SELECT kind, a, b FROM pairs UNION ALL SELECT kind, b, a FROM pairs),
    reach AS (SELECT kind, rep, rep AS other FROM s UNION SELECT r.kind, r.rep, e.b FROM reach r JOIN edges e ON e.kind = r.kind AND e.a = r.other),
    roots AS (SELECT kind, rep, min(other) AS class_id FROM reach GROUP BY ALL),
    degree AS (SELECT kind, a AS rep, count(*) AS links FROM edges GROUP BY ALL)
    SELECT m.kind, m.key, r.class_id, coalesce(d.links, 0) AS links FROM member m JOIN roots r USING (kind, rep) LEFT JOIN degree d USING (kind, rep)""",
}
