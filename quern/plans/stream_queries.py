"""Streams, stateful steps and their batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import models
from quern.operators import lexical
from quern.plans.catalog_queries import UP, uploads
from quern.plans.lexical_queries import SC, _ENT, _words, lexical_input
from quern.plans.source_queries import SEGMENTS, segments
from quern.plans.vector_queries import _DENSE, dense_vectors
from quern.runtime import table
from quern.streaming import jobs


def stream_resume_buffers(spark, d):
    """Events as a stream, cut into buffers of fifty per user: how far each buffer got."""
    out = jobs.drain(jobs.advance_buffers(jobs.file_stream(spark, d, "events"), "user_id", "event_id"), spark)
    return out.groupBy("user_id", "buffer").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("n"))


def stream_status_counts(spark, d):
    return jobs.drain(jobs.windowed_counts(jobs.file_stream(spark, d, "events"), "ts", "event_type"), spark, "complete")


def event_sessions(spark, d):
    """Sessions of each user: events at most thirty minutes apart."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return s.select("user_id", "n", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("last"))


def status_latest(spark, d):
    """The last event of every user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def dead_letter(spark, d):
    """Users whose failures exceed the attempts allowed, and the failures of the others that are tried again."""
    tried = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    return tried.withColumn("route", F.when(F.col("attempts") > jobs.MAX_ATTEMPTS, "dead").otherwise("retry"))


def webhook_fanout(spark, d):
    """Finished uploads times the webhooks of their project, of which every project has one per organisation and one of its own."""
    hooks = table(spark, d, "project_variables").select("project_id", F.explode(F.array(F.concat(F.lit("org/"), F.col("org_id")), F.concat(F.lit("project/"), F.col("readable_id")))).alias("url"))
    done = uploads(spark, d).where(F.upper("status").isin(*jobs.WEBHOOK_EVENTS)).select("id", "project_id", F.upper("status").alias("event"))
    return done.join(hooks, "project_id").select("id", "event", "url")


def tag_pool_running(spark, d):
    """Per buffer of a document: tags first seen in it, and how many were known before it. The first buffer of each tag decides, so no set is carried."""
    tags = segments(spark, d).where("document_id is not null").select("document_id", F.coalesce("file_chunk_number", F.lit(0)).alias("buf"), F.explode(F.split(F.coalesce("keywords", F.lit("")), ",")).alias("tag"))
    tags = tags.withColumn("tag", F.lower(F.trim("tag")))
    first = tags.where("tag <> ''").groupBy("document_id", "tag").agg(F.min("buf").alias("buf")).groupBy("document_id", "buf").agg(F.count(F.lit(1)).alias("new_tags"))
    every = tags.select("document_id", "buf").distinct().join(first, ["document_id", "buf"], "left").withColumn("new_tags", F.coalesce("new_tags", F.lit(0)).cast("bigint"))
    w = Window.partitionBy("document_id").orderBy("buf").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("known_before", F.coalesce(F.sum("new_tags").over(w), F.lit(0)).cast("bigint"))


def _batches(spark, d):
    n = F.floor(F.col("number") / jobs.BATCH_CHUNKS).cast("bigint")
    return lexical_input(spark, d).groupBy("doc", n.alias("batch")).agg(F.min("number").cast("bigint").alias("first_no"), F.max("number").cast("bigint").alias("last_no"), F.count(F.lit(1)).alias("n"))


def checkpoint_antijoin(spark, d):
    """Enrichment batches that are still to do: those of documents that aren't processed."""
    done = uploads(spark, d).where("status = 'PROCESSED'").select(F.col("id").alias("doc"))
    every = _batches(spark, d)
    stored = every.join(done, "doc", "left_semi").select("doc", "first_no", "last_no")
    return every.join(stored, ["doc", "first_no", "last_no"], "left_anti").select("doc", "batch", "first_no", "last_no", "n")


def ingest_scatter_gather(spark, d):
    """Four enrichments of every chunk, computed apart and gathered: dense vector, sparse terms, entities and tags."""
    from quern.functions.lexicon import content_words

    chunks = lexical_input(spark, d)
    sparse = chunks.select("chunk", F.size(F.array_distinct(content_words(F.col("text")))).cast("bigint").alias("terms"))
    dense = dense_vectors(spark, d).select(F.col("key").alias("chunk"), F.lit(True).alias("dense"))
    ents = lexical.entities(chunks).groupBy("chunk").agg(F.count(F.lit(1)).alias("entities"))
    tags = chunks.select("chunk", F.size(models.model("tags")(F.col("text"))).cast("bigint").alias("tags"))
    joined = chunks.select("chunk").join(sparse, "chunk").join(dense, "chunk", "left").join(ents, "chunk", "left").join(tags, "chunk")
    return joined.select("chunk", "terms", F.coalesce("dense", F.lit(False)).alias("dense"), F.coalesce("entities", F.lit(0)).cast("bigint").alias("entities"), "tags")


def local_embeddings(spark, d):
    """The local embedder over every segment's topic: its length and where its first component lies."""
    s = segments(spark, d).where("topic_summary is not null").select("segment_id", models.model("dense")(F.col("topic_summary")).alias("v"))
    return s.select("segment_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (stream_resume_buffers, stream_status_counts, event_sessions, status_latest, dead_letter, webhook_fanout, tag_pool_running, checkpoint_antijoin, ingest_scatter_gather, local_embeddings)
}

ORACLE: dict[str, str] = {
    "stream_resume_buffers": "WITH r AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS buffer FROM events WHERE user_id IS NOT NULL) SELECT user_id, buffer, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY ALL",
    "stream_status_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "event_sessions": """
    WITH m AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS o FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM k GROUP BY user_id, s""",
    "status_latest": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1",
    "dead_letter": "SELECT user_id, count(*) AS attempts, CASE WHEN count(*) > 3 THEN 'dead' ELSE 'retry' END AS route FROM events WHERE event_type = 'error' GROUP BY 1",
    "webhook_fanout": f"SELECT u.id, upper(status) AS event, url FROM {UP} u JOIN (SELECT project_id, unnest(['org/' || org_id, 'project/' || readable_id]) AS url FROM project_variables) h USING (project_id) WHERE upper(status) IN ('PROCESSED', 'FAILED')",
    "tag_pool_running": f"""
    WITH t AS (SELECT document_id, coalesce(file_chunk_number, 0) AS buf, lower(trim(unnest(string_split(coalesce(keywords, ''), ',')))) AS tag FROM {SEGMENTS} WHERE document_id IS NOT NULL),
    f AS (SELECT document_id, buf, count(*) AS n FROM (SELECT document_id, tag, min(buf) AS buf FROM t WHERE tag <> '' GROUP BY ALL) GROUP BY ALL),
    e AS (SELECT document_id, buf, coalesce(n, 0) AS new_tags FROM (SELECT DISTINCT document_id, buf FROM t) LEFT JOIN f USING (document_id, buf))
    SELECT *, coalesce(sum(new_tags) OVER (PARTITION BY document_id ORDER BY buf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS known_before FROM e""",
    "checkpoint_antijoin": f"WITH {SC} SELECT doc, (number // 30)::BIGINT AS batch, min(number)::BIGINT AS first_no, max(number)::BIGINT AS last_no, count(*) AS n FROM sc WHERE doc NOT IN (SELECT id FROM {UP} WHERE status = 'PROCESSED') GROUP BY ALL",
    "ingest_scatter_gather": f"""
    WITH {SC}, {_DENSE}, {_ENT} SELECT sc.chunk, len(list_distinct({_words('[a-z]{4,}')})) AS terms, key IS NOT NULL AS dense, coalesce(n, 0) AS entities, least(2, len(list_distinct({_words('[a-z]{8,}')}))) AS tags
    FROM sc LEFT JOIN dense ON key = sc.chunk LEFT JOIN (SELECT chunk, count(*) AS n FROM ent GROUP BY 1) e ON e.chunk = sc.chunk""",
}
