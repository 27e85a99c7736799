"""Retrieval plans: hybrid search, gates, expansion over the graph, fusion of sources and assembly of context.

All plans are lazy compositions. What follows the first top-k is bounded by k, so windows without partitions below see at most a few
hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import models

# Gates, limits and labels of the plans.
POINT_GATE, LANE_GATE, LANE_COUNT, LANE_CHUNKS, EXPERT_CHUNKS, SIMILAR_GATE, TOP_K = 0.45, 0.70, 3, 5, 5, 0.80, 10
HIGH, MEDIUM = 0.8, 0.5


def effective_k(top_k: int | None) -> int:
    return top_k if top_k else TOP_K


def gate(points: DataFrame, least: float = POINT_GATE, keep_max: bool = True) -> DataFrame:
    """(key, score) of points that pass; the greatest score per key."""
    passed = points.where(F.col("key").isNotNull() & (F.col("score") >= least))
    return passed.groupBy("key").agg(F.max("score").alias("score")) if keep_max else passed.select("key", "score")


def min_max(scores: DataFrame, by: str = "source") -> DataFrame:
    """Scores of each source mapped to 0..1; 1 where all are equal."""
    ranges = scores.groupBy(F.col(by).alias("__by")).agg(F.min("score").alias("__low"), F.max("score").alias("__high"))  # one row per source
    low, high = F.col("__low"), F.col("__high")
    ranged = scores.join(ranges, F.col(by).eqNullSafe(F.col("__by")))
    return ranged.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)).drop("__by", "__low", "__high")


def fuse_sources(scores: DataFrame, k: int = EXPERT_CHUNKS) -> DataFrame:
    """(key, sources, total): chunks by how many sources have them, then by the sum of their normalised scores, then by key."""
    return min_max(scores).groupBy("key").agg(F.count(F.lit(1)).alias("sources"), F.round(F.sum("score"), 6).alias("total")).orderBy(F.desc("sources"), F.desc("total"), "key").limit(k)


def lane_chunk_scores(nodes: DataFrame, edges: DataFrame, query: str, k: int | None = LANE_CHUNKS) -> DataFrame:
    """(key, score): for every node that shares words with the query, similarity times edge weight; the best per chunk over all lanes.

    Nodes meet the query's words by an equi-join. ``nodes`` has node_id, type, value; edges below the lane gate don't count."""
    from quern.functions.lexicon import content_words

    spark = nodes.sparkSession
    asked = spark.range(1).select(F.explode(F.array_distinct(content_words(F.lit(query)))).alias("word"))
    words = nodes.select("node_id", "type", F.array_distinct(F.split("value", r"[\s_-]+")).alias("w"))
    n_query = spark.range(1).select(F.size(F.array_distinct(content_words(F.lit(query)))).alias("nq"))
    hits = words.select("node_id", "type", F.size("w").alias("nw"), F.explode("w").alias("word")).join(F.broadcast(asked), "word").groupBy("node_id", "type", "nw").agg(F.count(F.lit(1)).alias("hit"))
    sim = hits.crossJoin(F.broadcast(n_query)).withColumn("sim", F.col("hit") / F.sqrt(F.col("nw") * F.col("nq")))
    strong = edges.where(F.col("weight") >= LANE_GATE)
    scored = sim.join(strong, ["node_id", "type"]).select(F.col("chunk").alias("key"), (F.col("sim") * F.col("weight")).alias("score")).groupBy("key").agg(F.round(F.max("score"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k) if k else scored


def rerank(rows: DataFrame, query: str, text: str, k: int, model: str | None = "local") -> DataFrame:
    """The k rows that the reranker likes best, with its score; without a reranker the rows in order of their own score."""
    if model is None:
        return rows.withColumn("rerank_score", F.col("score")).orderBy(F.desc("score"), "key").limit(k)
    return rows.withColumn("rerank_score", F.round(models.model("rerank", model)(F.lit(query), F.col(text)), 6)).orderBy(F.desc("rerank_score"), F.desc("score"), "key").limit(k)


def drop_neighbours(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows (key, prev_chunk, next_chunk, ...) in order, without those already shown as, or beside, an earlier kept row.

    Sequential by nature; it runs on the at most few hundred rows behind a top-k, in one fold over an array."""
    cols = rows.columns
    listed = rows.withColumn("__n", F.row_number().over(Window.orderBy(*order))).agg(F.array_sort(F.collect_list(F.struct("__n", *cols))).alias("rows"))
    kind = listed.schema["rows"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast("array<string>").alias("seen"))
    fold = F.aggregate(
        "rows",
        start,
        lambda acc, r: F.when(F.array_contains(acc["seen"], r["key"]), acc).otherwise(F.struct(F.concat(acc["kept"], F.array(r)).alias("kept"), F.concat(acc["seen"], F.filter(F.array(r["key"], r["prev_chunk"], r["next_chunk"]), lambda x: x.isNotNull())).alias("seen"))),
        lambda acc: acc["kept"],
    )
    return listed.select(F.explode(fold).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in cols])


def relevance(score: Column) -> Column:
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")


def quick_context(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, score, context): each chunk with its neighbours' texts, except neighbours that are themselves results."""
    mains = rows.select(F.col("key").alias("__m"))
    own = chunks.select(F.col("chunk").alias("key"), F.col("text").alias("own"))
    side = lambda col, out: rows.select("key", F.col(col).alias("chunk")).join(mains, F.col("chunk") == F.col("__m"), "left_anti").join(chunks.select("chunk", F.col("text").alias(out)), "chunk").select("key", out)
    joined = rows.select("key", "score").join(own, "key").join(side("prev_chunk", "before"), "key", "left").join(side("next_chunk", "after"), "key", "left")
    return joined.select("key", "score", F.concat_ws("\n", F.concat(F.lit("["), relevance(F.col("score")), F.lit("]")), "before", "own", "after").alias("context"))


def context_islands(parts: DataFrame) -> DataFrame:
    """(doc, first, last, n, text): numbered texts merged into runs of consecutive numbers.

    ``parts`` has doc, number, text and priority; of several texts of one number the one of least priority counts."""
    w = Window.partitionBy("doc", "number").orderBy("priority", "text")
    once = parts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    island = F.col("number") - F.row_number().over(Window.partitionBy("doc").orderBy("number"))
    rows = F.array_sort(F.collect_list(F.struct("number", "text")))
    return once.withColumn("island", island).groupBy("doc", "island").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text")).drop("island")


def merge_metadata(rows: DataFrame) -> DataFrame:
    """(key, sources, score): one row per chunk with all tools that found it and its first score; ``rows`` has key, source, ord, score."""
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.min_by("score", F.struct("ord", "source")).alias("score"))


def answer(query: str, context: DataFrame, column: str, model: str = "local", default: str = "No answer could be found.") -> DataFrame:
    """(answer) from the assembled context; the default where the model gives none."""
    said = models.model("answer", model)(F.lit(query), F.col(column))
    return context.select(F.coalesce(F.nullif(F.trim(said), F.lit("")), F.lit(default)).alias("answer"))
