"""The property graph in tables: nodes (id, type, value, frequency), label edges (chunk, node, type, weight, frequency) and chunk edges
(src, dst, type, label, weight). Writes are merges, reads are joins of fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.names import acronym_id, node_id

# Weights of sequential, reference and acronym edges, and the hints that name no place.
SEQUENTIAL, REFERENCE_ONE, REFERENCE_VAGUE, REFERENCE_MANY, DEFINED, USED = 1.0, 1.0, 0.6, 0.7, 1.0, 0.9
VAGUE = ("previous", "above", "before", "earlier")
NEW_TAGS = 2
#: Chunks in one row of a lane's mapping.
PAGE_CHUNKS = 1000


def semantic_nodes(maps: DataFrame) -> DataFrame:
    """(node_id, type, value, frequency): one node per value and type; its frequency is the number of chunks it was found in."""
    key = F.when(F.col("type") == "acronym", acronym_id(F.col("label"))).otherwise(node_id(F.col("label")))
    return maps.groupBy("type", key.alias("node_id")).agg(F.min("label").alias("value"), F.count(F.lit(1)).alias("frequency"))


def semantic_edges(maps: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(chunk, node_id, type, weight, frequency); with ``chunks``, only for chunks that exist there."""
    key = F.when(F.col("type") == "acronym", acronym_id(F.col("label"))).otherwise(node_id(F.col("label")))
    edges = maps.groupBy("chunk", key.alias("node_id"), "type").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("frequency"))
    return edges if chunks is None else edges.join(chunks.select("chunk").distinct(), "chunk", "left_semi")


def acronym_edges(usage: DataFrame) -> DataFrame:
    """(chunk, node_id, weight) from definitions and uses."""
    rows = usage.select(acronym_id(F.col("short")).alias("node_id"), F.explode(F.array(F.struct(F.col("defined_in").alias("chunk"), F.lit(DEFINED).alias("weight")), F.struct(F.col("used_in").alias("chunk"), F.lit(USED).alias("weight")))).alias("e"))
    return rows.select("node_id", F.col("e.chunk").alias("chunk"), F.col("e.weight").alias("weight")).distinct()


def sequential_edges(chunks: DataFrame, batch_scoped: bool = False) -> DataFrame:
    """(src, dst, type, weight): NEXT and PREV between successive chunk numbers of a document, or of one input buffer only."""
    keys = ["doc", "buf"] if batch_scoped else ["doc"]
    a = chunks.select(*keys, F.col("number").alias("n"), F.col("chunk").alias("src"))
    b = chunks.select(*keys, (F.col("number") - 1).alias("n"), F.col("chunk").alias("dst"))
    pairs = a.join(b, [*keys, "n"])
    both = F.array(F.struct("src", "dst", F.lit("NEXT").alias("type")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("PREV").alias("type")))
    return pairs.select(F.explode(both).alias("e")).select("e.*", F.lit(SEQUENTIAL).alias("weight"))


def reference_edges(chunks: DataFrame, hints: DataFrame) -> DataFrame:
    """(src, dst, label, weight): a vague hint refers to the chunk before; any other to the chunks of the same buffer that contain it.

    ``hints`` has chunk and hint. Chunks meet only within their buffer, which is bounded."""
    own = chunks.join(hints, "chunk").select("doc", "buf", F.col("chunk").alias("src"), F.col("number").alias("n"), F.lower("hint").alias("hint"))
    vague = F.col("hint").isin(*VAGUE)
    before = own.where(vague).join(chunks.select("doc", (F.col("number") + 1).alias("n"), F.col("chunk").alias("dst")), ["doc", "n"]).select("src", "dst", F.lit("previous").alias("label"))
    texts = chunks.select("doc", "buf", F.col("chunk").alias("dst"), F.lower("text").alias("t"))
    named = own.where(~vague & (F.trim("hint") != "")).join(texts, ["doc", "buf"]).where(F.contains("t", "hint") & (F.col("src") != F.col("dst"))).select("src", "dst", F.col("hint").alias("label"))
    every = before.unionByName(named).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("src"))
    weight = F.when(F.col("label") == "previous", REFERENCE_VAGUE).when(n == 1, REFERENCE_ONE).otherwise(REFERENCE_MANY)
    return every.withColumn("weight", weight)


def clean_tag(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def tag_map(responses: DataFrame, pool: DataFrame) -> DataFrame:
    """(tag, chunk, confidence) of tag responses (chunk, new_tags, similar array<struct<tag,confidence>>): at most two new tags at 1,
    similar ones only if the pool has them, clamped to 0..1; of several the greatest confidence."""
    new = responses.select("chunk", F.explode(F.slice(F.filter(F.transform("new_tags", clean_tag), lambda t: t != ""), 1, NEW_TAGS)).alias("tag"), F.lit(1.0).alias("confidence"))
    similar = responses.select("chunk", F.explode("similar").alias("s")).select("chunk", clean_tag(F.col("s.tag")).alias("tag"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s.confidence"))), 2).alias("confidence"))
    known = similar.join(pool.select(clean_tag(F.col("tag")).alias("tag")).distinct(), "tag", "left_semi")
    return new.unionByName(known.select("chunk", "tag", "confidence")).groupBy("tag", "chunk").agg(F.max("confidence").alias("confidence"))


def upsert_children(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children whose parent exists; others aren't written."""
    return children.join(parents.select(F.col("id").alias(parent)).distinct(), parent, "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk nodes and their edges without those of ``gone`` (chunk)."""
    g = gone.select("chunk").distinct()
    kept = edges.join(g.withColumnRenamed("chunk", "src"), "src", "left_anti").join(g.withColumnRenamed("chunk", "dst"), "dst", "left_anti")
    return nodes.join(g, "chunk", "left_anti"), kept


def expand_neighbours(scores: DataFrame, sequence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, score, number, prev_chunk, next_chunk) of scored chunks; a chunk without a neighbour has null there."""
    side = lambda kind, name: sequence.where(F.col("type") == kind).select(F.col("src").alias("chunk"), F.col("dst").alias(name))
    held = scores.join(chunks.select("chunk", "doc", "number"), "chunk")
    return held.join(side("PREV", "prev_chunk"), "chunk", "left").join(side("NEXT", "next_chunk"), "chunk", "left")


def expand_similar(scores: DataFrame, similar: DataFrame, least: float) -> DataFrame:
    """(chunk, score, similar array<struct<weight, chunk>>), strongest first; empty where there is none."""
    strong = similar.where(F.col("weight") >= least).select(F.col("src").alias("chunk"), F.struct((-F.col("weight")).alias("w"), F.col("dst").alias("c")).alias("s"))
    lists = strong.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.struct((-x["w"]).alias("weight"), x["c"].alias("chunk"))).alias("similar"))
    empty = F.array().cast("array<struct<weight:double,chunk:string>>")
    return scores.join(lists, "chunk", "left").withColumn("similar", F.coalesce("similar", empty))


def chunks_by_node(edges: DataFrame, node: str, kind: str) -> DataFrame:
    return edges.where((F.col("type") == kind) & (F.col("node_id") == node)).select("chunk")


def list_nodes(nodes: DataFrame, kind: str, needle: str = "") -> DataFrame:
    """Nodes of a type whose value contains the needle, for paging by frequency, then value."""
    return nodes.where((F.col("type") == kind) & F.contains(F.lower("value"), F.lit(needle.lower())))


def tag_nodes(tags: DataFrame) -> DataFrame:
    """Tag nodes (type, node_id, value, frequency) of distinct (chunk, label) rows."""
    return tags.groupBy(F.col("label").alias("value")).agg(F.count(F.lit(1)).alias("frequency")).select(F.lit("tag").alias("type"), F.md5(F.col("value").cast("binary")).alias("node_id"), "value", "frequency")


def tag_edges(tags: DataFrame) -> DataFrame:
    """Edges (type, node_id, chunk) from chunks to their tags."""
    return tags.select(F.lit("tag").alias("type"), F.md5(F.col("label").cast("binary")).alias("node_id"), "chunk")


def lane_mapping(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(node_id, value, frequency, page bigint, chunks array<struct<chunk, weight, frequency>>): every node of a lane with its chunks, in as many
    pages of about PAGE_CHUNKS chunks as they fill, so that a node which a third of all chunks have isn't gathered in one row."""
    mine = edges.where(F.col("type") == kind)
    sizes = mine.groupBy("node_id").agg(F.sum("frequency").alias("frequency"), F.ceil(F.count(F.lit(1)) / PAGE_CHUNKS).alias("pages"))
    paged = mine.join(sizes.select("node_id", "pages"), "node_id").withColumn("page", F.pmod(F.xxhash64("chunk"), F.col("pages")).cast("bigint"))
    lists = paged.groupBy("node_id", "page").agg(F.array_sort(F.collect_list(F.struct("chunk", "weight", "frequency"))).alias("chunks"))
    return nodes.where(F.col("type") == kind).select("node_id", "value").join(sizes.select("node_id", "frequency"), "node_id").join(lists, "node_id")


def duplicate_ids(nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Violations of uniqueness: ids that occur more than once per type."""
    return nodes.groupBy("type", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
