"""Lexical engine: entities, concepts, weighted keywords, phrases and acronyms of chunks, and the edges between chunks that
share them.

The engine works within a *scope*, the input buffer (``doc``, ``buf``) that a chunk came in: bounded, so pairs of chunks that share a
label stay few however large a document grows. Inputs are chunks (doc, buf, chunk, text); every plan is a composition of
built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.lexicon import FOREIGN_JAVA, TECHNICAL, content_words, not_stop

SCOPE = ["doc", "buf"]
# Thresholds and weights of the engine.
LEAST_CHUNKS, MAX_SHARE_DF, MAX_TERMS, LEAST_SCORE, NOISE_ROWS = 2, 0.4, 500, 0.05, 15
PHRASE_WORDS, PHRASE_CHUNKS = 4, 3
WEIGHTS = {"entity": 1.0, "concept": 0.75, "phrase": 0.85}
ACRONYM_WEIGHT = 0.9
TYPE_RANK = {"entity": 0, "concept": 1, "keyword": 2, "phrase": 3, "acronym": 4}
ENTITY_RUN = r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b"
DEFINITION = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\(([A-Z]{2,6})\)"
CHUNKS_PER_BUFFER, MAX_BUFFER = 50, 1000


def scoped(chunks: DataFrame) -> DataFrame:
    """Chunks with their scope. A chunk without a buffer number falls into one of fifty successive chunk numbers; a buffer that spans more
    than MAX_BUFFER chunk numbers is divided at their multiples, so that no scope grows with its document."""
    number = F.coalesce("chunk_number", F.lit(0))
    buf = F.coalesce(F.col("file_chunk_number").cast("bigint") + F.floor(number / MAX_BUFFER) * F.lit(1 << 32), -1 - F.floor(F.coalesce("chunk_number", F.lit(0)) / CHUNKS_PER_BUFFER))
    return chunks.where("document_id is not null").select(F.col("document_id").alias("doc"), buf.alias("buf"), F.col("chunk_id").alias("chunk"), F.col("chunk_number").alias("number"), F.coalesce("text", F.lit("")).alias("text"))


def _shared(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Labels (scope, label, chunk) that at least two chunks, and at most ``most``, of their scope have."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*SCOPE, "label"))
    counted = labels.withColumn("__n", n).where(F.col("__n") >= LEAST_CHUNKS)
    return (counted.where(F.col("__n") <= most) if most else counted).drop("__n")


def entities(chunks: DataFrame) -> DataFrame:
    """(scope, label, chunk): runs of capitalised words, lower-cased."""
    plain = F.regexp_replace("text", FOREIGN_JAVA, "#")
    found = chunks.select(*SCOPE, "chunk", "text").repartition(*SCOPE).select(*SCOPE, "chunk", F.explode(F.regexp_extract_all(plain, F.lit(ENTITY_RUN), F.lit(0))).alias("label"))
    return found.withColumn("label", F.lower("label")).where(not_stop(F.col("label")) & (F.length("label") >= 4)).select(*SCOPE, "label", "chunk").distinct()


def concepts(chunks: DataFrame) -> DataFrame:
    """(scope, label, chunk): pairs of successive technical nouns."""
    nouns = F.filter(content_words(F.col("text")), lambda w: w.rlike(f"^[a-z]{{4,}}(?:{TECHNICAL})$"))
    held = chunks.select(*SCOPE, "chunk", "text").repartition(*SCOPE).select(*SCOPE, "chunk", nouns.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    return held.select(*SCOPE, F.explode(F.array_distinct(pairs)).alias("label"), "chunk")


def phrases(chunks: DataFrame) -> DataFrame:
    """(scope, label, chunk): runs of four content words that two or three chunks share."""
    words = content_words(F.col("text"), r"^[a-z][\p{L}\p{N}_]+$")
    held = chunks.select(*SCOPE, "chunk", "text").repartition(*SCOPE).select(*SCOPE, "chunk", words.alias("w")).where(F.size("w") >= PHRASE_WORDS)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - PHRASE_WORDS + 1), lambda i: F.array_join(F.slice("w", i, PHRASE_WORDS), " "))
    return _shared(held.select(*SCOPE, F.explode(F.array_distinct(grams)).alias("label"), "chunk"), PHRASE_CHUNKS)


def _terms(chunks: DataFrame) -> DataFrame:
    """(scope, chunk, label, tf, n, df, total, kept): term counts per chunk with the scope's chunks, the term's chunks and count there, and
    whether it is in the scope's vocabulary: neither too rare nor too common, and among the 500 most frequent (ties in order).

    Chunks are hashed by scope once; every count, rank and norm below is over keys that contain the scope, so nothing moves again."""
    held = chunks.select(*SCOPE, "chunk", "text").repartition(*SCOPE).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*SCOPE)))
    counts = held.select(*SCOPE, "chunk", "n", F.explode(content_words(F.col("text"))).alias("label")).groupBy(*SCOPE, "chunk", "label").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"))
    own = Window.partitionBy(*SCOPE, "label")
    seen = counts.withColumns({"df": F.count(F.lit(1)).over(own), "total": F.sum("tf").over(own)})
    fit = (F.col("n") * MAX_SHARE_DF >= LEAST_CHUNKS) & (F.col("df") >= LEAST_CHUNKS) & (F.col("df") <= F.col("n") * MAX_SHARE_DF)
    rank = F.dense_rank().over(Window.partitionBy(*SCOPE).orderBy(F.desc("fit"), F.desc("total"), "label"))
    return seen.withColumn("fit", fit).withColumn("kept", F.col("fit") & (rank <= MAX_TERMS)).drop("fit")


def keywords(chunks: DataFrame) -> DataFrame:
    """(scope, label, chunk, weight): terms by sublinear tf and smooth idf, normalised per chunk over the vocabulary."""
    weighed = _terms(chunks).where("kept").withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*SCOPE, "chunk")))
    scored = weighed.withColumn("weight", F.col("x") / norm).where(F.col("weight") >= LEAST_SCORE).select(*SCOPE, "label", "chunk", "weight")
    return _shared(scored)


def noise_words(chunks: DataFrame) -> DataFrame:
    """(scope, rank, word): the first words in order that the vocabulary leaves out."""
    out = _terms(chunks).where("not kept").select(*SCOPE, "label").distinct()
    rank = F.row_number().over(Window.partitionBy(*SCOPE).orderBy("label"))
    return out.withColumn("rank", rank).where(F.col("rank") <= NOISE_ROWS).select(*SCOPE, "rank", F.col("label").alias("word"))


def acronyms(chunks: DataFrame) -> DataFrame:
    """(scope, short, expansion, defined_in): the last definition of each acronym."""
    plain = F.regexp_replace("text", FOREIGN_JAVA, "#")
    both = F.arrays_zip(F.regexp_extract_all(plain, F.lit(DEFINITION), F.lit(2)).alias("short"), F.regexp_extract_all(plain, F.lit(DEFINITION), F.lit(1)).alias("full"))
    found = chunks.select(*SCOPE, "chunk", "number", F.posexplode(both).alias("pos", "d"))
    last = found.groupBy(*SCOPE, F.col("d.short").alias("short")).agg(F.max(F.struct("number", "chunk", "pos", F.col("d.full").alias("full"))).alias("m"))
    return last.select(*SCOPE, "short", F.trim("m.full").alias("expansion"), F.col("m.chunk").alias("defined_in"))


def acronym_usage(chunks: DataFrame) -> DataFrame:
    """(scope, short, defined_in, used_in): other chunks of the scope in which the acronym stands as a word; an equi-join on words."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Z]{2,6}$")))
    held = chunks.select(*SCOPE, F.col("chunk").alias("used_in"), F.explode(words).alias("short"))
    return acronyms(chunks).join(held, [*SCOPE, "short"]).where("used_in <> defined_in").select(*SCOPE, "short", "defined_in", "used_in")


def bridges(chunks: DataFrame) -> DataFrame:
    """(scope, type, label, chunk, weight) of all labels that link chunks."""
    out = None
    for kind, rows in (("entity", _shared(entities(chunks))), ("concept", _shared(concepts(chunks))), ("phrase", phrases(chunks))):
        part = rows.select(*SCOPE, F.lit(kind).alias("type"), "label", "chunk", F.lit(WEIGHTS[kind]).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(keywords(chunks).select(*SCOPE, F.lit("keyword").alias("type"), "label", "chunk", "weight"))


def bridge_edges(chunks: DataFrame) -> DataFrame:
    """(scope, src, dst, type, label, weight): every pair of chunks of a scope that share a label, the smaller id first, weighted by
    the geometric mean; and from each acronym's definition to its uses."""
    # the chunks of a label lie within one input buffer, so a label's list is short; one pass over it makes the pairs
    lists = bridges(chunks).groupBy(*SCOPE, "type", "label").agg(F.array_sort(F.collect_list(F.struct("chunk", "weight"))).alias("c"))
    pair = lambda x, y: F.struct(x["chunk"].alias("src"), y["chunk"].alias("dst"), F.round(F.sqrt(x["weight"] * y["weight"]), 4).alias("weight"))
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: pair(x, y))))
    edges = lists.select(*SCOPE, "type", "label", F.explode(pairs).alias("e")).select(*SCOPE, "e.src", "e.dst", "type", "label", "e.weight")
    uses = acronym_usage(chunks).select(*SCOPE, F.col("defined_in").alias("src"), F.col("used_in").alias("dst"), F.lit("acronym").alias("type"), F.col("short").alias("label"), F.lit(ACRONYM_WEIGHT).alias("weight"))
    return edges.unionByName(uses)


def strongest_edges(edges: DataFrame) -> DataFrame:
    """The strongest edge of each unordered pair; of equal ones by type, then label."""
    rank = F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[F.col("type")]
    w = Window.partitionBy(*SCOPE, F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.desc("weight"), rank, "label")
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def node_maps(edges: DataFrame) -> DataFrame:
    """(type, label, chunk, weight): the labels that edges leave at their chunks, each with its greatest weight."""
    ends = edges.select("type", "label", F.explode(F.array("src", "dst")).alias("chunk"), "weight")
    return ends.groupBy("type", "label", "chunk").agg(F.max("weight").alias("weight"))
