"""Dense and sparse vectors: points, cosine and dot scores, top-k, rank fusion and similarity within documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Saturation of the local sparse model, fusion constant and first rank, similarity edges.
K1 = 1.2
FUSION_K, FIRST_RANK = 2, 0
SIMILAR_K, SIMILAR_LEAST = 3, 0.75
POOL_BLOCK = 2048
# Collections by provider and dimension.
DIMENSIONS = (1024, 1536, 2048, 3072)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is all zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def is_usable(v: Column, dim: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, v array<double>) per key; of several usable vectors the greatest."""
    return df.where(F.col(key).isNotNull() & is_usable(F.col(vector), dim)).groupBy(F.col(key).alias("key")).agg(F.max(F.transform(vector, lambda x: x.cast("double"))).alias("v"))


def sparse_weights(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, weight): saturated term frequencies."""
    counts = df.select(F.col(key).alias("key"), F.explode(words).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.select("key", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1)).alias("weight"))


def collection_of(provider: Column, dimension: Column) -> Column:
    """Name of the collection that holds a model's vectors; null for a dimension that none has."""
    return F.when(dimension.isin(*DIMENSIONS), F.concat_ws("_", F.lower(provider), dimension.cast("string")))


def build_points(chunks: DataFrame, dense: DataFrame, sparse: DataFrame, strict: bool = False) -> DataFrame:
    """Chunks with their dense vector and sparse terms (chunk, v, n_terms). Chunks without one of them are kept with null, or left out
    if ``strict``."""
    terms = sparse.groupBy(F.col("key").alias("chunk")).agg(F.count(F.lit(1)).alias("n_terms"))
    how = "inner" if strict else "left"
    return chunks.join(dense.withColumnRenamed("key", "chunk"), "chunk", how).join(terms, "chunk", how)


def dense_top(points: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(key, score): the k points of greatest cosine to the one query row (v); ties by key. With a column ``query``, a unique id, every
    row of ``query`` is asked: (query, key, score)."""
    if "query" in query.columns:
        return _dense_top_each(points, query, k)
    asked = query.agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("q")).where("n > 0")
    one = F.broadcast(asked.select(F.when(F.col("n") == 1, F.col("q")).otherwise(F.raise_error(F.lit("several queries need a query id"))).alias("q")))  # a single row
    return points.crossJoin(one).select("key", F.round(cosine(F.col("v"), F.col("q")), 9).alias("score")).orderBy(F.desc("score"), "key").limit(k)


def _dense_top_each(points: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Queries and points are divided into blocks that meet as matrices: a task holds two blocks, and only the best k of each query and
    block leave it, whatever the number of either."""
    blocks = lambda df, name: F.broadcast(df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / POOL_BLOCK)).cast("int").alias(name)))
    n = blocks(query, "qn").crossJoin(blocks(points, "bn"))  # a single row
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    mine = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    double = F.col("v").cast("array<double>")
    key_type, query_type = points.schema["key"].dataType, query.schema["query"].dataType
    no_key, no_query = F.lit(None).cast(key_type), F.lit(None).cast(query_type)
    ask = query.crossJoin(n).select(mine("query", "qn").alias("qb"), every("bn").alias("bb"), "query", no_key.alias("key"), double.alias("v"), F.lit(True).alias("ask"))
    base = points.crossJoin(n).select(every("qn").alias("qb"), mine("key", "bn").alias("bb"), no_query.alias("query"), "key", double.alias("v"), F.lit(False).alias("ask"))

    def best(group: pa.Table) -> pa.Table:
        asks = group.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        queries = np.array(group.column("query").to_pylist(), dtype=object)[asks]
        keys = np.array(group.column("key").to_pylist(), dtype=object)[~asks]
        cols: list[list] = [[], [], []]
        if len(queries) and len(keys):
            m = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(group.num_rows, -1)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            order = np.argsort(keys, kind="stable")
            sims = np.round(m[asks] @ m[~asks][order].T, 9)
            for q, s in zip(queries, sims, strict=True):
                top = np.argsort(-s, kind="stable")[:k]
                cols[0] += [q] * len(top)
                cols[1] += keys[order[top]].tolist()
                cols[2] += s[top].tolist()
        types = (group.schema.field("query").type, group.schema.field("key").type, pa.float64())
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["query", "key", "score"])

    near = ask.unionByName(base).groupBy("qb", "bb").applyInArrow(best, f"query {query_type.simpleString()}, key {key_type.simpleString()}, score double")
    return _first_of_each(near, k)


def _first_of_each(scores: DataFrame, k: int) -> DataFrame:
    """The k rows (query, key, score) of greatest score of every query; ties by key."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return scores.withColumn("r", rank).where(F.col("r") <= k).select("query", "key", "score")


def sparse_dot(points: DataFrame, query: DataFrame) -> DataFrame:
    """(key, score): sums over shared terms; ``query`` has term and weight. With a column ``query`` in it: (query, key, score)."""
    by = ["query"] if "query" in query.columns else []
    q = query.groupBy(*by, "term").agg(F.sum("weight").alias("qw"))
    return points.join(q, "term").groupBy(*by, "key").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("score"))


def sparse_top(points: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(key, score): the k keys of greatest ``sparse_dot``; with a column ``query`` those of every query: (query, key, score)."""
    return _sparse_top_each(points, query, k) if "query" in query.columns else sparse_dot(points, query).orderBy(F.desc("score"), "key").limit(k)


def _sparse_top_each(points: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """As for dense vectors: pairs that share a term never leave the task that holds their two blocks."""
    blocks = lambda df, name, key: F.broadcast(df.agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct(key) / POOL_BLOCK)).cast("int").alias(name)))
    n = blocks(query, "qn", "query").crossJoin(blocks(points, "bn", "key"))  # a single row
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    mine = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    key_type, query_type = points.schema["key"].dataType, query.schema["query"].dataType
    weight = F.col("weight").cast("double").alias("weight")
    ask = query.crossJoin(n).select(mine("query", "qn").alias("qb"), every("bn").alias("bb"), "query", F.lit(None).cast(key_type).alias("key"), "term", weight, F.lit(True).alias("ask"))
    base = points.crossJoin(n).select(every("qn").alias("qb"), mine("key", "bn").alias("bb"), F.lit(None).cast(query_type).alias("query"), "key", "term", weight, F.lit(False).alias("ask"))

    def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
        """Every value's rank among the distinct ones, and these in order."""
        found = column.combine_chunks().dictionary_encode()
        values = np.array(found.dictionary.to_pylist(), dtype=object)
        order = np.argsort(values, kind="stable")
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        return rank[found.indices.to_numpy(zero_copy_only=False)], values[order].tolist()

    def summed(term: np.ndarray, who: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights by term and row, in order of terms."""
        pairs, where = np.unique(term * width + who, return_inverse=True)
        return pairs // width, pairs % width, np.bincount(where, w, len(pairs))

    def best(group: pa.Table) -> pa.Table:
        group = group.filter(group.column("term").is_valid())
        asks, held = group.filter(group.column("ask")), group.filter(pa.compute.invert(group.column("ask")))
        cols: list[list] = [[], [], []]
        if len(asks) and len(held):
            term, _ = coded(pa.chunked_array([*asks.column("term").chunks, *held.column("term").chunks]))
            (qi, queries), (ki, keys) = coded(asks.column("query")), coded(held.column("key"))
            qt, qi, qw = summed(term[: len(asks)], qi, asks.column("weight").to_numpy(), len(queries))
            kt, ki, kw = summed(term[len(asks) :], ki, held.column("weight").to_numpy(), len(keys))
            scores, met = np.zeros((len(queries), len(keys))), np.zeros((len(queries), len(keys)), bool)
            shared = np.intersect1d(qt, kt)
            q0, q1, k0, k1 = (np.searchsorted(x, shared, side) for x in (qt, kt) for side in ("left", "right"))
            for a, b, c, d in zip(q0, q1, k0, k1, strict=True):
                at = np.ix_(qi[a:b], ki[c:d])
                scores[at] += np.outer(qw[a:b], kw[c:d])
                met[at] = True
            scores = np.where(met, np.round(scores, 9), -np.inf)
            for q, s, n_met in zip(queries, scores, met.sum(axis=1), strict=True):
                top = np.argsort(-s, kind="stable")[: min(k, int(n_met))]
                cols[0] += [q] * len(top)
                cols[1] += [keys[i] for i in top]
                cols[2] += s[top].tolist()
        types = (group.schema.field("query").type, group.schema.field("key").type, pa.float64())
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["query", "key", "score"])

    near = ask.unionByName(base).groupBy("qb", "bb").applyInArrow(best, f"query {query_type.simpleString()}, key {key_type.simpleString()}, score double")
    return _first_of_each(near, k)


def fuse(legs: list[DataFrame], k: int, constant: int = FUSION_K, first: int = FIRST_RANK) -> DataFrame:
    """(key, score): reciprocal rank fusion of legs (key, score) of at most k rows each; of legs (query, key, score), of at most k rows
    a query, (query, key, score)."""
    by = ["query"] if all("query" in leg.columns for leg in legs) else []
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "key")  # at most k rows
    ranked = None
    for leg in legs:
        part = (_first_of_each(leg, k) if by else leg.limit(k)).select(*by, "key", (1.0 / (F.lit(constant) + F.lit(first) + F.row_number().over(w) - 1)).alias("s"))
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy(*by, "key").agg(F.round(F.sum("s"), 9).alias("score"))
    return _first_of_each(fused, k) if by else fused.orderBy(F.desc("score"), "key").limit(k)


def similar_in_document(vectors: DataFrame, k: int = SIMILAR_K, least: float = SIMILAR_LEAST) -> DataFrame:
    """(src, dst, weight): for every chunk of a document its k most similar others of that document, if at least ``least``.

    ``vectors`` has doc, key and v. A document's chunks are divided into blocks, and blocks meet as matrices: a task holds two
    blocks, and only the best k of each chunk and block leave it, whatever the document's size."""
    blocks = vectors.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / POOL_BLOCK).cast("int").alias("blocks"))
    held = vectors.join(blocks, "doc").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ask = held.select("doc", F.col("block").alias("qb"), every.alias("bb"), "key", "v", F.lit(True).alias("ask"))
    base = held.select("doc", every.alias("qb"), F.col("block").alias("bb"), "key", "v", F.lit(False).alias("ask"))

    def best(group: pa.Table) -> pa.Table:
        asks = group.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        keys = np.array(group.column("key").to_pylist(), dtype=object)
        m = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(group.num_rows, -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
        qk, bk, rows = keys[asks], keys[~asks], []
        sims = np.round(m[asks] @ m[~asks].T, 6)
        order = np.argsort(bk.astype(str), kind="stable")
        for i, q in enumerate(qk):
            s = sims[i][order]
            n = 0
            for j in np.argsort(-s, kind="stable")[: k + 1]:
                if bk[order[j]] != q and n < k:
                    rows.append((q, bk[order[j]], float(s[j])))
                    n += 1
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table({"src": pa.array(cols[0], pa.string()), "dst": pa.array(cols[1], pa.string()), "weight": pa.array(cols[2], pa.float64())})

    near = ask.unionByName(base).groupBy("doc", "qb", "bb").applyInArrow(best, "src string, dst string, weight double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return near.withColumn("r", rank).where((F.col("r") <= k) & (F.col("weight") >= least)).select("src", "dst", "weight")


def delete_points(points: DataFrame, org: str, project: str, document: str) -> DataFrame:
    """Points without those of one tenant's document; null fields never match."""
    gone = (F.col("org_id") == org) & (F.col("project_id") == project) & (F.col("document_id") == document)
    return points.where(~F.coalesce(gone, F.lit(False)))
