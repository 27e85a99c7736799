"""One object for what a service would call: retrieval, listings and graph lookups over a directory of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.lexicon import content_words
from quern.functions.names import acronym_id, node_id
from quern.operators import catalog, graph, lexical
from quern.operators import vector_search as vs
from quern.operators.latest import latest_rows
from quern.plans import retrieval
from quern.runtime import cut_lineage, table


@dataclass
class Engine:
    """Derived tables (points, graph) are written once, when first asked for, and shared by later calls."""

    spark: SparkSession
    data: str
    dim: int = 96

    @cached_property
    def chunks(self) -> DataFrame:
        cols = ["chunk_id", "org_id", "project_id", "document_id", "file_chunk_number", "chunk_number", "text"]
        return latest_rows(table(self.spark, self.data, "chunks"), ["chunk_id"], "updated_at", cols)

    @cached_property
    def scoped(self) -> DataFrame:
        return lexical.scoped(self.chunks)

    @cached_property
    def dense(self) -> DataFrame:
        return cut_lineage(vs.usable(table(self.spark, self.data, "chunk_embeddings"), "chunk_id", "embedding", self.dim))

    @cached_property
    def sparse(self) -> DataFrame:
        return cut_lineage(vs.sparse_weights(self.scoped, "chunk", content_words(F.col("text"))))

    @cached_property
    def maps(self) -> DataFrame:
        return cut_lineage(lexical.node_maps(lexical.strongest_edges(lexical.bridge_edges(self.scoped))))

    @property
    def nodes(self) -> DataFrame:
        return graph.semantic_nodes(self.maps)

    @property
    def edges(self) -> DataFrame:
        return graph.semantic_edges(self.maps)

    @cached_property
    def sequence(self) -> DataFrame:
        return cut_lineage(graph.sequential_edges(self.scoped))

    @cached_property
    def similar(self) -> DataFrame:
        docs = self.chunks.where("document_id is not null").select(F.col("chunk_id").alias("key"), F.col("document_id").alias("doc"))
        return cut_lineage(vs.similar_in_document(self.dense.join(docs, "key")))

    def _tenant(self, org: str | None, project: str | None, document: str | None) -> DataFrame:
        """Ids within the tenant: the first filter of every search."""
        rows = self.chunks
        for name, value in (("org_id", org), ("project_id", project), ("document_id", document)):
            rows = rows if value is None else rows.where(F.col(name) == value)
        return rows.select(F.col("chunk_id").alias("key"))

    def search(self, text: str, vector: list[float] | None = None, k: int | None = None, org: str | None = None, project: str | None = None, document: str | None = None) -> DataFrame:
        """(key, score): hybrid search; with no vector the words alone decide."""
        k, mine = retrieval.effective_k(k), self._tenant(org, project, document)
        terms = self.spark.range(1).select(F.explode(F.array_distinct(content_words(F.lit(text)))).alias("term"), F.lit(1.0).alias("weight"))
        legs = [vs.sparse_top(self.sparse.join(mine, "key", "left_semi"), terms, k)]
        if vector is not None:
            query = self.spark.range(1).select(F.array(*[F.lit(float(x)) for x in vector]).alias("v"))
            legs.insert(0, vs.dense_top(self.dense.join(mine, "key", "left_semi"), query, k))
        return vs.fuse(legs, k)

    def query(self, text: str, vector: list[float] | None = None, kind: str = "quick", k: int | None = None, reranker: str | None = "local", rewrite: Callable[[str], str | None] | None = None, **tenant: str | None) -> DataFrame:
        """Results of a quick, smart or expert plan: (key, score, rerank_score, number, prev_chunk, next_chunk[, similar]). ``rewrite`` expands the
        question; where it gives nothing, or fails, the question stays."""
        if not text.strip():
            raise ValueError("the query is empty")
        if kind not in ("quick", "smart", "expert"):
            raise ValueError(f"no plan named {kind}")
        if rewrite is not None:
            try:
                text = (rewrite(text) or "").strip() or text
            except Exception:  # a model that fails leaves the question as it is
                pass
        scores = retrieval.gate(self.search(text, vector, k, **tenant))
        if kind == "expert":
            mine = self._tenant(tenant.get("org"), tenant.get("project"), tenant.get("document"))
            lanes = retrieval.lane_chunk_scores(self.nodes, self.edges.join(mine.withColumnRenamed("key", "chunk"), "chunk", "left_semi"), text)
            both = scores.withColumn("source", F.lit("points")).unionByName(lanes.withColumn("source", F.lit("lexical")))
            scores = retrieval.fuse_sources(both).select("key", F.col("total").alias("score"))
        rows = graph.expand_neighbours(scores.withColumnRenamed("key", "chunk"), self.sequence, self.scoped)
        if kind != "quick":
            rows = graph.expand_similar(rows, self.similar, retrieval.SIMILAR_GATE)
        texts = self.scoped.select("chunk", "text")
        ranked = retrieval.rerank(rows.join(texts, "chunk").withColumnRenamed("chunk", "key"), text, "text", retrieval.effective_k(k), reranker)
        return retrieval.drop_neighbours(ranked.drop("text", "doc"), [F.desc("rerank_score"), F.asc("key")])

    def documents(self, limit: int = 20, number: int = 1, **filters) -> DataFrame:
        return catalog.page(catalog.list_documents(table(self.spark, self.data, "uploads"), **filters), [F.desc("created_at"), F.asc("id")], limit, number)

    def list_nodes(self, kind: str, needle: str = "", limit: int = 20, number: int = 1) -> DataFrame:
        return catalog.page(graph.list_nodes(self.nodes, kind, needle), [F.desc("frequency"), F.asc("value")], limit, number)

    def chunk_ids(self, kind: str, value: str) -> DataFrame:
        key = acronym_id(F.lit(value)) if kind == "acronym" else node_id(F.lit(value))
        return self.edges.where((F.col("type") == kind) & (F.col("node_id") == key)).select("chunk")

    def chunk_page(self, document: str | None = None, needle: str | None = None, limit: int = 20, number: int = 1) -> DataFrame:
        rows = self.chunks if document is None else self.chunks.where(F.col("document_id") == document)
        rows = rows if needle is None else rows.where(catalog.contains_ignoring_case(F.col("text"), needle))
        return catalog.page(rows, [F.asc("document_id"), F.asc("chunk_number"), F.asc("chunk_id")], limit, number)

    @cached_property
    def tags(self) -> DataFrame:
        """(chunk, label): the cleaned tags of the segments."""
        rows = latest_rows(table(self.spark, self.data, "segments"), ["segment_id"], "ingested_at", ["segment_id", "keywords"]).where("keywords is not null")
        cut = rows.select(F.col("segment_id").alias("chunk"), F.explode(F.split("keywords", ",")).alias("t"))
        return cut_lineage(cut.select("chunk", graph.clean_tag(F.col("t")).alias("label")).where("label <> ''").distinct())

    def list_tags(self, needle: str = "", limit: int = 20, number: int = 1) -> DataFrame:
        return catalog.page(graph.list_nodes(graph.tag_nodes(self.tags), "tag", needle), [F.desc("frequency"), F.asc("value")], limit, number)

    def chunks_by_tag(self, tag: str) -> DataFrame:
        return graph.tag_edges(self.tags).where(F.col("node_id") == F.md5(graph.clean_tag(F.lit(tag)).cast("binary"))).select("chunk")

    def tools(self, **tenant: str | None) -> dict[str, Callable[..., DataFrame]]:
        """What an agent may call, each a lazy plan: vector_search(query, vector, top_k), lexical_lane_search(query), get_similar_chunks(ids) and
        rerank_chunks(query, ids). An empty list of ids gives no rows."""
        mine = self._tenant(tenant.get("org"), tenant.get("project"), tenant.get("document"))

        def given(ids: list[str]) -> DataFrame:
            return self.spark.createDataFrame([(i,) for i in ids], "key string").join(mine, "key", "left_semi")

        def around(scores: DataFrame) -> DataFrame:
            return graph.expand_neighbours(scores.withColumnRenamed("key", "chunk"), self.sequence, self.scoped)

        def vector_search(query: str, vector: list[float] | None = None, top_k: int = 5) -> DataFrame:
            return around(retrieval.gate(self.search(query, vector, top_k, **tenant), 0.0))

        def lexical_lane_search(query: str) -> DataFrame:
            edges = self.edges.join(mine.withColumnRenamed("key", "chunk"), "chunk", "left_semi")
            return around(retrieval.lane_chunk_scores(self.nodes, edges, query))

        def get_similar_chunks(ids: list[str]) -> DataFrame:
            strong = self.similar.where(F.col("weight") >= retrieval.SIMILAR_GATE)
            return strong.join(given(ids).withColumnRenamed("key", "src"), "src", "left_semi").join(mine.withColumnRenamed("key", "dst"), "dst", "left_semi").select(F.col("src").alias("related_to"), F.col("dst").alias("chunk"), "weight")

        def rerank_chunks(query: str, ids: list[str]) -> DataFrame:
            rows = given(ids).join(self.scoped.select(F.col("chunk").alias("key"), "text"), "key").withColumn("score", F.lit(1.0))
            return retrieval.rerank(rows, query, "text", max(len(ids), 1)).select("key", "rerank_score", "text")

        return {f.__name__: f for f in (vector_search, lexical_lane_search, get_similar_chunks, rerank_chunks)}

    def lane(self, kind: str) -> DataFrame:
        return graph.lane_mapping(self.nodes, self.edges, kind)
