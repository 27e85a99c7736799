"""Catalog listing: tenant-scoped filters, paging, point operations as set operations, configuration joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.latest import latest_rows

# Defaults of a project's variables.
VARIABLE_DEFAULTS: dict[str, float] = {
    "chunk_size": 1500,
    "chunk_overlap": 200,
    "max_chunk_size_mb": 5.0,
    "max_pages_per_batch": 10,
    "group_size": 3,
    "max_group_size": 5,
    "rows_per_io_buffer": 500,
    "gte_edge_vector_similar_threshold": 0.75,
    "gte_edge_vector_similar_top_k": 3,
    "gte_point_score": 0.45,
    "expert_lane_count": 3,
    "expert_lane_weight": 0.70,
    "expert_lane_chunks": 5,
    "expert_chunks": 5,
}


def page(df: DataFrame, order: list[Column], limit: int, number: int) -> DataFrame:
    """One page (numbered from 1) of an ordering; the order must be total, so end it with an id."""
    return df.orderBy(*order).offset(max(number - 1, 0) * limit).limit(limit)


def page_counts(df: DataFrame, limit: int, number: int = 1) -> DataFrame:
    """(total, total_pages, has_next, has_previous); an empty listing has one page."""
    pages = F.greatest(F.ceil(F.col("total") / limit), F.lit(1)).cast("bigint")
    counted = df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", pages)
    return counted.withColumns({"has_next": F.lit(number) < F.col("total_pages"), "has_previous": F.lit(number > 1)})


def contains_ignoring_case(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def list_documents(uploads: DataFrame, org: str | None = None, project: str | None = None, status: str | None = None, name: str | None = None, types: list[str] | None = None, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """The latest row of each upload that passes every given filter. Null sizes pass no size filter; types are compared without
    case and dots."""
    latest = latest_rows(uploads, ["id"], "updated_at", ["id", "org_id", "project_id", "name", "type", "status", "size", "created_at"])
    conditions = [
        F.col("org_id") == org if org else None,
        F.col("project_id") == project if project else None,
        F.upper("status") == status.upper() if status else None,
        contains_ignoring_case(F.col("name"), name) if name else None,
        F.lower(F.trim("type")).isin([t.lower().replace(".", "") for t in types]) if types else None,
        F.col("size") > min_size if min_size is not None else None,
        F.col("size") < max_size if max_size is not None else None,
    ]
    for c in conditions:
        latest = latest if c is None else latest.where(c)
    return latest


def last_per_group(df: DataFrame, group: str, order: str, cols: list[str]) -> DataFrame:
    """Per group the row of the greatest ``order`` (ties: greatest values)."""
    best = df.groupBy(group).agg(F.max(F.struct(order, *[c for c in cols if c not in (group, order)])).alias("b"))
    return best.select(group, *[F.col(f"b.{c}").alias(c) for c in cols if c != group])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], partial: bool = False) -> DataFrame:
    """``current`` with ``changes`` merged in by ``keys``; ``partial`` keeps the old value where the new one is null. Keys of
    changes must be unique; null keys never match and are kept as they are."""
    cols = current.columns
    old, new = current.alias("o"), changes.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = old.join(new, on, "full").withColumn("__new", F.coalesce(*[F.col(f"n.{k}").isNotNull() for k in keys]))
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keys or partial else F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in cols])


def remove(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def config_detail(configs: DataFrame, catalogs: dict[str, DataFrame], optional: dict[str, str]) -> DataFrame:
    """Configurations with the name of every referenced model, by left joins; a model in ``optional`` joins only where the named flag
    of the configuration is true. Catalogs are small; the optimiser sees their size and broadcasts them."""
    out = configs
    for kind, models in catalogs.items():
        key = F.col(f"{kind}_model_id")
        key = F.when(F.col(optional[kind]), key) if kind in optional else key
        side = models.select(F.col("id").alias(f"__{kind}"), F.col("name").alias(f"{kind}_model"))
        out = out.join(side, key == F.col(f"__{kind}"), "left").drop(f"__{kind}")
    return out


def readiness(file_type: Column, ocr: Column, ready: dict[str, Column]) -> Column:
    """Whether the models that a file needs are configured: audio, video, or OCR for images and scanned documents."""
    needed = F.when(file_type == "video", ready["video"]).when(file_type == "audio", ready["audio"]).when((file_type == "image") | ocr, ready["ocr"])
    return F.coalesce(needed, F.lit(True))


def flatten_catalog(raw: DataFrame, text: str, fields: list[str], org: str) -> DataFrame:
    """Rows of a JSON document ``provider -> [models]`` with the organisation stamped on."""
    schema = "map<string, array<struct<" + ", ".join(f"{f}: string" for f in fields) + ">>>"
    lists = raw.select(F.explode(F.from_json(F.col(text), schema)).alias("group", "models"))
    return lists.select("group", F.explode("models").alias("m")).select(F.lit(org).alias("org_id"), "group", *[F.col(f"m.{f}").alias(f) for f in fields])


# The kinds of models that have a catalog.
MODEL_KINDS = ("llm", "embedding", "ocr", "audio", "video", "sparse", "reranker")


@dataclass(frozen=True)
class ModelCatalog:
    """One kind's models (kind, id, name, provider), of which every change gives a new catalog. Rows of other kinds in ``every`` and in
    changes are passed over; an update keeps what is null in it; null ids are never matched."""

    kind: str
    every: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self._mine(self.every)

    def _mine(self, rows: DataFrame) -> DataFrame:
        return rows.select("kind", "id", "name", "provider").where(F.col("kind") == self.kind)

    def create(self, new: DataFrame) -> ModelCatalog:
        """With the models of ``new`` whose id isn't taken."""
        free = self._mine(new).join(self.rows.select("id"), "id", "left_anti").select("kind", "id", "name", "provider")
        return ModelCatalog(self.kind, self.rows.unionByName(free))

    def update(self, changes: DataFrame) -> ModelCatalog:
        """With the changes of models that exist."""
        known = self._mine(changes).join(self.rows.select("id"), "id", "left_semi").select("kind", "id", "name", "provider")
        return ModelCatalog(self.kind, upsert(self.rows, known, ["kind", "id"], partial=True))

    def delete(self, gone: DataFrame) -> ModelCatalog:
        return ModelCatalog(self.kind, remove(self.rows, self._mine(gone), ["kind", "id"]))

    def get(self, model_id: int) -> DataFrame:
        return self.rows.where(F.col("id") == model_id)

    def by_provider(self, provider: str, limit: int = 20, number: int = 1) -> DataFrame:
        return page(self.rows.where(F.col("provider") == provider), [F.asc("name"), F.asc("id")], limit, number)

    def providers(self) -> DataFrame:
        """(kind, provider, models) of every provider."""
        return self.rows.groupBy("kind", "provider").agg(F.count(F.lit(1)).alias("models"))
