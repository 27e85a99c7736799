"""Extension points for external models, each with a deterministic local default."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.lexicon import content_words

HASHED_DIM = 64
Model = Callable[..., Column]


def hashed_embedding(text: Column, dim: int = HASHED_DIM) -> Column:
    """Bag of words hashed into ``dim`` signed buckets, unit length; all zero for a text without words."""

    def embed(batch: pd.Series) -> pd.Series:
        out = np.zeros((len(batch), dim))
        for i, words in enumerate(batch):
            for w in words if words is not None else ():
                h = crc32(w.encode())
                out[i, h % dim] += 1 - 2 * (h >> 31)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(out))

    return F.pandas_udf(embed, "array<double>")(content_words(text))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    q = F.array_distinct(content_words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_words(text))) / F.size(q)).otherwise(0.0)


def same_query(query: Column) -> Column:
    """A query's expansion: itself."""
    return F.trim(query)


def expanded(query: Column, model_of: Model | None = None) -> Column:
    """A query as a model rewrites it; the query itself, trimmed, where the model gives null or nothing."""
    plain = F.trim(query)
    return F.coalesce(F.nullif(F.trim((model_of or model("expand"))(query)), F.lit("")), plain)


def first_sentence(query: Column, context: Column) -> Column:
    """An answer: the context's first sentence."""
    return F.regexp_extract(context, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1)


def frequent_tags(text: Column, n: int = 2) -> Column:
    """Tags of a text: its first content words of eight letters or more."""
    return F.slice(F.array_distinct(content_words(text, "^[a-z]{8,}$")), 1, n)


REGISTRY: dict[tuple[str, str], Model] = {
    ("dense", "local"): hashed_embedding,
    ("rerank", "local"): overlap_score,
    ("expand", "local"): same_query,
    ("answer", "local"): first_sentence,
    ("tags", "local"): frequent_tags,
}


def register(kind: str, name: str, model: Model) -> None:
    """Add a model: a function from columns to a column, for instance around a pandas UDF that calls a service."""
    REGISTRY[(kind, name)] = model


def model(kind: str, name: str = "local") -> Model:
    try:
        return REGISTRY[(kind, name)]
    except KeyError:
        raise LookupError(f"no {kind} model named {name}; registered: {sorted(n for k, n in REGISTRY if k == kind)}") from None
