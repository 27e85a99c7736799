"""Derived tables that several plans read: written once per session and data directory, as an index is."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.runtime import checkpoint_folder

_paths: dict[tuple[str, str, str], str] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stored(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of directory ``d``: built and written below the checkpoint folder when first asked for, and again if it has been
    removed there. The tables of a directory are taken not to change within a session; :func:`forget` drops what is known of them."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _paths or not _exists(spark, _paths[key]):
        path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"
        build().write.parquet(path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])


def forget(d: str | None = None) -> None:
    for key in [k for k in _paths if d is None or k[1] == d]:
        del _paths[key]
