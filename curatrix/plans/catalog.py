"""Every query of the library, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import documents, entities, files, points, scalars, streams, views
from .registry import QUERIES, SQL

__all__ = ["documents", "entities", "files", "points", "scalars", "streams", "views"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["class_index"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
