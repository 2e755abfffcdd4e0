"""Merging by precedence: overrides, additive unions, sets that never shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overridden(base: DataFrame, over: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``over`` rows are (key, delete, fields); set fields win, deleted rows go, unknown keys are added."""
    o = over.select(key, F.col("delete"), F.lit(True).alias("given"), *[F.col(f).alias(f"new_{f}") for f in fields])
    both = base.withColumn("known", F.lit(True)).join(o, key, "full").filter(~F.coalesce("delete", F.lit(False)))
    source = F.when(F.col("known").isNull(), "added").when(F.col("given").isNull(), "base").otherwise("override")
    return both.select(key, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields], source.alias("origin"))


def additive_union(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of the existing rows, and new rows of keys that it lacks."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def never_shrunk(old: DataFrame, fresh: DataFrame, key: str, fields: list[str], reviewed: str) -> DataFrame:
    """Per key: a reviewed old row stays; else fresh values where there are any; no key is lost."""
    f = fresh.select(key, F.lit(True).alias("found"), *[F.col(c).alias(f"new_{c}") for c in fields])
    both = old.withColumn("kept", F.lit(True)).join(f, key, "full")
    keep = F.coalesce(F.col(reviewed), F.lit(False))
    return both.select(key, *[F.when(keep, F.col(c)).otherwise(F.coalesce(f"new_{c}", c)).alias(c) for c in fields], F.when(F.col("kept").isNull(), "new").when(F.col("found").isNull(), "gone").otherwise("both").alias("side"))
