"""Data-quality rules: each gives findings (level, code, path, message).

A null is a finding of :func:`not_null` alone: forms, bounds, lists and references say nothing of it.
Repeated rows give a finding each, repeated keys one; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding(df: DataFrame, bad: Column, code: str, path: Column, message: str, level: str = "ERROR") -> DataFrame:
    return df.filter(bad).select(F.lit(level).alias("level"), F.lit(code).alias("code"), path.cast("string").alias("path"), F.lit(message).alias("message"))


def not_null(df, column, code, path):
    return finding(df, F.col(column).isNull(), code, path, f"{column} is missing")


def one_of(df, column, allowed, code, path):
    return finding(df, ~F.col(column).isin(*allowed), code, path, f"{column} is not allowed")


def like(df, column, pattern, code, path):
    return finding(df, ~F.col(column).rlike(pattern), code, path, f"{column} has a wrong form")


def within(df, column, lo, hi, code, path, level="ERROR"):
    return finding(df, (F.col(column) < lo) | (F.col(column) > hi), code, path, f"{column} is out of bounds", level)


def unique(df, keys, code, level="ERROR"):
    """One finding per repeated key: counted with partial aggregation, not in a window."""
    path = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return finding(df.groupBy(*keys).agg(F.count("*").alias("n")), F.col("n") > 1, code, path, f"{'+'.join(keys)} is repeated", level)


def foreign_key(df, column, other, other_column, code, path):
    lost = df.filter(F.col(column).isNotNull()).join(other.select(F.col(other_column).alias(column)).distinct(), column, "left_anti")
    return finding(lost, F.lit(True), code, path, f"{column} refers to nothing")


def contiguous(df, key, number, code, level="WARNING"):
    """Numbers of a key run from 1 without a gap."""
    got = df.groupBy(key).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.countDistinct(number).alias("n"))
    return finding(got, (F.col("lo") != 1) | (F.col("hi") != F.col("n")), code, F.col(key), f"{number} has gaps", level)


def all_findings(*found: DataFrame, strict: bool = False) -> DataFrame:
    out = reduce(DataFrame.unionByName, found)
    return out.withColumn("level", F.lit("ERROR")) if strict else out


def review_queue(df: DataFrame, confidence: Column, columns: list[str], below: float) -> DataFrame:
    """Rows to look at: a known confidence below the threshold."""
    return df.withColumn("confidence", confidence).filter(F.col("confidence") < below).select(*columns, "confidence")
