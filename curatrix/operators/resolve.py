"""Choosing among several observations of one thing: best, quorum, majority, alternates.

All of these aggregate before they shuffle: the best row travels as one struct per key and task, so a
key with a third of all rows costs its tasks no more memory than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], score: list[Column], columns: list[str]) -> DataFrame:
    """The row with the greatest score (a total order) of each key: a max over structs, not a window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])).alias("best")).select(*keys, "best.*")


def with_alternates(df: DataFrame, keys: list[str], value: str, score: list[Column]) -> DataFrame:
    """The best value of each key, and how many distinct others there were, joined in order."""
    got = df.groupBy(*keys).agg(F.max_by(value, F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])).alias("best"), F.collect_set(value).alias("seen"))
    other = F.array_sort(F.array_except("seen", F.array("best")))
    return got.select(*keys, "best", F.size(other).alias("n_alternates"), F.array_join(other, "|").alias("alternates"))


def quorum(df: DataFrame, voter: str, key: str, share: float = 0.5) -> DataFrame:
    """Keys with their number of voters, and whether more than ``share`` of all voters have them."""
    total = df.agg(F.countDistinct(voter).alias("voters"))
    votes = df.groupBy(key).agg(F.countDistinct(voter).alias("votes"))
    return votes.join(F.broadcast(total)).select(key, "votes", "voters", (F.col("votes") > F.col("voters") * share).alias("agreed"))


def missing(df: DataFrame, voter: str, key: str, agreed: DataFrame) -> DataFrame:
    """(voter, key): agreed keys that a voter lacks. agreed is the small set of keys."""
    pairs = df.select(voter).distinct().join(F.broadcast(agreed.select(key)))
    return pairs.join(df.select(voter, key).distinct(), [voter, key], "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined to ``b``, whose keys are unique, on keys that are equal or both null; columns of ``a``, then the others of ``b``."""
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most common value of each key; ties to the least value; whether it was a tie. Null keys are keys, null values no votes."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("top"))
    tops = same_keys(counts, top, keys).filter("n = top").groupBy(*keys, "n").agg(F.min(value).alias(value), F.count("*").alias("ties"))
    return tops.select(*keys, value, "n", (F.col("ties") > 1).alias("tie"))
