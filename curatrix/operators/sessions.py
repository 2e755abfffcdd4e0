"""Runs, dwells, segments and intervals: order-sensitive operators over one stream per key.

A stream is sorted within its key, as its meaning is its order. A stream that holds a large share of all
rows is first cut: see :func:`merged_intervals`, which merges inside buckets of time before it merges
their results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "run") -> DataFrame:
    """``df`` numbered by runs; ``starts`` is true where a row begins a new one (null: it does)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, keys: list[str], order: list[str], time: str, same: str, max_gap: int, min_len: int = 1) -> DataFrame:
    """Runs of one value with gaps of at most ``max_gap``: start, end, length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (F.lag(same).over(w) != F.col(same)) | (F.col(time) - F.lag(time).over(w) > max_gap)
    got = islands(df, keys, order, new).groupBy(*keys, "run", same).agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n"))
    return got.filter(F.col("n") >= min_len)


def segments(df: DataFrame, keys: list[str], order: list[str], time: str, label: str, tail: int) -> DataFrame:
    """Runs of one label; a segment ends where the next starts, the last ``tail`` after its last row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    got = islands(df, keys, order, F.lag(label).over(w) != F.col(label)).groupBy(*keys, "run", label).agg(F.min(time).alias("t0"), F.max(time).alias("last"), F.count("*").alias("n"))
    nxt = F.lead("t0").over(Window.partitionBy(*keys).orderBy("run"))
    return got.select(*keys, "run", label, "t0", F.coalesce(nxt, F.col("last") + tail).alias("t1"), "n")


def gaps(df: DataFrame, keys: list[str], order: list[str], time: str, longer: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("before", F.lag(time).over(w)).filter(F.col(time) - F.col("before") > longer).select(*keys, F.col("before").alias("t0"), F.col(time).alias("t1"), (F.col(time) - F.col("before")).alias("gap"))


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return islands(df, keys, ["t0", "t1"], F.col("t0") > reach, "island").groupBy(*keys, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")


def merged_intervals(df: DataFrame, keys: list[str], bucket: int | None = None) -> DataFrame:
    """Overlapping or touching intervals [t0, t1) of a key as one.

    bucket: intervals are first merged among those that start in the same span of that length, which
    spreads a hot key over many tasks and leaves few intervals for the second pass.
    """
    if bucket:
        df = _merge(df.withColumn("bucket", F.floor(F.col("t0") / bucket)), [*keys, "bucket"]).drop("bucket")
    return _merge(df, keys)


def subtracted(whole: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of [t0, t1) outside the blocks of the same key: (keys, t0, t1).

    A sweep: the ends of intervals and blocks are sorted, and a stretch counts where an interval is open
    and no block is. Blocks with a null key are blocks of no key.
    """
    def ends(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(*keys, F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(a).alias("on"), F.lit(b).alias("off")), F.struct(F.col("t1").alias("t"), F.lit(-a).alias("on"), F.lit(-b).alias("off")))).alias("e")).select(*keys, "e.*")

    moves = ends(whole, 1, 0).unionAll(ends(blocks.dropna(subset=keys), 0, 1)).groupBy(*keys, "t").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    w = Window.partitionBy(*keys).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    state = moves.select(*keys, F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.sum("on").over(run).alias("on"), F.sum("off").over(run).alias("off"))
    return _merge(state.filter("on > 0 and off = 0 and t1 > t0").select(*keys, "t0", "t1"), keys)
