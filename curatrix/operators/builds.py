"""Allocations: exclusive prefix sums, budget verdicts, positional codes, id migrations, sanitising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points_above(df: DataFrame, keys: list[str], tier: str, points: str) -> DataFrame:
    """Points in strictly lower tiers of the same build, by tier: tiers are summed before they are ordered."""
    per = df.groupBy(*keys, tier).agg(F.sum(points).alias("points"))
    w = Window.partitionBy(*keys).orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("above", F.coalesce(F.sum("points").over(w), F.lit(0)))


def encoded(df: DataFrame, build: str, segment: str, position: str, digit: str) -> DataFrame:
    """Digits in order of position, trailing zeros cut, segments joined by hyphens, trailing ones cut."""
    own = df.groupBy(build, segment).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, digit))), lambda x: x[digit].cast("string")), "").alias("own"))
    own = own.withColumn("own", F.regexp_replace("own", "0+$", ""))
    code = own.groupBy(build).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(segment, "own"))), lambda x: x["own"]), "-").alias("code"))
    return code.withColumn("code", F.regexp_replace("code", "-+$", ""))


def decoded(df: DataFrame, build: str, code: str) -> DataFrame:
    """(build, segment, position, digit) of every digit that isn't zero."""
    segs = df.select(build, F.posexplode(F.split(code, "-")).alias("segment", "own"))
    digits = segs.filter("own <> ''").select(build, "segment", F.posexplode(F.split("own", "")).alias("position", "digit"))
    return digits.filter("digit <> '' and digit <> '0'").withColumn("digit", F.col("digit").cast("int"))


def migrated(df: DataFrame, id: str, steps: list[DataFrame]) -> DataFrame:
    """Ids taken through (from_id, to_id) maps in turn; a null to_id removes, an unknown id stays."""
    for step in steps:
        m = step.select(F.col("from_id").alias(id), "to_id", F.lit(True).alias("moved"))
        df = df.join(m, id, "left").filter("moved is null or to_id is not null").withColumn(id, F.coalesce("to_id", id)).drop("to_id", "moved")
    return df


def first_reason(rules: list[tuple[str, object]]):
    """The name of the first rule that holds, else `ok`."""
    out = F.lit("ok")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def sanitised(df: DataFrame, build: str, tier: Column, points: str, per_tier: int) -> DataFrame:
    """(build, tier, points) that is legal: a tier needs ``per_tier`` points below it for each tier.

    What is dropped takes support from higher tiers only, so one fold in the order of tiers reaches the
    fixpoint. A build has one entry a tier, which bounds its array.
    """
    per = df.groupBy(build, tier.cast("int").alias("tier")).agg(F.sum(points).cast("long").alias("points"))
    own = per.groupBy(build).agg(F.array_sort(F.collect_list(F.struct("tier", "points"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<tier:int,points:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        holds = acc["total"] >= per_tier * x["tier"]
        return F.struct(F.when(holds, acc["total"] + x["points"]).otherwise(acc["total"]).alias("total"), F.when(holds, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return own.select(build, F.explode(F.aggregate("all", start, step)["kept"]).alias("e")).select(build, "e.*")
