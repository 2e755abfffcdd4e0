"""How a rule says what it found.

A document is one row with nested arrays, so a rule is an expression over that row: an array of findings
(level, code, path). Nothing is shuffled, and a document costs its own size. Absent fields are nulls: a rule
whose operands are absent finds nothing, except the rules that are about absence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<level:string,code:string,path:string>>"
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
REVIEW_BELOW = 0.8
SOURCE = "struct<kind:string,video:string,t:double,frame:int,crop:string,panel:string,confidence:double,reader:string,readings:int,build:string,talentId:int,reviewed:boolean,reviewedBy:string,reviewedAt:string,note:string>"


def yes(bad: Column) -> Column:
    return F.coalesce(bad, F.lit(False))


def found(bad: Column, level: str, code: str, path: Column) -> Column:
    return F.when(yes(bad), F.array(F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), path.cast("string").alias("path")))).otherwise(F.array().cast(FINDING))


def error(bad: Column, code: str, path: Column) -> Column:
    return found(bad, "ERROR", code, path)


def warning(bad: Column, code: str, path: Column) -> Column:
    return found(bad, "WARNING", code, path)


def over(items: Column, *rules: Callable[[Column, Column], Column]) -> Column:
    return F.coalesce(F.flatten(F.transform(items, lambda x, i: F.concat(*[r(x, i) for r in rules]))), F.array().cast(FINDING))


def all_of(*found: Column) -> Column:
    return F.concat(*[F.coalesce(f, F.array().cast(FINDING)) for f in found])


def seen_before(items: Column, i: Column, same: Callable[[Column], Column]) -> Column:
    """Whether an element before the i-th is the same."""
    return F.when(i > 0, F.exists(F.slice(items, F.lit(1), F.greatest(i, F.lit(1))), same)).otherwise(False)


def is_sorted(items: Column) -> Column:
    return items == F.array_sort(items)


def blank_ends(text: Column) -> Column:
    return (text != F.regexp_replace(text, r"^\s+|\s+$", "")) | text.contains("  ")


def slugs(value: Column, code: str, path: Column) -> Column:
    return error(~F.coalesce(value, F.lit("")).rlike(SLUG) | (F.length(value) > 64), code, path)


def source_fields(src: Column, code: str, path: Column) -> Column:
    """What a video, datamined or manual source, and a reviewed one, has to say (races and spells)."""
    lacks = lambda *names: [error((src["kind"] == "video") & src[n].isNull(), code, path) for n in names]
    reviewed, by = F.coalesce(src["reviewed"], F.lit(False)), (src["reviewedBy"].isNotNull(), src["reviewedAt"].isNotNull())
    return F.concat(
        *lacks("video", "t", "frame", "crop", "confidence", "reader"),
        error((src["kind"] == "datamined") & (F.coalesce(src["build"], F.lit("")) == ""), code, path),
        error((src["kind"] == "manual") & ~reviewed, code, path),
        error(reviewed & ~(by[0] & by[1]), code, path),
        error(~reviewed & (by[0] | by[1]), code, path),
    )


def needs_review(src: Column, path: Column) -> Column:
    return warning((src["confidence"] < REVIEW_BELOW) & ~F.coalesce(src["reviewed"], F.lit(False)), "NEEDS-REVIEW", path)


def findings(docs: DataFrame, name: str, *rules: Column) -> DataFrame:
    """(name, level, code, path) of every finding; ``name`` tells the document."""
    return docs.select(F.col(name), F.explode(all_of(*rules)).alias("f")).select(name, "f.*")


def strict(found: DataFrame) -> DataFrame:
    """Warnings as errors."""
    return found.withColumn("level", F.when(F.col("level") == "WARNING", "ERROR").otherwise(F.col("level")))


def printed(found: DataFrame) -> DataFrame:
    """SRT11: in the order in which findings are printed: errors first, then by path and code."""
    rank = F.when(F.col("level") == "ERROR", 0).when(F.col("level") == "WARNING", 1).otherwise(2)
    return found.orderBy(rank, "path", "code")


def missing_files(wanted: DataFrame, files: DataFrame, code: str) -> DataFrame:
    """Paths that documents name (doc, path, file) and that a listing (file) lacks."""
    return wanted.filter("file is not null").join(files.select("file").distinct(), "file", "left_anti").select("doc", F.lit("ERROR").alias("level"), F.lit(code).alias("code"), "path")
