"""Reading: headered CSV with required columns, candidate JSON in several wrappers, tab lists, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import slug


class MissingColumns(ValueError):
    pass


def csv_table(spark: SparkSession, path: str, required: list[str], optional: dict[str, str] | None = None) -> DataFrame:
    """All values as strings; a byte-order mark before the first name is dropped; optional columns get a default."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if lost := sorted(set(required) - set(df.columns)):
        raise MissingColumns(f"{path}: {', '.join(lost)}")
    for name, default in (optional or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    return df


def repeating(df: DataFrame, prefix: str, n: int, name: str) -> DataFrame:
    """Columns prefix_0 ... prefix_n-1 as one array of their positive numbers."""
    own = F.array(*[F.col(f"{prefix}_{i}").try_cast("int") for i in range(n)])
    return df.withColumn(name, F.filter(own, lambda x: x > 0)).drop(*[f"{prefix}_{i}" for i in range(n)])


def candidates(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of files that hold a bare array, or an object with it under candidates, records or talents."""
    v = F.try_parse_json("value")
    kind = f"array<{schema.simpleString()}>"
    found = F.coalesce(*[F.try_variant_get(v, p, kind) for p in ("$", "$.candidates", "$.records", "$.talents")])
    return spark.read.text(path, wholetext=True).select(F.explode(found).alias("r")).select("r.*")


def tab_list(spark: SparkSession, path: str) -> DataFrame:
    """name<TAB>tier; blank lines and lines that start with # are passed over."""
    line = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return line.select(F.trim(F.get(F.split("value", "\t"), F.lit(0))).alias("name"), F.trim(F.get(F.split("value", "\t"), F.lit(1))).alias("tier"))


def first_origin(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several origins; of a key's rows those of the first origin that has it."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df.join(out.select(key).distinct(), key, "left_anti"))
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that a manifest lists and that are gone or have another hash."""
    return before.join(now.select("path", "sha256"), ["path", "sha256"], "left_anti")


def versions(spark: SparkSession, pattern: str) -> DataFrame:
    """Text of files named v<N>.json and their N."""
    df = spark.read.text(pattern, wholetext=True).withColumn("version", F.regexp_extract(F.input_file_name(), r"v([0-9]+)\.json$", 1).try_cast("int"))
    return df.filter("version is not null").select("version", "value")


def count_rows(spark: SparkSession, path: str) -> int:
    """SRC8: data rows of a headered CSV."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC14, SRC23: documents that may not be there: then no rows of the same schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def windows(spark: SparkSession, path: str | None, fallback: list[tuple]) -> tuple[DataFrame, str]:
    """SRC15, SRC16: (t0, t1, class, note) from a JSON file of windows, or a list by hand where there is none; and which of them."""
    schema = "t0 int, t1 int, class string, note string"
    if path and exists(spark, path):
        return spark.read.schema(schema).option("multiLine", True).json(path), path
    return spark.createDataFrame(fallback, schema), "built in"


def tables(spark: SparkSession, folder: str, required: dict[str, list[str]], optional: dict[str, list[str]]) -> tuple[dict[str, DataFrame], list[str]]:
    """SRC5: a folder's CSV tables by name, with the columns that each has to have; an optional one that is missing is empty, and named."""
    out, missing = {n: csv_table(spark, f"{folder}/{n}.csv", c) for n, c in required.items()}, []
    for name, columns in optional.items():
        if exists(spark, f"{folder}/{name}.csv"):
            out[name] = csv_table(spark, f"{folder}/{name}.csv", columns)
        else:
            out[name] = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
            missing.append(name)
    return out, missing


def landed(spark: SparkSession, folder: str, names: list[str], fetch, known: DataFrame | None = None) -> DataFrame:
    """SRC6: path, bytes, sha256, rows of tables in a folder; ``fetch(name, path)`` is called for those that are not there yet."""
    for name in names:
        if not exists(spark, f"{folder}/{name}.csv"):
            fetch(name, f"{folder}/{name}.csv")
    rows = spark.createDataFrame([(f"{n}.csv", count_rows(spark, f"{folder}/{n}.csv")) for n in names], "file string, rows long")
    return manifest(spark, f"{folder}/*.csv").withColumn("file", F.regexp_extract("path", "([^/]*)$", 1)).join(rows, "file")


def named_candidates(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC11: as :func:`candidates`, an id that is missing made of the name."""
    df = candidates(spark, path, schema)
    return df.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), slug(F.col("name"))))


def registry(versions_: DataFrame, migrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC25: encodings (version, value) and migrations (from, value), the first file of a version or step counting, by path."""
    first = lambda df, key: df.groupBy(key).agg(F.min_by("value", "path").alias("value"))
    return first(versions_, "version"), first(migrations, "from")
