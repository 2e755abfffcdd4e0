"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, contamination, language, neardup, pii, quality, substrings, suffixes, warc
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents")).drop("kept")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents")).drop("kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(chat.TURN_SCHEMAS, chat.SCHEMA_COLUMNS)
    return chat.linked(chat.with_calls(table(spark, sf_dir, "conversations")), schemas)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df, names, failed, kept, rule = quality.judged(docs, table(spark, sf_dir, "labels"))
    counts = [n for n in quality.COUNTS if n != "n_lines"]
    return df.select("doc_id", *(df[names[n]].alias(n) for n in counts), failed.alias("base_failed"), kept.alias("kept"), rule.alias("rule"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Windows of 35 words that occur twice or more, and the words that they cover.
OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
o AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""

#: Queries that DuckDB can say on the same tables.
ORACLES: dict[str, str] = {"op1_substring_dedup": OP1, "op3_warc": warc.ORACLE, "op4_tool_calls": chat.ORACLE}

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_warc, op4_tool_calls, op5_suffix_array_dedup, op6_pii, op7_quality_rules, op8_decontamination, op9_byte_bpe, op10_near_dedup)}
