"""The training-data pipeline: quality rules, near copies, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs`` as they were. Rows with a null text or id pass through a stage unless its rule rejects them:
the first stage rejects texts without words, so null texts end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import bpe, contamination, neardup, pii, quality
from curatrix.llm.common import discard, release, stored, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    df, _, _, kept, _ = quality.judged(docs, table(spark, sf_dir, "labels"))
    return df.filter(kept).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id."""
    return neardup.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return contamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    df, (_, _, red) = pii.with_spans(docs, pii.fit(docs))
    return df.select(*(F.col(red).alias(c) if c == "text" else F.col(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of what they decode to."""
    return bpe.tokenized(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal),
    ("byte_bpe", token_ids),
]

#: The learned stages have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = stored(), docs
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, mark, keep=docs)  # what the stage stored is in its result now
        if name != STAGES[0][0]:  # the table of documents itself stays
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
