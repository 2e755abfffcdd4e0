"""One template for sentences that differ only in numbers and plurals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem

#: Numbers, words, and every other character by itself: the pieces of a text, in order, joined give it back.
PIECE = r"[0-9]+(?:\.[0-9]+)?|(?<![0-9])\.[0-9]+|[A-Za-z]+|[\s\S]"
IS_NUMBER, IS_WORD = r"^\.?[0-9]", r"^[A-Za-z]"
CHANGED = "sentence shape changes between ranks"


def _slot(piece: Column, min_len: int) -> Column:
    """A number without idle zeros in front, or what a word has after its stem."""
    number = F.when(piece.contains("."), piece.cast("double").cast("string")).otherwise(F.regexp_replace(piece, "^0+(?=.)", ""))
    return F.when(piece.rlike(IS_NUMBER), number).otherwise(F.substring(piece, F.length(stem(piece, min_len)) + 1, F.length(piece)))


def inferred(df: DataFrame, texts: str, min_len: int = 3) -> DataFrame:
    """``df`` with template, slots (array of arrays of strings, one per text) and reason.

    Pieces that differ between the texts become ``{0}``, ``{1}``, ...: numbers wholly, words only by a
    plural s after more than ``min_len - 1`` letters. Any other difference gives a null template and
    slots, and a reason. One text, or equal ones, have no slots. A null or empty list, or a null text,
    has nulls and no reason. The three names must be free in ``df``; so must those with an underscore before.
    """
    whole = F.col(texts).isNotNull() & (F.size(texts) > 0) & ~F.exists(texts, lambda t: t.isNull())
    split = df.withColumn("_pieces", F.when(whole, F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)))))
    even = F.size(F.array_distinct(F.transform("_pieces", F.size))) == 1
    across = F.transform(F.get("_pieces", F.lit(0)), lambda _, i: F.transform("_pieces", lambda p: F.get(p, i)))
    kind = lambda c: (
        F.when(F.size(F.array_distinct(c)) == 1, "same")
        .when(F.forall(c, lambda v: v.rlike(IS_NUMBER)), "slot")
        .when(F.forall(c, lambda v: v.rlike(IS_WORD)) & (F.size(F.array_distinct(F.transform(c, lambda v: stem(v, min_len)))) == 1), "slot")
        .otherwise("other")
    )
    kinds = split.withColumn("_across", F.when(even, across)).withColumn("_kinds", F.transform("_across", kind))
    kinds = kinds.withColumn("_open", F.when(~F.array_contains("_kinds", "other"), F.filter(F.transform("_kinds", lambda k, i: F.when(k == "slot", i)), lambda i: i.isNotNull())))
    named = F.transform(F.get("_pieces", F.lit(0)), lambda v, i: F.when(F.array_contains("_open", i), F.concat(F.when(v.rlike(IS_NUMBER), "").otherwise(stem(v, min_len)), F.lit("{"), (F.array_position("_open", i) - 1).cast("string"), F.lit("}"))).otherwise(v))
    out = kinds.withColumn("template", F.when(F.col("_open").isNotNull(), F.array_join(named, "")))
    out = out.withColumn("slots", F.when(F.col("_open").isNotNull(), F.transform("_pieces", lambda p: F.transform("_open", lambda i: _slot(F.get(p, i), min_len)))))
    out = out.withColumn("reason", F.when(F.col("_pieces").isNotNull() & F.col("_open").isNull(), CHANGED))
    return out.drop("_pieces", "_across", "_kinds", "_open")
