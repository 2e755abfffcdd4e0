"""Several readings of one thing: how far they agree, what is merged, what is paired with what."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

# Confidences of agreement.
SETTLED, CORROBORATED, ADJUDICATED, THIRD_DIFFERS, DISPUTED, APART, THIRD_ONLY = 1.0, 0.9, 0.9, 0.85, 0.7, 0.3, 0.3


def agreement(whole: Column, partly: Column, single: Column | None = None) -> Column:
    """BIZ29, BIZ30: 1.0 where all is equal, 0.7 where the main parts are, else 0.3; 0.0 where there is no second reading."""
    out = F.when(F.coalesce(whole, F.lit(False)), SETTLED).when(F.coalesce(partly, F.lit(False)), DISPUTED).otherwise(APART)
    return out if single is None else F.when(single, 0.0).otherwise(out)


def roles(readings: Column) -> Column:
    """BIZ36: struct(primary, authority, others) of readings in order; the authority alone is the primary."""
    is_ = lambda r: F.lower(F.coalesce(r["reader"], F.lit(""))).contains("codex")
    rest, auth = F.filter(readings, lambda r: ~is_(r)), F.filter(readings, is_)
    n = F.size(rest)
    return F.struct(F.coalesce(F.get(rest, 0), F.get(auth, 0)).alias("primary"), F.when(n > 0, F.get(auth, 0)).alias("authority"), F.when(n > 1, F.slice(rest, F.lit(2), F.greatest(n - 1, F.lit(1)))).otherwise(F.slice(rest, 1, 0)).alias("others"))


def merged_confidence(n: Column, disputed: Column, authority: Column, corrected: Column) -> Column:
    """BIZ31: by who agreed: a lone reading 0, a dispute 0.7, no independent reading 0.9, corrected by it 0.9, verbatim 1.0."""
    return F.when(n <= 1, 0.0).when(disputed, DISPUTED).when(~authority, CORROBORATED).when(corrected, ADJUDICATED).otherwise(SETTLED)


def merged_name(primary: Column, authority: Column) -> tuple[Column, Column, Column]:
    """BIZ33: (name, disputed, corrected): the authority decides on case, another name is a dispute and the primary's stays."""
    a, b = tx.without_rank(F.coalesce(primary, F.lit(""))), tx.without_rank(F.coalesce(authority, F.lit("")))
    same = (b != "") & (F.lower(a) == F.lower(b))
    return F.when(same, b).otherwise(a), (b != "") & ~same, same & (a != b)


def merged_entry(readings: Column) -> Column:
    """BIZ32, BIZ33: struct(name, confidence, disputed) of a row's readings (reader, name, rank, kind)."""
    r = roles(readings)
    name, other, cased = merged_name(r["primary"]["name"], r["authority"]["name"])
    both = r["authority"].isNotNull()
    disputed = F.filter(F.array(F.when(both & other, "name"), F.when(both & ~r["primary"]["rank"].eqNullSafe(r["authority"]["rank"]), "rank"), F.when(both & ~r["primary"]["kind"].eqNullSafe(r["authority"]["kind"]), "kind")), lambda x: x.isNotNull())
    return F.struct(name.alias("name"), merged_confidence(F.size(readings), F.size(disputed) > 0, F.exists(readings, lambda x: F.lower(x["reader"]).contains("codex")), both & cased).alias("confidence"), disputed.alias("disputed"))


def differing(fields: dict[str, tuple[Column, Column]]) -> Column:
    """BIZ37: names of fields whose two values differ, in order."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in fields.items()]))


def refiled(lines: Column, requires: Column, description: Column, kind: Column, footer: Column) -> Column:
    """STR36: struct(kind, extra, requires, description, footer) with lines put into the field that they belong to."""
    low = lambda x: F.lower(x)
    is_need, is_kind, is_foot = (lambda x: low(x).startswith("requires")), (lambda x: low(x) == "passive"), (lambda x: low(x).startswith("click to learn"))
    none = F.array().cast("array<string>")
    extra = F.filter(F.transform(F.coalesce(lines, none), tx.clean_text), lambda x: x != "")
    needs = F.concat(F.filter(F.transform(F.coalesce(requires, none), tx.clean_text), lambda x: x != ""), F.filter(extra, is_need))
    own = F.filter(needs, lambda x: ~is_kind(x) & ~is_foot(x))
    text = tx.clean_text(F.coalesce(description, F.lit("")))
    passive = F.lower(text).startswith("passive ")
    text = F.when(passive, F.substr(text, F.lit(9))).otherwise(text)
    glued = r"^((?:Requires [^.]*\.\s+)+)(\S.*)$"
    head = F.regexp_extract_all(F.regexp_extract(text, glued, 1), F.lit(r"Requires [^.]*\."), F.lit(0))
    rest = F.when(text.rlike(glued), F.regexp_extract(text, glued, 2)).otherwise(text)
    tail = F.regexp_extract(rest, r" (Click to learn\.?)$", 1)
    feet = F.filter(F.concat(F.array(F.nullif(tx.clean_text(F.coalesce(footer, F.lit(""))), F.lit(""))), F.filter(extra, is_foot), F.filter(needs, is_foot), F.array(F.nullif(tail, F.lit("")))), lambda x: x.isNotNull())
    is_passive = passive | F.exists(extra, is_kind) | F.exists(needs, is_kind)
    return F.struct(
        F.when(is_passive, "Passive").otherwise(F.nullif(kind, F.lit(""))).alias("kind"), F.filter(extra, lambda x: ~is_need(x) & ~is_kind(x) & ~is_foot(x)).alias("extra"),
        F.array_distinct(F.concat(F.transform(own, lambda x: F.when(is_need(x), x).otherwise(F.concat(F.lit("Requires "), x))), head)).alias("requires"), F.regexp_replace(rest, r"\s+Click to learn\.?$", "").alias("description"), F.get(feet, 0).alias("footer"),
    )


def paired(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Two readings by key, each key once a side: (keys, a_<field>, b_<field>, side)."""
    one = lambda df, p: df.select(*keys, *[F.col(f).alias(f"{p}_{f}") for f in fields], F.lit(True).alias(f"in_{p}"))
    both = one(a, "a").join(one(b, "b"), keys, "full")
    return both.withColumn("side", F.when(F.col("in_a").isNull(), "second").when(F.col("in_b").isNull(), "first").otherwise("both")).drop("in_a", "in_b")


def with_third(records: DataFrame, third: DataFrame, key: str, best: Column) -> DataFrame:
    """(key, confidence, third) after a third reading: raised where it agrees with one of two, lowered where it differs from both; alone it is a lead.

    records: (key, confidence, ...); third: one row a key; best: how well the third agrees with the record's best reading, over both sides' columns.
    """
    both = records.withColumn("known", F.lit(True)).join(third.withColumn("said", F.lit(True)), key, "full")
    conf = F.coalesce("confidence", F.lit(0.0))
    out = F.when(F.col("known").isNull(), THIRD_ONLY).when(F.col("said").isNull(), conf).when((conf >= 1) & (best < 1), THIRD_DIFFERS).when(best >= 1, F.greatest(conf, F.lit(CORROBORATED))).when(best >= 0.7, F.greatest(conf, F.lit(DISPUTED))).otherwise(conf)
    return both.select(key, out.alias("confidence"), F.coalesce("said", F.lit(False)).alias("third"))


def aligned(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Two passes over an ordered column, rows (column, pos, id, rank): each row of the first claims the nearest free one of the second
    that is equal, then the nearest with its id; what is left of the second stands alone. A column has some tens of rows, and each claim
    depends on those before, so a column is aligned in Python by itself.
    """

    out = T.StructType([T.StructField("a_pos", T.LongType()), T.StructField("b_pos", T.LongType()), a.schema["id"], T.StructField("confidence", T.DoubleType())])

    @F.pandas_udf(T.ArrayType(out))
    def claimed(left: pd.Series, right: pd.Series) -> pd.Series:
        got = []
        for x, y in zip(left, right, strict=True):
            x, y = ([(r["pos"], (r["id"], r["rank"])) for r in (side if side is not None else [])] for side in (x, y))
            match, used = {}, set()
            for same in (lambda u, v: u == v, lambda u, v: u[0] == v[0]):
                for i, (_, u) in enumerate(x):
                    if i not in match:
                        free = [j for j in sorted(range(len(y)), key=lambda j: (abs(j - i), j)) if j not in used and same(u, y[j][1])]
                        if free:
                            match[i] = free[0]
                            used.add(free[0])
            rows = [{"a_pos": p, "b_pos": y[match[i]][0] if i in match else None, "id": u[0], "confidence": (1.0 if y[match[i]][1] == u else 0.7) if i in match else 0.0} for i, (p, u) in enumerate(x)]
            got.append(rows + [{"a_pos": None, "b_pos": p, "id": v[0], "confidence": 0.0} for j, (p, v) in enumerate(y) if j not in used])
        return pd.Series(got)

    one = lambda df, name: df.groupBy(column).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "id", "rank"))).alias(name))
    both = one(a, "a_rows").join(one(b, "b_rows"), column, "full")
    return both.select(column, F.explode(claimed("a_rows", "b_rows")).alias("e")).select(column, "e.*")


def stitched(sequences: DataFrame, group: str) -> DataFrame:
    """WIN16: (group, pos, id): one order of the ids of a group's overlapping sequences (group, seq, pos, id).

    Ids come out when all that stand directly above them somewhere have; on a cycle the one that appeared first does. A group's ids are few
    and each step depends on the last, so a group is stitched in Python by itself.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        order, above = [], {}
        for _, own in rows.sort_values(["seq", "pos"]).groupby("seq", sort=True):
            ids = own["id"].tolist()
            for x in ids:
                if x not in above:
                    above[x] = set()
                    order.append(x)
            for x, y in zip(ids, ids[1:], strict=False):
                if x != y:
                    above[y].add(x)
        out, left = [], list(order)
        while left:
            x = next((x for x in left if not above[x] - set(out)), left[0])
            out.append(x)
            left.remove(x)
        return pd.DataFrame([(key[0], i, x) for i, x in enumerate(out)], columns=[group, "pos", "id"])

    kinds = dict(sequences.dtypes)
    return sequences.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, pos int, id {kinds['id']}")


def suspects(crops: DataFrame, edge_ratio: float = 0.9, width_factor: float = 0.8) -> DataFrame:
    """BIZ35: crops (id, width, edge) narrower than a share of the median width whose right edge is weak against the median edge."""
    mid = crops.agg(F.median("width").alias("w"), F.median("edge").alias("e"))
    return crops.crossJoin(F.broadcast(mid)).filter((F.col("width") < F.col("w") * width_factor) & (F.col("edge") < F.col("e") * edge_ratio)).select("id")  # mid is one row


def decided(best: Column, margin: Column, rank: Column, score: Column, accept: float = 0.6, strong: float = 0.8, least_margin: float = 0.05, prior_rank: int = 5, prior_score: float = 0.45, overrule: float = 0.7) -> Column:
    """BIZ38: which icon is taken: the prior's (high, medium), the best by sight (high, medium), or none.

    best, margin: the best score and its lead; rank, score: place and score of the prior's icon (null: no prior).
    """
    prior = (rank < prior_rank) & (score >= prior_score)
    doubt = rank.isNotNull() & (rank > 0) & ((best < overrule) | (margin < least_margin))
    seen = (best >= accept) & ((margin >= least_margin) | (best >= strong))
    return F.when(prior & ((rank == 0) | (score >= strong)), "prior high").when(prior, "prior medium").when(doubt, "none").when(seen & (best >= strong) & (margin >= least_margin), "sight high").when(seen, "sight medium").otherwise("none")


def cell_pairs(cells: DataFrame, rows: int = 3, cols: int = 1) -> DataFrame:
    """BIZ40: ordered pairs of cells (grp, tree, row, col) of one tree: the second not above, at most so far away, same-row pairs once."""
    a = cells.select("grp", "tree", F.col("row").alias("r1"), F.col("col").alias("c1"))
    b = cells.select("grp", "tree", F.col("row").alias("r2"), F.col("col").alias("c2"))
    dr, dc = F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")
    return a.join(b, ["grp", "tree"]).filter(dr.between(0, rows) & (F.abs(dc) <= cols) & ((dr > 0) | (dc > 0)))


def without_overlaps(arrows: DataFrame, group: str) -> DataFrame:
    """BIZ39: arrows (group, src, dst, shape) without L-shapes whose straight leg another arrow has."""
    straight = arrows.filter("shape = 'straight'")
    bottom = straight.select(group, "src").distinct().withColumn("shape", F.lit("L-bottom"))
    top = straight.select(group, "dst").distinct().withColumn("shape", F.lit("L-top"))
    return arrows.join(bottom, [group, "src", "shape"], "left_anti").join(top, [group, "dst", "shape"], "left_anti")
