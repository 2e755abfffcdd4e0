"""Builds: points spent on talents under rules, checked, repaired, imported and decoded.

talents: (cls, tree, talent, page, row, col, max_rank, place), place being the order in which trees and cells are
walked; needs: (cls, tree, talent, other, least), where a talent wants another of its tree at a rank; limits: (cls,
per_row, max_points); budgets: (cls, page, budget); builds: (build, cls, tree, talent, rank). A class has some tens of
talents and a build at most as many rows, so what is gathered by build is bounded. Rows of no rank are no part of a
build; rows that repeat a talent count with their greatest rank; null keys match nothing and are unknown talents.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rules:
    talents: DataFrame
    needs: DataFrame
    limits: DataFrame
    budgets: DataFrame


def spent(builds: DataFrame) -> DataFrame:
    return builds.groupBy("build", "cls", "tree", "talent").agg(F.max("rank").cast("int").alias("rank")).filter("rank > 0")


def placed(builds: DataFrame, rules: Rules) -> DataFrame:
    """Spent ranks with what the class says of the talent, and the points in rows above it."""
    own = spent(builds).join(F.broadcast(rules.talents), ["cls", "tree", "talent"], "left").join(F.broadcast(rules.limits), "cls", "left")
    rows = own.filter("row is not null").groupBy("build", "tree", "row").agg(F.sum("rank").alias("points"))
    above = F.coalesce(F.sum("points").over(Window.partitionBy("build", "tree").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(rows.select("build", "tree", "row", above.alias("above")), ["build", "tree", "row"], "left")


def totals(builds: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """AGG22: points of builds, and of their pages."""
    own = spent(builds)
    page = own.join(F.broadcast(rules.talents.select("cls", "tree", "talent", "page")), ["cls", "tree", "talent"]).groupBy("build", "cls", "page").agg(F.sum("rank").alias("points"))
    return own.groupBy("build", "cls").agg(F.sum("rank").alias("points")), page


def violations(builds: DataFrame, rules: Rules) -> DataFrame:
    """BIZ3: (build, tree, talent, reason) of every broken rule; budgets are broken by no talent of their own."""
    own = placed(builds, rules)
    say = lambda df, reason: df.select("build", "tree", "talent", F.lit(reason).alias("reason"))
    have = spent(builds).select("build", "tree", F.col("talent").alias("other"), F.col("rank").alias("got"))
    wants = own.join(F.broadcast(rules.needs), ["cls", "tree", "talent"]).join(have, ["build", "tree", "other"], "left").filter(F.coalesce("got", F.lit(0)) < F.col("least"))
    total, page = totals(builds, rules)
    nobody = lambda df, reason: df.select("build", F.lit("").alias("tree"), F.lit("").alias("talent"), F.lit(reason).alias("reason"))
    return (
        say(own.filter("max_rank is null"), "unknown-talent").unionAll(say(own.filter("rank > max_rank"), "maxed")).unionAll(say(own.filter(F.col("above") < F.col("per_row") * F.col("row")), "row-locked")).unionAll(say(wants, "prereq"))
        .unionAll(nobody(total.join(F.broadcast(rules.limits), "cls").filter("points > max_points"), "no-points")).unionAll(nobody(page.join(F.broadcast(rules.budgets), ["cls", "page"]).filter("points > budget"), "page-full"))
    )


def _classes(rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(numbers of the talents that a class has or wants, with their row and page; a row a class: its limits, pages and talents by tree and row)."""
    named = rules.talents.select("cls", "tree", "talent").unionAll(rules.needs.select("cls", "tree", F.col("other").alias("talent"))).distinct()
    named = named.withColumn("no", F.row_number().over(Window.partitionBy("cls").orderBy("tree", "talent")))
    other = named.select("cls", "tree", F.col("talent").alias("other"), F.col("no").alias("wanted"))
    wants = rules.needs.join(F.broadcast(named), ["cls", "tree", "talent"]).join(F.broadcast(other), ["cls", "tree", "other"], "left").groupBy("cls").agg(F.collect_list(F.struct("no", "wanted", "least")).alias("wants"))
    every = rules.talents.join(F.broadcast(named), ["cls", "tree", "talent"], "left").join(F.broadcast(rules.budgets), ["cls", "page"], "left")
    rows = every.groupBy("cls", "tree", "row").agg(F.collect_list(F.struct("no", "talent", "page", "max_rank", "budget")).alias("talents"), F.collect_set("page").alias("own"))
    classes = rows.groupBy("cls").agg(F.collect_list(F.struct("tree", "row", "talents")).alias("rows"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("pages"))
    return named.join(F.broadcast(rules.talents.select("cls", "tree", "talent", "row", "page")), ["cls", "tree", "talent"], "left"), classes.join(F.broadcast(rules.limits), "cls").join(F.broadcast(wants), "cls", "left")


def can_add(builds: DataFrame, rules: Rules) -> DataFrame:
    """BIZ1: (build, tree, talent, verdict) for every talent of a build's class: ok, or the first reason against one more point.

    Only the rows of builds are shuffled, once, by build. What a build holds is one row from then on, and each
    talent of its class is decided from that row; a build without a name counts its points but holds no talent.
    """
    named, classes = _classes(rules)
    own = builds.join(F.broadcast(named), ["cls", "tree", "talent"], "left").select("build", "cls", "no", "tree", F.when(F.col("no").isNull(), F.col("talent")).alias("talent"), "row", "page", "rank")
    own = own.repartition("build").groupBy("build", "cls", "no", "tree", "talent", "row", "page").agg(F.max("rank").cast("int").alias("rank")).filter("rank > 0")
    sums = lambda rows, holds: F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + F.when(holds(x), x["rank"]).otherwise(0))
    each = own.groupBy("build", "cls").agg(F.sum("rank").alias("points"), F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "tree", "row", "page", "rank"))).alias("all")).join(F.broadcast(classes), "cls")
    each = each.withColumn("own", F.filter("all", lambda x: F.col("build").isNotNull())).withColumn("ranks", F.map_from_entries(F.transform("own", lambda x: F.struct(x["no"], x["rank"]))))
    rank = lambda no: F.coalesce(F.try_element_at("ranks", no), F.lit(0))
    locked = lambda r: sums(F.col("own"), lambda x: (x["tree"] == r["tree"]) & (x["row"] < r["row"])) < F.col("per_row") * r["row"]
    each = each.select(  # what needs a lambda is said once a build; what is said of each talent is compiled
        "build", "points", "ranks", "max_points", F.transform(F.filter("wants", lambda n: rank(n["wanted"]) < n["least"]), lambda n: n["no"]).alias("short"),
        F.map_from_entries(F.transform("pages", lambda p: F.struct(p, sums(F.col("all"), lambda x: x["page"] == p)))).alias("on_pages"), F.transform("rows", lambda r: F.struct(r["tree"].alias("tree"), r["talents"].alias("talents"), locked(r).alias("locked"))).alias("rows"),
    )
    each = each.select("build", "points", "ranks", "max_points", "short", "on_pages", F.explode("rows").alias("r")).select("*", F.explode("r.talents").alias("t"))
    verdict = F.when(rank(F.col("t.no")) >= F.col("t.max_rank"), "maxed").when(F.col("points") >= F.col("max_points"), "no-points").when(F.coalesce(F.try_element_at("on_pages", F.col("t.page")), F.lit(0)) >= F.col("t.budget"), "page-full")
    verdict = verdict.when(F.col("r.locked"), "row-locked").when(F.array_contains("short", F.col("t.no")), "prereq").otherwise("ok")
    return each.select("build", "r.tree", F.col("t.talent").alias("talent"), verdict.alias("verdict"))


def can_remove(builds: DataFrame, rules: Rules) -> DataFrame:
    """BIZ2: (build, tree, talent, verdict) for every spent talent: ok, or the first rule that one point less breaks anew.

    A point less can only leave a deeper row of the tree with too few points above, or a talent that wants this one
    at its rank; both are told from what the build holds, without taking the point away.
    """
    own = placed(builds, rules).filter("max_rank is not null")
    x = own.select("build", "tree", F.col("talent"), F.col("rank"), F.col("row").alias("x_row"))
    y = own.select("build", "cls", "tree", F.col("talent").alias("hurt"), F.col("row").alias("y_row"), "col", "above", "per_row")
    orphan = x.join(y, ["build", "tree"]).filter((F.col("y_row") > F.col("x_row")) & (F.col("above") == F.col("per_row") * F.col("y_row"))).select("build", "tree", "talent", "y_row", "col", F.lit(0).alias("kind"))
    wants = y.join(F.broadcast(rules.needs.select("cls", "tree", F.col("talent").alias("hurt"), F.col("other").alias("talent"), "least")), ["cls", "tree", "hurt"])
    broken = x.join(wants, ["build", "tree", "talent"]).filter("rank = least").select("build", "tree", "talent", "y_row", "col", F.lit(1).alias("kind"))
    first = orphan.unionAll(broken).groupBy("build", "tree", "talent").agg(F.min(F.struct("y_row", "col", "kind")).alias("f"))
    return x.join(first, ["build", "tree", "talent"], "left").select("build", "tree", "talent", F.when(F.col("f").isNull(), "ok").when(F.col("f.kind") == 0, "would-orphan").otherwise("prereq").alias("verdict"))


def changed(builds: DataFrame, moves: DataFrame, rules: Rules) -> DataFrame:
    """BIZ5: builds after one move each, (build, tree, talent, step) with step 1 or -1, where its verdict is ok; else as they were."""
    ok = can_add(builds, rules).withColumn("step", F.lit(1)).unionAll(can_remove(builds, rules).withColumn("step", F.lit(-1))).filter("verdict = 'ok'").drop("verdict")
    done = moves.join(ok, ["build", "tree", "talent", "step"], "left_semi").join(builds.select("build", "cls").distinct(), "build")
    both = spent(builds).unionByName(done.select("build", "cls", "tree", "talent", F.col("step").alias("rank")))
    return both.groupBy("build", "cls", "tree", "talent").agg(F.sum("rank").cast("int").alias("rank")).filter("rank > 0")


def reset(builds: DataFrame, tree: str | None = None) -> DataFrame:
    """BIZ5: builds without a tree, or without anything."""
    return builds.limit(0) if tree is None else builds.filter(F.col("tree") != tree)


class Legal:
    """The rules of one class in Python, for what is repaired or filled step by step."""

    def __init__(self, talents, needs, per_row: int, most: int, budgets: dict):
        self.talents = {(t, i): (page, row, top) for t, i, page, row, top in talents}
        self.needs = {}
        for tree, talent, other, least in needs:
            self.needs.setdefault((tree, talent), []).append(((tree, other), least))
        self.per_row, self.most, self.budgets = per_row, most, budgets

    def above(self, ranks: dict, tree, row: int) -> int:
        return sum(r for (t, i), r in ranks.items() if t == tree and (t, i) in self.talents and self.talents[t, i][1] < row)

    def on_page(self, ranks: dict, page) -> int:
        return sum(r for k, r in ranks.items() if k in self.talents and self.talents[k][0] == page)

    def fault(self, ranks: dict, k) -> str | None:
        if k not in self.talents:
            return "unknown-talent"
        _, row, top = self.talents[k]
        if ranks[k] > top:
            return "maxed"
        if self.above(ranks, k[0], row) < self.per_row * row:
            return "row-locked"
        return "prereq" if any(ranks.get(o, 0) < least for o, least in self.needs.get(k, ())) else None

    def over_budget(self, ranks: dict) -> bool:
        return sum(ranks.values()) > self.most or any(self.on_page(ranks, p) > b for p, b in self.budgets.items())

    def addable(self, ranks: dict, k) -> bool:
        page, row, top = self.talents[k]
        if ranks.get(k, 0) >= top or sum(ranks.values()) >= self.most or (page in self.budgets and self.on_page(ranks, page) >= self.budgets[page]):
            return False
        return self.above(ranks, k[0], row) >= self.per_row * row and all(ranks.get(o, 0) >= least for o, least in self.needs.get(k, ()))

    def repaired(self, ranks: dict, walk: list) -> dict:
        """The first fault in walk order is cut to the talent's top or to nothing; without faults, the last point goes while a budget is broken."""
        ranks = dict(ranks)
        order = [k for k in walk if k in ranks] + [k for k in ranks if k not in set(walk)]
        while True:
            bad = next(((k, f) for k in order if k in ranks and (f := self.fault(ranks, k))), None)
            if bad:
                k, fault = bad
                if fault == "maxed":
                    ranks[k] = self.talents[k][2]
                else:
                    del ranks[k]
            elif self.over_budget(ranks):
                k = next(k for k in reversed(order) if k in ranks)
                ranks[k] -= 1
                if not ranks[k]:
                    del ranks[k]
            else:
                return ranks

    def filled(self, wanted: dict, walk: list) -> dict:
        """Points spent as a player could: three walks, each adding to every wanted talent what the rules allow by then."""
        ranks: dict = {}
        for _ in range(3):
            before = dict(ranks)
            for k in walk:
                if k in wanted and k in self.talents:
                    while ranks.get(k, 0) < min(wanted[k], self.talents[k][2]) and self.addable(ranks, k):
                        ranks[k] = ranks.get(k, 0) + 1
            if ranks == before:
                break
        return ranks


def _by_build(builds: DataFrame, rules: Rules, how: str) -> DataFrame:
    """Each build by itself in Python, many to an Arrow batch: its next step depends on the one before. The rules of all classes are a small, bounded table."""
    collect = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    talents, needs, limits, budgets = collect(rules.talents.orderBy("place"), "cls", "tree", "talent", "page", "row", "max_rank"), collect(rules.needs, "cls", "tree", "talent", "other", "least"), collect(rules.limits, "cls", "per_row", "max_points"), collect(rules.budgets, "cls", "page", "budget")
    legal = {c: Legal([t[1:] for t in talents if t[0] == c], [n[1:] for n in needs if n[0] == c], per, most, {p: b for k, p, b in budgets if k == c}) for c, per, most in limits}
    walks = {c: [t[1:3] for t in talents if t[0] == c] for c in legal}

    own = spent(builds)

    @F.pandas_udf(T.ArrayType(T.StructType([own.schema[c] for c in ("tree", "talent")] + [T.StructField("rank", T.IntegerType())])))
    def stepped(cls: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for c, ranks in zip(cls, rows, strict=True):
            got = getattr(legal[c], how)({(r["tree"], r["talent"]): int(r["rank"]) for r in ranks}, walks[c]) if c in legal else {}
            out.append([{"tree": t, "talent": i, "rank": r} for (t, i), r in got.items()])
        return pd.Series(out)

    each = own.groupBy("build", "cls").agg(F.array_sort(F.collect_list(F.struct("tree", "talent", "rank"))).alias("rows"))
    return each.select("build", "cls", F.explode(stepped("cls", "rows")).alias("e")).select("build", "cls", "e.*")


def sanitised(builds: DataFrame, rules: Rules) -> DataFrame:
    """BIZ4, SRT10: legal builds, faults cut in walk order, then points from the end of the walk while over budget."""
    return _by_build(builds, rules, "repaired")


def imported(wanted: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """BIZ10, J35: (builds that spend what is wanted as far as the rules allow, what is left out and why).

    wanted: (build, cls, name, rank), matched to the first talent of a class (by place) with that name, squashed;
    rules.talents has the names. Reasons: not-there, fewer-ranks, rules.
    """
    from ..functions.text import squashed_name

    first = rules.talents.groupBy("cls", squashed_name(F.col("name")).alias("key")).agg(F.min_by(F.struct("tree", "talent", "max_rank"), "place").alias("t"))
    w = wanted.withColumn("key", squashed_name(F.col("name"))).join(F.broadcast(first), ["cls", "key"], "left")
    lost = w.filter("t is null").select("build", "name", F.col("rank").alias("requested"), F.lit(0).alias("kept"), F.lit("not-there").alias("reason"))
    own = w.filter("t is not null").select("build", "cls", "t.tree", "t.talent", "rank", "name", "t.max_rank")
    got = _by_build(own, rules, "filled")
    short = own.join(got.withColumnRenamed("rank", "kept"), ["build", "cls", "tree", "talent"], "left").withColumn("kept", F.coalesce("kept", F.lit(0))).filter("kept < rank")
    why = F.when((F.col("rank") > F.col("max_rank")) & (F.col("kept") == F.col("max_rank")), "fewer-ranks").otherwise("rules")
    return got, lost.unionAll(short.select("build", "name", F.col("rank").alias("requested"), "kept", why.alias("reason")))


def decoded(codes: DataFrame, rules: Rules, order: DataFrame, steps: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """BIZ7-9, J34: (builds, notices) of codes (build, cls, code, version) of any version up to the current one.

    order: (version, cls, seg, tree, pos, talent), the positions of a version; steps: (from, cls, old, new, to_tree), new
    null where a talent was removed. Notices: (build, kind, n), kind being unknown-version, bad-string, unknown-talent, clamped or adjusted.
    """
    known = order.select("version", "cls").distinct().withColumn("known", F.lit(True))
    c = codes.join(F.broadcast(known), ["version", "cls"], "left")
    note = lambda df, kind, n: df.select("build", F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    bad = F.col("known") & ~F.col("code").rlike("^[0-9-]*$")
    notices = note(c.filter("known is null"), "unknown-version", F.lit(0)).unionAll(note(c.filter(bad), "bad-string", F.lit(0)))
    own = c.filter(F.col("known") & F.col("code").rlike("^[0-9-]*$"))
    segs = own.select("build", "cls", "version", F.posexplode(F.split("code", "-")).alias("seg", "own")).filter("own <> ''")
    digits = segs.select("build", "cls", "version", "seg", F.posexplode(F.split("own", "")).alias("pos", "d")).select("*", F.col("d").cast("int").alias("rank")).filter("rank > 0")
    at = digits.join(F.broadcast(order), ["version", "cls", "seg", "pos"], "left")
    lost = at.filter("talent is null").groupBy("build").agg(F.sum("rank").alias("n"))
    rows = at.filter("talent is not null").select("build", "cls", "version", "tree", "talent", "rank")
    for v in range(1, version):  # one join a version, whatever the number of builds
        s = steps.filter(F.col("from") == v).select("cls", F.col("old").alias("talent"), "new", "to_tree", F.lit(True).alias("step"))
        moved = rows.filter(F.col("version") == v).join(F.broadcast(s), ["cls", "talent"], "left").filter("step is null or new is not null")
        moved = moved.select("build", "cls", F.lit(v + 1).alias("version"), F.coalesce("to_tree", "tree").alias("tree"), F.coalesce("new", "talent").alias("talent"), "rank")
        rows = rows.filter(F.col("version") != v).unionByName(moved)
    one = rules.talents.groupBy("cls", "talent").agg(F.min_by(F.struct("tree", "max_rank"), "place").alias("t"))
    rows = rows.join(F.broadcast(one), ["cls", "talent"], "left")
    gone = rows.filter("t is null").groupBy("build").agg(F.sum("rank").alias("n"))
    over = rows.filter("rank > t.max_rank").groupBy("build").agg(F.count("*").alias("n"))
    builds = rows.filter("t is not null").select("build", "cls", "t.tree", "talent", F.least("rank", "t.max_rank").alias("rank"))
    legal = sanitised(builds, rules)
    points = lambda df, name: df.groupBy("build").agg(F.sum("rank").alias(name))
    cut = points(builds, "was").join(points(legal, "now"), "build", "left").withColumn("n", F.col("was") - F.coalesce("now", F.lit(0))).filter("n > 0")
    notices = notices.unionAll(note(lost, "unknown-talent", F.col("n"))).unionAll(note(gone, "unknown-talent", F.col("n"))).unionAll(note(over, "clamped", F.col("n"))).unionAll(note(cut, "adjusted", F.col("n")))
    return legal, notices
