"""Rules VS2 to VS16 over spell documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_defects
from .common import REVIEW_BELOW, SLUG, SOURCE, all_of, error, is_sorted, needs_review, over, seen_before, source_fields, warning
from .races import _at, classic, icons

TOOLTIP = f"struct<description:string,footer:string,rank:int,source:{SOURCE}>"
SPELL = f"struct<id:string,name:string,kind:string,tab:string,ranksSeen:array<int>,icon:string,iconSource:string,iconCrop:string,classic:struct<status:string,classicName:string,note:string>,tags:array<string>,tooltips:array<{TOOLTIP}>,source:{SOURCE}>"
COVERAGE = "struct<tabsSeen:array<string>,tabsMissing:array<string>,entriesRead:int,tooltipsRead:int,observedLevel:int,showAllSpellRanks:string>"
SCHEMA = f"class string, stem string, observedLevel int, tabs array<struct<id:string,order:int>>, spells array<{SPELL}>, coverage {COVERAGE}, complete boolean, notes array<string>"
PUBLISH_FROM, PAGE_CAPACITY = 0.5, 21


def _spells(*rules) -> Column:
    return over(F.col("spells"), *rules)


def _tips(rule) -> Column:
    """Findings of rule (spell, tooltip, path) on every tooltip."""
    return _spells(lambda s, i: over(s["tooltips"], lambda t, j: rule(s, t, F.concat(_at("spells", i), F.lit("/tooltips/"), j.cast("string")))))


def _list(items: Column) -> Column:
    return F.coalesce(items, F.array())


def ids() -> Column:
    """VS2."""
    return all_of(error(~F.col("class").eqNullSafe(F.col("stem")), "CLASS-FILENAME", F.lit("/class")), _spells(lambda s, i: error(~F.coalesce(s["id"], F.lit("")).rlike(SLUG), "BAD-ID", _at("spells", i))))


def unique_spells() -> Column:
    """VS3: one record for each spell and set of ranks."""
    spells = F.col("spells")
    ranks = lambda s: F.array_sort(F.coalesce(s["ranksSeen"], F.array().cast("array<int>")))
    return _spells(lambda s, i: error(seen_before(spells, i, lambda o: o["id"].eqNullSafe(s["id"]) & (ranks(o) == ranks(s))), "DUPLICATE-SPELL", _at("spells", i)))


def tabs() -> Column:
    """VS4."""
    orders, ids_ = F.transform("tabs", lambda t: t["order"]), F.coalesce(F.transform("tabs", lambda t: t["id"]), F.array().cast("array<string>"))
    return all_of(
        error((F.size(orders) > 0) & (F.array_sort(orders) != F.sequence(F.lit(0), F.greatest(F.size(orders) - 1, F.lit(0)))), "TAB-ORDER", F.lit("/tabs")),
        _spells(lambda s, i: error(s["tab"].isNotNull() & ~F.array_contains(ids_, s["tab"]), "UNKNOWN-TAB", _at("spells", i)), lambda s, i: error(s["tab"].isNull() & (F.coalesce(s["source"]["note"], F.lit("")) == ""), "NO-TAB-NOTE", _at("spells", i))),
    )


def coverage() -> Column:
    """VS5: the coverage block against what the document holds (AGG28)."""
    c, none = F.col("coverage"), F.array().cast("array<string>")
    seen, lost = F.coalesce(c["tabsSeen"], none), F.coalesce(c["tabsMissing"], none)
    own = F.coalesce(F.transform("tabs", lambda t: t["id"]), none)
    tips = F.aggregate("spells", F.lit(0), lambda n, s: n + F.coalesce(F.size(s["tooltips"]), F.lit(0)))
    differ = (F.size(F.array_except(seen, own)) > 0) | (F.size(F.array_except(own, seen)) > 0)
    return all_of(
        error(differ, "COVERAGE-TABS", F.lit("/coverage/tabsSeen")), error(F.arrays_overlap(seen, lost), "COVERAGE-TABS", F.lit("/coverage/tabsMissing")),
        error(~c["entriesRead"].eqNullSafe(F.size("spells")), "COVERAGE-COUNT", F.lit("/coverage/entriesRead")), error(~c["tooltipsRead"].eqNullSafe(tips), "COVERAGE-COUNT", F.lit("/coverage/tooltipsRead")),
        error(~c["observedLevel"].eqNullSafe(F.col("observedLevel")), "COVERAGE-LEVEL", F.lit("/coverage/observedLevel")),
        error(~is_sorted(seen), "COVERAGE-UNSORTED", F.lit("/coverage/tabsSeen")), error(~is_sorted(lost), "COVERAGE-UNSORTED", F.lit("/coverage/tabsMissing")),
    )


def shows_all_ranks() -> Column:
    """AGG29: whether a spell is listed at two ranks or more."""
    ids_ = F.transform("spells", lambda s: s["id"])
    return F.exists("spells", lambda s: F.coalesce(F.size(s["ranksSeen"]) > 1, F.lit(False))) | (F.size(F.array_distinct(ids_)) < F.size(ids_))


def ranks() -> Column:
    """VS6."""
    on = F.col("coverage")["showAllSpellRanks"].eqNullSafe("on")
    return all_of(
        _spells(
            lambda s, i: error(~is_sorted(s["ranksSeen"]), "RANKS-UNSORTED", _at("spells", i, "/ranksSeen")),
            lambda s, i: warning(s["ranksSeen"].isNotNull() & s["kind"].isin("passive", "racial-passive"), "RANK-ON-PASSIVE", _at("spells", i)),
        ),
        error(shows_all_ranks() != on, "SHOW-ALL-RANKS", F.lit("/coverage/showAllSpellRanks")),
    )


def sources() -> Column:
    """VS8."""
    return all_of(
        _spells(lambda s, i: source_fields(s["source"], "SOURCE-FIELDS", _at("spells", i, "/source")), lambda s, i: error(s["source"]["panel"] != "spell-list", "SOURCE-PANEL", _at("spells", i, "/source"))),
        _tips(lambda s, t, at: F.concat(source_fields(t["source"], "SOURCE-FIELDS", F.concat(at, F.lit("/source"))), error(~t["source"]["panel"].eqNullSafe("tooltip"), "SOURCE-PANEL", F.concat(at, F.lit("/source"))))),
    )


def completeness() -> Column:
    """VS10."""
    whole = F.coalesce("complete", F.lit(False))
    return all_of(error(whole & (F.size(F.col("coverage")["tabsMissing"]) > 0), "COMPLETE-MISSING-TABS", F.lit("/complete")), error(~whole & ~F.coalesce(F.size("notes") > 0, F.lit(False)), "INCOMPLETE-UNEXPLAINED", F.lit("/notes")))


def tooltips() -> Column:
    """VS11."""
    defects = lambda text, at: over(text_defects(text), lambda d, _: warning(F.lit(True), "TEXT-HYGIENE", at))
    return _tips(
        lambda s, t, at: F.concat(
            defects(F.coalesce(t["description"], F.lit("")), F.concat(at, F.lit("/description"))), defects(F.coalesce(t["footer"], F.lit("")), F.concat(at, F.lit("/footer"))),
            error(F.trim(F.coalesce(t["description"], F.lit(""))) == "", "TOOLTIP-EMPTY", at), error((F.size(s["ranksSeen"]) > 0) & ~F.array_contains(s["ranksSeen"], t["rank"]), "TOOLTIP-RANK", at),
        )
    )


def confidence() -> Column:
    """VS13: list rows and tooltips."""
    return all_of(_spells(lambda s, i: needs_review(s["source"], _at("spells", i))), _tips(lambda s, t, at: needs_review(t["source"], at)))


def kinds() -> Column:
    """VS14."""
    return _spells(
        lambda s, i: warning(s["name"].rlike(r"(?i)\brank\s*[0-9]"), "RANK-IN-NAME", _at("spells", i)),
        lambda s, i: warning(s["name"].rlike(r"(?i)[\s(]\(?(racial\s+passive|racial|passive)\)?\s*$"), "KIND-IN-NAME", _at("spells", i)),
    )


def counts(docs: DataFrame, most: int = PAGE_CAPACITY) -> DataFrame:
    """VS15: tabs with more entries than a page holds."""
    n = docs.select("class", F.explode("spells").alias("s")).filter("s.tab <> ''").groupBy("class", "s.tab").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > most).select("class", F.lit("WARNING").alias("level"), F.lit("TAB-OVER-CAPACITY").alias("code"), F.lit("/spells").alias("path"))


def publishable() -> Column:
    """VS16: what an unreviewed video record needs."""
    s_ = lambda s: s["source"]
    open_ = lambda s: ~F.coalesce(s_(s)["reviewed"], F.lit(False)) & (s_(s)["kind"] == "video")
    return _spells(
        lambda s, i: error(open_(s) & (s_(s)["confidence"] < PUBLISH_FROM), "UNPUBLISHABLE", _at("spells", i)), lambda s, i: error(open_(s) & (F.coalesce(s_(s)["crop"], F.lit("")) == ""), "UNPUBLISHABLE", _at("spells", i)),
        lambda s, i: error(open_(s) & s_(s)["frame"].isNull(), "UNPUBLISHABLE", _at("spells", i)), lambda s, i: error(open_(s) & (s_(s)["confidence"] < REVIEW_BELOW) & F.array_contains(s["tags"], "new"), "UNPUBLISHABLE", _at("spells", i)),
    )


def in_document() -> list[Column]:
    return [ids(), unique_spells(), tabs(), coverage(), ranks(), classic("spells", {"new": "new"}, True), sources(), icons("spells"), completeness(), tooltips(), confidence(), kinds(), publishable()]
