"""Rules VR1 to VR15 over race documents, and VRM over the matrix of races and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLUG, SOURCE, all_of, blank_ends, error, findings, is_sorted, needs_review, over, seen_before, source_fields, warning

TRAIT = f"struct<id:string,name:string,kind:string,order:int,variants:array<string>,description:string,icon:string,iconSource:string,iconCrop:string,classic:struct<status:string,classicName:string,note:string>,tags:array<string>,source:{SOURCE}>"
VARIANT = "struct<id:string,faction:string,classes:array<string>,lore:string,loreComplete:boolean>"
SCHEMA = f"race string, stem string, schemaVersion int, faction string, variants array<{VARIANT}>, classes array<string>, classesSource {SOURCE}, lore string, loreComplete boolean, loreSource {SOURCE}, traits array<{TRAIT}>, complete boolean, notes array<string>"
MATRIX = "race string, faction string, classes array<string>, byVariant map<string,array<string>>, observed boolean"


def _at(name: str, i: Column, *rest: str) -> Column:
    return F.concat(F.lit(f"/{name}/"), i.cast("string"), *[F.lit(r) for r in rest])


def _traits(*rules) -> Column:
    return over(F.col("traits"), *rules)


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def ids(known: list[str], version: int = 1) -> Column:
    """VR1, VR2."""
    bad = lambda name: (lambda x, i: error(~F.coalesce(x["id"], F.lit("")).rlike(SLUG), "BAD-ID", _at(name, i)))
    return all_of(
        error(~F.col("schemaVersion").eqNullSafe(F.lit(version)), "SCHEMA-VERSION", F.lit("/")),
        error(~F.col("race").eqNullSafe(F.col("stem")), "RACE-FILENAME", F.lit("/race")), warning(~F.coalesce(F.col("race").isin(*known), F.lit(False)), "UNKNOWN-RACE", F.lit("/race")),
        _traits(bad("traits")), over(F.col("variants"), bad("variants")),
    )


def unique_traits() -> Column:
    """VR3."""
    traits = F.col("traits")
    orders = F.array_sort(F.array_distinct(F.filter(F.transform(traits, lambda t: t["order"]), lambda o: o.isNotNull())))
    return all_of(
        _traits(
            lambda t, i: error(seen_before(traits, i, lambda o: o["id"].eqNullSafe(t["id"])), "DUPLICATE-TRAIT", _at("traits", i)),
            lambda t, i: error(seen_before(traits, i, lambda o: o["order"] == t["order"]), "DUPLICATE-ORDER", _at("traits", i)),
        ),
        warning((F.size(orders) > 0) & (orders != F.sequence(F.lit(0), F.greatest(F.size(orders) - 1, F.lit(0)))), "ORDER-GAPS", F.lit("/traits")),
    )


def variants() -> Column:
    """VR4."""
    own = _some(F.col("variants"))
    factions = F.transform("variants", lambda v: F.coalesce(v["faction"], F.lit("")))
    ids_ = F.coalesce(F.transform("variants", lambda v: v["id"]), F.array().cast("array<string>"))
    return all_of(
        error(own & (F.size(F.array_distinct(factions)) != F.size(factions)), "VARIANT-FACTIONS", F.lit("/variants")), warning(own & ~F.col("faction").eqNullSafe("neutral"), "VARIANT-FACTION-TOP", F.lit("/faction")),
        _traits(lambda t, i: error(own != _some(t["variants"]), "TRAIT-VARIANTS", _at("traits", i)), lambda t, i: over(t["variants"], lambda v, _: error(~F.array_contains(ids_, v), "UNKNOWN-VARIANT", _at("traits", i)))),
    )


def classes(known: list[str]) -> Column:
    """VR5, AGG34: sorted, known, and the union over the variants."""
    own = F.coalesce("classes", F.array().cast("array<string>"))
    union = F.array_sort(F.array_distinct(F.flatten(F.transform("variants", lambda v: F.coalesce(v["classes"], F.array().cast("array<string>"))))))
    return all_of(
        error(~is_sorted(own), "CLASSES-UNSORTED", F.lit("/classes")), error(F.exists(own, lambda c: ~c.isin(*known)), "UNKNOWN-CLASS", F.lit("/classes")),
        error(_some(F.col("variants")) & (union != F.array_sort(F.array_distinct(own))), "CLASSES-UNION", F.lit("/classes")), warning(F.size(own) == 0, "NO-CLASSES", F.lit("/classes")),
    )


def descriptions() -> Column:
    """VR6."""
    return _traits(
        lambda t, i: warning(t["description"].isNull(), "NO-DESCRIPTION", _at("traits", i)),
        lambda t, i: error(t["description"].isNull() & (F.coalesce(t["source"]["note"], F.lit("")) == ""), "NO-DESCRIPTION-NOTE", _at("traits", i)),
        lambda t, i: warning(blank_ends(t["description"]), "TEXT-HYGIENE", _at("traits", i)), lambda t, i: warning(t["description"].rlike(r"[|\\~]"), "TEXT-HYGIENE", _at("traits", i)),
    )


def classic(items: str, want: dict[str, str], note: bool) -> Column:
    """VR7, VS7: status, counterpart and tags agree; note: every block needs one."""
    named = lambda x: F.coalesce(x["classic"]["classicName"], F.lit("")) != ""
    tag = lambda x: F.coalesce(*[F.when(x["classic"]["status"] == s, F.lit(t)) for s, t in want.items()])
    rules = [
        lambda x, i: error((x["classic"]["status"] == "new") & named(x), "CLASSIC-NEW", _at(items, i)), lambda x, i: error(x["classic"]["status"].isin("same", "changed") & ~named(x), "CLASSIC-MATCH", _at(items, i)),
        lambda x, i: warning(tag(x).isNotNull() & ~F.array_contains(F.coalesce(x["tags"], F.array().cast("array<string>")), tag(x)), "TAG-MISMATCH", _at(items, i)),
    ]
    if note:
        rules.append(lambda x, i: error(F.coalesce(x["classic"]["note"], F.lit("")) == "", "CLASSIC-NOTE", _at(items, i)))
    return over(F.col(items), *rules)


def sources() -> Column:
    """VR8."""
    top = [F.when(F.col(k).isNotNull(), source_fields(F.col(k), "SOURCE-FIELDS", F.lit(f"/{k}"))) for k in ("classesSource", "loreSource")]
    return all_of(*top, _traits(lambda t, i: source_fields(t["source"], "SOURCE-FIELDS", _at("traits", i, "/source")), lambda t, i: warning((t["source"]["panel"] == "spellbook-general") & (F.coalesce(t["description"], F.lit("")) != ""), "PANEL-DESCRIPTION", _at("traits", i))))


def icons(items: str) -> Column:
    """VR9, VS9, but for whether files exist: see common.missing_files."""
    crop = lambda x: F.coalesce(x["iconSource"] == "crop", F.lit(False))
    has = lambda x: F.coalesce(x["iconCrop"], F.lit("")) != ""
    return over(F.col(items), lambda x, i: error(crop(x) != has(x), "ICON-CROP", _at(items, i)), lambda x, i: warning(crop(x) & (F.coalesce(x["icon"], F.lit("")) != "") & (x["icon"] != F.concat(F.lit("crop-"), x["id"])), "ICON-NAME", _at(items, i)))


def named_files(docs: DataFrame, name: str, items: str) -> DataFrame:
    """SET8: (doc, path, file) that the elements of a document name."""
    x = docs.select(F.col(name).alias("doc"), F.posexplode(items).alias("i", "x"))
    at = F.concat(F.lit(f"/{items}/"), F.col("i").cast("string"))
    return x.select("doc", F.explode(F.array(F.struct(F.concat(at, F.lit("/source/crop")).alias("path"), F.col("x.source.crop").alias("file")), F.struct(F.concat(at, F.lit("/iconCrop")).alias("path"), F.when(F.col("x.iconSource") == "crop", F.col("x.iconCrop")).alias("file")))).alias("f")).select("doc", "f.*").filter("file <> ''")


def completeness() -> Column:
    """VR10."""
    told = F.coalesce(F.exists("notes", lambda n: n.contains("scroll") | n.contains("not")), F.lit(False))
    whole = F.coalesce("complete", F.lit(False))
    return all_of(error(whole & ~_some(F.col("traits")), "COMPLETE-EMPTY", F.lit("/complete")), warning(~whole & ~told, "INCOMPLETE-UNEXPLAINED", F.lit("/notes")))


def lore() -> Column:
    """VR11."""
    has = F.coalesce("lore", F.lit("")) != ""
    return all_of(
        error(has & F.col("loreComplete").isNull(), "LORE-COMPLETE", F.lit("/lore")), error(has & F.col("loreSource").isNull(), "LORE-SOURCE", F.lit("/lore")),
        over(F.col("variants"), lambda v, i: error((F.coalesce(v["lore"], F.lit("")) != "") & v["loreComplete"].isNull(), "LORE-COMPLETE", _at("variants", i))),
    )


def not_canonical(raw: Column, canonical: Column, check: bool = False) -> Column:
    """VR12, VS12: the bytes of a file against its canonical text (sinks.document_text)."""
    return (error if check else warning)(raw != canonical, "NOT-CANONICAL", F.lit("/"))


def confidence() -> Column:
    """VR13."""
    return _traits(lambda t, i: needs_review(t["source"], _at("traits", i)))


def review_rows(docs: DataFrame) -> DataFrame:
    """VR13's queue: every unreviewed trait."""
    t = docs.select("race", F.explode("traits").alias("t")).filter(~F.coalesce("t.source.reviewed", F.lit(False)))
    return t.select("race", F.col("t.id").alias("trait"), F.col("t.name").alias("name"), F.col("t.source.confidence").alias("confidence"), F.col("t.classic.status").alias("status"))


def kinds() -> Column:
    """VR14."""
    return _traits(lambda t, i: warning(F.lower(t["name"]).contains("(passive"), "KIND-IN-NAME", _at("traits", i)))


def counts(least: int = 3, most: int = 8) -> Column:
    """VR15."""
    return warning(F.coalesce("complete", F.lit(False)) & ~F.coalesce(F.size("traits"), F.lit(0)).between(least, most), "TRAIT-COUNT", F.lit("/traits"))


def in_document(known_races: list[str], known_classes: list[str]) -> list[Column]:
    want = {"new": "new", "changed": "reworked", "same": "classic-unchanged"}
    return [ids(known_races), unique_traits(), variants(), classes(known_classes), descriptions(), classic("traits", want, False), sources(), icons("traits"), completeness(), lore(), confidence(), kinds(), counts()]


def matrix(rows: DataFrame, races: DataFrame) -> DataFrame:
    """VRM: matrix rows (MATRIX) against race documents; a race's rows beyond the first by class list are duplicates."""
    own = F.coalesce("classes", F.array().cast("array<string>"))
    union = F.array_sort(F.array_distinct(F.flatten(F.map_values("byVariant"))))
    there = races.select("race", F.col("faction").alias("doc_faction"), F.coalesce("classes", F.array().cast("array<string>")).alias("doc_classes"), F.lit(True).alias("there"))
    many = rows.groupBy("race").agg(F.count("*").alias("times"))
    path = F.concat(F.lit("/races/"), F.col("race"))
    known = F.col("there").isNotNull()
    found = findings(
        rows.join(there, "race", "left"), "race",
        error(~is_sorted(own), "CLASSES-UNSORTED", path), error(F.col("observed") != (F.size(own) > 0), "OBSERVED", path), error((F.size("byVariant") > 0) & (union != own), "CLASSES-UNION", path),
        error(~known, "MISSING-RACE-FILE", path), error(known & (F.col("doc_classes") != own), "MATRIX-MISMATCH", path), error(known & ~F.col("doc_faction").eqNullSafe(F.col("faction")), "MATRIX-MISMATCH", path),
    )
    again = many.filter("times > 1").select("race", F.explode(F.array_repeat(F.struct(F.lit("ERROR").alias("level"), F.lit("DUPLICATE-RACE").alias("code"), path.alias("path")), (F.col("times") - 1).cast("int"))).alias("f")).select("race", "f.*")
    lost = races.select("race").distinct().join(rows.select("race"), "race", "left_anti").select("race", F.lit("ERROR").alias("level"), F.lit("MATRIX-INCOMPLETE").alias("code"), F.lit("/races").alias("path"))
    return found.unionAll(again).unionAll(lost)
