"""Rules V1 to V20 over class documents, and overrides of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions.text import RFC3339
from .common import REVIEW_BELOW, SLUG, SOURCE, all_of, blank_ends, error, findings, over, seen_before, slugs, warning, yes

TALENT = f"struct<id:string,name:string,row:int,col:int,maxRank:int,icon:string,iconSource:string,iconCrop:string,description:string,ranks:array<struct<text:string,slots:array<double>>>,ranksObserved:array<int>,ranksSource:string,ranksNote:string,ranksPrior:struct<id:int,spells:array<int>>,requires:array<struct<talent:string,rank:int>>,spellIds:array<int>,source:{SOURCE}>"
TREE = f"struct<id:string,page:string,order:int,rows:int,cols:int,source:{SOURCE},talents:array<{TALENT}>>"
SCHEMA = f"class string, stem string, schemaVersion int, dataVersion int, generatedAt string, rules struct<pointsPerRow:int,maxPoints:int,firstPointLevel:int,maxLevel:int,pointsPerPage:map<string,int>>, pages array<struct<id:string>>, trees array<{TREE}>"
VIDEO, DATAMINED = ("video", "t", "frame", "crop", "confidence", "reader"), ("build", "talentId")


def _path(tree: Column, talent: Column | None = None) -> Column:
    return F.concat_ws("/", F.col("class"), tree["id"], *([talent["id"]] if talent is not None else []))


def _talents(*rules) -> Column:
    """Findings of rules (tree, talent, talents of the tree, place) over every talent."""
    return over(F.col("trees"), lambda tree, _: over(tree["talents"], *[(lambda t, i, r=r: r(tree, t, tree["talents"], i)) for r in rules]))


def _every() -> Column:
    """All talents of the document with their tree."""
    return F.flatten(F.transform("trees", lambda tree: F.transform(tree["talents"], lambda t: F.struct(tree["id"].alias("tree"), t["id"].alias("id")))))


def schema_version(known: int = 1) -> Column:
    """V1, beyond the types that reading with SCHEMA enforces."""
    return error(~F.col("schemaVersion").eqNullSafe(F.lit(known)), "R01-SCHEMA-VERSION", F.col("stem"))


def ids(known: list[str]) -> Column:
    """V2."""
    return all_of(
        error(~F.col("class").eqNullSafe(F.col("stem")), "R02-CLASS-STEM", F.col("stem")),
        warning(~F.col("class").isin(*known), "UNKNOWN-CLASS", F.col("stem")),
        slugs(F.col("class"), "R02-SLUG", F.col("stem")),
        over(F.col("pages"), lambda p, _: slugs(p["id"], "R02-SLUG", F.concat(F.col("class"), F.lit("/pages")))),
        over(F.col("trees"), lambda tree, _: slugs(tree["id"], "R02-SLUG", _path(tree))),
        _talents(lambda tree, t, *_: slugs(t["id"], "R02-SLUG", _path(tree, t)), lambda tree, t, *_: over(t["requires"], lambda r, _i: slugs(r["talent"], "R02-SLUG", _path(tree, t)))),
    )


def level_cap() -> Column:
    """V3."""
    r, page_ids = F.col("rules"), F.transform("pages", lambda p: p["id"])
    path = F.concat(F.col("class"), F.lit("/rules"))
    return all_of(
        error(r["firstPointLevel"] - 1 + r["maxPoints"] > r["maxLevel"], "R03-RULES", path),
        over(F.map_keys(r["pointsPerPage"]), lambda k, _: error(~F.array_contains(page_ids, k), "R03-POINTS-PER-PAGE", path)),
    )


def pages_and_trees() -> Column:
    """V4."""
    pages, trees = F.col("pages"), F.col("trees")
    return all_of(
        over(pages, lambda p, i: error(seen_before(pages, i, lambda q: q["id"] == p["id"]), "R04-PAGE-DUP", F.concat(F.col("class"), F.lit("/pages")))),
        over(
            trees,
            lambda x, i: error(seen_before(trees, i, lambda y: y["id"] == x["id"]), "R04-TREE-DUP", _path(x)),
            lambda x, _: error(~F.exists(pages, lambda p: p["id"] == x["page"]), "R04-TREE-PAGE", _path(x)),
            lambda x, i: error(seen_before(trees, i, lambda y: (y["page"] == x["page"]) & (y["order"] == x["order"])), "R04-TREE-ORDER", _path(x)),
        ),
    )


def cells() -> Column:
    """V5."""
    every = _every()
    return all_of(
        over(every, lambda e, i: error(seen_before(every, i, lambda o: o["id"] == e["id"]), "R05-ID-DUP", F.concat_ws("/", F.col("class"), e["tree"], e["id"]))),
        _talents(
            lambda tree, t, all_, i: error(seen_before(all_, i, lambda o: (o["row"] == t["row"]) & (o["col"] == t["col"])), "R05-CELL-DUP", _path(tree, t)),
            lambda tree, t, *_: error(t["row"] >= tree["rows"], "R05-ROW", _path(tree, t)),
            lambda tree, t, *_: error(t["col"] >= tree["cols"], "R05-COL", _path(tree, t)),
        ),
    )


def ranks() -> Column:
    """V6."""
    slots = lambda t: num.placeholders(t["description"])
    want = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return _talents(
        lambda tree, t, *_: error(F.regexp_replace(t["description"], r"\{[0-9]+\}", "").rlike("[{}]"), "R06-BRACES", _path(tree, t)),
        lambda tree, t, *_: error(slots(t) != want(F.size(slots(t))), "R06-PLACEHOLDERS", _path(tree, t)),
        lambda tree, t, *_: error(F.size(t["ranks"]) != t["maxRank"], "R06-RANKS-LEN", _path(tree, t)),
        lambda tree, t, *_: over(
            t["ranks"],
            lambda r, _i: error(r["slots"].isNotNull() & (F.size(r["slots"]) != F.size(slots(t))), "R06-SLOTS", _path(tree, t)),
            lambda r, _i: error(r["text"].rlike(r"\{[0-9]+\}"), "R06-STRING-RANK", _path(tree, t)),
            lambda r, _i: error(r["text"].isNull() & r["slots"].isNull(), "R06-RANK-TYPE", _path(tree, t)),
        ),
    )


def rank_sources() -> Column:
    """V7, but for what the prior knows: see :func:`against_prior`."""
    obs = lambda t: t["ranksObserved"]
    covers = lambda t: F.array_sort(F.array_distinct(obs(t))) == F.sequence(F.lit(1), F.greatest(t["maxRank"], F.lit(1)))
    return _talents(
        lambda tree, t, *_: error(obs(t) != F.array_sort(F.array_distinct(obs(t))), "R07-OBSERVED-ORDER", _path(tree, t)),
        lambda tree, t, *_: error(F.exists(obs(t), lambda r: (r < 1) | (r > t["maxRank"])), "R07-OBSERVED-RANGE", _path(tree, t)),
        lambda tree, t, *_: error((t["ranksSource"] == "observed") != covers(t), "R07-OBSERVED-IFF", _path(tree, t)),
        lambda tree, t, *_: error((t["ranksSource"] == "classic-prior") != t["ranksPrior"].isNotNull(), "R07-PRIOR-IFF", _path(tree, t)),
        lambda tree, t, *_: error((t["ranksSource"] == "manual") & (F.coalesce(t["ranksNote"], F.lit("")) == ""), "R07-MANUAL-NOTE", _path(tree, t)),
    )


def requirements() -> Column:
    """V8, but for cycles: see :func:`requirement_edges`."""

    def one(tree, t, all_, _):
        def rule(r, _i):
            target = F.get(F.filter(all_, lambda o: o["id"] == r["talent"]), -1 + F.size(F.filter(all_, lambda o: o["id"] == r["talent"])))
            other = yes(r["talent"] != t["id"])
            known = other & target.isNotNull()
            path = _path(tree, t)
            return F.concat(
                error(r["talent"] == t["id"], "R08-SELF", path), error(other & target.isNull(), "R08-TARGET", path), error(known & (target["row"] > t["row"]), "R08-ROW", path),
                error(known & (target["row"] == t["row"]) & (target["col"] == t["col"]), "R08-CELL", path), error(known & (r["rank"] > target["maxRank"]), "R08-RANK", path),
            )

        return F.concat(error(F.size(t["requires"]) == 0, "R08-EMPTY", _path(tree, t)), error(F.size(t["requires"]) > 3, "R08-COUNT", _path(tree, t)), over(t["requires"], rule))

    return _talents(one)


def requirement_edges(docs: DataFrame) -> DataFrame:
    """(a, b): talents of one tree that name each other, as paths; for graph.on_cycles."""
    t = docs.select("class", F.explode("trees").alias("tree")).select("class", F.col("tree.id").alias("tree"), F.explode("tree.talents").alias("t"))
    own = F.concat_ws("/", "class", "tree", "t.id")
    return t.select(own.alias("a"), F.explode("t.requires").alias("r"), "class", "tree").select("a", F.concat_ws("/", "class", "tree", "r.talent").alias("b")).distinct()


def icons() -> Column:
    """V9, but for whether files exist: see common.missing_files and :func:`named_files`."""
    crop = lambda t: t["iconSource"] == "crop"
    return _talents(
        lambda tree, t, *_: error(crop(t) != t["iconCrop"].isNotNull(), "R09-ICONCROP-IFF", _path(tree, t)),
        lambda tree, t, *_: error(crop(t) & (t["icon"] != F.concat(F.lit("crop-"), t["id"])), "R09-ICON-SLUG", _path(tree, t)),
    )


def named_files(docs: DataFrame) -> DataFrame:
    """SET8: (doc, path, file) of every file that a document names: crops of icons and of video sources."""
    t = docs.select("class", F.explode("trees").alias("tree")).select("class", "tree", F.explode("tree.talents").alias("t"))
    path = F.concat_ws("/", "class", "tree.id", "t.id")
    video = lambda s: F.when(F.col(f"{s}.kind") == "video", F.col(f"{s}.crop"))
    trees = docs.select(F.col("class").alias("doc"), F.explode("trees").alias("tree")).select("doc", F.concat_ws("/", "doc", "tree.id").alias("path"), video("tree.source").alias("file"))
    return trees.unionAll(t.select(F.col("class").alias("doc"), path.alias("path"), F.explode(F.array("t.iconCrop", video("t.source"))).alias("file"))).filter("file is not null")


def source_rule(src: Column, path: Column) -> Column:
    """V10 on one source."""
    some, none = (lambda names: _any(src, names)), (lambda names: _lacks(src, names))
    video, mined = src["kind"] == "video", src["kind"] == "datamined"
    reviewed, by = F.coalesce(src["reviewed"], F.lit(False)), (src["reviewedBy"].isNotNull(), src["reviewedAt"].isNotNull())
    return F.when(src.isNull(), F.array().cast("array<struct<level:string,code:string,path:string>>")).otherwise(
        F.concat(
            error(F.when(video, none(VIDEO)).otherwise(some(VIDEO)), "R10-SOURCE-VIDEO", path), error(F.when(mined, none(DATAMINED)).otherwise(some(DATAMINED)), "R10-SOURCE-DATAMINED", path),
            error(F.when(reviewed, ~(by[0] & by[1])).otherwise(by[0] | by[1]), "R10-REVIEWED", path), error(~src["reviewedAt"].rlike(RFC3339), "R10-REVIEWED-AT", path),
            warning((src["kind"] == "manual") & ~reviewed, "MANUAL-UNREVIEWED", path),
        )
    )


def _any(src: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | src[n].isNotNull()
    return out


def _lacks(src: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | src[n].isNull()
    return out


def sources() -> Column:
    """V10."""
    return all_of(
        over(F.col("trees"), lambda tree, _: source_rule(tree["source"], _path(tree))),
        _talents(lambda tree, t, *_: source_rule(t["source"], _path(tree, t)), lambda tree, t, *_: error(F.size(t["spellIds"]) != t["maxRank"], "R10-SPELLIDS", _path(tree, t))),
    )


def canonical() -> Column:
    """V12, but for the bytes: see sinks.document_text."""
    return all_of(
        _talents(lambda tree, t, *_: error(t["source"]["readings"].isNotNull(), "R12-READINGS", _path(tree, t))),
        over(F.col("trees"), lambda tree, _: error(tree["source"]["readings"].isNotNull(), "R12-READINGS", _path(tree))),
        error(F.col("generatedAt").isNull(), "R12-GENERATED-AT", F.col("class")),
    )


def _budget(tree: Column) -> Column:
    r = F.col("rules")
    return F.least(r["maxPoints"], F.coalesce(F.try_element_at(r["pointsPerPage"], tree["page"]), r["maxPoints"]))


def reachable_rows() -> Column:
    """V13."""
    return over(F.col("trees"), lambda tree, _: warning(F.col("rules")["pointsPerRow"] * (tree["rows"] - 1) > _budget(tree), "R13-ROW-GATING", _path(tree)))


def low_confidence() -> Column:
    """V16."""
    return _talents(lambda tree, t, *_: warning((t["source"]["kind"] == "video") & (t["source"]["confidence"] < REVIEW_BELOW) & ~F.coalesce(t["source"]["reviewed"], F.lit(False)), "NEEDS-REVIEW", _path(tree, t)))


LONE_L = r"(?<![A-Za-z])[lI](?=[0-9]|%|\s(sec|min|yd|yards|seconds|minutes)\b)|(?<=[0-9])[lI](?![A-Za-z])"


def _hygiene(text: Column, path: Column) -> Column:
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.concat(
        warning(text != bare, "R17-WHITESPACE", path), warning(text.contains("  "), "R17-DOUBLE-SPACE", path), warning((bare != "") & ~bare.rlike("[.%]$"), "R17-TERMINATOR", path),
        warning(text.rlike(r"[|\\~]"), "R17-OCR-ARTEFACT", path), warning(text.rlike(LONE_L), "R17-OCR-ARTEFACT", path),
    )


def hygiene() -> Column:
    """V17."""
    return _talents(
        lambda tree, t, *_: _hygiene(t["description"], _path(tree, t)),
        lambda tree, t, *_: over(t["ranks"], lambda r, _i: _hygiene(r["text"], _path(tree, t))),
        lambda tree, t, *_: warning(blank_ends(t["name"]), "R17-NAME", _path(tree, t)),
    )


def tree_totals() -> Column:
    """V18."""
    total = lambda tree: F.aggregate(tree["talents"], F.lit(0), lambda s, t: s + t["maxRank"])
    return over(
        F.col("trees"),
        lambda tree, _: warning(total(tree) < _budget(tree), "R18-TREE-TOO-SMALL", _path(tree)),
        lambda tree, _: warning(total(tree) > 3 * F.col("rules")["maxPoints"], "R18-TREE-TOO-LARGE", _path(tree)),
    )


def empty_rows() -> Column:
    """V19."""
    used = lambda tree: F.transform(tree["talents"], lambda t: t["row"])
    return over(F.col("trees"), lambda tree, _: warning(F.size(F.array_except(F.sequence(F.lit(0), F.greatest(tree["rows"] - 1, F.lit(0))), used(tree))) > 0, "R19-EMPTY-ROWS", _path(tree)))


def slot_columns(docs: DataFrame) -> DataFrame:
    """A row for each numeric slot of talents with several ranks, all of them slots: doc, path, name, description, slot, vals, observed, prior."""
    t = docs.select("class", F.explode("trees").alias("tree")).select("class", F.col("tree.id").alias("tree"), F.explode("tree.talents").alias("t")).filter((F.col("t.maxRank") >= 2) & F.forall("t.ranks", lambda r: r["slots"].isNotNull()))
    rows = t.select(F.col("class").alias("doc"), F.concat_ws("/", "class", "tree", "t.id").alias("path"), "t.description", F.col("t.ranksObserved").alias("observed"), F.col("t.ranksPrior.id").alias("prior"), F.transform("t.ranks", lambda r: r["slots"]).alias("all"), F.explode(num.placeholders(F.col("t.description"))).alias("slot"))
    rows = rows.withColumn("vals", F.transform("all", lambda s: F.get(s, F.col("slot"))))
    return rows.filter((F.size("all") > 0) & F.forall("vals", lambda v: v.isNotNull())).drop("all")


def _finding(df: DataFrame, bad: Column, level: str, code: str) -> DataFrame:
    return df.filter(bad).select("doc", F.lit(level).alias("level"), F.lit(code).alias("code"), "path")


def progressions(slots: DataFrame, prior: DataFrame) -> DataFrame:
    """Slots that are neither constant nor arithmetic, nor step like one of the prior's slots up to a factor.

    prior: (id, slots), slots being a list of ranks, each a list of values.
    """
    columns = F.transform(F.sequence(F.lit(0), F.greatest(F.array_max(F.transform("slots", lambda r: F.size(r))), F.lit(1)) - 1), lambda j: F.transform("slots", lambda r: F.get(r, j)))
    known = prior.select(F.col("id").alias("prior"), columns.alias("known"))

    def like(column: Column) -> Column:
        own, other = num.steps(F.col("vals")), num.steps(column)
        ratio = F.array_distinct(F.zip_with(own, other, lambda a, b: F.round(F.try_divide(a, b), 6)))
        return (F.size(own) == F.size(other)) & ((own == other) | (F.forall(other, lambda d: d != 0) & (F.size(ratio) == 1)))

    rows = slots.join(known, "prior", "left").filter(~num.shape(F.col("vals")).isin("constant", "arithmetic"))
    return _finding(rows, ~F.coalesce(F.exists("known", like), F.lit(False)), "WARNING", "NONLINEAR-RANKS")


PERCENT_LIMIT = r"(?i)(below|under|less than|beneath|at or below|above|over|more than|greater than|at least)\s+(\w+\s+){0,2}?\{([0-9]+)\}\s*%"
DISTANCE_LIMIT = r"(?i)(within|inside|closer than|no more than)\s+(\w+\s+){0,2}?\{([0-9]+)\}\s*(yards?|yds?|meters?|metres?)"


def sane_ranks(slots: DataFrame, prior: DataFrame, headroom: float = 1.6) -> DataFrame:
    """Conditions that scale with the rank, percentages over 100 that were not read, values far above the prior's."""
    top = prior.select(F.col("id").alias("prior"), F.posexplode(F.flatten(F.transform("slots", lambda r: F.transform(r, lambda v, j: F.struct(j.alias("slot"), v.alias("v")))))).alias("_", "e")).select("prior", "e.slot", "e.v")
    rows = slots.join(top.groupBy("prior", "slot").agg(F.max("v").alias("top")), ["prior", "slot"], "left")
    limit = F.lit(False)
    for pattern in (PERCENT_LIMIT, DISTANCE_LIMIT):
        limit = limit | F.array_contains(F.regexp_extract_all("description", F.lit(pattern), F.lit(3)), F.col("slot").cast("string"))
    percent = F.regexp_like("description", F.concat(F.lit(r"\{"), F.col("slot").cast("string"), F.lit(r"\}\s*%")))
    unread = F.exists(F.transform("vals", lambda v, i: (v > 100) & ~F.array_contains(F.coalesce("observed", F.array(F.lit(1))), i + 1)), lambda x: x)
    return (
        _finding(rows, limit & (F.size(F.array_distinct("vals")) > 1), "WARNING", "R20-THRESHOLD-SCALED")
        .unionAll(_finding(rows, percent & unread & (F.get("vals", F.lit(0)) <= 100), "WARNING", "R20-PERCENT-OVER-100"))
        .unionAll(_finding(rows, (F.col("top") > 0) & (F.array_max("vals") > headroom * F.col("top")), "WARNING", "R20-ABOVE-CLASSIC"))
    )


def against_prior(docs: DataFrame, prior: DataFrame) -> DataFrame:
    """V7's other half: priors that are named but not known, or whose spells differ. prior: (id, spells)."""
    t = docs.select(F.col("class").alias("doc"), F.explode("trees").alias("tree")).select("doc", F.col("tree.id").alias("tree"), F.explode("tree.talents").alias("t")).filter("t.ranksPrior is not null")
    rows = t.select("doc", F.concat_ws("/", "doc", "tree", "t.id").alias("path"), F.col("t.ranksPrior.id").alias("id"), F.col("t.ranksPrior.spells").alias("said")).join(prior.select("id", "spells", F.lit(True).alias("known")), "id", "left")
    differ = F.col("known") & (F.size("spells") > 0) & ~F.col("said").eqNullSafe(F.col("spells"))
    return _finding(rows, F.col("known").isNull(), "WARNING", "PRIOR-UNKNOWN").unionAll(_finding(rows, differ, "WARNING", "PRIOR-SPELLS"))


def encodings(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """A document against its encoding. registry: (version, class, trees, order map<tree, ids>)."""
    latest = registry.agg(F.max("version").alias("latest"))
    e = registry.select(F.col("version").alias("dataVersion"), "class", F.col("trees").alias("enc_trees"), "order")
    rows = docs.join(registry.select(F.col("version").alias("dataVersion")).distinct().withColumn("there", F.lit(True)), "dataVersion", "left").join(e, ["dataVersion", "class"], "left").crossJoin(F.broadcast(latest))
    place = F.transform("trees", lambda x: F.struct(F.when(F.exists("pages", lambda p: p["id"] == x["page"]), F.array_position(F.transform("pages", lambda p: p["id"]), x["page"])).otherwise(99).alias("p"), x["order"].alias("o"), x["id"].alias("id")))
    own_trees = F.transform(F.array_sort(place), lambda x: x["id"])
    listed, own = F.flatten(F.map_values("order")), F.flatten(F.transform("trees", lambda x: F.transform(x["talents"], lambda t: t["id"])))
    differ = (F.size(F.array_except(listed, own)) > 0) | (F.size(F.array_except(own, listed)) > 0)
    known = F.col("order").isNotNull()
    major = lambda x: F.transform(F.array_sort(F.transform(x["talents"], lambda t: F.struct(t["row"].alias("r"), t["col"].alias("c"), t["id"].alias("id")))), lambda s: s["id"])
    cls = F.col("class")
    per_tree = over(
        F.col("trees"),
        lambda x, _: error(known & F.try_element_at("order", x["id"]).isNull(), "R11-ENCODING-TREE-ORDER", _path(x)),
        lambda x, _: warning((F.array_sort(F.try_element_at("order", x["id"])) == F.array_sort(major(x))) & (F.try_element_at("order", x["id"]) != major(x)), "ENCODING-ORDER", _path(x)),
    )
    return findings(
        rows, "class",
        error(F.col("there").isNull(), "R11-ENCODING-MISSING", cls), error(F.col("there") & (F.col("dataVersion") != F.col("latest")), "R11-ENCODING-NOT-LATEST", cls), error(F.col("there") & ~known, "R11-ENCODING-CLASS", cls),
        error(known & (F.col("enc_trees") != own_trees), "R11-ENCODING-TREES", cls), error(known & differ, "R11-ENCODING-IDS", cls), error(known & (F.size(listed) != F.size(F.array_distinct(listed))), "R11-ENCODING-DUP", cls), per_tree,
    )


def migrations(registry: DataFrame, steps: DataFrame) -> DataFrame:
    """V11's chain: (class, level, code, path) where a step from one version to the next loses or invents ids.

    registry: (version, class, id); steps: (from, class, old, new), new null where a talent was removed. Both grow with
    the ids, and exploded or filtered rows are estimated far too small, so no side with ids is left to be broadcast.
    """
    r = registry.select("version", "class", "id").distinct()
    nxt = r.select((F.col("version") - 1).alias("version"), "class", F.col("id").alias("target"), F.lit(True).alias("there"))
    step = steps.select(F.col("from").alias("version"), "class", F.col("old").alias("id"), "new", F.lit(True).alias("named"))
    later = r.groupBy("class").agg(F.max("version").alias("latest"))
    old = r.join(later, "class").filter("version < latest").join(step.hint("shuffle_merge"), ["version", "class", "id"], "left")
    moved = old.filter("named is null or new is not null").withColumn("target", F.coalesce("new", "id")).join(nxt.hint("shuffle_merge"), ["version", "class", "target"], "left")
    say = lambda df, code: df.select("class", F.lit("ERROR").alias("level"), F.lit(code).alias("code"), F.concat_ws("/", "class", F.concat(F.lit("v"), F.col("version").cast("string")), "id").alias("path"))
    ghost = step.join(r.withColumn("known", F.lit(True)).hint("shuffle_merge"), ["version", "class", "id"], "left").filter("known is null")
    return say(moved.filter("there is null and named is null"), "R11-MIGRATION-NOT-TOTAL").unionAll(say(moved.filter("there is null and named"), "R11-MIGRATION-RENAME")).unionAll(say(ghost, "R11-MIGRATION-RENAME"))


def names(docs: DataFrame, prior: DataFrame, least: float = 90.0) -> DataFrame:
    """Talents without a prior of about their name, and those whose rank count differs from it.

    prior: (class, id, name, max_rank). A name is scored against its own class only; the best score wins, then the least id.
    """
    from ..functions.text import token_sort_ratio

    t = docs.select(F.col("class").alias("doc"), F.explode("trees").alias("tree")).select("doc", F.col("tree.id").alias("tree"), F.explode("tree.talents").alias("t")).select("doc", F.concat_ws("/", "doc", "tree", "t.id").alias("path"), "t.name", F.col("t.maxRank").alias("ranks"))
    pairs = t.select("doc", "name").distinct().join(prior.select(F.col("class").alias("doc"), F.col("id").alias("prior"), F.col("name").alias("known"), "max_rank"), "doc")
    scored = pairs.withColumn("score", token_sort_ratio("name", "known"))
    best = scored.groupBy("doc", "name").agg(F.max_by(F.struct("score", "max_rank"), F.struct("score", -F.col("prior"))).alias("best"))
    rows = t.join(best, ["doc", "name"])
    return _finding(rows, F.col("best.score") < least, "INFO", "NEW-TALENT").unionAll(_finding(rows, (F.col("best.score") >= least) & (F.col("best.max_rank") != F.col("ranks")), "WARNING", "MAXRANK-DIFFERS-FROM-CLASSIC"))


def in_document(known: list[str]) -> list[Column]:
    """The rules that one document decides: V1 to V6, parts of V7 to V10, V12, V13, V16 to V19."""
    return [schema_version(), ids(known), level_cap(), pages_and_trees(), cells(), ranks(), rank_sources(), requirements(), icons(), sources(), canonical(), reachable_rows(), low_confidence(), hygiene(), tree_totals(), empty_rows()]


def overrides(over_: DataFrame, extracted: DataFrame) -> DataFrame:
    """VO: overrides (class, talent, tree, add_id, has_add, reason, by, at) against extracted talents (class, id, tree)."""
    ex = extracted.groupBy("class", F.col("id").alias("talent")).agg(F.max("tree").alias("found_in"))
    files = extracted.select("class").distinct().withColumn("there", F.lit(True))
    rows = over_.join(files, "class", "left").join(ex, ["class", "talent"], "left")
    path, there, add = F.concat_ws("/", "class", "tree", "talent"), F.coalesce("there", F.lit(False)), F.coalesce("has_add", F.lit(False))
    return findings(
        rows, "class",
        error(~F.col("talent").rlike(SLUG), "R01-SCHEMA", path), error(F.col("reason").isNull() | F.col("by").isNull() | ~F.coalesce(F.col("at").rlike(RFC3339), F.lit(False)), "R01-SCHEMA", path),
        error(add & ~F.col("add_id").eqNullSafe(F.col("talent")), "OVR-ADD-ID", path), error(add & there & F.col("found_in").isNotNull(), "OVR-ADD-EXISTS", path),
        warning(~add & there & F.col("found_in").isNull(), "OVR-TARGET", path), warning(~add & there & (F.col("found_in") != F.col("tree")), "OVR-TREE", path),
    )


def review_reasons(docs: DataFrame, found: DataFrame) -> DataFrame:
    """VQ: unreviewed talents with a reason to look at them, least confidence first (unknown counts as 1.0).

    Reasons: low confidence of a video, ranks by hand, a cropped icon, and the codes of warnings other than NEEDS-REVIEW.
    """
    codes = found.filter("level = 'WARNING' and code <> 'NEEDS-REVIEW'").groupBy("path").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    t = docs.select("class", F.explode("trees").alias("tree")).select("class", F.col("tree.id").alias("tree"), F.explode("tree.talents").alias("t"))
    rows = t.withColumn("path", F.concat_ws("/", "class", "tree", "t.id")).join(codes, "path", "left")
    own = F.array_compact(F.array(F.when((F.col("t.source.kind") == "video") & (F.col("t.source.confidence") < REVIEW_BELOW), "confidence"), F.when(F.col("t.ranksSource") == "manual", "ranksSource manual"), F.when(F.col("t.iconSource") == "crop", "iconSource crop")))
    every = F.concat(own, F.coalesce("codes", F.array().cast("array<string>")))
    return rows.filter((F.size(every) > 0) & ~F.coalesce("t.source.reviewed", F.lit(False))).select("class", "tree", F.col("t.id").alias("talent"), F.col("t.source.confidence").alias("confidence"), every.alias("reasons"))
