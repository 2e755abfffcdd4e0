"""Queries of builds and readings over rules and rows made of driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocations as al
from ..operators import readings as rd
from .registry import query


def _rules(t):
    """One class of three trees with five rows of four talents; two pages; every seventh talent below the first row wants the one above it."""
    j = F.col("id").cast("int")
    tal = t.spark.range(60).select(
        F.lit("c").alias("cls"), F.concat(F.lit("t"), F.floor(j / 20).cast("string")).alias("tree"), F.concat(F.lit("i"), j.cast("string")).alias("talent"), F.when(j < 40, "main").otherwise("side").alias("page"),
        F.floor(j % 20 / 4).cast("int").alias("row"), (j % 4).alias("col"), (j % 3 + 1).alias("max_rank"), j.alias("place"), F.concat(F.lit("Name "), (j % 50).cast("string")).alias("name"), j.alias("j"),
    )
    needs = tal.filter("j % 7 = 3 and row > 0").select("cls", "tree", "talent", F.concat(F.lit("i"), (F.col("j") - 4).cast("string")).alias("other"), (1 + F.col("j") % 2).alias("least"))
    limits = t.spark.createDataFrame([("c", 2, 20)], "cls string, per_row int, max_points int")
    return al.Rules(tal, needs, limits, t.spark.createDataFrame([("c", "main", 12)], "cls string, page string, budget int"))


def _builds(t):
    """A build for every order: its parts are talents, some unknown, their quantities ranks."""
    j = F.col("l_partkey") % 61
    return t.lineitem.select(F.col("l_orderkey").alias("build"), F.lit("c").alias("cls"), F.concat(F.lit("t"), F.floor(j / 20).cast("string")).alias("tree"), F.concat(F.lit("i"), j.cast("string")).alias("talent"), (F.col("l_quantity").cast("int") % 5).alias("rank"))


_BUILD = """WITH m AS (SELECT CAST(j AS INT) AS j, 't' || (j // 20) AS tree, 'i' || j AS talent, CASE WHEN j < 40 THEN 'main' ELSE 'side' END AS page, j % 20 // 4 AS row, j % 4 AS col, j % 3 + 1 AS max_rank FROM range(60) r(j)),
n AS (SELECT tree, talent, 'i' || (j - 4) AS other, 1 + j % 2 AS least FROM m WHERE j % 7 = 3 AND row > 0),
b AS (SELECT l_orderkey AS build, 't' || (l_partkey % 61 // 20) AS tree, 'i' || (l_partkey % 61) AS talent, max(CAST(l_quantity AS INT) % 5) AS rank FROM lineitem GROUP BY ALL HAVING max(CAST(l_quantity AS INT) % 5) > 0),
p AS (SELECT b.*, m.row, m.col, m.max_rank, m.page FROM b LEFT JOIN m USING (tree, talent)),
a AS (SELECT p.*, coalesce((SELECT sum(q.rank) FROM p q WHERE q.build = p.build AND q.tree = p.tree AND q.row < p.row), 0) AS above FROM p)
"""


@query(_BUILD + """SELECT build, tree, talent, 'unknown-talent' AS reason FROM a WHERE max_rank IS NULL UNION ALL SELECT build, tree, talent, 'maxed' FROM a WHERE rank > max_rank UNION ALL SELECT build, tree, talent, 'row-locked' FROM a WHERE above < 2 * row
UNION ALL SELECT a.build, a.tree, a.talent, 'prereq' FROM a JOIN n USING (tree, talent) LEFT JOIN b ON b.build = a.build AND b.tree = a.tree AND b.talent = n.other WHERE coalesce(b.rank, 0) < n.least
UNION ALL SELECT build, '', '', 'no-points' FROM a GROUP BY build HAVING sum(rank) > 20 UNION ALL SELECT build, '', '', 'page-full' FROM a WHERE page = 'main' GROUP BY build HAVING sum(rank) > 12""")
def build_violations(t):
    """BIZ3, AGG22: every rule that a build breaks: unknown and overfull talents, locked rows, prerequisites, budgets."""
    return al.violations(_builds(t), _rules(t))


@query(_BUILD + """, s AS (SELECT build, sum(rank) AS points, coalesce(sum(rank) FILTER (page = 'main'), 0) AS main FROM p GROUP BY 1),
v AS (SELECT s.*, m.*, coalesce(b.rank, 0) AS rank, coalesce((SELECT sum(q.rank) FROM p q WHERE q.build = s.build AND q.tree = m.tree AND q.row < m.row), 0) AS above,
  EXISTS (SELECT 1 FROM n LEFT JOIN b x ON x.build = s.build AND x.tree = n.tree AND x.talent = n.other WHERE n.tree = m.tree AND n.talent = m.talent AND coalesce(x.rank, 0) < n.least) AS short FROM s CROSS JOIN m LEFT JOIN b ON b.build = s.build AND b.tree = m.tree AND b.talent = m.talent)
SELECT build, tree, talent, CASE WHEN rank >= max_rank THEN 'maxed' WHEN points >= 20 THEN 'no-points' WHEN page = 'main' AND main >= 12 THEN 'page-full' WHEN above < 2 * row THEN 'row-locked' WHEN short THEN 'prereq' ELSE 'ok' END AS verdict FROM v""")
def build_can_add(t):
    """BIZ1: the first reason against one more point, for every talent of every build's class."""
    return al.can_add(_builds(t), _rules(t))


@query(_BUILD + """, o AS (SELECT x.build, x.tree, x.talent, y.row, y.col, 0 AS kind FROM a x JOIN a y ON y.build = x.build AND y.tree = x.tree AND y.row > x.row AND y.above = 2 * y.row
UNION ALL SELECT x.build, x.tree, x.talent, y.row, y.col, 1 FROM a x JOIN n ON n.tree = x.tree AND n.other = x.talent AND n.least = x.rank JOIN a y ON y.build = x.build AND y.tree = n.tree AND y.talent = n.talent WHERE x.max_rank IS NOT NULL AND y.max_rank IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY build, tree, talent ORDER BY row, col, kind) AS r FROM o)
SELECT a.build, a.tree, a.talent, CASE WHEN f.kind IS NULL THEN 'ok' WHEN f.kind = 0 THEN 'would-orphan' ELSE 'prereq' END AS verdict FROM a LEFT JOIN f ON f.build = a.build AND f.tree = a.tree AND f.talent = a.talent AND f.r = 1 WHERE a.max_rank IS NOT NULL""")
def build_can_remove(t):
    """BIZ2: what one point less would break."""
    return al.can_remove(_builds(t), _rules(t))


@query()
def build_sanitised(t):
    """BIZ4, SRT10: builds made legal."""
    return al.sanitised(_builds(t), _rules(t))


@query()
def build_imported(t):
    """BIZ10, J35: builds wanted by name, filled as far as the rules allow."""
    j = F.col("l_partkey") % 55
    wanted = t.lineitem.groupBy(F.col("l_orderkey").alias("build"), F.lit("c").alias("cls"), F.concat(F.lit("name"), j.cast("string")).alias("name")).agg(F.max(F.col("l_quantity").cast("int") % 5).alias("rank")).filter("rank > 0")
    return al.imported(wanted, _rules(t))[1]


def _decoded(t):
    rules = _rules(t)
    j = F.col("j")
    now = rules.talents.select("cls", "tree", "talent", "j", F.floor(j / 20).cast("int").alias("seg"), (j % 20).alias("pos"))
    old = now.select(F.lit(1).alias("version"), "cls", "seg", "tree", "pos", F.when(j % 9 == 0, F.concat(F.lit("old"), j.cast("string"))).otherwise(F.col("talent")).alias("talent"))
    order = old.unionAll(now.select(F.lit(2).alias("version"), "cls", "seg", "tree", "pos", "talent"))
    steps = now.filter(j % 9 == 0).select(F.lit(1).alias("from"), "cls", F.concat(F.lit("old"), j.cast("string")).alias("old"), F.when(j % 18 == 0, None).otherwise(F.col("talent")).alias("new"), F.lit(None).cast("string").alias("to_tree"))
    k = F.col("o_orderkey")
    code = F.concat(F.lit("2"), (k % 10000).cast("string"), F.when(k % 3 == 0, "--").otherwise("-"), (k % 97).cast("string"), F.when(k % 50 == 0, "-1-23").otherwise(""), F.when(k % 40 == 0, "x").otherwise(""))
    codes = t.orders.select(k.alias("build"), F.lit("c").alias("cls"), code.alias("code"), (1 + k % 3).cast("int").alias("version"))
    return al.decoded(codes, rules, order, steps, 2)


@query()
def codec_builds(t):
    """BIZ7-9, J34: codes of three versions decoded, migrated, clamped and made legal."""
    return _decoded(t)[0]


@query("""WITH c AS (SELECT o_orderkey AS k, 1 + o_orderkey % 3 AS version FROM orders) SELECT k AS build, 'unknown-version' AS kind, 0 AS n FROM c WHERE version = 3 UNION ALL SELECT k, 'bad-string', 0 FROM c WHERE version < 3 AND k % 40 = 0""")
def codec_notices(t):
    """BIZ7: codes of unknown versions or with foreign characters."""
    return _decoded(t)[1].filter("kind in ('unknown-version', 'bad-string')")


# --- readings ----------------------------------------------------------------------------------


def _readings(t):
    k = F.col("p_partkey")
    one = lambda who, name, rank: F.struct(F.lit(who).alias("reader"), name.alias("name"), rank.cast("int").alias("rank"), F.lit("active").alias("kind"))
    name = F.initcap("p_name")
    first, second, third = one("vlm 3x", F.concat(name, F.lit(" Rank 2")), k % 4), one("vlm 2x", name, k % 4), one("codex", F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, name).otherwise(F.concat(name, F.lit("e"))), F.when(k % 5 == 0, 9).otherwise(k % 4))
    return t.part.select("p_partkey", F.when(k % 7 == 0, F.array(first)).when(k % 7 == 1, F.array(third)).when(k % 7 == 2, F.array(first, second)).otherwise(F.array(first, second, third)).alias("readings"))


@query("""WITH x AS (SELECT p_partkey AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, upper(p_name) AS big FROM part), y AS (SELECT *, k % 7 > 2 AS three, k % 7 > 2 AND k % 3 = 2 AS other, k % 7 > 2 AND k % 5 = 0 AS ranked FROM x)
SELECT k AS p_partkey, CASE WHEN k % 7 = 1 THEN CASE k % 3 WHEN 0 THEN big WHEN 1 THEN name ELSE name || 'e' END WHEN three AND k % 3 = 0 THEN big ELSE name END AS name,
  CASE WHEN k % 7 <= 1 THEN 0.0 WHEN other OR ranked THEN 0.7 WHEN k % 7 = 2 THEN 0.9 WHEN k % 3 = 0 THEN 0.9 ELSE 1.0 END AS confidence, array_to_string(list_concat(CASE WHEN other THEN ['name'] ELSE [] END, CASE WHEN ranked THEN ['rank'] ELSE [] END), ',') AS disputed FROM y""")
def merged_entries(t):
    """BIZ29-BIZ33, BIZ36: rows of two passes and an authority merged, with their confidence and what is disputed."""
    return _readings(t).select("p_partkey", rd.merged_entry(F.col("readings")).alias("m")).select("p_partkey", "m.name", "m.confidence", F.array_join("m.disputed", ",").alias("disputed"))


@query("""WITH a AS (SELECT p_partkey AS k, p_name, p_size FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.k, b.k) AS p_partkey, CASE WHEN a.k IS NULL THEN 'second' WHEN b.k IS NULL THEN 'first' ELSE 'both' END AS side, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 0.0 WHEN a.p_name = b.p_name AND a.p_size = b.p_size THEN 1.0 WHEN a.p_size = b.p_size THEN 0.7 ELSE 0.3 END AS confidence,
  CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p_name <> b.p_name THEN 'p_name' END, CASE WHEN a.p_size <> b.p_size THEN 'p_size' END) END AS fields FROM a FULL JOIN b ON a.k = b.k""")
def paired_readings(t):
    """J17, BIZ30, BIZ37: two passes by key, how far they agree and which fields differ."""
    k = F.col("p_partkey")
    a = t.part.filter(k % 5 != 0)
    b = t.part.filter(k % 7 != 0).select(k, F.when(k % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.when(k % 6 == 0, 0).otherwise(F.col("p_size")).alias("p_size"))
    p = rd.paired(a, b, ["p_partkey"], ["p_name", "p_size"])
    name, size = F.col("a_p_name") == F.col("b_p_name"), F.col("a_p_size") == F.col("b_p_size")
    differ = F.array_join(rd.differing({"p_name": (F.col("a_p_name"), F.col("b_p_name")), "p_size": (F.col("a_p_size"), F.col("b_p_size"))}), ",")
    return p.select("p_partkey", "side", rd.agreement(name & size, size, F.col("side") != "both").alias("confidence"), F.when(F.col("side") == "both", differ).otherwise("").alias("fields"))


@query("""WITH r AS (SELECT p_partkey AS k, (p_partkey % 3) * 0.5 AS conf, p_size FROM part WHERE p_partkey % 9 <> 0), c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END AS said, p_partkey % 4 < 2 AS close FROM part WHERE p_partkey % 4 <> 3),
j AS (SELECT coalesce(r.k, c.k) AS k, r.k IS NULL AS lone, c.k IS NOT NULL AS third, conf, CASE WHEN said = p_size THEN 1.0 WHEN close THEN 0.7 ELSE 0.3 END AS best FROM r FULL JOIN c ON r.k = c.k)
SELECT k AS p_partkey, CASE WHEN lone THEN 0.3 WHEN NOT third THEN conf WHEN conf >= 1 AND best < 1 THEN 0.85 WHEN best >= 1 THEN greatest(conf, 0.9) WHEN best >= 0.7 THEN greatest(conf, 0.7) ELSE conf END AS confidence, third FROM j""")
def third_readings(t):
    """A third reading folded into records on one ladder of confidence."""
    k = F.col("p_partkey")
    records = t.part.filter(k % 9 != 0).select(k, ((k % 3) * 0.5).alias("confidence"), "p_size")
    third = t.part.filter(k % 4 != 3).select(k, F.when(k % 2 == 0, F.col("p_size")).otherwise(-1).alias("said_size"), (k % 4 < 2).alias("close"))
    return rd.with_third(records, third, "p_partkey", F.when(F.col("said_size") == F.col("p_size"), 1.0).when(F.col("close"), 0.7).otherwise(0.3))


@query()
def aligned_columns(t):
    """The lines of an order against those of the same order in another pass that skips some."""
    pos = lambda df: df.select(F.col("l_orderkey").alias("col"), F.row_number().over(_by_order()).alias("pos"), (F.col("l_partkey") % 5).alias("id"), "l_linenumber").withColumnRenamed("l_linenumber", "rank")
    return rd.aligned(pos(t.lineitem), pos(t.lineitem.filter("l_partkey % 4 <> 0")), "col")


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")


@query()
def stitched_orders(t):
    """WIN16: one order of event types from each user's days."""
    e = t.events.select("user_id", F.to_date("ts").alias("seq"), "ts", "event_id", F.col("event_type").alias("id"))
    from pyspark.sql import Window

    return rd.stitched(e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id", "seq").orderBy("ts", "event_id"))), "user_id")


@query("""WITH w AS (SELECT median(p_size) AS w, median(p_partkey % 10) AS e FROM part) SELECT p_partkey AS id FROM part, w WHERE p_size < w * 0.8 AND p_partkey % 10 < e * 0.9""")
def suspect_crops(t):
    """BIZ35: narrow parts with a weak edge, against the medians."""
    return rd.suspects(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("width"), (F.col("p_partkey") % 10).alias("edge")))


@query("""WITH x AS (SELECT p_partkey AS k, (p_size % 50) / 50.0 AS best, (p_partkey % 10) / 50.0 AS margin, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 8 END AS rank, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size % 50) / 60.0 END AS score FROM part)
SELECT k AS p_partkey, CASE WHEN rank < 5 AND score >= 0.45 THEN CASE WHEN rank = 0 OR score >= 0.8 THEN 'prior high' ELSE 'prior medium' END WHEN rank > 0 AND (best < 0.7 OR margin < 0.05) THEN 'none'
  WHEN best >= 0.6 AND (margin >= 0.05 OR best >= 0.8) THEN CASE WHEN best >= 0.8 AND margin >= 0.05 THEN 'sight high' ELSE 'sight medium' END ELSE 'none' END AS icon FROM x""")
def icon_decisions(t):
    """BIZ38: what a scored match is taken for."""
    k, s = F.col("p_partkey"), F.col("p_size") % 50
    prior = k % 3 != 0
    return t.part.select("p_partkey", rd.decided(s / 50.0, (k % 10) / 50.0, F.when(prior, k % 8), F.when(prior, s / 60.0)).alias("icon"))


_CELLS = """WITH c AS (SELECT DISTINCT l_orderkey AS grp, l_partkey % 2 AS tree, l_linenumber % 4 AS row, l_suppkey % 3 AS col FROM lineitem)
"""


def _cells(t):
    return t.lineitem.select(F.col("l_orderkey").alias("grp"), (F.col("l_partkey") % 2).alias("tree"), (F.col("l_linenumber") % 4).alias("row"), (F.col("l_suppkey") % 3).alias("col")).distinct()


@query(_CELLS + """SELECT a.grp, a.tree, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2 FROM c a JOIN c b ON a.grp = b.grp AND a.tree = b.tree WHERE b.row - a.row BETWEEN 0 AND 3 AND abs(b.col - a.col) <= 1 AND (b.row > a.row OR b.col > a.col)""")
def cell_pairs(t):
    """BIZ40: cells of an order's grid that an arrow may join."""
    return rd.cell_pairs(_cells(t))


@query("""WITH a AS (SELECT l_orderkey AS grp, l_partkey % 4 AS src, l_suppkey % 4 AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'straight' WHEN 1 THEN 'L-top' ELSE 'L-bottom' END AS shape FROM lineitem)
SELECT * FROM a WHERE NOT (shape = 'L-bottom' AND EXISTS (SELECT 1 FROM a s WHERE s.grp = a.grp AND s.shape = 'straight' AND s.src = a.src)) AND NOT (shape = 'L-top' AND EXISTS (SELECT 1 FROM a s WHERE s.grp = a.grp AND s.shape = 'straight' AND s.dst = a.dst))""")
def arrow_overlaps(t):
    """BIZ39: arrows without L-shapes on a straight one's line."""
    n = F.col("l_linenumber") % 3
    a = t.lineitem.select(F.col("l_orderkey").alias("grp"), (F.col("l_partkey") % 4).alias("src"), (F.col("l_suppkey") % 4).alias("dst"), F.when(n == 0, "straight").when(n == 1, "L-top").otherwise("L-bottom").alias("shape"))
    return rd.without_overlaps(a, "grp").select("grp", "src", "dst", "shape")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 5 = 0 THEN 'Passive' END AS kind, 'Melee' AS extra, CASE WHEN p_partkey % 3 = 0 THEN 'Requires Level 5|Requires Shields|Requires Staves.' ELSE 'Requires Level 5|Requires Shields' END AS requires, 'Hits for ' || p_size || '.' AS description, CASE WHEN p_partkey % 4 = 0 THEN 'Click to learn' WHEN p_partkey % 7 = 0 THEN 'Click to learn.' END AS footer FROM part""")
def refiled_readings(t):
    """STR36: lines of a reading put into the field that they belong to."""
    k = F.col("p_partkey")
    words = lambda *w: F.array(*map(F.lit, w))
    lines = F.concat(words("Melee", "Requires  Level 5"), F.when(k % 2 == 0, words("passive")).otherwise(F.slice(words("x"), 1, 0)), F.when(k % 4 == 0, words("Click to learn")).otherwise(F.slice(words("x"), 1, 0)))
    text = F.concat(F.when(k % 5 == 0, "Passive ").otherwise(""), F.when(k % 3 == 0, "Requires Staves. ").otherwise(""), F.lit("Hits for "), F.col("p_size").cast("string"), F.lit("."), F.when(k % 7 == 0, " Click to learn.").otherwise(""))
    got = t.part.select("p_partkey", rd.refiled(lines, words("Shields"), text, F.lit(None).cast("string"), F.lit("")).alias("r"))
    return got.select("p_partkey", "r.kind", F.array_join("r.extra", "|").alias("extra"), F.array_join(F.array_sort("r.requires"), "|").alias("requires"), "r.description", "r.footer")
