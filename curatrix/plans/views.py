"""Queries of views, joins by precedence, orders and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import resolve, views
from .registry import query


@query("""SELECT p_partkey, p_partkey % 7 = 0 OR (coalesce(CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 4) / 4.0 END > 0, TRUE) AND p_partkey % 5 <> 0) AS shown, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AS here, CASE p_partkey % 4 WHEN 0 THEN 'h' WHEN 3 THEN 'n' ELSE 'a' END AS variant,
  CASE WHEN p_partkey % 2 = 0 THEN 'fine' ELSE '' END AS notes, CASE p_partkey % 3 WHEN 0 THEN 'talents' WHEN 1 THEN 'overrides' ELSE 'other' END AS kind FROM part""")
def shown_rows(t):
    """FLT3, FLT8, FLT9, FLT11, FLT12, FLT15: what is published, of a variant, for players, and of which kind of file."""
    k = F.col("p_partkey")
    variant = lambda i, f: F.struct(F.lit(i).alias("id"), F.lit(f).alias("faction"))
    all_ = F.when(k % 4 == 3, F.array(variant("n", "none"))).otherwise(F.array(variant("h", "horde"), variant("a", "alliance")))
    notes = F.when(k % 2 == 0, F.array(F.lit("fine"), F.lit("see R05-CELL"))).otherwise(F.array(F.lit("crop at x.png")))
    path = F.concat(F.lit("/data/"), F.when(k % 3 == 0, "talents").when(k % 3 == 1, "overrides").otherwise("misc"), F.lit("/x.json"))
    kind = F.regexp_extract(path, "/(talents|extracted|overrides|examples)/[^/]*$", 1)
    return t.part.select(
        "p_partkey", views.publishable(k % 7 == 0, F.when(k % 3 > 0, (k % 4) / 4.0), F.when(k % 5 != 0, "crop")).alias("shown"), views.of_variant(F.when(k % 3 > 0, F.array(F.when(k % 3 == 1, "a").otherwise("h"))), F.lit("a")).alias("here"),
        views.active_variant(all_, F.when(k % 4 == 0, "h").otherwise("zz")).alias("variant"), F.array_join(views.public_notes(notes, [r"\bR[0-9]{2}-", r"\.png\b"]), "|").alias("notes"), F.when(kind != "", kind).otherwise("other").alias("kind"),
    )


@query("""WITH x AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, o_custkey, CAST(k AS INT) AS k FROM x WHERE o_totalprice >= 100000 AND k < 3""")
def published_rows(t):
    """FLT10, SRT15: rows under a threshold dropped, and a customer's rows beyond the third."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", k.alias("k")).filter("o_totalprice >= 100000 and k < 3").select("o_orderkey", "o_custkey", "k")


@query("""SELECT p_partkey, array_to_string(list_filter([p_size % 3, p_partkey % 4, 0, 7], lambda x: x > 0), ',') AS spells, concat_ws(',', CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 || ':' || p_size END, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 || ':1' END) AS prereq,
  CASE WHEN p_partkey % 2 = 0 THEN 'inv_' || p_partkey END AS icon FROM part WHERE p_partkey % 3 = 0""")
def import_projections(t):
    """PRJ7, PRJ8, PRJ10, PRJ11: repeating groups as arrays, the default difficulty only, icons by the stem of their path."""
    k = F.col("p_partkey")
    spells = F.filter(F.array(F.col("p_size") % 3, k.cast("int") % 4, F.lit(0), F.lit(7)), lambda x: x > 0)
    needs = F.filter(F.arrays_zip(F.array(k % 4, k % 5).alias("id"), F.array(F.col("p_size"), F.lit(1)).alias("rank")), lambda x: x["id"] > 0)
    path = F.concat(F.lit("Interface/"), F.when(k % 2 == 0, "ICONS").otherwise("Other"), F.lit("/INV_"), k.cast("string"), F.lit(".blp"))
    in_icons = F.lower(F.translate(path, "/", "\\")).contains("\\icons\\")
    difficulty = F.when(k % 6 == 0, None).otherwise(k % 3)
    d = t.part.filter(F.coalesce(difficulty, F.lit(0)) == 0)
    return d.select("p_partkey", F.array_join(F.transform(spells, lambda x: x.cast("string")), ",").alias("spells"), F.array_join(F.transform(needs, lambda x: F.concat_ws(":", x["id"].cast("string"), x["rank"].cast("string"))), ",").alias("prereq"), F.when(in_icons, F.lower(F.regexp_extract(path, r"([^/]*)\.[^.]*$", 1))).alias("icon"))


@query("""WITH a AS (SELECT l_partkey AS k, max(l_orderkey) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT p_partkey AS k, p_name FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(a.k, b.k, c.k) AS spell, p_name AS name, coalesce(p_size, 0) AS duration, coalesce(last, 0) AS last FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k)""")
def spell_fold(t):
    """Every table may create a spell; absent values have defaults."""
    a = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("spell")).agg(F.max("l_orderkey").alias("last"))
    b = t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("spell"), F.col("p_name").alias("name"))
    c = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("spell"), F.col("p_size").alias("duration"))
    return a.join(b, "spell", "full").join(c, "spell", "full").select("spell", "name", F.coalesce("duration", F.lit(0)).alias("duration"), F.coalesce("last", F.lit(0)).alias("last"))


@query("""WITH x AS (SELECT p_partkey AS k, unnest([p_partkey, p_partkey + 3, p_partkey + 100000]) AS id, unnest([0, 1, 2]) AS pos FROM part) SELECT k AS p_partkey, string_agg(p_name, '/' ORDER BY pos) FILTER (p.p_partkey IS NOT NULL) AS texts, CAST(count(*) FILTER (p.p_partkey IS NULL) AS BIGINT) AS dangling FROM x LEFT JOIN part p ON p.p_partkey = id GROUP BY k""")
def rank_texts(t):
    """Ids of ranks exploded in order and looked up; those that lead nowhere are counted."""
    k = F.col("p_partkey")
    x = t.part.select(k.alias("k"), F.posexplode(F.array(k, k + 3, k + 100000)).alias("pos", "id"))
    got = x.join(t.part.select(k.alias("id"), "p_name"), "id", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("p_name").isNotNull(), F.struct("pos", "p_name")))).alias("all"), F.count_if(F.col("p_name").isNull()).alias("dangling"))
    return got.select(F.col("k").alias("p_partkey"), F.array_join(F.transform("all", lambda s: s["p_name"]), "/").alias("texts"), "dangling")


@query("""WITH n AS (SELECT p_name AS name, max(p_partkey) AS new_id, max_by(p_size, p_partkey) AS size FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), o AS (SELECT p_name AS name, max(p_partkey) AS old_id, bool_or(p_partkey % 10 = 0) AS reviewed, max(CASE WHEN p_partkey % 4 = 0 THEN 'crop' || p_partkey END) AS crop FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT coalesce(n.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'gone' ELSE 'kept' END AS side, CASE WHEN n.name IS NOT NULL AND new_id <> old_id THEN old_id END AS renamed_from, CASE WHEN n.name IS NOT NULL THEN crop END AS crop, coalesce(reviewed AND n.name IS NULL, FALSE) AS review_lost FROM n FULL JOIN o ON n.name = o.name""")
def merge_plan(t):
    """A snapshot merged into the one before by name, the last of a name counting: renames, crops that stay, reviews that go."""
    k = F.col("p_partkey")
    n = t.part.filter(k % 3 != 0).groupBy(F.col("p_name").alias("name")).agg(F.max(k).alias("new_id"))
    o = t.part.filter("p_size % 2 = 0").groupBy(F.col("p_name").alias("name")).agg(F.max(k).alias("old_id"), F.bool_or(k % 10 == 0).alias("reviewed"), F.max(F.when(k % 4 == 0, F.concat(F.lit("crop"), k.cast("string")))).alias("crop"))
    side = F.when(F.col("old_id").isNull(), "new").when(F.col("new_id").isNull(), "gone").otherwise("kept")
    return n.join(o, "name", "full").select("name", side.alias("side"), F.when(F.col("new_id") != F.col("old_id"), F.col("old_id")).alias("renamed_from"), F.when(F.col("new_id").isNotNull(), F.col("crop")).alias("crop"), F.coalesce(F.col("reviewed") & F.col("new_id").isNull(), F.lit(False)).alias("review_lost"))


_GRID = """WITH c AS (SELECT s_suppkey AS cell, s_nationkey % 2 AS grp, (s_suppkey * 37) % 200 AS cx, (s_suppkey * 53) % 200 AS cy FROM supplier), p AS (SELECT c_custkey AS point, c_nationkey % 2 AS grp, (c_custkey * 17) % 200 + 0.25 AS px, (c_custkey * 29) % 200 + 0.5 AS py FROM customer)
"""


def _grid(t):
    c = t.supplier.select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 2).alias("grp"), (F.col("s_suppkey") * 37 % 200).alias("cx"), (F.col("s_suppkey") * 53 % 200).alias("cy"))
    p = t.customer.select(F.col("c_custkey").alias("point"), (F.col("c_nationkey") % 2).alias("grp"), (F.col("c_custkey") * 17 % 200 + 0.25).alias("px"), (F.col("c_custkey") * 29 % 200 + 0.5).alias("py"))
    return p, c


@query(_GRID + """, d AS (SELECT p.grp, point, cell, sqrt((px - cx) ** 2 + (py - cy) ** 2) AS away FROM p JOIN c USING (grp)), r AS (SELECT *, row_number() OVER (PARTITION BY grp, point ORDER BY away, cell) AS n FROM d WHERE away <= 20) SELECT grp, point, cell, round(away, 6) AS away FROM r WHERE n = 1""")
def nearest_cells(t):
    """J20, J21, VIS13: points with their nearest cell within reach."""
    return views.near_cells(*_grid(t), 20.0, 20.0)


@query(_GRID + """SELECT p.grp, point, min(cell) AS cell FROM p JOIN c USING (grp) WHERE px BETWEEN cx - 15 + 2 AND cx + 15 - 2 AND py BETWEEN cy - 9 + 2 AND cy + 9 - 2 GROUP BY ALL""")
def cells_at_points(t):
    """Points with the cell that holds them."""
    p, c = _grid(t)
    return views.containing_cells(p, c.select("grp", "cell", (F.col("cx") - 15).alias("x0"), (F.col("cy") - 9).alias("y0"), (F.col("cx") + 15).alias("x1"), (F.col("cy") + 9).alias("y1")), 2.0, 30.0)


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value FROM events), a AS (SELECT * FROM e WHERE event_type = 'signup'), r AS (SELECT a.event_id, b.event_id AS best, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value - b.value), b.us, b.event_id) AS n FROM a JOIN e b ON a.user_id = b.user_id AND b.event_type <> 'signup')
SELECT event_id, best FROM r WHERE n = 1""")
def closest_match(t):
    """Each sign-up with the user's other event of the least difference, the earliest of equals."""
    e = t.events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    a = e.filter("event_type = 'signup'").select("event_id", "user_id", F.col("value").alias("own"))
    b = e.filter("event_type <> 'signup'").select(F.col("event_id").alias("other"), "user_id", "us", "value")
    return a.join(b, "user_id").groupBy("event_id").agg(F.min_by("other", F.struct(F.abs(F.col("own") - F.col("value")), "us", "other")).alias("best"))


@query("""WITH h AS (SELECT lower(p_name) AS name, min_by(p_brand, p_partkey) AS icon FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT p_partkey, CASE WHEN p_size > 25 THEN h.icon END AS icon, CASE WHEN p_size > 25 AND h.icon IS NOT NULL THEN 'classic' END AS icon_source FROM part LEFT JOIN h ON lower(p_name) = h.name""")
def icons_applied(t):
    """Hints by lower-cased name, the first of a name; written back with full refresh: what isn't matched loses the field."""
    hints = t.part.filter("p_partkey % 3 = 0").groupBy(F.lower("p_name").alias("name")).agg(F.min_by("p_brand", "p_partkey").alias("hint"))
    got = t.part.join(hints, F.lower("p_name") == F.col("name"), "left")
    icon = F.when(F.col("p_size") > 25, F.col("hint"))
    return got.select("p_partkey", icon.alias("icon"), F.when(icon.isNotNull(), "classic").alias("icon_source"))


@query("""WITH own AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_partkey % 4 = 0), shared AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 9 = 0), racial AS (SELECT p_name, min(p_brand) AS race FROM part WHERE p_partkey % 11 = 0 GROUP BY 1), talent AS (SELECT DISTINCT p_name FROM part WHERE p_type = 'ECONOMY')
SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND r.race IS NOT NULL THEN 'racial ' || r.race WHEN o.p_name IS NOT NULL OR s.p_name IS NOT NULL THEN 'same' WHEN l.p_name IS NOT NULL THEN 'talent' ELSE 'new' END AS status
FROM part p LEFT JOIN own o ON o.p_name = p.p_name AND o.p_brand = p.p_brand LEFT JOIN shared s ON s.p_name = p.p_name LEFT JOIN racial r ON r.p_name = p.p_name LEFT JOIN talent l ON l.p_name = p.p_name""")
def name_status(t):
    """A name's status by precedence: racial, of its class or shared, a talent's, else new."""
    p, flag = t.part, lambda n: F.lit(True).alias(n)
    own = p.filter("p_partkey % 4 = 0").select("p_name", "p_brand", flag("own")).distinct()
    shared, talent = p.filter("p_partkey % 9 = 0").select("p_name", flag("shared")).distinct(), p.filter("p_type = 'ECONOMY'").select("p_name", flag("talent")).distinct()
    racial = p.filter("p_partkey % 11 = 0").groupBy("p_name").agg(F.min("p_brand").alias("race"))
    d = p.join(own, ["p_name", "p_brand"], "left").join(shared, "p_name", "left").join(racial, "p_name", "left").join(talent, "p_name", "left")
    return d.select("p_partkey", F.when((F.col("p_size") % 5 == 0) & F.col("race").isNotNull(), F.concat(F.lit("racial "), F.col("race"))).when(F.coalesce("own", "shared"), "same").when(F.col("talent"), "talent").otherwise("new").alias("status"))


@query("""WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'a' || (p_partkey + 1) END AS said, CASE WHEN p_partkey % 2 = 0 THEN 'a' || (p_partkey + p_partkey % 4) END AS drawn FROM part) SELECT k AS p_partkey, coalesce(said, drawn) AS requires, CASE WHEN said IS NOT NULL AND drawn IS NOT NULL AND said <> drawn THEN 'arrow says ' || drawn WHEN said IS NULL AND drawn IS NOT NULL THEN 'from arrow' END AS note FROM t""")
def arrow_requires(t):
    """J33, BIZ42: prerequisites of text and of arrows: text wins, a conflict is noted."""
    k = F.col("p_partkey")
    a = lambda x: F.concat(F.lit("a"), x.cast("string"))
    said = t.part.filter(k % 3 == 0).select("p_partkey", a(k + 1).alias("said"))
    drawn = t.part.filter(k % 2 == 0).select("p_partkey", a(k + k % 4).alias("drawn"))
    d = t.part.select("p_partkey").join(said, "p_partkey", "left").join(drawn, "p_partkey", "left")
    return d.select("p_partkey", F.coalesce("said", "drawn").alias("requires"), F.when(F.col("said") != F.col("drawn"), F.concat(F.lit("arrow says "), F.col("drawn"))).when(F.col("said").isNull() & F.col("drawn").isNotNull(), "from arrow").alias("note"))


@query("""SELECT p_partkey, CASE WHEN strpos(p_name, ' ') > 0 THEN 'Needs |' || p_name || '| or |' || string_split(p_name, ' ')[1] || '|.' ELSE 'Needs |' || p_name || '| or |' || p_name || '|.' END AS segments, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE array_to_string(list_filter(['a', 'b', 'c'], lambda x: x <> CASE p_partkey % 2 WHEN 0 THEN 'b' ELSE 'z' END), ',') END AS combos FROM part""")
def name_segments(t):
    """Sentences cut at the names they hold; new combinations, null where nothing was known before."""
    first = F.get(F.split("p_name", " "), 0)
    line = F.concat(F.lit("Needs "), F.col("p_name"), F.lit(" or "), first, F.lit("."))
    segs = views.name_segments(line, F.array_distinct(F.array(first, F.col("p_name"))))
    k = F.col("p_partkey")
    prior = F.when(k % 3 != 0, F.array(F.when(k % 2 == 0, "b").otherwise("z")))
    combos = F.when(prior.isNotNull(), F.array_join(F.array_except(F.array(F.lit("a"), F.lit("b"), F.lit("c")), prior), ","))
    return t.part.select("p_partkey", F.array_join(F.transform(segs, lambda s: s["text"]), "|").alias("segments"), combos.alias("combos"))


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 AND min(o_orderstatus) = 'O' THEN 'Read from footage.' WHEN count(DISTINCT o_orderstatus) = 1 AND min(o_orderstatus) = 'F' THEN 'Read from the client.' WHEN count(DISTINCT o_orderstatus) = 1 AND min(o_orderstatus) = 'P' THEN 'Entered by hand.' ELSE 'Read from footage and from the client.' END AS line,
  CASE WHEN count(*) FILTER (o_orderkey % 3 = 0) = 0 THEN 'None of the ' || count(*) || ' checked.' WHEN count(*) FILTER (o_orderkey % 3 = 0) = count(*) THEN 'All ' || count(*) || ' checked.' ELSE count(*) FILTER (o_orderkey % 3 = 0) || ' of ' || count(*) || ' checked.' END AS checked,
  CASE WHEN count(*) FILTER (o_totalprice < 100000) > 0 THEN count(*) FILTER (o_totalprice < 100000) || ' of ' || count(*) || ' uncertain.' END AS doubts FROM orders GROUP BY 1""")
def trust_lines(t):
    """AGG24: where a customer's orders come from, how many were checked, how many are uncertain."""
    kind = F.when(F.col("o_orderstatus") == "O", "video").when(F.col("o_orderstatus") == "F", "datamined").otherwise("manual")
    return views.trust_lines(t.orders.withColumn("kind", kind), "o_custkey", "kind", F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") < 100000)


@query("""SELECT l_returnflag AS kind, CAST(floor(l_discount * 100 / 2) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (l_tax = 0) AS cut_off, count(*) FILTER (l_shipdate IS NULL) AS missing, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY ALL""")
def outcome_counts(t):
    """AGG12, AGG25, AGG27: a histogram with counts of what was cut off or is missing, per kind of outcome."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("kind"), F.floor(F.col("l_discount") * 100 / 2).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") == 0).alias("cut_off"), F.count_if(F.col("l_shipdate").isNull()).alias("missing"), F.countDistinct("l_suppkey").alias("sources"))


@query("""WITH o AS (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT n_name, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM o WHERE c_nationkey = n_nationkey), 0) AS orders, coalesce((SELECT string_agg(o_orderpriority || ':' || n, ',' ORDER BY o_orderpriority) FROM o WHERE c_nationkey = n_nationkey), '') AS by_priority, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey""")
def nation_index(t):
    """AGG19, AGG26: nations with their orders and lists of counts, empty ones kept."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(F.count("*").alias("n")).join(t.customer, "c_custkey").groupBy("c_nationkey", "o_orderpriority").agg(F.sum("n").alias("n"))
    g = per.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("orders"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "n"))), lambda x: F.concat_ws(":", x["o_orderpriority"], x["n"].cast("string"))), ",").alias("by_priority"))
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).join(g, "n_nationkey", "left").select("n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("by_priority", F.lit("")).alias("by_priority"), F.col("r_name").alias("region"))


@query("""WITH v AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(median(x), 6) AS middle, count(*) FILTER (abs(x) > 0.1) >= greatest(3, 0.25 * count(*)) AS unstable FROM v GROUP BY ALL""")
def median_vectors(t):
    """AGG31, AGG32: the median of each place over a label's vectors, and the places that move in enough of them."""
    v = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return v.groupBy("label", "i").agg(F.round(F.percentile("x", 0.5), 6).alias("middle"), (F.count_if(F.abs("x") > 0.1) >= F.greatest(F.lit(3.0), 0.25 * F.count("*"))).alias("unstable"))


@query("""WITH c AS (SELECT user_id, event_type, date_trunc('day', ts) AS seg, value, event_id, epoch_us(ts) AS us FROM events WHERE value > 20) SELECT user_id, event_type, strftime(min(seg), '%Y-%m-%d') AS first_segment, max(value) AS sharpest FROM c GROUP BY ALL""")
def chosen_recoveries(t):
    """AGG36, AGG2: the sharpest candidate of each user and type under a condition, and the earliest day that has one."""
    return t.events.filter("value > 20").groupBy("user_id", "event_type").agg(F.date_format(F.min(F.date_trunc("day", "ts")), "yyyy-MM-dd").alias("first_segment"), F.max("value").alias("sharpest"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, value FROM events), r AS (SELECT user_id, min(h) AS t0, max(h) AS t1, run FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY h, value ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY h, value) <= 12 THEN 0 ELSE 1 END AS new FROM e WHERE value >= 50)) GROUP BY user_id, run),
w AS (SELECT user_id, h - 6 AS a, h + 30 AS b FROM e WHERE value >= 150) SELECT count(*) AS runs, count(*) FILTER (EXISTS (SELECT 1 FROM w WHERE w.user_id = r.user_id AND a <= t0 AND b >= t1)) AS covered FROM r""")
def sweep_coverage(t):
    """AGG37: runs of hits, and how many lie wholly in a window around a strong one."""
    from ..operators import sessions

    e = t.events.select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("h"), "value", F.lit(1).alias("one"))
    runs = sessions.runs(e.filter("value >= 50"), ["user_id"], ["h", "value"], "h", "one", 12).select("user_id", "run", "t0", "t1")
    w = e.filter("value >= 150").select(F.col("user_id").alias("u"), (F.col("h") - 6).alias("a"), (F.col("h") + 30).alias("b"))
    hit = runs.join(w, (F.col("user_id") == F.col("u")) & (F.col("a") <= F.col("t0")) & (F.col("b") >= F.col("t1")), "left_semi")
    return runs.withColumn("hit", F.lit(0)).unionAll(hit.withColumn("hit", F.lit(1))).agg(F.count_if(F.col("hit") == 0).alias("runs"), F.count_if(F.col("hit") == 1).alias("covered"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS place, CAST(len(list_filter(range(o_orderkey % 20, o_orderkey % 20 + 30, 7), lambda i: i < 40)) AS INT) AS frames FROM orders""")
def running_orders(t):
    """WIN9, WIN15: a running number within a customer, and how many offsets from a lead over a span in steps stay in bounds."""
    k = (F.col("o_orderkey") % 20).cast("int")
    return t.orders.select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).alias("place"), F.size(F.filter(F.sequence(k, k + 29, F.lit(7)), lambda i: i < 40)).alias("frames"))


_STATE = """WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, value FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS state FROM (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id)) <= 40 THEN 0 ELSE 1 END AS new FROM e)),
"""


@query(_STATE + """g AS (SELECT user_id, CAST(state AS BIGINT) AS state, count(*) AS n, sum(value) AS total FROM s GROUP BY ALL HAVING count(*) >= 2) SELECT user_id, state, n, round(total, 2) AS total FROM g""")
def change_states(t):
    """WIN18, WIN19, STM2: states of a user's values, which end where the value jumps."""
    e = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "value")
    return views.states(e, ["user_id"], ["us", "event_id"], "value", 40.0, 2).select("user_id", "state", "n", F.round("total", 2).alias("total"))


@query()
def distinct_states(t):
    """SRT13, SRT14: a type's events in order, without those whose value is close to one that stays."""
    e = t.events.select("event_type", "event_id", "value")
    return views.distinct_states(e, ["event_type"], "event_id", "value", 0.5, [F.col("event_id")])


@query("""SELECT n_name, n_nationkey, r_name, CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 99 END AS rank, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 99 END, r_name, lower(n_name)) AS place FROM nation JOIN region ON r_regionkey = n_regionkey""")
def ordered_nations(t):
    """SRT3-SRT7, SRT11: by page (unknown last), then name: 25 nations, the one table here that is numbered as a whole."""
    rank = F.when(F.col("r_name") == "EUROPE", 0).when(F.col("r_name") == "ASIA", 1).otherwise(99)
    d = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select("n_name", "n_nationkey", "r_name", rank.alias("rank"), F.row_number().over(Window.orderBy(rank, "r_name", F.lower("n_name"))).alias("place"))


@query("""WITH c AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(l_linenumber))) AS seen FROM lineitem GROUP BY 1), m AS (SELECT o, unnest(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(seen, x))) AS line, list_max(seen) AS top FROM c)
SELECT o AS l_orderkey, line AS l_linenumber, CASE WHEN line > top THEN 'never reached' WHEN o % 2 = 0 THEN 'skipped' ELSE 'no detection' END AS reason FROM m""")
def missing_lines(t):
    """SET6: line numbers that an order lacks, with a reason."""
    c = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("seen"), F.max("l_linenumber").alias("top"))
    m = c.select("l_orderkey", "top", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(7)), "seen")).alias("l_linenumber"))
    return m.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > F.col("top"), "never reached").when(F.col("l_orderkey") % 2 == 0, "skipped").otherwise("no detection").alias("reason"))


_FILES = """WITH r AS (SELECT DISTINCT unnest(['img/' || (p_partkey % 50) || '.png', CASE WHEN p_size % 2 = 0 THEN 'crop/' || p_size || '.png' END]) AS path FROM part), d AS (SELECT CASE WHEN s % 9 = 0 THEN 'crop/_keep' || s || '.png' WHEN s % 2 = 0 THEN 'crop/' || s || '.png' ELSE 'img/' || s || '.png' END AS path FROM range(80) x(s))
"""


def _files(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    wanted = t.part.select(F.explode(F.array(F.concat(F.lit("img/"), (k % 50).cast("string"), F.lit(".png")), F.when(s % 2 == 0, F.concat(F.lit("crop/"), s.cast("string"), F.lit(".png"))))).alias("path")).filter("path is not null").distinct()
    i = F.col("id")
    name = F.when(i % 9 == 0, F.concat(F.lit("crop/_keep"), i.cast("string"))).when(i % 2 == 0, F.concat(F.lit("crop/"), i.cast("string"))).otherwise(F.concat(F.lit("img/"), i.cast("string")))
    return t.spark.range(80).select(F.concat(name, F.lit(".png")).alias("path")), wanted


@query(_FILES + "SELECT path FROM d WHERE path NOT LIKE 'crop/\\_%' ESCAPE '\\' AND path NOT IN (SELECT path FROM r WHERE path IS NOT NULL)")
def orphan_files(t):
    """SNK18-SNK20, SET8: files that nothing refers to; names with a leading _ stay."""
    return views.orphans(*_files(t))


@query(_FILES + "SELECT path FROM r WHERE path IS NOT NULL")
def referenced_files(t):
    """SET8, SET9, SNK22: all files that are referred to, once each."""
    return _files(t)[1].orderBy("path")


@query("""WITH x AS (SELECT user_id, event_type, min(epoch_us(ts)::HUGEINT * 1000000 + event_id) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS types FROM x GROUP BY 1""")
def ordered_types(t):
    """SET10, WIN5: a user's event types in the order of their first appearance."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")).alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ">").alias("types"))


@query("""WITH x AS (SELECT p_partkey AS k, p_partkey % 4 AS ranks, 1 + p_partkey % 2 AS seen, CASE p_partkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'classic-prior' ELSE 'guess' END AS src, p_partkey % 5 = 0 AS prop FROM part)
SELECT k AS p_partkey, CASE WHEN ranks > seen THEN CASE WHEN ranks = seen + 1 THEN 'Rank ' || ranks || ' is ' ELSE 'Ranks ' || seen + 1 || '-' || ranks || ' are ' END || CASE WHEN src = 'manual' THEN 'not known yet' WHEN prop THEN 'rank times the first' WHEN src = 'classic-prior' THEN 'taken from the prior' ELSE 'estimated' END || '.' END AS line FROM x""")
def derivation_lines(t):
    """STR42: where unobserved ranks come from."""
    k = F.col("p_partkey")
    src = F.when(k % 3 == 0, "manual").when(k % 3 == 1, "classic-prior").otherwise("guess")
    return t.part.select("p_partkey", views.derivation(src, 1 + k % 2, k % 4, F.when(k % 5 == 0, "proportional").otherwise("table")).alias("line"))


@query("""WITH x AS (SELECT p_partkey, p_type AS section, p_name, CASE p_partkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'moved' WHEN 2 THEN 'values' ELSE 'gone' END AS status FROM part)
SELECT status, section, n, names, CAST(sum(n) OVER (PARTITION BY status) AS BIGINT) AS total FROM (SELECT status, section, count(*) AS n, string_agg(p_name, ',' ORDER BY p_name, p_partkey) AS names FROM x WHERE lower(p_name) LIKE '%o%' GROUP BY status, section)""")
def change_sections(t):
    """BIZ24, BIZ26, BIZ27, FLT7: changes by status and section, filtered and counted anew."""
    k = F.col("p_partkey")
    x = t.part.filter(F.lower("p_name").contains("o")).select(F.when(k % 4 == 0, "new").when(k % 4 == 1, "moved").when(k % 4 == 2, "values").otherwise("gone").alias("status"), F.col("p_type").alias("section"), "p_name", "p_partkey")
    g = x.groupBy("status", "section").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))), lambda s: s["p_name"]), ",").alias("names"))
    return resolve.same_keys(g, g.groupBy("status").agg(F.sum("n").alias("total")), ["status"])


@query("""WITH v AS (SELECT p_brand AS class, lower(p_type) AS tree, string_agg(p_partkey || '', ',' ORDER BY p_size, p_partkey) AS ids, count(*) AS n FROM part GROUP BY ALL) SELECT class, string_agg(tree || '=' || ids, ';' ORDER BY tree) AS entry, CAST(sum(n) AS BIGINT) AS talents FROM v GROUP BY 1""")
def encoding_entries(t):
    """BIZ9, BIZ19, BIZ20, BIZ25: trees of a class in order with their ids, row by row: what a version of the encoding freezes."""
    own = t.part.groupBy(F.col("p_brand").alias("class"), F.lower("p_type").alias("tree")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_size", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("ids"), F.count("*").alias("n"))
    return own.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tree", "ids"))), lambda x: F.concat_ws("=", x["tree"], x["ids"])), ";").alias("entry"), F.sum("n").alias("talents"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error' AND value >= 100) AS throttled, count(*) FILTER (event_type = 'error' AND value < 100) AS live_edge, count(*) FILTER (event_type = 'error' AND value >= 100) > 2 AS abort FROM events GROUP BY 1""")
def skip_health(t):
    """STM4, STM5: skips of a day as throttled or at the live edge, and whether to stop."""
    error, high = F.col("event_type") == "error", F.col("value") >= 100
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(error & high).alias("throttled"), F.count_if(error & ~high).alias("live_edge"), (F.count_if(error & high) > 2).alias("abort"))
