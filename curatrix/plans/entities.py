"""Queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..operators import builds, graph, match, merge, resolve, rules, templates
from .documents import _SLUG
from .registry import query


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS top FROM c)
SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, max(n) AS n, count(*) > 1 AS tie FROM m WHERE n = top GROUP BY o_custkey
""")
def mode_name(t):
    """AGG9, AGG10: the most common priority of each customer."""
    return resolve.majority(t.orders, ["o_custkey"], "o_orderpriority")


@query("""
SELECT p_partkey, n > 1 AS duplicate, CASE WHEN n > 1 THEN least(0.3, p_size / 50.0) ELSE p_size / 50.0 END AS confidence FROM part JOIN (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL) USING (p_brand, p_name)
""")
def duplicate_flag_cap(t):
    """AGG11, FLT1: repeated names of a brand have their confidence capped."""
    n = t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    own = F.col("p_size") / 50.0
    return resolve.same_keys(t.part, n, ["p_brand", "p_name"]).select("p_partkey", (F.col("n") > 1).alias("duplicate"), F.when(F.col("n") > 1, F.least(F.lit(0.3), own)).otherwise(own).alias("confidence"))


@query("""
SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def status_counts_rollup(t):
    """AGG15, AGG16."""
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


@query("""
SELECT n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
""")
def left_counts_keep_empty(t):
    """AGG17, AGG20: counts per nation, empty ones kept."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    return t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("""
WITH g AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS seen FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(seen) AS INT) AS n, array_to_string(seen, ',') AS seen, array_to_string(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(seen, x)), ',') AS missing FROM g
""")
def nested_coverage(t):
    """AGG18, AGG28, SET7: line numbers that an order has and lacks."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("s"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return g.select("l_orderkey", F.size("s").alias("n"), text(F.col("s")).alias("seen"), text(F.array_except(F.sequence(F.lit(1), F.lit(7)), "s")).alias("missing"))


@query("""
WITH per AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS points FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, points, CAST(coalesce(sum(points) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS above FROM per
""")
def prefix_points(t):
    """WIN8, AGG22: points in strictly lower tiers."""
    return builds.points_above(t.lineitem.withColumn("q", F.col("l_quantity").cast("long")), ["l_orderkey"], "l_linenumber", "q")


@query(f"""
WITH s AS (SELECT p_partkey, p_brand, {_SLUG.format('p_name')} AS slug FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY slug) AS same, row_number() OVER (PARTITION BY slug, p_brand ORDER BY p_partkey) AS nth FROM s)
SELECT p_partkey, CASE WHEN same = 1 THEN slug ELSE slug || '-' || lower(replace(p_brand, '#', '')) || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END END AS id FROM n
""")
def unique_ids(t):
    """WIN10, WIN11: names as ids; a shared name gets its brand, then a number."""
    s = t.part.select("p_partkey", "p_brand", tx.slug(F.col("p_name")).alias("slug"))
    same = s.groupBy("slug").agg(F.count("*").alias("same"))
    nth = F.row_number().over(Window.partitionBy("slug", "p_brand").orderBy("p_partkey"))
    own = F.concat_ws("-", "slug", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(F.col("nth") > 1, F.col("nth").cast("string")))
    return resolve.same_keys(s.withColumn("nth", nth), same, ["slug"]).select("p_partkey", F.when(F.col("same") == 1, F.col("slug")).otherwise(own).alias("id"))


@query("""
SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def lookup_chain(t):
    """Dimension lookups; lines and orders are aggregated before they meet the dimensions."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = t.orders.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("o_orderkey").alias("o"), F.sum("r").alias("r"))
    cust = t.customer.join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("c"), F.sum("o").alias("o"), F.sum("r").alias("r"))
    dims = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return cust.join(F.broadcast(dims), "n_nationkey").select("r_name", "n_name", F.col("c").alias("customers"), F.coalesce("o", F.lit(0)).alias("orders"), F.round("r", 2).alias("revenue"))


_SNAP = """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'gone' WHEN a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' END) ELSE '' END AS fields FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
"""


def _snapshots(t):
    k = F.col("o_orderkey")
    old = t.orders.filter(k % 10 != 0)
    new = t.orders.filter(k % 13 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return match.snapshot_diff(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(_SNAP + "SELECT * FROM d")
def snapshot_diff(t):
    """J7, SET4: two snapshots, made by rules on the key."""
    return _snapshots(t)


@query(_SNAP + "SELECT count(*) FILTER (status IN ('same', 'changed')) AS common, count(*) FILTER (status = 'same') AS equal, round(100.0 * count(*) FILTER (status = 'same') / count(*) FILTER (status IN ('same', 'changed')), 2) AS percent FROM d")
def snapshot_percent(t):
    """How much of what both have is equal."""
    both = F.col("status").isin("same", "changed")
    return _snapshots(t).agg(F.count_if(both).alias("common"), F.count_if(F.col("status") == "same").alias("equal")).withColumn("percent", F.round(100.0 * F.col("equal") / F.col("common"), 2))


_PARTS = """WITH v AS (SELECT p_partkey, p_name AS n1, p_size AS s1, p_retailprice AS r1, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' new' ELSE p_name END AS n2, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS s2, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS r2 FROM part),
k AS (SELECT p_partkey, CASE WHEN n1 <> n2 THEN 'reworded' WHEN s1 <> s2 AND r1 <> r2 THEN 'reworked' WHEN s1 <> s2 THEN 'resized' WHEN r1 <> r2 THEN 'repriced' ELSE 'unchanged' END AS status FROM v)
"""


def _changes(t):
    """Both versions of every part as columns, compared field by field."""
    k = F.col("p_partkey")
    old = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    new = t.part.select(k, F.when(k % 5 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")).alias("p_name"), F.when(k % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.when(k % 4 == 0, F.col("p_retailprice") * 2).otherwise(F.col("p_retailprice")).alias("p_retailprice"))
    both = match.two_versions(old, new, ["p_partkey"], ["p_name", "p_size", "p_retailprice"])
    renamed, resized, repriced = (~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in ("p_name", "p_size", "p_retailprice"))
    return both.select("p_partkey", builds.first_reason([("reworded", renamed), ("reworked", resized & repriced), ("resized", resized), ("repriced", repriced), ("unchanged", F.lit(True))]).alias("status"))


@query(_PARTS + "SELECT * FROM k")
def classify_change(t):
    """BIZ22, BIZ23: the first class of change that holds."""
    return _changes(t)


@query(_PARTS + "SELECT s AS status, count(k.status) AS n FROM (SELECT unnest(['reworded', 'reworked', 'resized', 'repriced', 'unchanged', 'removed']) AS s) LEFT JOIN k ON k.status = s GROUP BY s")
def change_counts(t):
    """AGG15: counts over a fixed list of classes, zeros kept."""
    names = t.spark.createDataFrame([(s,) for s in ("reworded", "reworked", "resized", "repriced", "unchanged", "removed")], "status string")
    n = _changes(t).groupBy("status").agg(F.count("*").alias("n"))
    return names.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH c AS (SELECT c_nationkey AS nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer), s AS (SELECT s_nationkey AS nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier)
SELECT nationkey, c_custkey, s_suppkey FROM c JOIN s USING (nationkey, nth)
""")
def exclusive_match(t):
    """Customers and suppliers of a nation paired off, each once."""
    return match.exclusive_pairs(t.customer.withColumnRenamed("c_nationkey", "nationkey"), t.supplier.withColumnRenamed("s_nationkey", "nationkey"), "nationkey", "c_custkey", "s_suppkey")


@query("""
WITH a AS (SELECT DISTINCT p_name AS a FROM part WHERE length(p_name) >= 6), b AS (SELECT DISTINCT p_name AS b FROM part)
SELECT a, b, CAST(levenshtein(a, b) AS INT) AS edits FROM a JOIN b ON left(a, 1) = left(b, 1) AND a <> b AND abs(length(a) - length(b)) <= 3 AND levenshtein(a, b) <= 3
""")
def fuzzy_blocked(t):
    """Part names of one first letter at most three edits apart: candidates, no best one is chosen."""
    return match.fuzzy(t.part.select(F.col("p_name").alias("a")), t.part.select(F.col("p_name").alias("b")), "a", "b", most=3)


@query("""
WITH v AS (SELECT DISTINCT p_name AS b FROM part), a AS (SELECT DISTINCT p_name || 's' AS a FROM part UNION SELECT DISTINCT substr(p_name, 1, 1) || substr(p_name, 3) FROM part),
d AS (SELECT a, b, CAST(levenshtein(a, b) AS INT) AS edits FROM a JOIN v ON left(a, 1) = left(b, 1) WHERE length(a) >= 6 AND a NOT IN (SELECT b FROM v) AND levenshtein(a, b) <= 2),
m AS (SELECT *, min(edits) OVER (PARTITION BY a) AS least FROM d)
SELECT a, min(b) AS b, min(edits) AS edits FROM m WHERE edits = least GROUP BY a HAVING count(*) = 1
""")
def snap_unique(t):
    """STR25: misspelt part names, a letter more or less, set right where one name is nearest."""
    n = t.part.select("p_name").filter("p_name is not null").distinct()
    wrong = n.select(F.concat("p_name", F.lit("s")).alias("a")).unionAll(n.select(F.concat(F.left("p_name", F.lit(1)), F.substr("p_name", F.lit(3))).alias("a")))
    return match.snapped(wrong, n.select(F.col("p_name").alias("b")), "a", "b")


@query()
def fuzzy_ratio(t):
    """STR29: all pairs of part names whose sorted words are at least 75 alike."""
    return match.alike(t.part, "p_name", 75)


_OVER = """WITH o AS (SELECT o_custkey AS c_custkey, bool_or(o_orderstatus = 'F' AND o_totalprice > 400000) AS del, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS bal FROM orders GROUP BY 1),
p AS (SELECT c_custkey, del, bal FROM o WHERE del OR bal IS NOT NULL UNION ALL SELECT -1, FALSE, 1.0)
"""


@query(_OVER + """SELECT coalesce(c.c_custkey, p.c_custkey) AS c_custkey, round(coalesce(bal, c_acctbal), 2) AS c_acctbal, CASE WHEN c.c_custkey IS NULL THEN 'added' WHEN p.c_custkey IS NULL THEN 'base' ELSE 'override' END AS origin
FROM customer c FULL JOIN p ON c.c_custkey = p.c_custkey WHERE NOT coalesce(del, FALSE)""")
def overrides_fold(t):
    """BIZ17, BIZ18: balances set, rows deleted and added by overrides that orders imply."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).alias("delete"), F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("c_acctbal"))
    o = o.filter("delete or c_acctbal is not null").unionByName(t.spark.createDataFrame([(-1, False, 1.0)], "c_custkey long, delete boolean, c_acctbal double"))
    got = merge.overridden(t.customer.select("c_custkey", "c_acctbal"), o, "c_custkey", ["c_acctbal"])
    return got.select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "origin")


def _findings(t):
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return rules.all_findings(
        rules.unique(t.lineitem, ["l_orderkey", "l_linenumber"], "R05-LINE-DUP"),
        rules.within(t.lineitem, "l_quantity", 1, 45, "R05-QUANTITY", path),
        rules.foreign_key(t.orders, "o_custkey", t.customer, "c_custkey", "R04-CUSTOMER", F.col("o_orderkey")),
        rules.one_of(t.orders, "o_orderstatus", ["F", "O"], "R01-STATUS", F.col("o_orderkey")),
        rules.like(t.part, "p_brand", "^Brand#[0-4]", "R02-BRAND", F.col("p_partkey")),
        rules.not_null(t.part, "p_type", "R01-TYPE", F.col("p_partkey")),
        rules.contiguous(t.lineitem, "l_orderkey", "l_linenumber", "R09-GAP"),
    )


_RULES = """WITH f AS (
SELECT 'ERROR' AS level, 'R05-LINE-DUP' AS code, l_orderkey || '/' || l_linenumber AS path, 'l_orderkey+l_linenumber is repeated' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'ERROR', 'R05-QUANTITY', l_orderkey || '/' || l_linenumber, 'l_quantity is out of bounds' FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45
UNION ALL SELECT 'ERROR', 'R04-CUSTOMER', CAST(o_orderkey AS VARCHAR), 'o_custkey refers to nothing' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'ERROR', 'R01-STATUS', CAST(o_orderkey AS VARCHAR), 'o_orderstatus is not allowed' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'ERROR', 'R02-BRAND', CAST(p_partkey AS VARCHAR), 'p_brand has a wrong form' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-4]')
UNION ALL SELECT 'ERROR', 'R01-TYPE', CAST(p_partkey AS VARCHAR), 'p_type is missing' FROM part WHERE p_type IS NULL
UNION ALL SELECT 'WARNING', 'R09-GAP', CAST(l_orderkey AS VARCHAR), 'l_linenumber has gaps' FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber))
"""


@query(_RULES + "SELECT * FROM f")
def rules_findings(t):
    """V1-V9: one query per rule, united."""
    return _findings(t)


@query(_RULES + "SELECT level, code, count(*) AS n FROM f GROUP BY ALL")
def rules_summary(t):
    """AGG33: findings by level and code."""
    return _findings(t).groupBy("level", "code").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, lang, round(n_chars / 2000.0, 6) AS confidence FROM documents WHERE n_chars / 2000.0 < 0.8")
def review_queue(t):
    """VQ, SRT2: what is to be looked at, least confidence first."""
    return rules.review_queue(t.documents, F.round(F.col("n_chars") / 2000.0, 6), ["doc_id", "source", "lang"], 0.8).orderBy("confidence", "doc_id")


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 WHEN n_nationkey < 15 THEN n_nationkey + 1 END AS b FROM nation),
w AS (SELECT a AS x, b AS y, 1 AS steps FROM e WHERE b IS NOT NULL UNION SELECT x, e.b, steps + 1 FROM w JOIN e ON e.a = w.y WHERE e.b IS NOT NULL AND steps < 25)
SELECT DISTINCT x AS n_nationkey FROM w WHERE x = y
""")
def cycle_check(t):
    """V8, VZ: nations on a cycle of a successor relation."""
    k = F.col("n_nationkey")
    edges = t.nation.select(k.alias("a"), F.when(k % 5 == 4, k - 4).when(k < 15, k + 1).alias("b")).filter("b is not null")
    return graph.on_cycles(edges).select(F.col("node").alias("n_nationkey"))


_CODE = """WITH d AS (SELECT l_orderkey, l_linenumber % 3 AS segment, l_linenumber AS position, CAST(max(l_quantity) AS BIGINT) % 10 AS digit FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, segment, regexp_replace(string_agg(CAST(digit AS VARCHAR), '' ORDER BY position), '0+$', '') AS own FROM d GROUP BY ALL),
c AS (SELECT l_orderkey, regexp_replace(string_agg(own, '-' ORDER BY segment), '-+$', '') AS code FROM s GROUP BY 1)
"""


def _codes(t):
    d = t.lineitem.groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("segment"), F.col("l_linenumber").alias("position")).agg((F.max("l_quantity").cast("long") % 10).alias("digit"))
    return builds.encoded(d, "l_orderkey", "segment", "position", "digit")


@query(_CODE + "SELECT * FROM c")
def codec_encode(t):
    """BIZ6: positional codes."""
    return _codes(t)


@query(_CODE + """, g AS (SELECT l_orderkey, generate_subscripts(p, 1) - 1 AS segment, unnest(p) AS own FROM (SELECT l_orderkey, string_split(code, '-') AS p FROM c)),
x AS (SELECT l_orderkey, segment, generate_subscripts(p, 1) - 1 AS position, unnest(p) AS digit FROM (SELECT l_orderkey, segment, string_split(own, '') AS p FROM g WHERE own <> ''))
SELECT l_orderkey, CAST(segment AS INT) AS segment, CAST(position AS INT) AS position, CAST(digit AS INT) AS digit FROM x WHERE digit <> '' AND digit <> '0'""")
def codec_decode(t):
    """BIZ7: codes back to digits."""
    return builds.decoded(_codes(t), "l_orderkey", "code")


@query("""
WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_partkey + 100000 ELSE p_partkey END AS x FROM part), b AS (SELECT p_partkey, CASE WHEN x > 100000 AND x % 3 = 0 THEN x + 100000 ELSE x END AS x FROM a WHERE x IS NOT NULL)
SELECT p_partkey AS first_id, x AS id FROM b
""")
def migration_chain(t):
    """BIZ8, J34: ids through two versions of renames and removals."""
    k = F.col("p_partkey")
    one = t.part.filter((k % 17 == 0) | (k % 5 == 0)).select(k.alias("from_id"), F.when(k % 17 != 0, k + 100000).alias("to_id")).distinct()
    ids = t.part.select(k.alias("from_id")).unionAll(one.select("to_id")).distinct()  # version two renames what it finds, whether or not version one had renamed it
    two = ids.filter("from_id > 100000 and from_id % 3 = 0").select("from_id", (F.col("from_id") + 100000).alias("to_id"))
    return builds.migrated(t.part.filter(k.isNotNull()).select(k.alias("first_id"), k.alias("id")), "id", [one, two])


@query("""
WITH o AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN n > 6 THEN 'too-many' WHEN q > 150 THEN 'over-budget' WHEN d >= 0.1 THEN 'discount' ELSE 'ok' END AS verdict FROM o
""")
def verdict_first_reason(t):
    """BIZ1, BIZ3, BIZ28: the first rule that an order breaks."""
    o = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return o.select("l_orderkey", builds.first_reason([("too-many", F.col("n") > 6), ("over-budget", F.col("q") > 150), ("discount", F.col("d") >= 0.1)]).alias("verdict"))


@query("""
WITH RECURSIVE p AS (SELECT l_orderkey, l_linenumber - 1 AS tier, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
w AS (SELECT DISTINCT l_orderkey, -1 AS tier, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS q FROM p
  UNION ALL SELECT w.l_orderkey, w.tier + 1, w.total + CASE WHEN w.total >= 20 * (w.tier + 1) THEN coalesce(p.q, 0) ELSE 0 END, CASE WHEN w.total >= 20 * (w.tier + 1) THEN p.q END
  FROM w LEFT JOIN p ON p.l_orderkey = w.l_orderkey AND p.tier = w.tier + 1 WHERE w.tier < 6)
SELECT l_orderkey, CAST(tier AS INT) AS tier, q AS points FROM w WHERE q IS NOT NULL
""")
def sanitize_builds(t):
    """BIZ4, BIZ10: line quantities that rest on enough below them."""
    return builds.sanitised(t.lineitem, "l_orderkey", F.col("l_linenumber") - 1, "l_quantity", 20)


@query(r"""
SELECT p_partkey, 'Size ' || p_size || ' costs ' || CASE WHEN p_retailprice = round(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', round(p_retailprice, 2)), '\.?0+$', '') END || ' {2}' AS text,
       array_to_string(list_transform([1, 2, 3], lambda k: CAST(p_size * k AS VARCHAR)), '/') AS series FROM part
""")
def template_render(t):
    """STR12, STR18, MTH2: a template with slots, one of them missing; a slot scaled by rank."""
    text = tx.render(F.lit("Size {0} costs {1} {2}"), [F.col("p_size").cast("string"), tx.number_text(F.col("p_retailprice")), F.lit(None).cast("string")])
    return t.part.select("p_partkey", text.alias("text"), F.array_join(F.transform(num.scaled(F.col("p_size"), 3), lambda x: x.cast("long").cast("string")), "/").alias("series"))


@query("""
SELECT c_mktsegment AS segment, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS other FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1
""")
def matrix_pivot(t):
    """BIZ28, AGG21: segment by priority, from counts per customer."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("other")
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), kind.alias("kind")).agg(F.count("*").alias("n"))
    m = n.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey").groupBy("segment").pivot("kind", ["urgent", "high", "other"]).agg(F.sum("n"))
    return m.select("segment", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("urgent", "high", "other")])


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(CAST(q AS VARCHAR), '/' ORDER BY l_linenumber) AS spread, CAST(sum(q) AS BIGINT) AS spent, CAST(greatest(300 - sum(q), 0) AS BIGINT) AS spare FROM p GROUP BY 1
""")
def build_summary(t):
    """AGG23: points by line as a/b/c, spent and left."""
    p = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
    g = p.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("all"), F.sum("q").alias("spent"))
    return g.select("l_orderkey", F.array_join(F.transform("all", lambda x: x["q"].cast("string")), "/").alias("spread"), "spent", F.greatest(300 - F.col("spent"), F.lit(0)).alias("spare"))


@query("""
WITH a AS (SELECT l_orderkey, list(v ORDER BY l_linenumber) AS v FROM (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) GROUP BY 1),
d AS (SELECT l_orderkey, v, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS s FROM a)
SELECT l_orderkey, CASE WHEN len(list_distinct(v)) <= 1 THEN 'constant' WHEN len(list_distinct(s)) = 1 AND s[1] = v[1] THEN 'proportional' WHEN len(list_distinct(s)) = 1 THEN 'affine' ELSE 'irregular' END AS kind FROM d
""")
def rank_progression(t):
    """WIN12, WIN13: how an order's quantities go on from line to line."""
    p = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    g = p.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("all"))
    return g.select("l_orderkey", num.progression(F.transform("all", lambda x: x["q"])).alias("kind"))


@query("""
WITH x AS (SELECT p_partkey, [CAST(p_size AS DOUBLE), p_size * 2.0, p_size * 3.0 + (p_partkey % 3)] AS v FROM part), b AS (SELECT *, greatest(v[1] - 0.5, (v[2] - 0.5) / 2, (v[3] - 0.5) / 3) AS lo, least(v[1] + 0.5, (v[2] + 0.5) / 2, (v[3] + 0.5) / 3) AS hi FROM x)
SELECT p_partkey, round(CASE WHEN lo <= hi THEN (lo + hi) / 2 ELSE -1 END, 6) AS k FROM b
""")
def proportional_fit(t):
    """MTH1: one coefficient that explains three printed values, -1 where there is none."""
    s = F.col("p_size").cast("double")
    return t.part.select("p_partkey", F.round(F.coalesce(num.proportional(F.array(s, s * 2, s * 3 + F.col("p_partkey") % 3)), F.lit(-1.0)), 6).alias("k"))


@query("""
SELECT p_partkey, CAST(CASE WHEN bit_count(p_size) = 1 THEN log2(p_size) + 1 ELSE 0 END AS INT) AS class_id, CAST(least(greatest(p_size - 10 + 1, 0), 30) AS INT) AS points FROM part
""")
def mask_and_level(t):
    """PRJ9, MTH10: a mask's only bit; points at a level."""
    return t.part.select("p_partkey", num.single_bit(F.col("p_size")).alias("class_id"), num.points_at_level(F.col("p_size"), 10, 30).alias("points"))


@query("""
WITH x AS (SELECT p_brand, p_type, p_partkey, p_size % 3 + 1 AS v, CASE WHEN p_size % 3 = 0 THEN '' ELSE 's' END AS s, CASE WHEN p_partkey % 17 = 0 THEN '!' ELSE '.' END AS e FROM part),
g AS (SELECT p_brand, p_type, count(DISTINCT v) > 1 AS many, count(DISTINCT s) > 1 AS mixed, count(DISTINCT e) > 1 AS changed FROM x GROUP BY ALL)
SELECT p_brand, p_type, CASE WHEN NOT any_value(changed) THEN 'Makes ' || p_type || ' parts of ' || p_brand || ' cost ' || CASE WHEN any_value(many) THEN '{0}' ELSE CAST(any_value(v) AS VARCHAR) END || ' point' || CASE WHEN any_value(mixed) THEN '{1}' ELSE any_value(s) END || any_value(e) END AS template,
  CASE WHEN NOT any_value(changed) THEN string_agg(CASE WHEN mixed THEN v || ',' || s WHEN many THEN CAST(v AS VARCHAR) ELSE '' END, ';' ORDER BY p_partkey) END AS slots
FROM x JOIN g USING (p_brand, p_type) GROUP BY p_brand, p_type
""")
def template_slots(t):
    """STR13, STR14: the template of a group's sentences and the slots of each; null where more than numbers and plurals differ."""
    v = F.col("p_size") % 3 + 1
    said = F.concat(F.lit("Makes "), "p_type", F.lit(" parts of "), "p_brand", F.lit(" cost "), v.cast("string"), F.when(v == 1, " point").otherwise(" points"), F.when(F.col("p_partkey") % 17 == 0, "!").otherwise("."))
    g = t.part.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", said.alias("said")))).alias("all"))
    got = templates.inferred(g.select("p_brand", "p_type", F.transform("all", lambda x: x["said"]).alias("texts")), "texts")
    return got.select("p_brand", "p_type", "template", F.array_join(F.transform("slots", lambda r: F.array_join(r, ",")), ";").alias("slots"))
