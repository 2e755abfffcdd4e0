"""Queries of the document rules: class, race and spell documents made of driver tables, with faults by modulo of their keys.

A document holds a bounded number of rows (50 parts, 6 customers, the lines of an order), so documents, not
their sizes, grow with the tables. The SQL states each fault on flat rows; the rules find it in nested documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..rules import classes, races, spells
from ..rules.common import findings
from .registry import query

VIDEO = ["kind", "video", "t", "frame", "crop", "panel", "confidence", "reader", "readings", "build", "talentId", "reviewed", "reviewedBy", "reviewedAt", "note"]


def _cast(df, schema: str):
    """``df``'s columns as the schema says, by position of its names."""
    from pyspark.sql import types as T

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])


def _source(**said):
    """A source struct: what isn't said is null."""
    kinds = dict(part.split(":", 1) for part in classes.SOURCE[len("struct<") : -1].split(","))
    return F.struct(*[said.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in VIDEO])


def _when(condition, value):
    return F.when(condition, value if not isinstance(value, str) else F.lit(value))


# --- class documents ---------------------------------------------------------------------------


def _class_rows(t):
    k = F.col("p_partkey")
    texts = ["Gives {0} and {2}.", "Gives {0} points.", "Within {0} yards of it.", "Adds {0}% damage.", " No l5 | slots here", "Odd {brace.", "Gives {0} point{1}."]
    text = F.element_at(F.array(*map(F.lit, texts)), (k % 7 + 1).cast("int"))
    ranks = (k % 4 + 1).cast("int")
    n = ranks + F.when(k % 6 == 0, 1).otherwise(0)
    id_ = F.concat(F.when(k % 17 == 0, "T_").otherwise("t"), (k % 40).cast("string"))
    value = lambda i: F.col("p_size").cast("double") * F.when(k % 3 == 2, i * i).otherwise(i)
    slots = lambda i: F.when(k % 7 == 6, F.array(value(i), F.lit(0.0))).when((k % 7).isin(4, 5), F.array().cast("array<double>")).otherwise(F.array(value(i)))
    rank = lambda i: F.struct(F.when(k % 13 == 0, F.when(k % 26 == 0, "Text {0}").otherwise("Read. ")).alias("text"), F.when(k % 13 != 0, slots(i)).alias("slots"))
    following = F.concat(F.lit("t"), ((k + 1) % 40).cast("string"))
    need = lambda talent, r: F.struct(talent.alias("talent"), F.lit(r).alias("rank"))
    has_prior = ((k % 5 == 1) & (k % 4 != 0)) | (k % 20 == 2)
    video, mined = k % 4 <= 1, k % 4 == 2
    source = _source(
        kind=F.when(video, "video").when(mined, "datamined").otherwise("manual"), video=_when(video, "v"), t=_when(video, F.lit(1.0)), frame=_when(video, F.lit(1)), crop=_when(k % 4 == 0, "c"),
        confidence=_when(video, (k % 10) / 10.0), reader=_when(video | (k % 8 == 7), "r"), readings=_when(k % 19 == 0, F.lit(2)), build=_when(mined & (k % 3 != 2), "b"), talentId=_when(mined, F.lit(1)),
        reviewed=_when(k % 5 == 0, F.lit(True)), reviewedBy=_when(k % 10 == 0, "me"), reviewedAt=F.when(k % 20 == 0, "2026-01-02T03:04:05Z").when(k % 10 == 0, "yesterday"),
    )
    talent = F.struct(
        id_.alias("id"), F.concat("p_name", F.when(k % 11 == 0, "  x").otherwise("")).alias("name"), (k % 9).alias("row"), (k % 5).alias("col"), ranks.alias("maxRank"), F.when(k % 2 == 0, F.concat(F.lit("crop-"), id_)).otherwise("x").alias("icon"),
        F.when(k % 3 == 0, "crop").otherwise("classic").alias("iconSource"), F.when(k % 6 < 3, F.concat(F.lit("crops/"), k.cast("string"))).alias("iconCrop"), text.alias("description"), F.transform(F.sequence(F.lit(1), n), rank).alias("ranks"),
        F.when(k % 8 == 0, F.array(F.lit(2), F.lit(1))).when(k % 8 == 1, F.array(F.lit(1), F.lit(9))).when(k % 8 == 2, F.sequence(F.lit(1), ranks)).otherwise(F.array(F.lit(1))).alias("ranksObserved"),
        F.element_at(F.array(*map(F.lit, ["observed", "classic-prior", "manual", "proportional", "proportional"])), (k % 5 + 1).cast("int")).alias("ranksSource"), _when(k % 2 == 0, "n").alias("ranksNote"),
        F.when(has_prior, F.struct(k.cast("int").alias("id"), F.array(F.when(k % 3 == 0, k).otherwise(0).cast("int")).alias("spells"))).alias("ranksPrior"),
        F.when(k % 9 == 0, F.array().cast("array<struct<talent:string,rank:int>>")).when(k % 9 == 1, F.array(need(id_, 1))).when(k % 9 == 2, F.array(need(following, 9))).when(k % 9 == 3, F.array_repeat(need(following, 1), 4)).alias("requires"),
        F.when(k % 7 == 0, F.array(F.lit(1))).alias("spellIds"), source.alias("source"),
    )
    return t.part.select(F.floor(k / 50).cast("long").alias("blk"), F.lower("p_type").alias("tree"), F.length("p_type").alias("len"), k.alias("k"), talent.alias("talent"))


def _class_docs(t):
    b = F.col("blk")
    trees = _class_rows(t).groupBy("blk", "tree", "len").agg(F.array_sort(F.collect_list(F.struct("k", "talent"))).alias("all"))
    tree = F.struct(F.col("tree").alias("id"), F.when(F.col("len") % 2 == 0, "main").otherwise("side").alias("page"), (F.col("len") % 3).alias("order"), F.lit(8).alias("rows"), F.lit(4).alias("cols"), _source().alias("source"), F.transform("all", lambda x: x["talent"]).alias("talents"))
    tree = tree.withField("source", F.lit(None).cast(classes.SOURCE))
    docs = trees.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("tree", tree.alias("t")))).alias("trees"))
    cls = F.concat(F.lit("c"), b.cast("string"))
    page = lambda *names: F.array(*[F.struct(F.lit(n).alias("id")) for n in names])
    none = F.array().cast("array<struct<id:string>>")
    rules = F.struct(F.lit(5).alias("pointsPerRow"), F.lit(51).alias("maxPoints"), F.lit(10).alias("firstPointLevel"), F.when(b % 6 == 5, 50).otherwise(60).alias("maxLevel"), F.when(b % 3 == 1, F.create_map(F.lit("main"), F.lit(31), F.lit("ghost"), F.lit(5))).otherwise(F.create_map(F.lit("main"), F.lit(31))).alias("pointsPerPage"))
    docs = docs.select(
        cls.alias("class"), F.when(b % 5 == 4, "other").otherwise(cls).alias("stem"), F.lit(1).alias("schemaVersion"), (1 + b % 3).alias("dataVersion"), F.when(b % 7 != 6, "2026").alias("generatedAt"), rules.alias("rules"),
        F.concat(page("main"), F.when(b % 3 != 0, page("side")).otherwise(none), F.when(b % 4 == 0, page("main")).otherwise(none)).alias("pages"), F.transform("trees", lambda x: x["t"]).alias("trees"),
    )
    return _cast(docs, classes.SCHEMA)


_T = """WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey // 50 AS blk, 'c' || (p_partkey // 50) AS cls, lower(p_type) AS tree, length(p_type) AS len, p_size, p_name,
  CASE WHEN p_partkey % 17 = 0 THEN 'T_' ELSE 't' END || (p_partkey % 40) AS id, p_partkey % 9 AS row, p_partkey % 5 AS col, p_partkey % 4 + 1 AS max_rank, p_partkey % 4 + 1 + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS nr,
  CASE WHEN length(p_type) % 2 = 0 THEN 'main' ELSE 'side' END AS page, (p_partkey % 5 = 1 AND p_partkey % 4 <> 0) OR p_partkey % 20 = 2 AS has_prior FROM part),
p AS (SELECT *, cls || '/' || tree || '/' || id AS path FROM t), b AS (SELECT DISTINCT blk, cls, CASE WHEN blk % 5 = 4 THEN 'other' ELSE cls END AS stem FROM t),
x AS (SELECT blk, cls, tree, page, len % 3 AS ord, sum(max_rank) AS total, count(DISTINCT row) FILTER (row < 8) AS used FROM t GROUP BY ALL),
"""
_R8 = """q AS (SELECT p.*, 't' || ((k + 1) % 40) AS target, CASE WHEN k % 9 = 2 THEN 9 ELSE 1 END AS need, CASE WHEN k % 9 = 2 THEN 1 ELSE 4 END AS times FROM p WHERE k % 9 IN (2, 3)),
l AS (SELECT blk, tree, id, max_by(row, k) AS row, max_by(col, k) AS col, max_by(max_rank, k) AS max_rank FROM t GROUP BY ALL),
r8 AS (SELECT q.cls, q.path, q.need, q.row, q.col, l.id AS hit, l.row AS r, l.col AS c, l.max_rank AS m, unnest(range(q.times)) AS i FROM q LEFT JOIN l ON l.blk = q.blk AND l.tree = q.tree AND l.id = q.target),
"""
_CLASS_SQL = _T + _R8 + """f AS (
SELECT cls, 'ERROR' AS level, 'R02-CLASS-STEM' AS code, stem AS path FROM b WHERE blk % 5 = 4
UNION ALL SELECT cls, 'WARNING', 'UNKNOWN-CLASS', stem FROM b WHERE blk > 1
UNION ALL SELECT cls, 'ERROR', 'R02-SLUG', path FROM p WHERE k % 17 = 0
UNION ALL SELECT cls, 'ERROR', 'R02-SLUG', path FROM p WHERE k % 17 = 0 AND k % 9 = 1
UNION ALL SELECT cls, 'ERROR', 'R03-RULES', cls || '/rules' FROM b WHERE blk % 6 = 5
UNION ALL SELECT cls, 'ERROR', 'R03-POINTS-PER-PAGE', cls || '/rules' FROM b WHERE blk % 3 = 1
UNION ALL SELECT cls, 'ERROR', 'R03-POINTS-PER-PAGE', cls || '/rules' FROM b WHERE FALSE
UNION ALL SELECT cls, 'ERROR', 'R04-PAGE-DUP', cls || '/pages' FROM b WHERE blk % 4 = 0
UNION ALL SELECT cls, 'ERROR', 'R04-TREE-PAGE', cls || '/' || tree FROM x WHERE page = 'side' AND blk % 3 = 0
UNION ALL SELECT cls, 'ERROR', 'R04-TREE-ORDER', cls || '/' || tree FROM (SELECT *, row_number() OVER (PARTITION BY blk, page, ord ORDER BY tree) AS n FROM x) WHERE n > 1
UNION ALL SELECT cls, 'ERROR', 'R05-ID-DUP', path FROM (SELECT *, row_number() OVER (PARTITION BY blk, id ORDER BY tree, k) AS n FROM p) WHERE n > 1
UNION ALL SELECT cls, 'ERROR', 'R05-CELL-DUP', path FROM (SELECT *, row_number() OVER (PARTITION BY blk, tree, row, col ORDER BY k) AS n FROM p) WHERE n > 1
UNION ALL SELECT cls, 'ERROR', 'R05-ROW', path FROM p WHERE row >= 8
UNION ALL SELECT cls, 'ERROR', 'R05-COL', path FROM p WHERE col >= 4
UNION ALL SELECT cls, 'ERROR', 'R06-BRACES', path FROM p WHERE k % 7 = 5
UNION ALL SELECT cls, 'ERROR', 'R06-PLACEHOLDERS', path FROM p WHERE k % 7 = 0
UNION ALL SELECT cls, 'ERROR', 'R06-RANKS-LEN', path FROM p WHERE k % 6 = 0
UNION ALL SELECT cls, 'ERROR', 'R06-SLOTS', path FROM (SELECT *, unnest(range(nr)) FROM p WHERE k % 13 <> 0 AND k % 7 = 0)
UNION ALL SELECT cls, 'ERROR', 'R06-STRING-RANK', path FROM (SELECT *, unnest(range(nr)) FROM p WHERE k % 26 = 0)
UNION ALL SELECT cls, 'ERROR', 'R07-OBSERVED-ORDER', path FROM p WHERE k % 8 = 0
UNION ALL SELECT cls, 'ERROR', 'R07-OBSERVED-RANGE', path FROM p WHERE k % 8 <= 1
UNION ALL SELECT cls, 'ERROR', 'R07-OBSERVED-IFF', path FROM p WHERE (k % 5 = 0) <> (k % 8 IN (2, 4))
UNION ALL SELECT cls, 'ERROR', 'R07-PRIOR-IFF', path FROM p WHERE (k % 5 = 1) <> has_prior
UNION ALL SELECT cls, 'ERROR', 'R07-MANUAL-NOTE', path FROM p WHERE k % 5 = 2 AND k % 2 = 1
UNION ALL SELECT cls, 'ERROR', 'R08-EMPTY', path FROM p WHERE k % 9 = 0
UNION ALL SELECT cls, 'ERROR', 'R08-COUNT', path FROM p WHERE k % 9 = 3
UNION ALL SELECT cls, 'ERROR', 'R08-SELF', path FROM p WHERE k % 9 = 1
UNION ALL SELECT cls, 'ERROR', 'R08-TARGET', path FROM r8 WHERE hit IS NULL
UNION ALL SELECT cls, 'ERROR', 'R08-ROW', path FROM r8 WHERE r > row
UNION ALL SELECT cls, 'ERROR', 'R08-CELL', path FROM r8 WHERE r = row AND c = col
UNION ALL SELECT cls, 'ERROR', 'R08-RANK', path FROM r8 WHERE need > m
UNION ALL SELECT cls, 'ERROR', 'R09-ICONCROP-IFF', path FROM p WHERE (k % 3 = 0) <> (k % 6 < 3)
UNION ALL SELECT cls, 'ERROR', 'R09-ICON-SLUG', path FROM p WHERE k % 3 = 0 AND k % 2 = 1
UNION ALL SELECT cls, 'ERROR', 'R10-SOURCE-VIDEO', path FROM p WHERE k % 4 = 1 OR k % 8 = 7
UNION ALL SELECT cls, 'ERROR', 'R10-SOURCE-DATAMINED', path FROM p WHERE k % 4 = 2 AND k % 3 = 2
UNION ALL SELECT cls, 'ERROR', 'R10-REVIEWED', path FROM p WHERE k % 5 = 0 AND k % 10 <> 0
UNION ALL SELECT cls, 'ERROR', 'R10-REVIEWED-AT', path FROM p WHERE k % 10 = 0 AND k % 20 <> 0
UNION ALL SELECT cls, 'WARNING', 'MANUAL-UNREVIEWED', path FROM p WHERE k % 4 = 3 AND k % 5 <> 0
UNION ALL SELECT cls, 'ERROR', 'R10-SPELLIDS', path FROM p WHERE k % 7 = 0 AND max_rank <> 1
UNION ALL SELECT cls, 'ERROR', 'R12-READINGS', path FROM p WHERE k % 19 = 0
UNION ALL SELECT cls, 'ERROR', 'R12-GENERATED-AT', cls FROM b WHERE blk % 7 = 6
UNION ALL SELECT cls, 'WARNING', 'R13-ROW-GATING', cls || '/' || tree FROM x WHERE page = 'main'
UNION ALL SELECT cls, 'WARNING', 'NEEDS-REVIEW', path FROM p WHERE k % 4 <= 1 AND k % 10 < 8 AND k % 5 <> 0
UNION ALL SELECT cls, 'WARNING', unnest(['R17-WHITESPACE', 'R17-TERMINATOR', 'R17-OCR-ARTEFACT', 'R17-OCR-ARTEFACT']), path FROM p WHERE k % 7 = 4
UNION ALL SELECT cls, 'WARNING', CASE WHEN k % 26 = 0 THEN 'R17-TERMINATOR' ELSE 'R17-WHITESPACE' END, path FROM (SELECT *, unnest(range(nr)) FROM p WHERE k % 13 = 0)
UNION ALL SELECT cls, 'WARNING', 'R17-NAME', path FROM p WHERE k % 11 = 0
UNION ALL SELECT cls, 'WARNING', 'R18-TREE-TOO-SMALL', cls || '/' || tree FROM x WHERE total < CASE WHEN page = 'main' THEN 31 ELSE 51 END
UNION ALL SELECT cls, 'WARNING', 'R19-EMPTY-ROWS', cls || '/' || tree FROM x WHERE used < 8)
"""


def _class_findings(t):
    return findings(_class_docs(t), "class", *classes.in_document(["c0", "c1"])).withColumnRenamed("class", "cls")


@query(_CLASS_SQL + "SELECT * FROM f")
def class_rules(t):
    """V1-V10, V12, V13, V16-V19, PRJ1, FLT15: what one class document decides."""
    return _class_findings(t)


@query(_CLASS_SQL + """, w AS (SELECT path, list_sort(list(code)) AS codes FROM f WHERE level = 'WARNING' AND code <> 'NEEDS-REVIEW' GROUP BY path),
z AS (SELECT p.*, CASE WHEN k % 4 <= 1 THEN (k % 10) / 10.0 END AS confidence, list_concat(list_concat(list_concat(CASE WHEN k % 4 <= 1 AND k % 10 < 8 THEN ['confidence'] ELSE [] END, CASE WHEN k % 5 = 2 THEN ['ranksSource manual'] ELSE [] END), CASE WHEN k % 3 = 0 THEN ['iconSource crop'] ELSE [] END), coalesce(codes, [])) AS why FROM p LEFT JOIN w USING (path))
SELECT cls, tree, id AS talent, confidence, array_to_string(why, ',') AS reasons FROM z WHERE len(why) > 0 AND k % 5 <> 0""")
def class_review(t):
    """VQ, SRT2: unreviewed talents with their reasons, least confidence first."""
    got = classes.review_reasons(_class_docs(t), _class_findings(t))
    got = got.select(F.col("class").alias("cls"), "tree", "talent", "confidence", F.array_join("reasons", ",").alias("reasons"))
    return got.orderBy(F.coalesce("confidence", F.lit(1.0)), "tree", "talent")


def _prior(t):
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 4 + 1 + F.when(F.col("p_partkey") % 6 == 0, 1).otherwise(0)).cast("int")
    size = F.col("p_size").cast("double")
    rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.array(size * F.when(k % 10 == 1, 3 * i * i).otherwise(2 * i)))
    return t.part.filter(k % 5 == 1).select(k.cast("int").alias("id"), F.concat(F.lit("c"), F.floor(k / 50).cast("string")).alias("class"), F.col("p_name").alias("name"), ((k + 1) % 4 + 1).cast("int").alias("max_rank"), F.array(k.cast("int")).alias("spells"), rows.alias("slots"))


@query(_T + """v AS (SELECT *, CASE WHEN k % 3 = 2 THEN p_size * nr * nr ELSE p_size * nr END AS top, CASE WHEN k % 10 = 1 THEN 3.0 * p_size * nr * nr ELSE 2.0 * p_size * nr END AS old, has_prior AND k % 5 = 1 AS known FROM p),
s AS (SELECT * FROM v WHERE max_rank >= 2 AND k % 13 <> 0 AND k % 7 NOT IN (4, 5)),
o AS (SELECT *, list_filter(range(1, nr + 1), lambda i: p_size * CASE WHEN k % 3 = 2 THEN i * i ELSE i END > 100 AND NOT CASE WHEN k % 8 = 0 THEN i IN (1, 2) WHEN k % 8 = 1 THEN i IN (1, 9) WHEN k % 8 = 2 THEN i <= max_rank ELSE i = 1 END) AS unread FROM s WHERE k % 7 = 3)
SELECT cls AS doc, 'WARNING' AS level, 'PRIOR-UNKNOWN' AS code, path FROM v WHERE has_prior AND k % 5 <> 1
UNION ALL SELECT cls, 'WARNING', 'PRIOR-SPELLS', path FROM v WHERE known AND k % 3 <> 0
UNION ALL SELECT cls, 'WARNING', 'NONLINEAR-RANKS', path FROM s WHERE k % 3 = 2 AND nr >= 3 AND NOT (known AND k % 10 = 1)
UNION ALL SELECT cls, 'WARNING', 'R20-THRESHOLD-SCALED', path FROM s WHERE k % 7 = 2
UNION ALL SELECT cls, 'WARNING', 'R20-PERCENT-OVER-100', path FROM o WHERE len(unread) > 0 AND p_size <= 100
UNION ALL SELECT cls, 'WARNING', 'R20-ABOVE-CLASSIC', path FROM s WHERE known AND top > 1.6 * old""")
def class_prior_rules(t):
    """V7, V14, V20, SRC21, SRC22: talents against their priors."""
    docs, prior = _class_docs(t), _prior(t)
    slots = classes.slot_columns(docs)
    return classes.against_prior(docs, prior).unionAll(classes.progressions(slots, prior)).unionAll(classes.sane_ranks(slots, prior))


@query()
def class_names(t):
    """Names without a prior of about the same name, and other rank counts."""
    return classes.names(_class_docs(t), _prior(t))


@query(_T + """e AS (SELECT DISTINCT blk, cls || '/' || tree || '/' || id AS a, cls || '/' || tree || '/' || CASE WHEN k % 9 = 1 THEN id ELSE 't' || ((k + 1) % 40) END AS b FROM t WHERE k % 9 IN (1, 2, 3)),
w AS (SELECT a AS x, b AS y FROM e UNION SELECT x, e.b FROM w JOIN e ON e.a = w.y) SELECT DISTINCT x AS node FROM w WHERE x = y""")
def requirement_cycles(t):
    """Talents that need themselves, through others of their tree or at once."""
    return graph.on_cycles(classes.requirement_edges(_class_docs(t)))


_ENC = """d AS (SELECT blk, cls, 1 + blk % 3 AS version, list(tree ORDER BY CASE WHEN page = 'main' THEN 1 WHEN blk % 3 <> 0 THEN 2 ELSE 99 END, ord, tree) AS trees FROM x GROUP BY ALL),
m AS (SELECT blk, tree, list(id ORDER BY row, col, id) AS own, list_sort(list(id)) AS sorted FROM t GROUP BY ALL),
n AS (SELECT blk, count(*) AS n, count(DISTINCT id) AS kinds FROM t GROUP BY ALL)
"""


def _registry(t):
    """Versions 1 and 2 of three classes in four: reversed trees in every fifth, ids by name in every second, one id too many in every seventh."""
    rows = _class_rows(t)
    b = F.col("blk")
    ids = rows.groupBy("blk", "tree", "len").agg(F.array_sort(F.collect_list(F.struct("talent.row", "talent.col", "talent.id"))).alias("own"))
    ids = ids.withColumn("ids", F.transform("own", lambda x: x["id"])).withColumn("ids", F.when(b % 2 == 1, F.array_sort("ids")).otherwise(F.col("ids")))
    page = F.when(F.col("len") % 2 == 0, 1).when(b % 3 != 0, 2).otherwise(99)
    g = ids.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct(page.alias("p"), (F.col("len") % 3).alias("o"), "tree", "ids"))).alias("all"))
    g = g.withColumn("trees", F.transform("all", lambda x: x["tree"])).withColumn("order", F.map_from_arrays("trees", F.transform("all", lambda x: x["ids"])))
    g = g.withColumn("trees", F.when(b % 5 == 0, F.reverse("trees")).otherwise(F.col("trees"))).withColumn("order", F.when(b % 7 == 0, F.map_concat("order", F.create_map(F.lit("zz"), F.array(F.lit("zz"))))).otherwise(F.col("order")))
    return g.filter(b % 4 != 3).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), F.concat(F.lit("c"), b.cast("string")).alias("class"), "trees", "order")


@query(_T + _ENC + """, k AS (SELECT *, version <= 2 AND blk % 4 <> 3 AS known FROM d)
SELECT cls, 'ERROR' AS level, 'R11-ENCODING-MISSING' AS code, cls AS path FROM d WHERE version = 3
UNION ALL SELECT cls, 'ERROR', 'R11-ENCODING-NOT-LATEST', cls FROM d WHERE version = 1
UNION ALL SELECT cls, 'ERROR', 'R11-ENCODING-CLASS', cls FROM d WHERE version <= 2 AND blk % 4 = 3
UNION ALL SELECT cls, 'ERROR', 'R11-ENCODING-TREES', cls FROM k WHERE known AND blk % 5 = 0 AND list_reverse(trees) <> trees
UNION ALL SELECT cls, 'ERROR', 'R11-ENCODING-IDS', cls FROM k WHERE known AND blk % 7 = 0
UNION ALL SELECT cls, 'ERROR', 'R11-ENCODING-DUP', cls FROM k JOIN n USING (blk) WHERE known AND n.n > kinds
UNION ALL SELECT cls, 'WARNING', 'ENCODING-ORDER', cls || '/' || tree FROM k JOIN m USING (blk) WHERE known AND blk % 2 = 1 AND own <> sorted""")
def class_encodings(t):
    """V11, J32, SRC24, SRC25, BIZ9: documents against the registry of encodings."""
    return classes.encodings(_class_docs(t), _registry(t)).withColumnRenamed("class", "cls")


@query("""WITH r AS (SELECT 'c' || (p_partkey % 5) AS cls, 'i' || p_partkey AS id, unnest([1, 2, 3]) AS version, p_partkey AS k FROM part), v AS (SELECT * FROM r WHERE version <> 2 OR k % 4 <> 0),
s AS (SELECT cls, version, id, k, CASE WHEN k % 8 = 0 THEN NULL WHEN k % 12 = 4 THEN 'i' || (k + 1) ELSE 'none' END AS new FROM (SELECT DISTINCT cls, 1 AS version, id, k FROM r WHERE k % 4 = 0 AND k % 16 <> 12) UNION ALL SELECT cls, 2, id, k, id FROM (SELECT DISTINCT cls, id, k FROM r WHERE k % 20 = 0))
SELECT v.cls, 'ERROR' AS level, CASE WHEN s.id IS NULL THEN 'R11-MIGRATION-NOT-TOTAL' ELSE 'R11-MIGRATION-RENAME' END AS code, v.cls || '/v' || v.version || '/' || v.id AS path
FROM v LEFT JOIN s ON s.cls = v.cls AND s.version = v.version AND s.id = v.id LEFT JOIN v w ON w.cls = v.cls AND w.version = v.version + 1 AND w.id = coalesce(s.new, v.id)
WHERE v.version < 3 AND (s.id IS NULL OR s.new IS NOT NULL) AND w.id IS NULL
UNION ALL SELECT cls, 'ERROR', 'R11-MIGRATION-RENAME', cls || '/v' || version || '/' || id FROM s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.cls = s.cls AND v.version = s.version AND v.id = s.id)""")
def migration_rules(t):
    """Migrations that lose or invent ids: version two lacks every fourth, with steps for most of these."""
    k = F.col("p_partkey")
    own = t.part.select(F.concat(F.lit("c"), (k % 5).cast("string")).alias("class"), F.concat(F.lit("i"), k.cast("string")).alias("id"), k)
    registry = own.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter((F.col("version") != 2) | (k % 4 != 0)).select("version", "class", "id")
    new = F.when(k % 8 == 0, None).when(k % 12 == 4, F.concat(F.lit("i"), (k + 1).cast("string"))).otherwise("none")
    one = own.filter((k % 4 == 0) & (k % 16 != 12)).select(F.lit(1).alias("from"), "class", F.col("id").alias("old"), new.alias("new"))
    two = own.filter(k % 20 == 0).select(F.lit(2).alias("from"), "class", F.col("id").alias("old"), F.col("id").alias("new"))
    return classes.migrations(registry, one.unionAll(two)).withColumnRenamed("class", "cls")


@query(_T + """e AS (SELECT cls, id, max(tree) AS found_in FROM t WHERE k % 4 <> 3 GROUP BY ALL), c AS (SELECT DISTINCT cls FROM t WHERE k % 4 <> 3),
o AS (SELECT t.cls, k, id AS talent, CASE WHEN k % 12 = 0 THEN tree ELSE 'ghost' END AS tree, k % 18 = 0 AS has_add, CASE WHEN k % 36 = 0 THEN id ELSE 'zz' END AS add_id FROM t WHERE k % 6 = 0),
j AS (SELECT o.*, o.cls || '/' || o.tree || '/' || o.talent AS path, e.found_in, c.cls IS NOT NULL AS there FROM o LEFT JOIN c ON c.cls = o.cls LEFT JOIN e ON e.cls = o.cls AND e.id = o.talent)
SELECT cls, 'ERROR' AS level, 'R01-SCHEMA' AS code, path FROM j WHERE k % 17 = 0 UNION ALL SELECT cls, 'ERROR', 'R01-SCHEMA', path FROM j WHERE k % 30 = 0
UNION ALL SELECT cls, 'ERROR', 'OVR-ADD-ID', path FROM j WHERE has_add AND add_id <> talent UNION ALL SELECT cls, 'ERROR', 'OVR-ADD-EXISTS', path FROM j WHERE has_add AND found_in IS NOT NULL
UNION ALL SELECT cls, 'WARNING', 'OVR-TARGET', path FROM j WHERE NOT has_add AND there AND found_in IS NULL UNION ALL SELECT cls, 'WARNING', 'OVR-TREE', path FROM j WHERE NOT has_add AND found_in <> tree""")
def override_rules(t):
    """VO, JSN1: override files against what was extracted."""
    rows = _class_rows(t).select(F.concat(F.lit("c"), F.col("blk").cast("string")).alias("class"), "k", "tree", "talent.id")
    k = F.col("k")
    over = rows.filter(k % 6 == 0).select("class", F.col("id").alias("talent"), F.when(k % 12 == 0, F.col("tree")).otherwise("ghost").alias("tree"), (k % 18 == 0).alias("has_add"), F.when(k % 36 == 0, F.col("id")).otherwise("zz").alias("add_id"), _when(k % 30 != 0, "why").alias("reason"), F.lit("me").alias("by"), F.lit("2026-01-02T03:04:05Z").alias("at"))
    return classes.overrides(over, rows.filter(k % 4 != 3).select("class", "id", "tree")).withColumnRenamed("class", "cls")


# --- race documents ----------------------------------------------------------------------------


def _race_docs(t):
    k, b = F.col("c_custkey"), F.col("blk")
    id_ = F.when(k % 23 == 0, "Bad Id").otherwise(F.concat(F.lit("q"), (k % 5).cast("string")))
    video = k % 3 == 0
    source = _source(
        kind=F.when(video, "video").when(k % 3 == 1, "datamined").otherwise("manual"), video=_when(video, "v"), t=_when(video, F.lit(1.0)), frame=_when(video, F.lit(1)), crop=_when(video, "c"), reader=_when(video, "r"), confidence=_when(video, (k % 10) / 10.0),
        build=_when((k % 3 == 1) & (k % 2 == 1), "b"), panel=_when(k % 10 == 3, "spellbook-general"), note=_when(k % 12 == 0, "why"),
    )
    words = lambda *pairs: F.coalesce(*[F.when(c, F.array(*map(F.lit, w))) for c, w in pairs])
    trait = F.struct(
        id_.alias("id"), F.concat("c_name", F.when(k % 9 == 0, " (Passive)").otherwise("")).alias("name"), F.lit("active").alias("kind"), F.when(k % 7 == 0, 0).otherwise(k % 6).alias("order"), words((k % 4 == 0, ["a"]), (k % 4 == 1, ["z"])).alias("variants"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, " x").when(k % 6 == 2, "a|b").otherwise("Fine.").alias("description"), F.when(k % 5 == 0, F.concat(F.lit("crop-"), id_)).otherwise("y").alias("icon"), _when(k % 4 == 0, "crop").alias("iconSource"), _when(k % 8 < 4, "i").alias("iconCrop"),
        F.struct(F.element_at(F.array(*map(F.lit, ["new", "same", "changed", "unknown"])), (k % 4 + 1).cast("int")).alias("status"), _when(k % 3 == 0, "N").alias("classicName"), F.lit(None).cast("string").alias("note")).alias("classic"),
        words((k % 5 == 0, ["new"]), (k % 5 == 1, ["classic-unchanged"]), (k % 5 == 2, ["reworked"])).alias("tags"), source.alias("source"),
    )
    docs = t.customer.select(F.floor(k / 6).cast("long").alias("blk"), k.alias("k"), trait.alias("t")).groupBy("blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("traits"))
    race = F.concat(F.lit("r"), b.cast("string"))
    variant = lambda id_, faction, own, lore, done: F.struct(F.lit(id_).alias("id"), faction.alias("faction"), F.array(*map(F.lit, own)).alias("classes"), lore.alias("lore"), done.alias("loreComplete"))
    no = F.lit(None)
    both = F.array(variant("a", F.lit("alliance"), ["mage", "rogue"], F.lit("l"), F.when(b % 8 != 0, True)), variant("h", F.when(b % 16 == 0, "alliance").otherwise("horde"), ["rogue"], no.cast("string"), no.cast("boolean")))
    docs = docs.select(
        race.alias("race"), F.when(b % 9 == 8, "x").otherwise(race).alias("stem"), F.when(b % 31 == 30, 2).otherwise(1).alias("schemaVersion"), F.when(b % 3 == 0, "neutral").otherwise("alliance").alias("faction"), F.when(b % 4 == 0, both).alias("variants"),
        F.coalesce(words((b % 5 == 0, ["mage", "rogue"]), (b % 5 == 1, ["rogue", "mage"]), (b % 5 == 3, ["mage", "zzz"]), (b % 5 == 4, ["mage"])), F.array().cast("array<string>")).alias("classes"),
        F.when(b % 2 == 0, _source(kind=F.lit("video"), video=F.lit("v"), t=F.lit(1.0), frame=F.lit(1), crop=F.lit("c"), confidence=F.lit(1.0))).alias("classesSource"), _when(b % 3 == 1, "Old.").alias("lore"), F.when(b % 6 != 1, True).alias("loreComplete"),
        F.when(b % 9 != 1, _source(kind=F.lit("manual"), reviewed=F.lit(True), reviewedBy=F.lit("me"), reviewedAt=F.lit("now"))).alias("loreSource"), "traits", (b % 2 == 1).alias("complete"), F.when(b % 4 == 2, F.array(F.lit("not read"))).alias("notes"),
    )
    return _cast(docs, races.SCHEMA)


_RACE = """WITH t AS (SELECT c_custkey AS k, c_custkey // 6 AS blk, 'r' || (c_custkey // 6) AS race, row_number() OVER (PARTITION BY c_custkey // 6 ORDER BY c_custkey) - 1 AS i,
  CASE WHEN c_custkey % 23 = 0 THEN 'Bad Id' ELSE 'q' || (c_custkey % 5) END AS id, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 6 END AS ord FROM customer),
p AS (SELECT *, '/traits/' || i AS path FROM t), b AS (SELECT blk, race, count(*) AS n, max(ord) AS top, count(DISTINCT ord) AS orders FROM t GROUP BY ALL),
c AS (SELECT *, CASE blk % 5 WHEN 0 THEN ['mage', 'rogue'] WHEN 1 THEN ['rogue', 'mage'] WHEN 3 THEN ['mage', 'zzz'] WHEN 4 THEN ['mage'] ELSE [] END AS own, CASE WHEN blk % 3 = 0 THEN 'neutral' ELSE 'alliance' END AS faction FROM b)
"""


@query(_RACE + """
SELECT race, 'ERROR' AS level, 'SCHEMA-VERSION' AS code, '/' AS path FROM b WHERE blk % 31 = 30
UNION ALL SELECT race, 'ERROR', 'RACE-FILENAME', '/race' FROM b WHERE blk % 9 = 8 UNION ALL SELECT race, 'WARNING', 'UNKNOWN-RACE', '/race' FROM b WHERE blk > 1
UNION ALL SELECT race, 'ERROR', 'BAD-ID', path FROM p WHERE k % 23 = 0
UNION ALL SELECT race, 'ERROR', 'DUPLICATE-TRAIT', path FROM (SELECT *, row_number() OVER (PARTITION BY blk, id ORDER BY i) AS n FROM p) WHERE n > 1
UNION ALL SELECT race, 'ERROR', 'DUPLICATE-ORDER', path FROM (SELECT *, row_number() OVER (PARTITION BY blk, ord ORDER BY i) AS n FROM p) WHERE n > 1
UNION ALL SELECT race, 'WARNING', 'ORDER-GAPS', '/traits' FROM b WHERE top <> orders - 1
UNION ALL SELECT race, 'ERROR', 'VARIANT-FACTIONS', '/variants' FROM b WHERE blk % 16 = 0 UNION ALL SELECT race, 'WARNING', 'VARIANT-FACTION-TOP', '/faction' FROM b WHERE blk % 4 = 0 AND blk % 3 <> 0
UNION ALL SELECT race, 'ERROR', 'TRAIT-VARIANTS', path FROM p WHERE (blk % 4 = 0) <> (k % 4 <= 1) UNION ALL SELECT race, 'ERROR', 'UNKNOWN-VARIANT', path FROM p WHERE k % 4 = 1 OR k % 4 = 0 AND blk % 4 <> 0
UNION ALL SELECT race, 'ERROR', 'CLASSES-UNSORTED', '/classes' FROM b WHERE blk % 5 = 1 UNION ALL SELECT race, 'ERROR', 'UNKNOWN-CLASS', '/classes' FROM b WHERE blk % 5 = 3
UNION ALL SELECT race, 'ERROR', 'CLASSES-UNION', '/classes' FROM b WHERE blk % 4 = 0 AND blk % 5 IN (2, 3, 4) UNION ALL SELECT race, 'WARNING', 'NO-CLASSES', '/classes' FROM b WHERE blk % 5 = 2
UNION ALL SELECT race, 'WARNING', 'NO-DESCRIPTION', path FROM p WHERE k % 6 = 0 UNION ALL SELECT race, 'ERROR', 'NO-DESCRIPTION-NOTE', path FROM p WHERE k % 6 = 0 AND k % 12 <> 0 UNION ALL SELECT race, 'WARNING', 'TEXT-HYGIENE', path FROM p WHERE k % 6 IN (1, 2)
UNION ALL SELECT race, 'ERROR', 'CLASSIC-NEW', path FROM p WHERE k % 4 = 0 AND k % 3 = 0 UNION ALL SELECT race, 'ERROR', 'CLASSIC-MATCH', path FROM p WHERE k % 4 IN (1, 2) AND k % 3 <> 0 UNION ALL SELECT race, 'WARNING', 'TAG-MISMATCH', path FROM p WHERE k % 4 < 3 AND k % 5 <> k % 4
UNION ALL SELECT race, 'ERROR', 'SOURCE-FIELDS', '/classesSource' FROM b WHERE blk % 2 = 0 UNION ALL SELECT race, 'ERROR', 'SOURCE-FIELDS', path || '/source' FROM p WHERE k % 3 = 1 AND k % 2 = 0 OR k % 3 = 2
UNION ALL SELECT race, 'WARNING', 'PANEL-DESCRIPTION', path FROM p WHERE k % 10 = 3 AND k % 6 <> 0 UNION ALL SELECT race, 'ERROR', 'ICON-CROP', path FROM p WHERE (k % 4 = 0) <> (k % 8 < 4) UNION ALL SELECT race, 'WARNING', 'ICON-NAME', path FROM p WHERE k % 4 = 0 AND k % 5 <> 0
UNION ALL SELECT race, 'WARNING', 'INCOMPLETE-UNEXPLAINED', '/notes' FROM b WHERE blk % 2 = 0 AND blk % 4 <> 2
UNION ALL SELECT race, 'ERROR', 'LORE-COMPLETE', '/lore' FROM b WHERE blk % 6 = 1 UNION ALL SELECT race, 'ERROR', 'LORE-SOURCE', '/lore' FROM b WHERE blk % 9 = 1 UNION ALL SELECT race, 'ERROR', 'LORE-COMPLETE', '/variants/0' FROM b WHERE blk % 8 = 0
UNION ALL SELECT race, 'WARNING', 'NEEDS-REVIEW', path FROM p WHERE k % 3 = 0 AND k % 10 < 8 UNION ALL SELECT race, 'WARNING', 'KIND-IN-NAME', path FROM p WHERE k % 9 = 0 UNION ALL SELECT race, 'WARNING', 'TRAIT-COUNT', '/traits' FROM b WHERE blk % 2 = 1 AND n NOT BETWEEN 3 AND 8
""")
def race_rules(t):
    """VR1-VR11, VR13-VR15, AGG34: what one race document decides."""
    return findings(_race_docs(t), "race", *races.in_document(["r0", "r1"], ["mage", "rogue"]))


@query(_RACE + """, r AS (SELECT race, blk, CASE WHEN blk % 11 = 0 THEN ['mage'] ELSE own END AS classes, own, CASE WHEN blk % 13 = 0 THEN 'horde' ELSE faction END AS faction, faction AS told FROM c WHERE blk % 7 <> 6 UNION ALL SELECT race, blk, CASE WHEN blk % 11 = 0 THEN ['mage'] ELSE own END, own, CASE WHEN blk % 13 = 0 THEN 'horde' ELSE faction END, faction FROM c WHERE blk % 10 = 0 AND blk % 7 <> 6)
SELECT race, 'ERROR' AS level, 'CLASSES-UNSORTED' AS code, '/races/' || race AS path FROM r WHERE list_sort(classes) <> classes UNION ALL SELECT race, 'ERROR', 'OBSERVED', '/races/' || race FROM r WHERE (blk % 2 = 0) <> (len(classes) > 0)
UNION ALL SELECT race, 'ERROR', 'CLASSES-UNION', '/races/' || race FROM r WHERE blk % 3 = 0 AND classes <> ['mage'] UNION ALL SELECT race, 'ERROR', 'MATRIX-MISMATCH', '/races/' || race FROM r WHERE classes <> own UNION ALL SELECT race, 'ERROR', 'MATRIX-MISMATCH', '/races/' || race FROM r WHERE faction <> told
UNION ALL SELECT 'ghost', 'ERROR', unnest(['MISSING-RACE-FILE', 'OBSERVED']), '/races/ghost' UNION ALL SELECT race, 'ERROR', 'DUPLICATE-RACE', '/races/' || race FROM c WHERE blk % 10 = 0 AND blk % 7 <> 6
UNION ALL SELECT race, 'ERROR', 'MATRIX-INCOMPLETE', '/races' FROM c WHERE blk % 7 = 6""")
def matrix_rules(t):
    """VRM, J31: the matrix of races against their documents."""
    docs = _race_docs(t)
    b = F.substr("race", F.lit(2)).cast("long")
    rows = docs.filter(b % 7 != 6).select("race", F.when(b % 13 == 0, "horde").otherwise(F.col("faction")).alias("faction"), F.when(b % 11 == 0, F.array(F.lit("mage"))).otherwise(F.col("classes")).alias("classes"), F.when(b % 3 == 0, F.create_map(F.lit("a"), F.array(F.lit("mage")))).alias("byVariant"), (b % 2 == 0).alias("observed"))
    ghost = t.spark.createDataFrame([("ghost", "none", [], None, True)], races.MATRIX)
    return races.matrix(rows.unionAll(rows.filter(b % 10 == 0)).unionAll(ghost), docs)


# --- spell documents ---------------------------------------------------------------------------


def _spell_docs(t):
    k, o, ln = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    id_ = F.concat(F.lit("s"), (k % 3).cast("string"))
    source = _source(kind=F.lit("video"), video=F.lit("v"), t=F.lit(1.0), frame=F.when(k % 13 != 0, 1), crop=_when(k % 11 != 0, "c"), confidence=(k % 10) / 10.0, reader=F.lit("r"), panel=F.when(k % 9 == 0, "tooltip").otherwise("spell-list"), note=_when(k % 12 == 0, "n"))
    tip = F.struct(F.when(k % 3 == 0, " ").when(k % 3 == 1, "Good. bad").otherwise("Fine.").alias("description"), _when(k % 4 == 0, "a|b").alias("footer"), (k % 8).cast("int").alias("rank"), _source(kind=F.lit("manual"), reviewed=F.lit(True), reviewedBy=F.lit("me"), reviewedAt=F.lit("now"), panel=_when(k % 5 != 0, "tooltip"), confidence=F.lit(0.5)).alias("source"))
    spell = F.struct(
        id_.alias("id"), F.when(k % 7 == 0, "Fire Rank 2").when(k % 7 == 1, "Fire (Passive)").otherwise("Fire").alias("name"), F.when(k % 5 == 0, "passive").otherwise("active").alias("kind"), F.when(k % 6 == 0, None).when(k % 6 == 1, "zz").otherwise("fire").alias("tab"),
        F.when(k % 4 == 0, F.array(F.lit(1), F.lit(2))).when(k % 4 == 1, F.array(F.lit(2), F.lit(1))).when(k % 4 == 2, F.array(ln)).alias("ranksSeen"), F.when(k % 4 == 0, F.concat(F.lit("crop-"), id_)).otherwise("z").alias("icon"), _when(k % 2 == 0, "crop").alias("iconSource"), _when(k % 3 == 0, "i").alias("iconCrop"),
        F.struct(F.when(k % 3 == 0, "new").when(k % 3 == 1, "same").otherwise("unknown").alias("status"), _when(k % 2 == 0, "N").alias("classicName"), _when(k % 7 != 0, "n").alias("note")).alias("classic"), F.when(k % 5 == 0, F.array(F.lit("new"))).alias("tags"), F.when(ln % 2 == 0, F.array(tip)).alias("tooltips"), source.alias("source"),
    )
    rows = t.lineitem.select(o.alias("o"), F.struct(ln, k, "l_suppkey", "l_extendedprice", spell.alias("s")).alias("x"))
    docs = rows.groupBy("o").agg(F.transform(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["l_linenumber"] != b["l_linenumber"], a["l_linenumber"] - b["l_linenumber"]).when(a["l_partkey"] != b["l_partkey"], (a["l_partkey"] - b["l_partkey"]).cast("int")).otherwise(0)), lambda x: x["s"]).alias("spells"))
    o = F.col("o")
    tab = lambda name, place: F.struct(F.lit(name).alias("id"), F.lit(place).alias("order"))
    tips = F.aggregate("spells", F.lit(0), lambda n, s: n + F.coalesce(F.size(s["tooltips"]), F.lit(0)))
    text = lambda *w: F.array(*map(F.lit, w))
    coverage = F.struct(F.when(o % 4 == 0, text("fire", "arms")).otherwise(text("fire")).alias("tabsSeen"), F.when(o % 5 == 0, text("fire")).when(o % 5 == 1, text("b", "a")).alias("tabsMissing"), (F.size("spells") + F.when(o % 7 == 0, 1).otherwise(0)).alias("entriesRead"), (tips + F.when(o % 9 == 0, 1).otherwise(0)).alias("tooltipsRead"), F.when(o % 8 != 0, 60).alias("observedLevel"), F.when(o % 2 == 0, "on").otherwise("off").alias("showAllSpellRanks"))
    cls = F.concat(F.lit("o"), o.cast("string"))
    docs = docs.select(cls.alias("class"), F.when(o % 11 == 0, "x").otherwise(cls).alias("stem"), F.lit(60).alias("observedLevel"), F.when(o % 3 == 0, F.array(tab("fire", 0), tab("arms", 2))).otherwise(F.array(tab("fire", 0))).alias("tabs"), "spells", coverage.alias("coverage"), (o % 2 == 1).alias("complete"), F.when(o % 6 == 0, text("n")).alias("notes"))
    return _cast(docs, spells.SCHEMA)


_SPELL = """WITH t AS (SELECT l_orderkey AS o, l_partkey AS k, l_linenumber AS ln, 'o' || l_orderkey AS cls, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i, 's' || (l_partkey % 3) AS id,
  CASE l_partkey % 4 WHEN 0 THEN '1,2' WHEN 1 THEN '1,2' WHEN 2 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS ranks FROM lineitem),
p AS (SELECT *, '/spells/' || i AS path, '/spells/' || i || '/tooltips/0' AS tip FROM t), h AS (SELECT * FROM p WHERE ln % 2 = 0),
d AS (SELECT o, cls, count(*) AS n, bool_or(k % 4 <= 1) OR count(DISTINCT id) < count(*) AS multi FROM t GROUP BY ALL)
"""


@query(_SPELL + """
SELECT cls, 'ERROR' AS level, 'CLASS-FILENAME' AS code, '/class' AS path FROM d WHERE o % 11 = 0
UNION ALL SELECT cls, 'ERROR', 'DUPLICATE-SPELL', path FROM (SELECT *, row_number() OVER (PARTITION BY o, id, ranks ORDER BY i) AS n FROM p) WHERE n > 1
UNION ALL SELECT cls, 'ERROR', 'TAB-ORDER', '/tabs' FROM d WHERE o % 3 = 0 UNION ALL SELECT cls, 'ERROR', 'UNKNOWN-TAB', path FROM p WHERE k % 6 = 1 UNION ALL SELECT cls, 'ERROR', 'NO-TAB-NOTE', path FROM p WHERE k % 6 = 0 AND k % 12 <> 0
UNION ALL SELECT cls, 'ERROR', 'COVERAGE-TABS', '/coverage/tabsSeen' FROM d WHERE (o % 4 = 0) <> (o % 3 = 0) UNION ALL SELECT cls, 'ERROR', 'COVERAGE-TABS', '/coverage/tabsMissing' FROM d WHERE o % 5 = 0
UNION ALL SELECT cls, 'ERROR', 'COVERAGE-COUNT', '/coverage/entriesRead' FROM d WHERE o % 7 = 0 UNION ALL SELECT cls, 'ERROR', 'COVERAGE-COUNT', '/coverage/tooltipsRead' FROM d WHERE o % 9 = 0 UNION ALL SELECT cls, 'ERROR', 'COVERAGE-LEVEL', '/coverage/observedLevel' FROM d WHERE o % 8 = 0
UNION ALL SELECT cls, 'ERROR', 'COVERAGE-UNSORTED', '/coverage/tabsSeen' FROM d WHERE o % 4 = 0 UNION ALL SELECT cls, 'ERROR', 'COVERAGE-UNSORTED', '/coverage/tabsMissing' FROM d WHERE o % 5 = 1
UNION ALL SELECT cls, 'ERROR', 'RANKS-UNSORTED', path || '/ranksSeen' FROM p WHERE k % 4 = 1 UNION ALL SELECT cls, 'WARNING', 'RANK-ON-PASSIVE', path FROM p WHERE k % 5 = 0 AND k % 4 <> 3 UNION ALL SELECT cls, 'ERROR', 'SHOW-ALL-RANKS', '/coverage/showAllSpellRanks' FROM d WHERE multi <> (o % 2 = 0)
UNION ALL SELECT cls, 'ERROR', 'CLASSIC-NEW', path FROM p WHERE k % 3 = 0 AND k % 2 = 0 UNION ALL SELECT cls, 'ERROR', 'CLASSIC-MATCH', path FROM p WHERE k % 3 = 1 AND k % 2 = 1 UNION ALL SELECT cls, 'ERROR', 'CLASSIC-NOTE', path FROM p WHERE k % 7 = 0 UNION ALL SELECT cls, 'WARNING', 'TAG-MISMATCH', path FROM p WHERE k % 3 = 0 AND k % 5 <> 0
UNION ALL SELECT cls, 'ERROR', 'SOURCE-FIELDS', path || '/source' FROM p WHERE k % 13 = 0 UNION ALL SELECT cls, 'ERROR', 'SOURCE-FIELDS', path || '/source' FROM p WHERE k % 11 = 0 UNION ALL SELECT cls, 'ERROR', 'SOURCE-PANEL', path || '/source' FROM p WHERE k % 9 = 0 UNION ALL SELECT cls, 'ERROR', 'SOURCE-PANEL', tip || '/source' FROM h WHERE k % 5 = 0
UNION ALL SELECT cls, 'ERROR', 'ICON-CROP', path FROM p WHERE (k % 2 = 0) <> (k % 3 = 0) UNION ALL SELECT cls, 'WARNING', 'ICON-NAME', path FROM p WHERE k % 4 = 2
UNION ALL SELECT cls, 'ERROR', 'COMPLETE-MISSING-TABS', '/complete' FROM d WHERE o % 2 = 1 AND o % 5 <= 1 UNION ALL SELECT cls, 'ERROR', 'INCOMPLETE-UNEXPLAINED', '/notes' FROM d WHERE o % 2 = 0 AND o % 6 <> 0
UNION ALL SELECT cls, 'WARNING', 'TEXT-HYGIENE', tip || '/description' FROM h WHERE k % 3 <= 1 UNION ALL SELECT cls, 'WARNING', 'TEXT-HYGIENE', tip || '/footer' FROM h WHERE k % 4 = 0 UNION ALL SELECT cls, 'ERROR', 'TOOLTIP-EMPTY', tip FROM h WHERE k % 3 = 0
UNION ALL SELECT cls, 'ERROR', 'TOOLTIP-RANK', tip FROM h WHERE k % 4 = 0 OR k % 8 = 5 OR k % 4 = 2 AND k % 8 <> ln
UNION ALL SELECT cls, 'WARNING', 'NEEDS-REVIEW', path FROM p WHERE k % 10 < 8 UNION ALL SELECT cls, 'WARNING', 'RANK-IN-NAME', path FROM p WHERE k % 7 = 0 UNION ALL SELECT cls, 'WARNING', 'KIND-IN-NAME', path FROM p WHERE k % 7 = 1
UNION ALL SELECT cls, 'WARNING', 'TAB-OVER-CAPACITY', '/spells' FROM (SELECT cls, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'zz' ELSE 'fire' END AS tab, count(*) AS n FROM t GROUP BY ALL) WHERE tab IS NOT NULL AND n > 3
UNION ALL SELECT cls, 'ERROR', 'UNPUBLISHABLE', path FROM p WHERE k % 10 < 5 UNION ALL SELECT cls, 'ERROR', 'UNPUBLISHABLE', path FROM p WHERE k % 11 = 0 UNION ALL SELECT cls, 'ERROR', 'UNPUBLISHABLE', path FROM p WHERE k % 13 = 0 UNION ALL SELECT cls, 'ERROR', 'UNPUBLISHABLE', path FROM p WHERE k % 10 < 8 AND k % 5 = 0
""")
def spell_rules(t):
    """VS2-VS11, VS13-VS16, AGG29: what one spell document decides."""
    docs = _spell_docs(t)
    return findings(docs, "class", *spells.in_document()).unionAll(spells.counts(docs, 3)).withColumnRenamed("class", "cls")
