"""Queries over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from ..operators import match, merge, resolve
from .registry import query


@query("""
SELECT source, lang, doc_id, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars >= 200 DESC, n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1
""")
def dedupe_best_per_key(t):
    """AGG1: the best document of each source and language: not short, then longest, then least id."""
    return resolve.best_per_key(t.documents, ["source", "lang"], [F.col("n_chars") >= 200, F.col("n_chars"), -F.col("doc_id")], ["doc_id", "n_chars"])


@query("""
WITH x AS (SELECT role, conv_id, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS r FROM conversations)
SELECT conv_id, role, max(text) FILTER (r = 1) AS best, CAST(count(DISTINCT text) - 1 AS INT) AS n_alternates,
       coalesce(string_agg(DISTINCT text, '|' ORDER BY text) FILTER (text <> b), '') AS alternates
FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id, role ORDER BY r) AS b FROM x) GROUP BY conv_id, role
""")
def merge_best_with_alternates(t):
    """AGG2-4: the longest turn of each role of a conversation, and the other distinct ones."""
    return resolve.with_alternates(t.conversations, ["conv_id", "role"], "text", [F.length("text"), -F.col("turn")])


@query("""
SELECT lang, count(*) AS documents, count(quality) AS reviewed, count(*) FILTER (quality = 0) AS needs_review, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def class_index(t):
    """AGG13: per language, documents, reviewed and to be reviewed."""
    both = t.documents.join(t.labels, "doc_id", "left")
    return both.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count("quality").alias("reviewed"), F.count_if(F.col("quality") == 0).alias("needs_review"),
        F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"),
    )


@query("""
SELECT count(*) AS documents, count(DISTINCT lang) AS langs, count(quality) AS reviewed, count(*) FILTER (quality = 0 AND toxic = 0) AS queued
FROM documents LEFT JOIN labels USING (doc_id)
""")
def facts(t):
    """AGG14: totals over everything."""
    both = t.documents.join(t.labels, "doc_id", "left")
    return both.agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("langs"), F.count("quality").alias("reviewed"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("queued"))


_SLUG = "trim(regexp_replace(replace(replace(strip_accents(lower({})), '''', ''), '’', ''), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT doc_id, {_SLUG.format('source || text')} AS slug FROM documents")
def slug_clean(t):
    """STR1."""
    return t.documents.select("doc_id", tx.slug(F.concat("source", "text")).alias("slug"))


@query(r"""
SELECT doc_id, regexp_replace(text, '[0-9]+(\.[0-9]+)?', '#', 'g') AS masked, array_to_string(list_transform(regexp_extract_all(text, '([0-9]+(\.[0-9]+)?)', 1), lambda x: x), ',') AS numbers,
       CAST(len(regexp_extract_all(text, '[0-9]+(\.[0-9]+)?')) AS INT) AS n FROM documents
""")
def mask_numbers(t):
    """STR8: numbers masked and listed."""
    return t.documents.select("doc_id", tx.masked(F.col("text")).alias("masked"), F.array_join(tx.numbers(F.col("text")), ",").alias("numbers"), F.size(tx.numbers(F.col("text"))).alias("n"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(replace(lower(p_name), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS spaced, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS squashed,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1))), '') AS initials FROM part
""")
def normalize_name(t):
    """STR4, STR5, STR41."""
    return t.part.select("p_partkey", tx.spaced_name(F.col("p_name")).alias("spaced"), tx.squashed_name(F.col("p_name")).alias("squashed"), tx.initials(F.col("p_name")).alias("initials"))


@query(r"""
SELECT conv_id, turn, regexp_replace(lower(trim(regexp_replace(translate(text, '‘’“” ', '''''"" '), '[ \t\r\n]+', ' ', 'g'))), '[. ]+$', '') AS normal FROM conversations
""")
def normalize_text(t):
    """STR2, STR9."""
    return t.conversations.select("conv_id", "turn", tx.normal_text(F.col("text")).alias("normal"))


@query(r"""
SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(lower(text), '([0-9]+(?:\.[0-9]+)?|[a-z]+)', 1), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN 'N' ELSE regexp_replace(w, '^(.{1,})s$', '\1') END), ' ') AS skeleton FROM conversations
""")
def text_skeleton(t):
    """STR10, STR11."""
    return t.conversations.select("conv_id", "turn", tx.skeleton(F.col("text")).alias("skeleton"))


@query("""
SELECT doc_id, lang, quality, n_chars FROM documents JOIN labels USING (doc_id)
WHERE quality = 0 AND (contains(lower(text || ' ' || source), 'the') OR contains(lower(text || ' ' || source), 'der'))
""")
def search_filter_sort(t):
    """FLT4-7, SRT1: labelled 0 and one of two terms in any text column; worst first."""
    both = t.documents.join(t.labels, "doc_id").filter("quality = 0")
    found = F.lower(F.concat_ws(" ", "text", "source"))
    return both.filter(found.contains("the") | found.contains("der")).select("doc_id", "lang", "quality", "n_chars").orderBy("quality", "n_chars", "doc_id")


@query("""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
""")
def contains_antijoin(t):
    """J14, FLT14: documents that hold no benchmark text."""
    return match.without_containing(t.documents, t.benchmark, "text", "text").select("doc_id", "source")


def _vocabulary(df, id):
    return df.select(id, F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()


@query("""
WITH d AS (SELECT DISTINCT source, unnest(string_split(lower(text), ' ')) AS word FROM documents), b AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark),
n AS (SELECT source, count(*) AS n FROM d GROUP BY 1), m AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT source, item_id, count(*) AS shared FROM d JOIN b USING (word) GROUP BY ALL)
SELECT source, item_id, shared, round(shared / least(n.n, m.n), 6) AS ratio FROM s JOIN n USING (source) JOIN m USING (item_id) WHERE shared / least(n.n, m.n) > 0.5
""")
def tree_match_overlap(t):
    """Sources and benchmark items that share more than half of the smaller vocabulary: the candidates of J12's last pass."""
    return match.overlap(_vocabulary(t.documents, "source"), _vocabulary(t.benchmark, "item_id"), "source", "item_id", "word")


@query()
def tree_match(t):
    """Sources and benchmark items matched one to one by id, by name, then by overlap of vocabularies."""
    items = t.benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("item_id").cast("string").alias("name"), "text")
    sources = t.documents.select("source", tx.squashed_name(F.col("source")).alias("name")).distinct()
    return match.identified(sources, items.select("item", "name"), _vocabulary(t.documents, "source"), _vocabulary(items, "item"), "source", "item", "name", "word")


@query("""
SELECT q.vec_id AS query_id, r.vec_id AS neighbour, round(s, 6) AS score, place FROM (
  SELECT q, r, s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 6) DESC, r.vec_id) AS INT) AS place FROM (
    SELECT q, r, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)) WHERE place <= 5
""")
def knn_topk(t):
    """J25, SRT8: the five nearest rows of each query vector; queries are the ids divisible by 100."""
    return match.nearest(t.embeddings.filter(F.col("vec_id") % 100 == 0), t.embeddings, "vec_id", "embedding", 5)


@query("""
WITH s AS (SELECT q.vec_id AS query_id, r.label AS label, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
m AS (SELECT query_id, label, max(score) AS score FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS place FROM m)
SELECT a.query_id, a.label, round(a.score - coalesce(b.score, 0), 6) AS margin FROM o a LEFT JOIN o b ON a.query_id = b.query_id AND b.place = 2 WHERE a.place = 1
""")
def runner_up_margin(t):
    """SRT9: the best label of each query vector and its lead over the best of another label."""
    q = match.broadcast_if_small(t.embeddings.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), F.size("q") * 4 + 16)
    s = t.embeddings.join(q, F.col("query_id") != F.col("vec_id")).select("query_id", "label", F.round(num.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    m = s.groupBy("query_id", "label").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    top = m.withColumn("place", F.row_number().over(w)).filter("place <= 2").groupBy("query_id").agg(F.min_by("label", "place").alias("label"), F.max("score").alias("best"), F.min_by("score", -F.col("place")).alias("second"), F.count("*").alias("n"))
    return top.select("query_id", "label", F.round(F.col("best") - F.when(F.col("n") == 2, F.col("second")).otherwise(0.0), 6).alias("margin"))


@query()
def neardup_suppress(t):
    """SRT12, HSH1, MTH5: of documents whose 64-bit word codes are within 6 bits, those of lower ids stay."""
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select("doc_id", F.xxhash64("w").alias("h"))
    bits = words.groupBy("doc_id").agg(*[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(1) * 2 - 1).alias(f"b{i}") for i in range(64)])
    code = F.lit(0).cast("long")
    for i in range(64):
        code = code.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return match.hamming_suppressed(bits.select("doc_id", code.alias("code")), "doc_id", "code")


@query("""
SELECT doc_id, source, text, n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL
SELECT doc_id, source, text, n_chars FROM documents d WHERE doc_id % 2 <> 0 OR doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.doc_id = d.doc_id)
""")
def additive_union(t):
    """SET1: two snapshots of documents, the first one wins. The first has the even ids, the second the odd ones and every third."""
    d = t.documents.select("doc_id", "source", "text", "n_chars")
    return merge.additive_union(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 <> 0 or doc_id % 3 = 0"), ["doc_id"])


@query("""
WITH o AS (SELECT d.doc_id, n_chars, quality = 1 AS reviewed FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id % 2 = 0),
f AS (SELECT doc_id, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 2 <> 0 OR doc_id % 3 = 0)
SELECT coalesce(o.doc_id, f.doc_id) AS doc_id, CASE WHEN coalesce(reviewed, FALSE) THEN o.n_chars ELSE coalesce(f.n_chars, o.n_chars) END AS n_chars,
       CASE WHEN o.doc_id IS NULL THEN 'new' WHEN f.doc_id IS NULL THEN 'gone' ELSE 'both' END AS side FROM o FULL JOIN f ON o.doc_id = f.doc_id
""")
def never_shrink(t):
    """SET2, SET3: fresh values win except over reviewed rows, and no key is lost."""
    old = t.documents.join(t.labels, "doc_id", "left").filter("doc_id % 2 = 0").select("doc_id", "n_chars", (F.col("quality") == 1).alias("reviewed"))
    return merge.never_shrunk(old, t.documents.filter("doc_id % 2 <> 0 or doc_id % 3 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars")), "doc_id", ["n_chars"], "reviewed")


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
       CAST(len(regexp_extract_all(html, '<a ')) AS INT) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS paragraphs FROM pages
""")
def html_facts(t):
    """SRC29, STR38: facts of raw pages."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"), n("<a ").alias("links"), n("<p[ >]").alias("paragraphs"))


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
       regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages
""")
def url_parse(t):
    """STR43, STR44."""
    part = lambda p: F.regexp_extract("url", p, 1)
    return t.pages.select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]*)").alias("host"), part("^[a-z]+://[^/?#]*([^?#]*)").alias("path"), part("[?&]page=([^&#]*)").alias("page"), part("#(.*)$").alias("fragment"))


@query()
def word_diff(t):
    """STR26-28: each turn against the one before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("before", before).filter("before is not null").select("conv_id", "turn", F.to_json(tx.word_diff("before", "text")).alias("ops"))


@query()
def merge_readings(t):
    """STR21, STR22: of each conversation and role, the first turn read against the last, others voting."""
    w = F.struct("turn", "text")
    g = t.conversations.groupBy("conv_id", "role").agg(F.min(w).alias("a"), F.max(w).alias("b"), F.collect_set("text").alias("others"))
    return g.select("conv_id", "role", tx.merge_readings("a.text", "b.text", "others").alias("merged"))


@query("""
WITH x AS (SELECT conv_id, turn, regexp_extract(text, '^[^ ]*') AS a, lead(regexp_extract(text, '^[^ ]*')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN a = b THEN 'same' WHEN lower(a) = lower(b) THEN 'case' WHEN replace(a, '%', '') = replace(b, '%', '') THEN 'percent'
  WHEN regexp_replace(a, '[^A-Za-z0-9]', '', 'g') = regexp_replace(b, '[^A-Za-z0-9]', '', 'g') THEN 'punct' ELSE 'word' END AS kind FROM x WHERE b IS NOT NULL
""")
def classify_pair(t):
    """STR20: how the first words of neighbouring turns differ."""
    first = F.regexp_extract("text", "^[^ ]*", 0)
    x = t.conversations.select("conv_id", "turn", first.alias("a"), F.lead(first).over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return x.filter("b is not null").select("conv_id", "turn", tx.pair_kind(F.col("a"), F.col("b")).alias("kind"))
