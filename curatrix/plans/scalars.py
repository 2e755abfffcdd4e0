"""Queries of single expressions: folded texts, parsed names, times, ranks, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as tx
from .registry import query


def _said(t):
    """Two descriptions of every part, the second one with other numbers, spellings or words."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    old = F.concat(F.lit("Deals "), n, F.lit(".5 damage for 10 seconds, and your Off-hand’s attacks gain "), n, F.lit(" percent."))
    new = F.when(k % 4 == 0, old).when(k % 4 == 1, F.regexp_replace(F.regexp_replace(F.regexp_replace(old, "seconds", "sec"), "Off-hand", "offhand"), "attacks", "attack")).when(k % 4 == 2, F.regexp_replace(old, "10", "15")).otherwise(F.concat(old, F.lit(" Also heals.")))
    return t.part.select("p_partkey", old.alias("old"), new.alias("new"))


_OLD = "'Deals ' || p_size || '.5 damage for 10 seconds, and your Off-hand’s attacks gain ' || p_size || ' percent.'"


@query(f"""WITH s AS (SELECT p_partkey, {_OLD} AS t FROM part)
SELECT p_partkey, replace(t, '’', '''') AS line, 'deals ' || p || '.5 damage for 10 sec and your off-hand s attacks gain ' || p || '%' AS claims, 'deal ' || p || '.5 damage for 10 sec and offhand s attack gain ' || p || '%' AS classified
FROM (SELECT s.*, CAST(p_size AS VARCHAR) AS p FROM s JOIN part USING (p_partkey))""")
def folded_texts(t):
    """STR3, STR6, STR7: descriptions as lines, as claims, and as what is classified."""
    d = _said(t)
    return d.select("p_partkey", tx.clean_line(F.col("old")).alias("line"), tx.claims(F.col("old")).alias("claims"), tx.classified(F.col("old")).alias("classified"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'values' WHEN 3 THEN 'text' ELSE 'none' END AS change FROM part")
def described_changes(t):
    """BIZ22: spelling is no change, other numbers are values, other words are text."""
    return _said(t).select("p_partkey", tx.described_change(F.col("old"), F.col("new")).alias("change"))


@query("""SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(before, '[ \\t\\n\\r]+'), lambda w: w <> ''), ' ') AS old_line, array_to_string(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> ''), ' ') AS new_line
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL""")
def diff_lines(t):
    """STR26-28, J5: a diff's two lines, which are the two texts word by word."""
    from pyspark.sql import Window

    d = t.conversations.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")
    d = d.select("conv_id", "turn", tx.word_diff("before", "text").alias("ops"))
    return d.select("conv_id", "turn", tx.kept_diff(F.col("ops"), "+").alias("old_line"), tx.kept_diff(F.col("ops"), "-").alias("new_line"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?|[A-Za-z]+')) AS INT) AS n, sha1('p' || chr(31) || coalesce(text, '')) AS key FROM documents""")
def token_counts(t):
    """STR19, HSH2: number and word tokens of texts; the key under which an answer about a text is kept."""
    return t.documents.select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"), tx.cache_key(F.lit("p"), F.coalesce("text", F.lit(""))).alias("key"))


def _names(t):
    k = F.col("p_partkey")
    name = F.initcap("p_name")
    n = (k % 12 + 1).cast("string")
    return t.part.select(
        "p_partkey", name.alias("plain"), F.concat(name, F.lit(" Rank "), n).alias("ranked"), F.concat(name, F.when(k % 3 == 0, " (Passive)").when(k % 3 == 1, " Racial").otherwise("")).alias("kinded"),
        F.when(k % 4 == 0, F.concat(F.lit("rank "), n)).when(k % 4 == 1, "Passive").when(k % 4 == 2, "(Passive)").otherwise("Racial Passive.").alias("subtitle"),
        F.when(k % 3 == 0, F.concat(F.lit("Requires "), name, F.lit(" (Rank "), n, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("requires "), n, F.lit(" points in "), name, F.lit(" Talents"))).otherwise("Needs nothing").alias("need"),
        F.when(k % 2 == 0, F.concat(name, F.lit(" (Passive) :  Gives  "), n)).otherwise(name).alias("line"), F.concat(F.when(k % 5 == 0, "Xy").otherwise("Mage"), F.regexp_replace(name, " ", "")).alias("camel"),
        F.concat(F.lit("read twice;  Merged: 2 ;"), n).alias("note"),
    )


_NAMES = """WITH n AS (SELECT p_partkey AS k, p_partkey % 12 + 1 AS r, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part)
"""


@query(_NAMES + """SELECT k AS p_partkey, CASE WHEN k % 4 = 0 THEN CAST(r AS INT) END AS rank, CASE k % 4 WHEN 0 THEN 'active' WHEN 3 THEN 'racial-passive' ELSE 'passive' END AS kind, name AS bare, name AS without_kind, CASE k % 3 WHEN 0 THEN 'Passive' WHEN 1 THEN 'Racial' END AS tail,
  CASE WHEN k % 3 < 2 THEN name END AS need, CASE WHEN k % 3 < 2 THEN CAST(r AS INT) END AS points, CASE WHEN k % 3 < 2 THEN k % 3 = 1 END AS tier, CASE WHEN k % 2 = 0 THEN name || '|passive|Gives ' || r END AS trait,
  CASE WHEN k % 5 <> 0 THEN 'mage' END AS prefix, CASE WHEN k % 5 <> 0 THEN name END AS rest, 'read twice; ' || r || '; new' AS note FROM n""")
def parsed_names(t):
    """STR32-35, STR37, STR39, STR40: ranks, kinds, requirements, trait lines, camel-cased names, rewritten notes."""
    d = _names(t)
    bare, tail = tx.without_kind(F.col("kinded"))
    need, trait = tx.requirement(F.col("need")), tx.trait_line(F.col("line"))
    prefix, rest = tx.camel_words(F.col("camel"), ["mage", "hunter"])
    return d.select(
        "p_partkey", tx.parse_rank(F.col("subtitle")).alias("rank"), tx.entry_kind(F.col("subtitle")).alias("kind"), tx.without_rank(F.col("ranked")).alias("bare"), bare.alias("without_kind"), tail.alias("tail"),
        need["name"].alias("need"), need["points"].alias("points"), need["tier"].alias("tier"), F.when(trait.isNotNull(), F.concat_ws("|", trait["name"], trait["kind"], trait["description"])).alias("trait"),
        prefix.alias("prefix"), rest.alias("rest"), tx.rewritten_note(F.col("note"), ["merged:"], [F.lit("new"), F.lit(None).cast("string")]).alias("note"),
    )


@query("""WITH x AS (SELECT doc_id, regexp_replace(trim(regexp_replace(substr(text, 1, 60), '[ \\t\\r\\n]+', ' ', 'g')), '^ +', '') AS s FROM documents), w AS (SELECT *, list_filter(string_split(s, ' '), lambda v: v <> '') AS ws FROM x)
SELECT doc_id, length(s) > 44 OR regexp_matches(s, '[.;]\\s') OR s LIKE '%.' OR (len(ws) >= 4 AND len(list_filter(ws, lambda v: regexp_matches(v, '^[A-Z]'))) * 2 < len(ws)) AS prose FROM w""")
def prose_names(t):
    """FLT13: what is too much of a sentence to be a name, of the first sixty letters of texts."""
    return t.documents.select("doc_id", tx.looks_like_prose(F.substr("text", F.lit(1), F.lit(60))).alias("prose"))


@query("""WITH x AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'https://a.b/#/mage?v=1' WHEN 2 THEN 'https://w.c/classic/talent-calc/mage/05-' || page_id WHEN 3 THEN page_id || '--5-' || page_id WHEN 4 THEN url ELSE 'https://w.c/talent-calc/mage' END AS s FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'link' WHEN 2 THEN 'foreign' WHEN 3 THEN 'code' ELSE 'error' END AS kind, CASE WHEN page_id % 6 = 3 THEN CASE WHEN page_id % 4 < 2 THEN NULL ELSE 4 END END AS segments FROM x""")
def pasted(t):
    """STR44, STR45: what was pasted, and the segments of codes, which may be at most three tabs in half of them."""
    k = F.col("page_id")
    n = k.cast("string")
    s = F.when(k % 6 == 0, "").when(k % 6 == 1, "https://a.b/#/mage?v=1").when(k % 6 == 2, F.concat(F.lit("https://w.c/classic/talent-calc/mage/05-"), n)).when(k % 6 == 3, F.concat(n, F.lit("--5-"), n)).when(k % 6 == 4, F.col("url")).otherwise("https://w.c/talent-calc/mage")
    d = t.pages.select("page_id", s.alias("s"))
    own = F.when(k % 4 < 2, F.size(tx.code_segments(F.col("s"), 3))).otherwise(F.size(tx.code_segments(F.col("s"), 4)))
    return d.select("page_id", tx.paste_kind(F.col("s")).alias("kind"), F.when((k % 6 == 3) & (own > 0), own).alias("segments"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 % 86400000 AS ms, ts FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS millis, printf('%d:%02d:%02d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000) AS stamp,
  CAST(ms // 1000 + CASE WHEN floor((CAST(ms AS DOUBLE) / 1000 - ms // 1000) * 60 + 0.5) >= 60 THEN 1 ELSE 0 END AS BIGINT) AS second, CAST(floor((CAST(ms AS DOUBLE) / 1000 - ms // 1000) * 60 + 0.5) AS BIGINT) % 60 AS frame, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at,
  CAST(ms // 1000 AS BIGINT) AS t0, CAST(ms // 1000 + 90 AS BIGINT) AS t1, CASE WHEN ms // 1000 >= 60 AND ms // 1000 % 60 = 0 THEN ms // 60000 || ' min' ELSE ms // 1000 || ' sec' END AS lasts FROM e""")
def times(t):
    """DT3-DT8, WIN15: stamps with milliseconds, stream stamps, seconds and frames, windows, RFC 3339, durations."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) % 86400000
    d = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), ms.alias("ms"))
    sec = F.col("ms") / 1000
    second, frame = tx.second_and_frame(sec)
    whole = F.floor(sec).cast("long")
    spec = F.when(F.col("event_id") % 2 == 0, F.concat(whole.cast("string"), F.lit("-"), (whole + 90).cast("string"))).otherwise(F.concat(tx.hms(whole), F.lit("-"), tx.hms(whole + 90)))
    t0, t1 = tx.window_seconds(spec)
    return d.select("event_id", tx.hms_millis(sec).alias("millis"), tx.stream_stamp(sec).alias("stamp"), second.alias("second"), frame.alias("frame"), tx.rfc3339(F.col("ts")).alias("at"), t0.alias("t0"), t1.alias("t1"), tx.duration_text(whole * 1000).alias("lasts"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN s || ',' || s * 2 WHEN s % 60 = 0 THEN s // 60 || ',' || s // 30 END AS lasts, CASE WHEN s <= 0 THEN 1 ELSE 9 + s END AS level, CAST(least(greatest(k % 70 - 10 + 1, 0), 51) AS BIGINT) AS available, CAST(least(least(greatest(k % 70 - 10 + 1, 0), 51), s) AS BIGINT) AS affordable, CAST(s - least(least(greatest(k % 70 - 10 + 1, 0), 51), s) AS BIGINT) AS beyond,
  CAST(CASE WHEN s >= 10 AND s % 5 <> 0 AND abs(s - round(s / 5.0) * 5) / s <= 0.05 THEN round(s / 5.0) * 5 END AS DOUBLE) AS near, CASE WHEN k % 2 = 0 THEN 'constant' WHEN k % 4 = 1 THEN 'copied' ELSE 'proportional' END AS rule,
  CASE WHEN k % 2 = 0 THEN s || '/' || s || '/' || s WHEN k % 4 = 1 THEN s || '/' || s + 1 || '/' || s + 5 ELSE s || '/' || 2 * s || '/' || 3 * s END AS vals FROM p""")
def planned_ranks(t):
    """DT9, MTH2, MTH3, MTH11, MTH12: converted durations, required levels, standings, rounding hints, scaled slots."""
    k, s = F.col("p_partkey"), F.col("p_size")
    as_text = lambda a: F.array_join(F.transform(a, tx.number_text), ",")
    own = num.standing((k % 70).cast("long"), s.cast("long"), 10, 51)
    first = s.cast("double")
    known = F.when(k % 2 == 0, F.array(first + 7, first + 7, first + 7)).otherwise(F.array(F.when(k % 4 == 1, first).otherwise(first + 2), first + 1, first + 5))
    plan = num.scaled_slot(first, known, F.lit(3), F.lit(True))
    return t.part.select(
        "p_partkey", as_text(tx.converted_durations(F.array(first, first * 2), F.lit("sec"), F.when(k % 3 == 0, "sec").otherwise("min"))).alias("lasts"), num.required_level(s, 10).cast("int").alias("level"),
        own["available"].cast("long").alias("available"), own["affordable"].cast("long").alias("affordable"), own["beyond"].cast("long").alias("beyond"), num.rounding(first).alias("near"), plan["rule"].alias("rule"), F.array_join(F.transform(plan["values"], tx.number_text), "/").alias("vals"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS p_partkey, CASE WHEN k % 3 = 2 THEN s || '/' || s || '/' || s ELSE s || '/' || CASE WHEN k % 3 = 0 THEN 2 * s ELSE s + 1 END || '/' || 3 * s END AS series, CASE WHEN k % 3 = 2 THEN '' WHEN k % 3 = 1 AND s = 1 THEN '0' ELSE '0' END AS varying,
  CASE WHEN k % 3 = 2 THEN 'copied' WHEN k % 3 = 0 OR s = 1 THEN 'proportional' ELSE 'table' END AS scaling, '0,2' AS slots, CASE WHEN k % 4 = 0 THEN 3 ELSE 1 END AS highest,
  CASE WHEN k % 3 = 2 THEN 'constant' WHEN k % 3 = 0 OR s = 1 THEN 'arithmetic' ELSE 'monotonic' END AS shape, CASE WHEN (SELECT min(p_size) FROM part) = 1 THEN 1 ELSE 0 END AS base FROM p""")
def rank_facts(t):
    """ARR1-ARR7, WIN13: series, varying places, scaling, placeholders, highest observed rank, shapes, base offset."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    second = F.when(k % 3 == 0, 2 * s).when(k % 3 == 1, s + 1).otherwise(s)
    vals = F.array(s, second, F.when(k % 3 == 2, s).otherwise(3 * s))
    ranks = F.transform(vals, lambda v: F.array(v, F.lit(1.0)))
    least = F.broadcast(t.part.agg(F.min("p_size").alias("least")))
    d = t.part.crossJoin(least)  # one row
    return d.select(
        "p_partkey", num.rank_series(ranks).alias("series"), F.array_join(F.transform(num.varying_positions(ranks), lambda j: j.cast("string")), ",").alias("varying"), num.rank_scaling(ranks).alias("scaling"),
        F.array_join(F.transform(num.placeholders(F.lit("{2} of {0} and {2}")), lambda j: j.cast("string")), ",").alias("slots"), num.highest_observed(F.when(k % 4 == 0, F.array(F.lit(1), F.lit(3)))).alias("highest"), num.shape(vals).alias("shape"), num.base_offset(F.col("least")).alias("base"),
    )


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS f FROM embeddings), m AS (SELECT vec_id, e, f, list_avg(e) AS me, list_avg(f) AS mf, list_stddev_pop(e) AS se, list_stddev_pop(f) AS sf, len(e) AS n FROM v WHERE f IS NOT NULL)
SELECT vec_id, round(list_sum(list_transform(range(1, n + 1), lambda i: (e[i] - me) * (f[i] - mf))) / n / (se * sf), 5) AS ncc, round(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN abs(e[i] - f[i]) > 0.1 THEN 1.0 ELSE 0.0 END)) / n, 6) AS changed, round(list_median(e), 6) AS middle FROM m""")
def vector_change(t):
    """MTH6-MTH9: each vector against the one with the next id, which ids of one step give without a sort of all."""
    d = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    nxt = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return d.join(nxt, "vec_id").select("vec_id", F.round(num.correlation(F.col("e"), F.col("f")), 5).alias("ncc"), F.round(num.changed_share(F.col("e"), F.col("f"), 0.1), 6).alias("changed"), F.round(num.middle(F.col("e")), 6).alias("middle"))


@query()
def capital_words(t):
    """STR23, STR24: capital I words lowered inside sentences, and capitalised phrases of texts."""
    d = t.documents.select("doc_id", "text", tx.lowered_capital_i("text").alias("low"))
    return d.select("doc_id", F.size("low.fixed").alias("lowered"), F.size(tx.capital_phrases(F.col("text"))).alias("phrases"))
