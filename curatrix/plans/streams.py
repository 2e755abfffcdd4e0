"""Queries over events and orders in the order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import resolve, sessions
from .registry import query

HOUR = 3600 * 1000000


def _events(t):
    return t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""
WITH v AS (SELECT event_type, count(DISTINCT user_id) AS votes FROM events GROUP BY 1) SELECT event_type, votes, (SELECT count(DISTINCT user_id) FROM events) AS voters, votes > 0.5 * (SELECT count(DISTINCT user_id) FROM events) AS agreed FROM v
""")
def quorum_consensus(t):
    """AGG5: event types that more than half of all users have."""
    return resolve.quorum(t.events, "user_id", "event_type")


@query("""
WITH k AS (SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 0.5 * (SELECT count(DISTINCT user_id) FROM events)), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, event_type FROM u, k EXCEPT SELECT user_id, event_type FROM events
""")
def quorum_missing(t):
    """AGG7, SET5: agreed types that a user lacks. There are few event types, so they are a broadcast side."""
    agreed = resolve.quorum(t.events, "user_id", "event_type").filter("agreed")
    return resolve.missing(t.events, "user_id", "event_type", agreed)


@query("""
SELECT event_type, round(median(value), 6) AS middle, round(avg(value), 6) AS mean, round(least(0.95, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events)), 6) AS confidence, round(quantile_cont(value, 0.85), 6) AS high FROM events GROUP BY 1
""")
def quorum_median(t):
    """AGG6, AGG8, AGG30: exact medians per type, vote share capped."""
    total = t.events.agg(F.countDistinct("user_id").alias("all"))
    got = t.events.groupBy("event_type").agg(F.median("value").alias("m"), F.avg("value").alias("a"), F.countDistinct("user_id").alias("u"), F.percentile("value", 0.85).alias("h"))
    return got.join(F.broadcast(total)).select("event_type", F.round("m", 6).alias("middle"), F.round("a", 6).alias("mean"), F.round(F.least(F.lit(0.95), F.col("u") / F.col("all")), 6).alias("confidence"), F.round("h", 6).alias("high"))


_EV = "WITH e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query(_EV + f""", n AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND us - lag(us) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS run FROM n)
SELECT user_id, run, event_type, min(us) AS t0, max(us) AS t1, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 2""")
def runs_islands(t):
    """WIN1, WIN2: runs of one type with gaps of at most six hours, two rows at least."""
    return sessions.runs(_events(t), ["user_id"], ["us", "event_id"], "us", "event_type", 6 * HOUR, 2)


@query(_EV + f""", n AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS run FROM n), d AS (SELECT user_id, event_type, run, max(us) - min(us) AS d FROM r GROUP BY ALL)
SELECT user_id, event_type, count(*) AS dwells, max(d) AS longest, CAST(sum(d) AS BIGINT) AS total, CASE WHEN max(d) >= {6 * HOUR} THEN 'long' WHEN count(*) > 1 THEN 'often' ELSE 'once' END AS verdict FROM d GROUP BY ALL""")
def dwell_sessions(t):
    """WIN3, AGG35: dwells per user and type with bridged gaps, and a verdict."""
    d = _dwells(t)
    return d.groupBy("user_id", "event_type").agg(F.count("*").alias("dwells"), F.max("d").alias("longest"), F.sum("d").alias("total")).withColumn("verdict", F.when(F.col("longest") >= 6 * HOUR, "long").when(F.col("dwells") > 1, "often").otherwise("once"))


def _dwells(t):
    e = _events(t).withColumn("one", F.lit(1))
    return sessions.runs(e, ["user_id", "event_type"], ["us", "event_id"], "us", "one", 12 * HOUR).select("user_id", "event_type", (F.col("t1") - F.col("t0")).alias("d"))


@query(_EV + f""", h AS (SELECT * FROM e WHERE value >= 50), n AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {24 * HOUR} THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS run FROM n) SELECT user_id, run, min(us) AS t0, max(us) AS t1, count(*) AS n FROM r GROUP BY ALL""")
def hit_runs(t):
    """WIN4: runs of hits with gaps of at most a day."""
    return sessions.runs(_events(t).filter("value >= 50").withColumn("hit", F.lit(1)), ["user_id"], ["us", "event_id"], "us", "hit", 24 * HOUR).drop("hit")


@query(_EV + f""", n AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS run FROM n), g AS (SELECT user_id, run, event_type, min(us) AS t0, max(us) AS last, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, run, event_type, t0, coalesce(lead(t0) OVER (PARTITION BY user_id ORDER BY run), last + {HOUR}) AS t1, n FROM g""")
def segments_lead(t):
    """WIN5: segments end where the next starts."""
    return sessions.segments(_events(t), ["user_id"], ["us", "event_id"], "us", "event_type", HOUR)


@query(_EV + f""", l AS (SELECT user_id, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS t0, us AS t1 FROM e) SELECT user_id, t0, t1, t1 - t0 AS gap FROM l WHERE t1 - t0 > {72 * HOUR}""")
def gap_detect(t):
    """WIN14: silences of more than three days."""
    return sessions.gaps(_events(t), ["user_id"], ["us", "event_id"], "us", 72 * HOUR)


_IV = """WITH i AS (SELECT o_custkey, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS t0, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) + 30 AS t1 FROM orders),
n AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY o_custkey ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS run FROM n), m AS (SELECT o_custkey, min(t0) AS t0, max(t1) AS t1 FROM r GROUP BY o_custkey, run)
"""


def _intervals(t):
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400000000).cast("long")
    return t.orders.select("o_custkey", day.alias("t0"), (day + 30).alias("t1"))


@query(_IV + "SELECT * FROM m")
def interval_merge(t):
    """WIN7: thirty days from each order, merged by customer, first within years."""
    return sessions.merged_intervals(_intervals(t), ["o_custkey"], bucket=365)


@query(_IV + """, b AS (SELECT DISTINCT o_custkey, t0 + 10 AS b0, t0 + 12 AS b1 FROM i), k AS (SELECT o_custkey, unnest(range(t0, t1)) AS d FROM m),
f AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_custkey = k.o_custkey AND d >= b0 AND d < b1)), g AS (SELECT *, d - row_number() OVER (PARTITION BY o_custkey ORDER BY d) AS grp FROM f)
SELECT o_custkey, min(d) AS t0, max(d) + 1 AS t1 FROM g GROUP BY o_custkey, grp""")
def interval_subtract(t):
    """WIN6, J24: the merged spans without days 10 and 11 after each order."""
    blocks = _intervals(t).select("o_custkey", (F.col("t0") + 10).alias("t0"), (F.col("t0") + 12).alias("t1"))
    return sessions.subtracted(sessions.merged_intervals(_intervals(t), ["o_custkey"]), blocks, ["o_custkey"])


@query(_EV + """ SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS stamp, s AS seconds FROM (SELECT event_id, us // 1000000 % 86400 AS s FROM e)""")
def time_stamps(t):
    """DT1, DT2: seconds of the day as HH:MM:SS and back."""
    s = F.floor(F.col("us") / 1000000) % 86400
    got = _events(t).select("event_id", tx.hms(s).alias("stamp"))
    return got.select("event_id", "stamp", tx.parse_hms(F.col("stamp")).alias("seconds"))


@query("""
WITH e AS (SELECT user_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT user_id, count(*) AS n, count(DISTINCT k) AS kinds, CAST(sum(coalesce(k, 0)) AS BIGINT) AS total, CAST(max(k) AS INT) AS most FROM e GROUP BY 1
""")
def json_props(t):
    """SRC3, SRC10: numbers out of JSON text, leniently cast."""
    k = tx.lenient_int(F.get_json_object("props", "$.k"))
    known = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(known).alias("kinds"), F.sum(k).alias("total"), F.max(known).alias("most"))


@query(_EV + f""", n AS (SELECT *, CASE WHEN us - lag(us) OVER w < {6 * HOUR} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS run FROM n)
SELECT user_id, event_type, epoch_ms(min(us) // 1000) AS t0, CAST(min(us) AS BIGINT) AS t0_us, max(us) + {6 * HOUR} AS t1_us, count(*) AS n, max(value) AS best FROM r GROUP BY user_id, event_type, run""".replace("epoch_ms(min(us) // 1000) AS t0, ", ""))
def stream_sessions(t):
    """STM1: sessions of a stream with a gap of six hours: those that the watermark closed, and those open at the end."""
    from ..streaming.sessions import all_sessions

    got = all_sessions(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)
    return got.select("user_id", "event_type", F.unix_micros("t0").alias("t0_us"), F.unix_micros("t1").alias("t1_us"), "n", "best")
