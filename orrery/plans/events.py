"""Queries: ledgers, sessions, windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import joins as J
from orrery.plans.registry import query
from orrery.plans.relations import table
from orrery.streaming import ledger as L


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def kinds(spark, sf_dir):
    """Events with short types: a (reserve), b (success), c (failure), d, e by id."""
    kind = F.element_at(F.array(*map(F.lit, "abcde")), (F.col("event_id") % 5 + 1).cast("int"))
    return events(spark, sf_dir).withColumn("event_type", kind)


KINDS = """WITH ev AS (SELECT event_id, ts, user_id, value, ['a', 'b', 'c', 'd', 'e'][event_id % 5 + 1] AS event_type FROM events)"""
BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    """WITH o AS (SELECT *, CAST(floor(epoch(date_trunc('second', ts)) / 3600) AS BIGINT) AS wave, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS new FROM events),
p AS (SELECT wave, count(*) AS events, count(*) FILTER (new) AS new FROM o GROUP BY wave) SELECT wave, events, new, CAST(sum(new) OVER (ORDER BY wave) AS BIGINT) AS known FROM p"""
)
def collector_waves(spark, sf_dir):
    return L.collector_waves(events(spark, sf_dir))


@query(
    KINDS
    + f""", o AS (SELECT *, first_value(CASE WHEN event_type IN ('b', 'c') THEN event_type END IGNORE NULLS) OVER ({BY_USER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS outcome FROM ev),
a AS (SELECT event_id, user_id, ts, outcome, row_number() OVER ({BY_USER}) AS nth FROM o WHERE event_type = 'a'),
w AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal FROM a WHERE nth <= 8),
c AS (SELECT a.*, w.ordinal AS ord, CASE WHEN nth > 8 THEN 'USER_LIMIT' WHEN w.ordinal > 700 THEN 'TOTAL_LIMIT' ELSE 'ADMITTED' END AS code FROM a LEFT JOIN w USING (event_id))
SELECT event_id, user_id, nth, CASE WHEN code = 'ADMITTED' THEN ord END AS ordinal, code,
  CASE WHEN code <> 'ADMITTED' THEN 'refused' WHEN outcome IS NULL THEN 'pending' WHEN outcome = 'b' THEN 'success' ELSE 'failure' END AS state FROM c"""
)
def ledger_state(spark, sf_dir):
    return L.ledger_state(kinds(spark, sf_dir), "a", "b", "c", 8, 700)


@query(
    KINDS
    + f""", u AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS used, CASE event_type WHEN 'a' THEN 6 WHEN 'b' THEN 9 ELSE 1073741824 END AS lim,
  sum(CAST(value >= 50 AS INT)) OVER ({BY_USER}) AS island FROM ev),
t AS (SELECT *, CAST(sum(CAST(value < 50 AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM u),
c AS (SELECT *, CASE WHEN used > lim THEN 'TYPE_BUDGET' WHEN streak >= 4 THEN 'NO_YIELD' ELSE 'OK' END AS code FROM t)
SELECT event_id, user_id, used, streak, code, max(CAST(code = 'NO_YIELD' AS INT)) OVER ({BY_USER}) = 1 AS stopped FROM c"""
)
def budget_stops(spark, sf_dir):
    return L.budget_stops(kinds(spark, sf_dir), {"a": 6, "b": 9}, 4)


@query(
    """WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, CASE WHEN event_id % 4 = 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS known FROM events),
n AS (SELECT *, last_value(CASE WHEN known IS NOT NULL THEN place END IGNORE NULLS) OVER w AS bp, last_value(known IGNORE NULLS) OVER w AS bk,
  first_value(CASE WHEN known IS NOT NULL THEN place END IGNORE NULLS) OVER v AS ap, first_value(known IGNORE NULLS) OVER v AS ak FROM p
  WINDOW w AS (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY user_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, CASE WHEN known IS NOT NULL THEN known WHEN bp IS NULL THEN ak - (ap - place) WHEN ap IS NULL THEN bk + (place - bp) ELSE bk + CAST(floor((ak - bk) * (place - bp) / (ap - bp)) AS BIGINT) END AS filled FROM n)
SELECT event_id, user_id, filled, max(filled - place) OVER (PARTITION BY user_id ORDER BY place) + place AS repaired FROM f"""
)
def event_time_repair(spark, sf_dir):
    return L.repaired_times(events(spark, sf_dir), F.col("event_id") % 4 == 0)


@query(
    KINDS
    + f""", s AS (SELECT *, CAST(sum(CAST(event_type = 'd' AS INT)) OVER ({BY_USER}) AS BIGINT) AS session FROM ev)
SELECT user_id, session, count(*) AS events, min(event_id) AS first, max(event_id) AS last, round(sum(value), 4) AS value FROM s GROUP BY ALL"""
)
def prompt_sessions(spark, sf_dir):
    return L.sessions(kinds(spark, sf_dir), "d")


@query(
    KINDS
    + f""" SELECT event_id, user_id, first_value(CASE WHEN event_type IN ('c', 'e') THEN event_id END IGNORE NULLS) OVER ({BY_USER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ended FROM ev"""
)
def forward_as_of(spark, sf_dir):
    own = kinds(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return J.next_of(own, ("user_id",), "at", F.col("event_type").isin("c", "e"), "event_id", "ended").select("event_id", "user_id", "ended")


@query(
    KINDS
    + f""", x AS (SELECT event_id, user_id, event_type = 'a' AS is_start, lead(event_type = 'a') OVER ({BY_USER}) AS nxt, lead(event_id) OVER ({BY_USER}) AS next_at, lag(event_type = 'a') OVER ({BY_USER}) AS prv FROM ev WHERE event_type IN ('a', 'b')),
k AS (SELECT *, CASE WHEN is_start AND nxt = false THEN 'matched' WHEN is_start THEN 'open' WHEN prv IS NULL OR NOT prv THEN 'orphan' END AS pairing FROM x)
SELECT event_id, user_id, pairing, CASE WHEN pairing = 'matched' THEN next_at END AS ended FROM k WHERE pairing IS NOT NULL"""
)
def call_pairing(spark, sf_dir):
    own = kinds(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    out = J.pair_calls(own, ("user_id",), "at", F.col("event_type") == "a", F.col("event_type") == "b")
    return out.select("event_id", "user_id", "pairing", F.col("ended.event_id").alias("ended"))


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    out = L.tumbling(events(spark, sf_dir))
    return out.select((F.unix_timestamp("start") / 3600).cast("bigint").alias("hour"), "event_type", "n", "value")


@query("WITH h AS (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) AS half FROM events), w AS (SELECT half AS start FROM h UNION ALL SELECT half - 1 FROM h) SELECT start, count(*) AS n FROM w GROUP BY start")
def sliding_windows(spark, sf_dir):
    out = L.sliding(events(spark, sf_dir))
    return out.select((F.unix_timestamp("start") / 1800).cast("bigint").alias("start"), "n")


@query(
    """WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS fresh FROM events),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def session_windows(spark, sf_dir):
    out = L.session_windows(events(spark, sf_dir))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY event_type")
def event_dedup(spark, sf_dir):
    own = events(spark, sf_dir)
    return L.deduplicated(own.unionAll(own.where("event_id % 3 = 0"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
