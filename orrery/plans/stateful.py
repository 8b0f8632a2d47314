"""Queries: leases with tickets, rounds under budgets, bound evaluations, trees of digests.  SQL steps through rows by recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import numbers as N
from orrery.functions import text as X
from orrery.operators import bundles, digests, evaluation
from orrery.operators.lexical import facet_variants
from orrery.plans.registry import query
from orrery.plans.relations import qrels, run, sql, table
from orrery.plans.text import STOP, _docs, _stem_sql
from orrery.streaming import stateful


@query(
    """WITH RECURSIVE e AS (SELECT event_id AS place, user_id AS topic, epoch_ms(ts) AS tm, CASE WHEN event_id % 50 = 0 THEN 'done' ELSE ['ask', 'ask', 'beat', 'fail', 'ask'][event_id % 5 + 1] END AS kind, 'w' || event_id % 3 AS owner,
  CASE WHEN event_id % 4 = 0 THEN user_id || '#' || (1 + event_id % 3) END AS shown, (event_id % 2) * 3600000 AS retry, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
f AS (SELECT CAST(0 AS BIGINT) AS n, user_id AS topic, CAST(NULL AS BIGINT) AS place, '' AS result, 'open' AS phase, CAST(NULL AS VARCHAR) AS holder, CAST(0 AS BIGINT) AS until, CAST(NULL AS VARCHAR) AS ticket, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS not_before FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT n, topic, place, result,
    CASE WHEN result IN ('granted', 'heartbeat', 'continued') THEN 'leased' WHEN result = 'completed' THEN 'completed' WHEN result = 'ticket' THEN 'waiting' ELSE own END,
    CASE WHEN result IN ('granted', 'heartbeat', 'continued') THEN owner WHEN result IN ('completed', 'ticket') THEN NULL ELSE had END,
    CASE WHEN result IN ('granted', 'heartbeat', 'continued') THEN tm + 7200000 ELSE until END,
    CASE WHEN result = 'ticket' THEN topic || '#' || (failures + 1) WHEN result = 'continued' THEN NULL ELSE ticket END,
    failures + CAST(result = 'ticket' AS INT), CASE WHEN result = 'ticket' THEN tm + retry ELSE not_before END FROM (
    SELECT s.*, CASE WHEN kind = 'ask' THEN CASE own WHEN 'completed' THEN 'cached' WHEN 'leased' THEN CASE WHEN had = owner THEN 'heartbeat' ELSE 'busy' END
        WHEN 'waiting' THEN CASE WHEN shown IS NULL THEN 'waiting' WHEN shown <> ticket THEN 'bad ticket' WHEN tm < not_before THEN 'early' ELSE 'continued' END
        ELSE CASE WHEN shown IS NOT NULL THEN 'bad ticket' ELSE 'granted' END END
      WHEN own <> 'leased' OR had <> owner THEN 'lost' WHEN kind = 'beat' THEN 'heartbeat' WHEN kind = 'done' THEN 'completed' ELSE 'ticket' END AS result FROM (
      SELECT e.*, f.until, f.ticket, f.failures, f.not_before, CASE WHEN f.phase = 'leased' AND f.until <= e.tm THEN 'open' ELSE f.phase END AS own, CASE WHEN f.phase = 'leased' AND f.until > e.tm THEN f.holder END AS had
      FROM f JOIN e ON e.topic = f.topic AND e.n = f.n + 1) s))
SELECT topic, place, result, holder, ticket AS open_ticket FROM f WHERE n > 0"""
)
def lease_tickets(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 50 == 0, "done").otherwise(F.element_at(F.array(*map(F.lit, ("ask", "ask", "beat", "fail", "ask"))), (i % 5 + 1).cast("int")))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("topic"), i.alias("place"), F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")).alias("at"), kind.alias("kind"), F.concat(F.lit("w"), (i % 3).cast("string")).alias("owner"),
        F.when(i % 4 == 0, F.concat(F.col("user_id").cast("string"), F.lit("#"), (1 + i % 3).cast("string"))).alias("ticket"), ((i % 2) * 3_600_000).alias("retry_ms"),
    )
    return stateful.leases(rows, 7_200_000).select("topic", "place", "result", "holder", "open_ticket")


def _higher(a: str, b: str) -> str:
    rank = lambda x: f"CASE {x} WHEN 'TASK_BUDGET' THEN 20 WHEN 'CALL_BUDGET' THEN 30 WHEN 'NO_PROGRESS' THEN 90 WHEN 'HARD_DEADLINE' THEN 100 ELSE -1 END"
    return f"CASE WHEN {rank(b)} > {rank(a)} THEN {b} ELSE {a} END"


@query(
    f"""WITH RECURSIVE k AS (SELECT event_id, user_id AS run, ['task', 'call', 'call', 'finish', 'round', 'call'][event_id % 6 + 1] AS kind, event_id % 3 AS t, CAST(floor(value / 20) AS BIGINT) AS nug, event_id % 4 AS fac, event_id % 7 = 0 AS again,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
e AS (SELECT *, CASE WHEN kind = 'round' THEN count(*) FILTER (kind = 'round') OVER (PARTITION BY run ORDER BY n) - CAST(again AS INT) END AS round FROM k),
f AS (SELECT CAST(0 AS BIGINT) AS n, user_id AS run, CAST(NULL AS BIGINT) AS event_id, '' AS code, CAST(NULL AS VARCHAR) AS stop, 0 AS streak, 0 AS tasks, 0 AS calls, CAST([] AS BIGINT[]) AS active, [0, 0, 0] AS used, CAST([] AS VARCHAR[]) AS decided, CAST(0 AS BIGINT) AS nug, CAST(0 AS BIGINT) AS fac FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT n, run, event_id, code, {_higher("late", "CASE WHEN latched IS NULL THEN '' ELSE latched END")}, streak,
    tasks + CAST(kind = 'task' AND code IN ('OK', 'SOFT_DEADLINE') AS INT), calls + CAST(kind = 'call' AND code IN ('OK', 'SOFT_DEADLINE') AS INT),
    CASE WHEN kind = 'finish' THEN list_filter(active, lambda a: a <> t) WHEN kind = 'task' AND code IN ('OK', 'SOFT_DEADLINE') THEN list_append(active, t) ELSE active END,
    list_transform(used, lambda u, i: u + CAST(kind = 'call' AND code IN ('OK', 'SOFT_DEADLINE') AND i = t + 1 AS INT)),
    CASE WHEN closes THEN list_append(decided, code) ELSE decided END, CASE WHEN closes THEN nug ELSE had_nug END, CASE WHEN closes THEN fac ELSE had_fac END FROM (
    SELECT v.*, CASE WHEN kind = 'finish' THEN 'OK'
        WHEN kind = 'round' THEN CASE WHEN round BETWEEN 1 AND len(decided) THEN decided[round] WHEN NOT closes THEN 'ROUND_SEQUENCE' WHEN streak >= 2 THEN 'NO_PROGRESS' ELSE fine END
        WHEN late IS NOT NULL THEN late
        WHEN kind = 'task' THEN CASE WHEN list_contains(active, t) THEN 'CONCURRENCY' WHEN tasks >= 6 THEN 'TASK_BUDGET' WHEN len(active) >= 2 THEN 'CONCURRENCY' ELSE fine END
        WHEN NOT list_contains(active, t) THEN 'NO_TASK' WHEN calls >= 8 THEN 'CALL_BUDGET' WHEN used[t + 1] >= 3 THEN 'TASK_CALLS' ELSE fine END AS code,
      CASE WHEN kind = 'round' THEN CASE WHEN closes AND streak >= 2 THEN 'NO_PROGRESS' END WHEN kind = 'finish' OR late IS NOT NULL THEN NULL
        WHEN kind = 'task' THEN CASE WHEN NOT list_contains(active, t) AND tasks >= 6 THEN 'TASK_BUDGET' END
        WHEN list_contains(active, t) AND (calls >= 8 OR calls = 7 AND used[t + 1] < 3) THEN 'CALL_BUDGET' END AS latched FROM (
      SELECT u.*, CASE WHEN closes THEN CASE WHEN nug > had_nug OR fac > had_fac THEN 0 ELSE before + 1 END ELSE before END AS streak FROM (
        SELECT e.*, f.tasks, f.calls, f.active, f.used, f.decided, f.nug AS had_nug, f.fac AS had_fac, f.streak AS before, CASE WHEN e.n >= 30 THEN 'HARD_DEADLINE' ELSE f.stop END AS late, CASE WHEN e.n >= 20 THEN 'SOFT_DEADLINE' ELSE 'OK' END AS fine,
          e.kind = 'round' AND e.round = len(f.decided) + 1 AS closes FROM f JOIN e ON e.run = f.run AND e.n = f.n + 1) u) v))
SELECT run, event_id, code, nullif(stop, '') AS stop, streak FROM f WHERE n > 0"""
)
def research_rounds(spark, sf_dir):
    i = F.col("event_id")
    by = Window.partitionBy("user_id").orderBy("event_id")
    own = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(by)).withColumn("kind", F.element_at(F.array(*map(F.lit, ("task", "call", "call", "finish", "round", "call"))), (i % 6 + 1).cast("int")))
    rounds = F.sum((F.col("kind") == "round").cast("int")).over(by) - (i % 7 == 0).cast("int")
    ids = lambda name, many: F.transform(F.sequence(F.lit(0), many), lambda k: F.concat(F.lit(name), k.cast("string")))
    rows = own.select(
        F.col("user_id").alias("run"), i.alias("place"), F.col("n").cast("long").alias("at"), "kind", F.concat(F.lit("t"), (i % 3).cast("string")).alias("task"), F.lit(False).alias("survey"),
        F.when(F.col("kind") == "round", rounds).cast("int").alias("round"), F.slice(ids("n", F.floor(F.col("value") / 20)), 2, 1 << 20).alias("nuggets"), F.array().cast("array<string>").alias("needs"), F.slice(ids("f", i % 4), 2, 1 << 20).alias("facets"),
    )
    made = stateful.research_rounds(rows, max_tasks=6, max_concurrent=2, max_calls=8, calls_per_task=3, no_progress_rounds=2, soft=20, hard=30)
    return made.select("run", F.col("place").alias("event_id"), "code", "stop", "streak")


@query(
    sql(
        "run qrels",
        """, q AS (SELECT *, count(*) FILTER (grade >= 2) OVER (PARTITION BY topic) AS relevant FROM qrels),
v AS (SELECT q.topic, max(relevant) AS relevant, count(*) FILTER (run.rank <= 50 AND grade >= 2) AS hits, count(*) FILTER (run.rank <= 10) AS judged FROM q JOIN run USING (topic, doc) GROUP BY q.topic)
SELECT topic, 'recall@50' AS metric, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END, 6) AS value FROM v UNION ALL SELECT topic, 'judged_rate@10', round(judged / 10, 6) FROM v""",
    )
)
def run_evaluation(spark, sf_dir):
    """Values bound to run, judgments, topics and metrics by digest; the binding itself is tested apart."""
    judged = qrels(spark, sf_dir)
    topics = judged.select("topic").distinct()
    own = run(spark, sf_dir).join(topics, "topic", "left_semi").select("topic", "doc", "rank", "score")
    values, _, _ = evaluation.evaluate_run(own, judged, topics, ("recall@50", "judged_rate@10"), variant="labels")
    return values.select("topic", "metric", F.round("value", 6).alias("value"))


@query(
    """WITH r AS (SELECT sha256(CAST(c_custkey AS VARCHAR))[1:2] AS prefix, sha256('9:c_acctbal6:double' || CASE WHEN b IS NULL THEN '-' ELSE strlen(b) || ':' || b END || '9:c_custkey6:bigint' || strlen(k) || ':' || k || '6:c_name6:string' || CASE WHEN c_name IS NULL THEN '-' ELSE strlen(c_name) || ':' || c_name END) AS digest
  FROM (SELECT c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS k, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) || '.0' AS b FROM customer)),
l2 AS (SELECT prefix, sha256(string_agg(digest, ',' ORDER BY digest)) AS digest, count(*) AS rows FROM r GROUP BY prefix),
l1 AS (SELECT prefix[1:1] AS prefix, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS prefix, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM l1)
SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2"""
)
def digest_tree(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.round("c_acctbal").alias("c_acctbal"))
    return digests.tree(own, ["c_custkey"], 2)


@query(
    f"""WITH t AS (SELECT doc_id AS doc, list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{STOP}], w)), lambda w: {_stem_sql("w")}) AS w FROM documents),
u AS (SELECT doc, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM t), f AS (SELECT doc, term, min(pos) AS pos FROM u WHERE length(term) >= 5 OR regexp_matches(term, '[0-9]') GROUP BY ALL)
SELECT t.doc, count(f.term) AS n, sha256(coalesce(string_agg(f.term, ' ' ORDER BY f.pos), '')) AS terms FROM t LEFT JOIN f ON f.doc = t.doc GROUP BY t.doc"""
)
def high_information_terms(spark, sf_dir):
    own = _docs(spark, sf_dir).withColumn("t", X.high_information(F.col("text")))
    return own.select("doc", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("terms"))


@query(
    r"""WITH w AS (SELECT doc_id AS doc, string_split_regex(text, '\s+') AS w FROM documents), p AS (SELECT doc, unnest(w[1:-2]) AS a, unnest(w[2:]) AS b FROM w),
c AS (SELECT doc, count(*) FILTER (regexp_matches(a, '[.!?][''")\]]*$') AND regexp_matches(b, '^[A-Z0-9''"(]')) - count(*) FILTER (regexp_matches(a, '(^|[^\p{L}\p{N}_])(Dr|Mr|Mrs|Ms|Prof|St|vs|etc|e\.g|i\.e|No|Fig|[A-Z])\.$') AND regexp_matches(b, '^[A-Z0-9''"(]')) AS n FROM p GROUP BY doc)
SELECT w.doc, coalesce(n, 0) AS n FROM w LEFT JOIN c ON c.doc = w.doc"""
)
def inner_sentence_ends(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc", X.inner_boundaries(F.col("text")).alias("n"))


@query("SELECT o_orderkey AS id, printf('%.2f', round(CAST(o_totalprice AS DECIMAL(38, 12)), 2)) AS price, CAST(round(CAST(CAST(o_totalprice AS DECIMAL(12, 2)) * 0.125 AS DECIMAL(38, 12)), 2) AS DECIMAL(20, 2))::VARCHAR AS eighth FROM orders")
def fixed_decimals(spark, sf_dir):
    """Halves at the third place, up."""
    p = F.col("o_totalprice")
    eighth = p.cast("decimal(12,2)") * F.lit("0.125").cast("decimal(4,3)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), N.half_up(p, 2).cast("string").alias("price"), N.half_up(eighth, 2).cast("string").alias("eighth"))


@query(
    """WITH c AS (SELECT user_id AS topic, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS stage, event_type AS counter, count(*) AS n FROM events GROUP BY ALL)
SELECT topic, stage, counter, CAST(sum(n) OVER (PARTITION BY topic, counter ORDER BY stage) AS BIGINT) AS value, n AS delta FROM c"""
)
def stage_accounting(spark, sf_dir):
    day = F.floor(F.unix_timestamp("ts") / 86400).cast("long")
    own = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("topic"), day.alias("stage"), F.col("event_type").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("topic", "counter").orderBy("stage"))
    return bundles.stage_deltas(own.select("topic", "stage", "counter", running.alias("value")))


@query(
    """WITH b AS (SELECT item_id AS topic, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM benchmark)
SELECT topic, 0 AS place, 'original' AS variant, text AS query FROM b UNION ALL SELECT topic, p, 'facet:' || f || ':q' || q, array_to_string(w[a:a + 3], ' ') FROM b, (VALUES (1, 'a', 1, 1), (2, 'a', 2, 5), (3, 'b', 1, 9)) v(p, f, q, a)"""
)
def facet_query_variants(spark, sf_dir):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    q = lambda a: F.array_join(F.slice(w, a, 4), " ")
    facet = lambda name, *queries: F.struct(F.lit(name).alias("id"), F.array(*queries).alias("queries"))
    plans = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), "text", F.array(facet("a", q(1), q(5)), facet("b", q(9))).alias("facets"))
    return facet_variants(plans)
