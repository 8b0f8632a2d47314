"""Queries: responses, caches, budgets and splices."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import stores as S
from orrery.operators.planning import torn_lines
from orrery.plans.registry import query
from orrery.plans.relations import run, sql, table

HITS = """h AS (SELECT o_orderkey AS response, place, CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE place END AS rank, CASE WHEN (o_orderkey + place) % 13 = 0 THEN NULL ELSE 'd' || (o_custkey + place) % 40 END AS doc,
  o_totalprice / place AS score, 'Text ' || (o_custkey + place) % 40 || CASE WHEN (o_custkey + place) % 40 = 7 AND o_orderkey % 2 = 0 THEN ' other' ELSE '' END AS text FROM orders CROSS JOIN (SELECT unnest([1, 2, 3]) AS place))"""


def _responses(spark, sf_dir):
    """Each order as a response of three hits; where and how deep the text lies differs."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def hit(place: int):
        number = (c + place) % 40
        text = F.concat(F.lit("Text  "), number.cast("string"), F.when((number == 7) & (k % 2 == 0), " other").otherwise(""))
        inner = F.when(k % 3 == 0, F.concat(F.lit('"contents": '), quote(text))).when(k % 3 == 1, F.concat(F.lit('"doc": {"x": {"text": '), quote(text), F.lit("}}"))).otherwise(
            F.concat(F.lit('"doc": '), F.lit('"{\\"parts\\": [\\"'), text, F.lit('\\"]}"'))
        )
        rank = F.when(c % 11 == 0, '"rank": 1, ').otherwise("")
        name = F.when((k + place) % 13 == 0, "").otherwise(F.concat(F.lit('"_id": "d'), number.cast("string"), F.lit('", ')))
        return F.concat(F.lit("{"), rank, name, F.lit('"score": '), (F.col("o_totalprice") / place).cast("string"), F.lit(", "), inner, F.lit("}"))

    field = F.element_at(F.array(*map(F.lit, S.HIT_FIELDS)), (k % 3 + 1).cast("int"))
    body = F.concat(F.lit('{"'), field, F.lit('": ['), F.concat_ws(", ", hit(1), hit(2), hit(3)), F.lit("]}"))
    return table(spark, sf_dir, "orders").select(k.alias("response"), body.alias("body"))


@query(f"WITH {HITS} SELECT response, rank, doc, round(score, 4) AS score, text FROM h")
def response_hits(spark, sf_dir):
    return S.normalised(_responses(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(
    f"""WITH {HITS}, b AS (SELECT doc, min(text) <> max(text) AS torn FROM h WHERE doc IS NOT NULL GROUP BY doc), f AS (SELECT h.response, h.rank, h.doc, CASE WHEN h.doc IS NULL THEN 'document'
  WHEN row_number() OVER (PARTITION BY response, rank ORDER BY h.doc NULLS FIRST) > 1 THEN 'repeated rank' WHEN torn THEN 'two bodies' END AS fault FROM h LEFT JOIN b ON b.doc = h.doc)
SELECT * FROM f WHERE fault IS NOT NULL"""
)
def response_faults(spark, sf_dir):
    return S.hit_faults(S.normalised(_responses(spark, sf_dir)))


@query(
    """WITH s AS (SELECT c_custkey AS key, sha256(CAST(c_custkey AS VARCHAR)) AS old FROM customer WHERE c_custkey % 3 <> 0),
e AS (SELECT o_custkey AS key, sha256(CASE WHEN o_custkey % 10 = 0 THEN 'x' WHEN o_custkey % 14 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END) AS new FROM orders WHERE o_orderkey % 3 = 0),
c AS (SELECT key, min(new) AS new, count(DISTINCT new) > 1 AS torn FROM e GROUP BY key)
SELECT coalesce(s.key, c.key) AS key, CASE WHEN torn OR old <> new THEN 'conflict' WHEN new IS NULL THEN 'kept' WHEN old IS NULL THEN 'inserted' ELSE 'equal' END AS action,
  CASE WHEN old IS NULL AND NOT torn THEN new ELSE old END AS sha256 FROM s FULL JOIN c ON s.key = c.key"""
)
def cache_commit(spark, sf_dir):
    c, o = F.col("c_custkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    store = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(c.alias("key"), F.sha2(text(c), 256).alias("sha256"))
    body = F.when(o % 10 == 0, "x").when(o % 14 == 0, text(F.col("o_orderkey"))).otherwise(text(o))
    return S.committed(store, table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(o.alias("key"), F.sha2(body, 256).alias("sha256")))


@query(
    """WITH t AS (SELECT o_custkey AS key, o_orderkey AS attempt, o_orderkey % 3 = 0 AS torn FROM orders), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY torn, attempt) AS nth FROM t)
SELECT key, attempt, CASE WHEN torn THEN 'torn' WHEN key % 4 = 0 THEN 'published before' WHEN nth > 1 THEN 'superseded' ELSE 'published' END AS state FROM w"""
)
def cache_recovery(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("attempt"))
    payload = F.concat(F.lit("body "), F.col("attempt").cast("string"))
    staged = o.withColumn("payload", payload).withColumn("sha256", F.when(F.col("attempt") % 3 == 0, "cut").otherwise(F.sha2(payload, 256)))
    return S.recovered(staged, table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key")))


@query(
    """WITH a AS (SELECT o_custkey AS topic, count(*) AS attempts, max(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) = 1 AS done, arg_max(o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0, o_orderkey) AS running FROM orders GROUP BY 1)
SELECT c_custkey AS topic, coalesce(attempts, 0) AS attempts, CASE WHEN done THEN 'done' WHEN running THEN 'running' WHEN coalesce(attempts, 0) >= 4 + c_custkey % 4 THEN 'given up' WHEN attempts > 0 THEN 'retry' ELSE 'open' END AS state
FROM customer LEFT JOIN a ON a.topic = c_custkey"""
)
def continuation_state(spark, sf_dir):
    k = F.col("o_orderkey")
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"), k.alias("attempt"), F.when(k % 5 == 0, True).when(k % 7 != 0, False).alias("ok"))
    return S.continued(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic"), (4 + F.col("c_custkey") % 4).alias("most")), answers)


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id AS run, event_id % 4 AS task, ['search', 'snippet', 'passage'][event_id % 3 + 1] AS tool, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT CAST(0 AS BIGINT) AS n, user_id AS run, CAST(NULL AS BIGINT) AS event_id, '' AS code, CAST(0 AS BIGINT) AS used, '' AS stop, [0, 0, 0, 0] AS tasks, [0, 0, 0, 0] AS searches FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT n, run, event_id, code, used + CAST(code = 'ADMITTED' AS INT), CASE WHEN stop <> '' THEN stop WHEN code = 'DEADLINE' THEN code WHEN code = 'ADMITTED' AND used + 1 >= 30 THEN 'TOTAL_BUDGET' ELSE '' END,
    list_transform(tasks, lambda x, i: x + CAST(code = 'ADMITTED' AND i = task + 1 AS INT)), list_transform(searches, lambda x, i: x + CAST(code = 'ADMITTED' AND i = task + 1 AND tool = 'search' AS INT)) FROM (
    SELECT e.*, f.used, f.stop, f.tasks, f.searches, CASE WHEN f.stop <> '' THEN f.stop WHEN e.run % 3 = 0 AND e.n >= 25 THEN 'DEADLINE' WHEN f.tasks[e.task + 1] >= 9 OR (e.tool = 'search' AND f.searches[e.task + 1] >= 2) THEN 'TASK_BUDGET' ELSE 'ADMITTED' END AS code
    FROM f JOIN e ON e.run = f.run AND e.n = f.n + 1))
SELECT event_id, run, code, used FROM f WHERE n > 0"""
)
def budget_admission(spark, sf_dir):
    from pyspark.sql import Window

    i = F.col("event_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("snippet"), F.lit("passage")), (i % 3 + 1).cast("int"))
    calls = table(spark, sf_dir, "events").withColumn("n", n).select(F.col("user_id").alias("run"), i.alias("place"), F.when(F.col("user_id") % 3 == 0, F.col("n")).otherwise(0).alias("at"), (i % 4).alias("task"), tool.alias("tool"))
    return S.budget(calls, 30, 9, {"search": 2}, deadline=25).select(F.col("place").alias("event_id"), "run", "code", "used")


@query(
    """WITH s AS (SELECT conv_id AS topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS w FROM conversations),
o AS (SELECT topic, unnest([0, topic % 3, 4, topic % 5 + 1, 1, topic % 2]) AS start, unnest([1, 0, topic % 4, 1, 0, topic % 7]) AS cnt, unnest([1, 2, 3, 4, 5, 6]) AS op FROM (SELECT DISTINCT topic FROM s)),
p AS (SELECT * FROM o WHERE op <= topic % 4 + 1), l AS (SELECT topic, count(*) AS n, sum(w) AS w FROM s GROUP BY topic),
g AS (SELECT p.topic, sum(s.w) AS w FROM p JOIN s ON s.topic = p.topic AND s.idx >= p.start AND s.idx < p.start + p.cnt GROUP BY p.topic),
f AS (SELECT l.topic, CASE WHEN (SELECT count(DISTINCT start) < count(*) FROM p WHERE p.topic = l.topic) THEN 'repeated start' WHEN (SELECT sum(cnt) > 8 FROM p WHERE p.topic = l.topic) THEN 'touched'
  WHEN EXISTS (SELECT 1 FROM p WHERE p.topic = l.topic AND CASE WHEN cnt = 0 THEN start > n ELSE start >= n OR start + cnt > n END) THEN 'range'
  WHEN EXISTS (SELECT 1 FROM p a JOIN p b ON a.topic = b.topic AND a.op <> b.op WHERE a.topic = l.topic AND a.cnt > 0 AND a.start <= b.start AND b.start < a.start + a.cnt) THEN 'overlap' END AS fault,
  l.w - coalesce(g.w, 0) + 2 * (SELECT count(*) FROM p WHERE p.topic = l.topic) AS total FROM l LEFT JOIN g ON g.topic = l.topic)
SELECT topic, CASE WHEN fault IS NOT NULL THEN fault WHEN total > 400 THEN 'words' END AS fault, CASE WHEN fault IS NULL AND total <= 400 THEN CAST(total AS BIGINT) END AS words FROM f"""
)
def splice_geometry(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    own = c.select(F.col("conv_id").alias("topic"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("idx"), "text")
    t = F.col("topic")
    op = lambda k, start, count: F.struct(F.lit(k).alias("op"), F.lit(start).cast("bigint").alias("start"), F.lit(count).cast("bigint").alias("count"), F.lit("new words").alias("text"))
    every = own.select("topic").distinct().select("topic", F.inline(F.array(op(1, 0, 1), op(2, t % 3, 0), op(3, 4, t % 4), op(4, t % 5 + 1, 1), op(5, 1, 0), op(6, t % 2, t % 7))))
    return S.splice_faults(own, every.where(F.col("op") <= t % 4 + 1).drop("op"), words=400)


@query(
    sql(
        "run",
        """, a AS (SELECT topic, lane, doc, (rank * lane) % 50 AS rank, CASE WHEN doc % 17 <> 0 THEN (doc * 31 % 97 + lane) / 10.0 END AS score FROM run CROSS JOIN (SELECT unnest([1, 2, 3]) AS lane) WHERE (doc + lane) % 2 = 0),
b AS (SELECT topic, doc, min(struct_pack(neg := -score, rank := rank, lane := lane)) AS best FROM a WHERE score IS NOT NULL GROUP BY ALL)
SELECT r.topic, r.doc, -best.neg AS score, best.lane AS lane, row_number() OVER (PARTITION BY r.topic ORDER BY best.neg NULLS LAST, best.rank, best.lane, r.doc) AS place, CASE WHEN best IS NULL THEN 'no scored passage' END AS fault
FROM run r LEFT JOIN b ON b.topic = r.topic AND b.doc = r.doc WHERE r.rank <= 40""",
    )
)
def supported_order(spark, sf_dir):
    own, d, lane = run(spark, sf_dir), F.col("doc"), F.col("lane")
    audit = own.withColumn("lane", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where((d + lane) % 2 == 0)
    audit = audit.select("topic", "lane", "doc", (F.col("rank") * lane % 50).alias("rank"), F.when(d % 17 != 0, (d * 31 % 97 + lane) / 10.0).alias("score"))
    return S.supported_order(own.where("rank <= 40").select("topic", "doc"), audit)


@query(
    """WITH c AS (SELECT event_id, (event_id % 100 - 3) / 10.0 AS elapsed, event_id % 50 - 1 AS done, user_id AS total, event_id % 7 AS finalize FROM events),
p AS (SELECT event_id, CASE WHEN elapsed > 0 AND done > 0 AND total >= done THEN elapsed * total / done + finalize END AS projected FROM c) SELECT event_id, round(projected, 6) AS projected, coalesce(projected <= 12.0, false) AS go_on FROM p"""
)
def runtime_projection(spark, sf_dir):
    i = F.col("event_id")
    c = table(spark, sf_dir, "events").select(i, ((i % 100 - 3) / 10.0).alias("elapsed"), (i % 50 - 1).alias("done"), F.col("user_id").alias("total"), (i % 7).alias("finalize"))
    return S.projected_seconds(c, 12.0).select("event_id", F.round("projected", 6).alias("projected"), "go_on")


@query("SELECT c_custkey AS k, c_custkey % 6 <> 0 AS whole FROM customer")
def torn_tail(spark, sf_dir):
    """Lines cut off by a break: what parses, and what does not, of all lines."""
    k = F.col("c_custkey").cast("string")
    lines = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lit('{"k": '), k, F.lit(', "v": "x"}'))).otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "v": "'))).alias("value"))
    good, torn = torn_lines(lines, "k long, v string")
    return good.select("k", F.lit(True).alias("whole")).unionByName(torn.select(F.regexp_extract("value", "([0-9]+)", 1).cast("long").alias("k"), F.lit(False).alias("whole")))
