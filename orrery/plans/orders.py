"""Queries: further orders and gains, matrices, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import numbers as N
from orrery.functions import text as X
from orrery.operators import orders as O
from orrery.operators import stats as S
from orrery.operators.ranking import ranked
from orrery.plans.registry import query
from orrery.plans.relations import lanes, qrels, run, sql, streams, table, windows

ROUND6 = lambda df, *c: df.withColumns({x: F.round(x, 6) for x in c})

DOCS = """, d AS (SELECT topic, doc, max(score) AS narrative, round(0.7 * max(score) + 0.3 * min(score), 6) AS combo, doc % 90 AS best_rank, count(DISTINCT lane) AS facets, doc % 4 AS passages FROM lanes GROUP BY topic, doc)"""


@query(
    sql(
        "lanes",
        DOCS
        + """ SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY narrative DESC, best_rank, doc) AS narrative_rank, row_number() OVER (PARTITION BY topic ORDER BY combo DESC, best_rank, doc) AS combo_rank,
  row_number() OVER (PARTITION BY topic ORDER BY facets DESC, passages DESC, combo DESC, best_rank, doc) AS breadth_rank FROM d""",
    )
)
def three_orders(spark, sf_dir):
    own = lanes(spark, sf_dir).groupBy("topic", "doc").agg(
        F.max("score").alias("narrative"), F.round(0.7 * F.max("score") + 0.3 * F.min("score"), 6).alias("combo"), F.countDistinct("lane").alias("facets")
    )
    own = own.withColumn("best_rank", F.col("doc") % 90).withColumn("passages", F.col("doc") % 4)
    return O.three_orders(own).select("topic", "doc", "narrative_rank", "combo_rank", "breadth_rank")


@query(
    sql(
        "streams",
        """, s AS (SELECT topic, doc, rank FROM streams WHERE stream = 'early'), c AS (SELECT doc_id AS doc, source AS topic, max(n_chars % 1000) AS score FROM documents WHERE NOT (source = 'src1' AND doc_id % 9 = 0) GROUP BY ALL),
b AS (SELECT s.*, c.score, count(*) FILTER (c.score IS NULL) OVER (PARTITION BY s.topic) AS missing FROM s LEFT JOIN c ON c.doc = s.doc AND c.topic = s.topic)
SELECT topic, doc, rank, missing, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN missing = 0 THEN -score END NULLS LAST, rank, doc) AS new_rank FROM b""",
    )
)
def stream_rerank(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").where("NOT (source = 'src1' AND doc_id % 9 = 0)").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), (F.col("n_chars") % 1000).alias("score"))
    return O.reranked_stream(streams(spark, sf_dir).where("stream = 'early'").select("topic", "doc", "rank"), scores)


@query(
    sql(
        "run",
        """, o AS (SELECT topic, doc, rank, round(1.0 / rank + (doc % 7) / 10.0, 9) AS objective, (doc % 10) / 10.0 AS part FROM run)
SELECT topic, doc, rank, row_number() OVER (PARTITION BY topic ORDER BY rank <= 10 DESC, CASE WHEN rank <= 10 THEN 0 ELSE -round(objective - 0.15 * part, 9) END, rank) AS new_rank FROM o""",
    )
)
def without_narrative(spark, sf_dir):
    own = run(spark, sf_dir).select("topic", "doc", "rank", F.round(1.0 / F.col("rank") + (F.col("doc") % 7) / 10.0, 9).alias("objective"), ((F.col("doc") % 10) / 10.0).alias("part"))
    return O.without_part(own, protected=10)


@query(sql("run", " SELECT topic, doc, rank FROM run WHERE rank <= 25"))
def depth_binding(spark, sf_dir):
    return O.bound_depth(run(spark, sf_dir).where("rank <= 25"), 25, 25).select("topic", "doc", "rank")


@query(
    sql(
        "qrels",
        """, u AS (SELECT topic, doc, (doc % 9 - 2) / 2.0 AS useful FROM qrels), r AS (SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY useful DESC, doc) AS rank FROM u WHERE useful > 0)
SELECT topic, doc, rank, count(*) OVER (PARTITION BY topic) - rank + 1 AS score FROM r WHERE rank <= 5""",
    )
)
def submission_cap(spark, sf_dir):
    return O.submitted(qrels(spark, sf_dir).select("topic", "doc", ((F.col("doc") % 9 - 2) / 2.0).alias("useful")), 5)


@query(
    sql(
        "streams qrels",
        """, k AS (SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY min(rank), doc) AS rank, max(CAST(stream = 'length' AND rank <= 25 AS INT)) = 0 AS facet_only FROM streams WHERE rank <= 40 GROUP BY topic, doc),
j AS (SELECT k.*, grade, coalesce(grade >= 2, false) AS rel FROM k LEFT JOIN qrels USING (topic, doc)), w AS (SELECT topic, count(*) AS known, sum(pow(2, grade) - 1) AS kg FROM qrels WHERE grade >= 2 GROUP BY topic),
p AS (SELECT j.topic, d.depth, count(*) FILTER (i) AS prefix, count(*) FILTER (i AND rel) AS found, coalesce(sum(pow(2, grade) - 1) FILTER (i AND rel), 0) AS gain, count(*) FILTER (i AND rel AND facet_only) AS kept, count(*) FILTER (rel AND facet_only) AS facet_only
  FROM j CROSS JOIN (SELECT unnest([10, 30, 0]) AS depth) d, LATERAL (SELECT d.depth = 0 OR j.rank <= d.depth AS i) GROUP BY ALL)
SELECT p.topic, depth, prefix, found, CAST(gain AS DOUBLE) AS gain, kept, facet_only, round(coalesce(found / nullif(prefix, 0), 0), 6) AS precision, round(coalesce(found / known, 0), 6) AS recall, round(coalesce(gain / kg, 0), 6) AS graded_recall,
  round(coalesce(kept / nullif(facet_only, 0), 0), 6) AS retention FROM p LEFT JOIN w ON w.topic = p.topic""",
    )
)
def facet_retention(spark, sf_dir):
    rows = streams(spark, sf_dir).where("rank <= 40")
    best = ranked(rows.groupBy("topic", "doc").agg(F.min("rank").alias("best")), "best", "doc")
    seen = rows.select("topic", "doc", F.when((F.col("stream") == "length") & (F.col("rank") <= 25), "original").otherwise("facet").alias("stream"))
    return ROUND6(O.retention(best, qrels(spark, sf_dir), seen, (10, 30)), "precision", "recall", "graded_recall", "retention")


@query(
    sql(
        "lanes",
        """, v AS (SELECT topic, round(avg(score) FILTER (lane = 'A'), 6) AS a, round(avg(score) FILTER (lane = 'R'), 6) AS b FROM lanes GROUP BY topic), d AS (SELECT topic, a / 100000 AS a, b / 100000 AS b, b / 100000 - a / 100000 AS delta FROM v)
SELECT count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses, count(*) FILTER (delta <= -0.05) AS big_losses, round(avg(delta), 9) AS mean_delta,
  round(avg(delta) / avg(a), 9) AS lift, arg_min(topic, struct_pack(x := round(delta, 9), y := topic)) AS worst FROM d""",
    )
)
def comparison_summary(spark, sf_dir):
    own = lanes(spark, sf_dir)
    side = lambda lane: own.where(F.col("lane") == lane).groupBy("topic").agg((F.round(F.avg("score"), 6) / 100000).alias("value"))
    return S.summary(S.compare(side("A"), side("R"))).withColumns({c: F.round(c, 9) for c in ("mean_delta", "lift")})


@query(
    """WITH c AS (SELECT l_orderkey % 12 AS i, l_partkey % 12 AS j, round(max(l_discount) * 10 - 0.3, 6) AS v FROM lineitem WHERE l_orderkey % 12 <= l_partkey % 12 AND (l_orderkey % 12 + l_partkey % 12) % 11 <> 0 GROUP BY ALL),
f AS (SELECT i, j, v FROM c UNION ALL SELECT j, i, CASE WHEN (i + j) % 5 = 0 THEN v + 1e-9 ELSE v END FROM c WHERE i < j UNION ALL SELECT 3, 4, 0.5 UNION ALL SELECT 12, 0, 0.5),
o AS (SELECT i, j, count(*) AS n, max(v) AS v FROM f GROUP BY ALL), g AS (SELECT a.i, b.j FROM (SELECT unnest(range(12)) AS i) a CROSS JOIN (SELECT unnest(range(12)) AS j) b UNION SELECT i, j FROM o)
SELECT g.i, g.j, CASE WHEN g.i >= 12 OR g.j >= 12 THEN 'outside' WHEN o.n IS NULL THEN 'missing' WHEN o.n > 1 THEN 'twice' WHEN abs(o.v) > 1 THEN 'range' ELSE 'symmetry' END AS fault
FROM g LEFT JOIN o ON o.i = g.i AND o.j = g.j LEFT JOIN o m ON m.i = g.j AND m.j = g.i WHERE g.i >= 12 OR g.j >= 12 OR o.n IS NULL OR o.n > 1 OR abs(o.v) > 1 OR abs(o.v - m.v) > 1e-12"""
)
def cosine_matrix(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 12).alias("i"), (F.col("l_partkey") % 12).alias("j"), "l_discount")  # noqa: E741
    c = l.where("i <= j AND (i + j) % 11 <> 0").groupBy("i", "j").agg(F.round(F.max("l_discount") * 10 - 0.3, 6).alias("value"))
    off = F.when((F.col("i") + F.col("j")) % 5 == 0, F.col("value") + 1e-9).otherwise(F.col("value"))
    cells = c.unionByName(c.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), off.alias("value")))
    more = spark.sql("SELECT * FROM VALUES (3L, 4L, 0.5D), (12L, 0L, 0.5D) AS t(i, j, value)")
    return O.cosine_faults(cells.unionByName(more), 12)


@query(
    """WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*') AS n FROM documents)
SELECT doc_id AS doc, sha256(array_to_string(n, ' ')) AS numbers, len(n) AS count,
  len(regexp_extract_all(text, '[.!?][''")\\]]*\\s+[A-Z0-9''"(]')) AS ends FROM x"""
)
def numbers_and_ends(spark, sf_dir):
    n = X.numbers(F.col("text"))
    ends = F.size(F.regexp_extract_all("text", F.lit(r"""[.!?]['")\]]*\s+[A-Z0-9'"(]"""), F.lit(0))).cast("bigint")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.sha2(F.array_join(n, " "), 256).alias("numbers"), F.size(n).cast("bigint").alias("count"), ends.alias("ends"))


@query(
    """WITH t AS (SELECT event_id, ts, epoch(ts) AS e FROM events), s AS (SELECT event_id, e, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
  WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN 'soon' ELSE '2024-13-40T00:00:00' END AS iso,
  CASE event_id % 5 WHEN 0 THEN CAST(event_id % 400 AS VARCHAR) WHEN 1 THEN ' 2.5 ' WHEN 2 THEN 'Mon, ' || strftime(ts + INTERVAL 90 SECOND, '%d %b %Y %H:%M:%S') || ' GMT' WHEN 3 THEN 'Mon, ' || strftime(ts - INTERVAL 90 SECOND, '%d %b %Y %H:%M:%S') || ' GMT' ELSE 'later' END AS header FROM t)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN floor(e) WHEN 1 THEN floor(e) WHEN 2 THEN floor(e) - 7200 WHEN 3 THEN floor(e / 86400) * 86400 END AS at,
  CASE event_id % 5 WHEN 0 THEN least(300.0, CAST(event_id % 400 AS DOUBLE)) WHEN 1 THEN 2.5 WHEN 2 THEN 90.0 WHEN 3 THEN 0.0 END AS wait FROM s"""
)
def times_and_waits(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    shown = lambda f, t=F.col("ts"): F.date_format(t, f)
    http = lambda s: F.concat(F.lit("Mon, "), shown("dd MMM yyyy HH:mm:ss", F.timestamp_seconds(F.unix_timestamp("ts") + s)), F.lit(" GMT"))
    iso = (
        F.when(i % 6 == 0, shown("yyyy-MM-dd'T'HH:mm:ss")).when(i % 6 == 1, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit("Z"))).when(i % 6 == 2, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(i % 6 == 3, shown("yyyy-MM-dd")).when(i % 6 == 4, "soon").otherwise("2024-13-40T00:00:00")
    )
    header = F.when(i % 5 == 0, (i % 400).cast("string")).when(i % 5 == 1, " 2.5 ").when(i % 5 == 2, http(90)).when(i % 5 == 3, http(-90)).otherwise("later")
    wait = N.retry_after(F.col("header"), F.unix_timestamp("ts"))
    known = F.col("header").rlike("^(Mon|[ 0-9])")
    return e.withColumn("iso", iso).withColumn("header", header).select("event_id", N.iso_seconds(F.col("iso")).alias("at"), F.when(known, wait).alias("wait"))


@query(
    """WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN '{"a": 1, "b": "x' WHEN 1 THEN '{"a": 1, "b": "x", "a": 2}' WHEN 2 THEN '{"a": NaN, "b": "x"}' WHEN 3 THEN '{"a": 1, "b": "x", "c": 0}' WHEN 4 THEN '{"b": "x"}'
  WHEN 5 THEN '{"a": 5, "b": "NaN: \\"a\\": 1"}' ELSE '{"b": "y", "a": ' || c_custkey || '}' END AS j FROM customer)
SELECT k, CASE k % 8 WHEN 0 THEN 'torn' WHEN 1 THEN 'name twice' WHEN 2 THEN 'number' WHEN 3 THEN 'unknown field' WHEN 4 THEN 'missing field' END AS fault, CASE WHEN k % 8 = 5 THEN 5 WHEN k % 8 > 5 THEN k END AS a,
  CASE WHEN k % 8 = 5 THEN '{"a":5,"b":"NaN: \\"a\\": 1"}' WHEN k % 8 > 5 THEN '{"a":' || k || ',"b":"y"}' END AS canonical FROM c"""
)
def strict_json(spark, sf_dir):
    k = F.col("c_custkey")
    cases = ['{"a": 1, "b": "x', '{"a": 1, "b": "x", "a": 2}', '{"a": NaN, "b": "x"}', '{"a": 1, "b": "x", "c": 0}', '{"b": "x"}', '{"a": 5, "b": "NaN: \\"a\\": 1"}']
    text = F.concat(F.lit('{"b": "y", "a": '), k.cast("string"), F.lit("}"))
    for at, case in enumerate(cases):
        text = F.when(k % 8 == at, case).otherwise(text)
    value, fault = N.strict_json(F.col("j"), "a bigint, b string")
    own = table(spark, sf_dir, "customer").select(k.alias("k"), text.alias("j")).withColumn("v", value).withColumn("fault", fault)
    canonical = N.canonical_json(("b", F.col("v.b")), ("a", F.col("v.a")))
    return own.select("k", "fault", F.col("v.a").alias("a"), F.when(F.col("v").isNotNull(), canonical).alias("canonical"))


@query(
    sql(
        "windows",
        """ SELECT doc, chunk, 'passage_' || left(sha256('7:passage,' || length(CAST(doc AS VARCHAR)) || ':' || doc || ',' || length(CAST("start" AS VARCHAR)) || ':' || "start" || ',' || length(CAST("end" AS VARCHAR)) || ':' || "end"), 24) AS id,
  CAST(CAST(score AS FLOAT) AS DOUBLE) AS single, NOT isnan(score) AND NOT isinf(score) AS finite, nextafter(nextafter(score, '-infinity'::DOUBLE), '-infinity'::DOUBLE) AS below FROM windows""",
    )
)
def span_identities(spark, sf_dir):
    s = F.col("score")
    return windows(spark, sf_dir).select(
        "doc", "chunk", N.span_id("passage", F.col("doc"), F.col("start"), F.col("end")).alias("id"), N.single(s).alias("single"), N.finite(s).alias("finite"), N.next_below(s, F.lit(2)).alias("below")
    )


@query(
    """SELECT p_partkey AS k, array_to_string(list_transform(list_sort(map_entries(map_concat(map {'a': 'base', 'b': 'base', 'c' || p_partkey % 2: 'base'}, map {'b': 'new', 'c1': 'k' || p_partkey}))), lambda e: e.key || '=' || e.value), ',') AS merged,
  CAST(round(CAST(p_partkey AS DECIMAL(18, 3)) / 8, 2) AS DECIMAL(18, 2))::DOUBLE AS shown FROM part"""
)
def merged_metadata(spark, sf_dir):
    k = F.col("p_partkey")
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("base"), F.concat(F.lit("c"), (k % 2).cast("string")), F.lit("base"))
    out = N.merged_map(base, F.create_map(F.lit("b"), F.lit("new"), F.lit("c1"), F.concat(F.lit("k"), k.cast("string"))))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(out)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "part").select(k.alias("k"), text.alias("merged"), N.half_up(k.cast("decimal(18,3)") / 8, 2).cast("double").alias("shown"))
