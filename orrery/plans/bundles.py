"""Queries: evidence lists, plans, bundles, gates, caches, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import bundles as B
from orrery.operators import ranking as R
from orrery.plans.registry import query
from orrery.plans.relations import lanes, qrels, retrieved, run, sql, streams, table, windows


@query(
    """WITH r AS (SELECT source AS topic, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END AS text FROM documents),
e AS (SELECT topic, doc, rank, row_number() OVER (PARTITION BY topic ORDER BY rank, doc) - 1 AS citation FROM r WHERE trim(text) <> '') SELECT * FROM e WHERE citation < 20"""
)
def top_evidence(spark, sf_dir):
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.col("text")).alias("text"))
    return B.evidence_list(run(spark, sf_dir).join(text, "doc"), 20).select("topic", "doc", "rank", "citation")


@query(
    """WITH t AS (SELECT item_id AS topic, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS n, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
f AS (SELECT *, [w[1], w[2], CASE WHEN topic % 4 = 0 THEN upper(w[1]) ELSE w[3] END] AS f FROM t WHERE len(w) >= 3),
v AS (SELECT *, len(list_distinct(list_transform(f, lambda x: lower(x)))) = 3 AND len(list_filter(f, lambda x: x IN ('AND', 'OR', 'NOT'))) = 0 AS valid FROM f),
q AS (SELECT topic, 'original' AS lane, n AS query FROM v UNION ALL
  SELECT topic, 'facet:' || i, array_to_string(string_split(n, ' ')[1:3], ' ') || ' ' || f[i] FROM v CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) WHERE valid)
SELECT topic, lane, query, sha256(query) AS digest FROM q"""
)
def lane_projection(spark, sf_dir):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    third = F.when(F.col("item_id") % 4 == 0, F.upper(F.get(w, F.lit(0)))).otherwise(F.get(w, F.lit(2)))
    topics = table(spark, sf_dir, "benchmark").where(F.size(w) >= 3)
    return B.lanes_of_plan(topics.select(F.col("item_id").alias("topic"), F.col("text").alias("narrative"), F.array(F.get(w, F.lit(0)), F.get(w, F.lit(1)), third).alias("facets")))


@query(
    sql(
        "run",
        """, s AS (SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY rank) AS output_rank FROM run WHERE doc % 3 <> 0),
k AS (SELECT * FROM s WHERE output_rank <= 8)
SELECT r.topic, r.doc, r.rank, k.output_rank, k.output_rank IS NOT NULL AS included, CASE WHEN k.output_rank IS NOT NULL THEN NULL WHEN r.doc % 3 = 0 THEN 'ineligible' ELSE 'below_cut' END AS reason
FROM run r LEFT JOIN k USING (topic, doc)""",
    )
)
def ranked_selection(spark, sf_dir):
    own = run(spark, sf_dir).select("topic", "doc", "rank")
    chosen = R.top(own.where("doc % 3 <> 0").withColumnRenamed("rank", "old"), 8, "old")
    return B.ranked_selection(own, chosen, F.col("doc") % 3 != 0)


@query(
    """WITH h AS (SELECT o_custkey AS topic, count(*) AS hits, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 40 = 0) AS errors FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS topic, coalesce(hits, 0) AS hits, coalesce(errors, 0) AS errors FROM customer LEFT JOIN h ON h.topic = c_custkey)
SELECT topic, hits, errors, CASE WHEN errors > 0 THEN 'failed' WHEN hits = 0 THEN 'empty' WHEN hits < 5 THEN 'thin' ELSE 'ok' END AS health FROM a"""
)
def topic_health(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("topic")).agg(
        F.count(F.lit(1)).alias("hits"), F.sum(((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 40 == 0)).cast("bigint")).alias("errors")
    )
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("topic")).join(o, "topic", "left").na.fill(0, ["hits", "errors"])
    return B.topic_health(every, 5)


@query(
    sql(
        "lanes",
        """, d AS (SELECT topic, lane AS component, round(avg(CASE WHEN doc % 2 = 0 THEN score ELSE -score END), 6) / 100000 AS delta FROM lanes GROUP BY ALL),
w AS (SELECT topic, arg_min(component, struct_pack(a := delta, b := component)) AS component, min(delta) AS delta, sum(delta) AS total FROM d GROUP BY topic)
SELECT topic, component, round(delta, 9) AS delta, round(total, 9) AS total, CASE WHEN total >= 0 THEN 'none' WHEN delta <= -0.01 THEN 'major:' || component ELSE 'minor' END AS kind FROM w""",
    )
)
def regression_classes(spark, sf_dir):
    signed = F.when(F.col("doc") % 2 == 0, F.col("score")).otherwise(-F.col("score"))
    rows = lanes(spark, sf_dir).groupBy("topic", F.col("lane").alias("component")).agg((F.round(F.avg(signed), 6) / 100000).alias("delta"))
    return B.regressions(rows, 0.01).withColumns({c: F.round(c, 9) for c in ("delta", "total")})


@query(
    """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS task, max(l_returnflag) AS a, max(l_linestatus) AS b FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1),
j AS (SELECT l_orderkey * 10 + l_linenumber AS task, max(CASE WHEN l_partkey % 9 = 0 THEN 'X' ELSE l_returnflag END) AS a, max(l_linestatus) AS b FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1)
SELECT coalesce(e.task, j.task) AS task, CASE WHEN j.task IS NULL THEN 'missing' WHEN e.task IS NULL THEN 'unexpected' WHEN e.a IS NOT DISTINCT FROM j.a AND e.b IS NOT DISTINCT FROM j.b THEN 'equal' ELSE 'different' END AS state
FROM e FULL JOIN j ON e.task = j.task"""
)
def expected_judgments(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("task", F.col("l_orderkey") * 10 + F.col("l_linenumber"))  # noqa: E741
    e = l.where("l_orderkey % 7 <> 0").groupBy("task").agg(F.max("l_returnflag").alias("a"), F.max("l_linestatus").alias("b"))
    j = l.where("l_orderkey % 11 <> 0").groupBy("task").agg(F.max(F.when(F.col("l_partkey") % 9 == 0, "X").otherwise(F.col("l_returnflag"))).alias("a"), F.max("l_linestatus").alias("b"))
    return B.expected_judgments(e, j, ["a", "b"])


@query(sql("windows", " SELECT topic, doc, count(*) AS windows, max(score) AS best, 'v' || doc % 3 AS lineage FROM windows GROUP BY topic, doc"))
def window_lineage(spark, sf_dir):
    own = windows(spark, sf_dir).withColumn("lineage", F.concat(F.lit("v"), (F.col("doc") % 3).cast("string")))
    return B.single_lineage(own, ("topic", "doc"), "lineage")


@query(sql("retrieved", " SELECT topic, doc, string_agg(DISTINCT stream, ',' ORDER BY stream) AS lanes, count(*) AS sightings, min(rank) AS best_rank FROM retrieved GROUP BY topic, doc"))
def union_bundle(spark, sf_dir):
    own = retrieved(spark, sf_dir).select("topic", F.col("stream").alias("lane"), "doc", "rank", F.sha2(F.col("doc").cast("string"), 256).alias("digest"))
    return B.bundle(own).withColumn("lanes", F.array_join("lanes", ","))


SHAPE = """WITH a AS (SELECT source AS topic, CAST(max(n_chars) AS DOUBLE) AS longest, CAST(count(*) AS DOUBLE) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
b AS (SELECT source AS topic, CAST(max(n_chars) AS DOUBLE) AS longest, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY 1),
l AS (SELECT a.topic, 'longest' AS metric, a.longest AS x, b.longest AS y FROM a JOIN b USING (topic) UNION ALL SELECT a.topic, 'n', a.n, b.n FROM a JOIN b USING (topic)),
p AS (SELECT metric, count(*) FILTER (y < x) AS worse, count(*) FILTER (y = x) AS equal, count(*) FILTER (y > x) AS better FROM l GROUP BY metric)"""


@query(SHAPE + " SELECT *, sum(worse) OVER () = 0 AND sum(better) OVER () > 0 AS passes FROM p")
def structural_gates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("topic", F.col("source"))
    shape = lambda df: df.groupBy("topic").agg(F.max("n_chars").cast("double").alias("longest"), F.count(F.lit(1)).cast("double").alias("n"))
    return B.gates(shape(d.where("doc_id % 2 = 0")), shape(d), ("longest", "n"))


@query(
    """WITH c AS (SELECT l_suppkey % 10 AS topic, l_orderkey AS g, l_linenumber AS ordinal, 'Part ' || l_partkey % 60 AS detail, CAST(l_quantity AS BIGINT) % 3 AS importance, l_partkey % 5 AS specificity, l_extendedprice AS price FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY topic, lower(detail) ORDER BY g, ordinal, price) AS nth FROM c),
p AS (SELECT topic, detail, g, ordinal, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, specificity DESC, g, ordinal) AS place FROM (
  SELECT topic, g, ordinal, detail, importance, specificity FROM f WHERE nth = 1))
SELECT topic, detail, CAST(place AS BIGINT) AS place, 'a' || lpad(CAST(place AS VARCHAR), 3, '0') AS label FROM p WHERE place <= 12"""
)
def audit_cards(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(
        (F.col("l_suppkey") % 10).alias("topic"), F.col("l_orderkey").alias("group"), F.struct("l_linenumber", "l_extendedprice").alias("ordinal"),
        F.concat(F.lit("Part  "), (F.col("l_partkey") % 60).cast("string")).alias("detail"), (F.col("l_quantity").cast("bigint") % 3).alias("importance"), (F.col("l_partkey") % 5).alias("specificity"),
    )
    out = B.merged_cards(rows, 12)
    return out.select("topic", F.regexp_replace("detail", " +", " ").alias("detail"), F.col("place").cast("bigint").alias("place"), "label")


@query(
    """SELECT user_id, max(event_id) AS attempt, arg_max(event_type, event_id) AS status, count(*) AS attempts FROM events GROUP BY user_id"""
)
def latest_attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"))
    return B.latest_attempts(e, ("user_id",), "event_id")


@query(
    sql(
        "lanes",
        """, m AS (SELECT * FROM (VALUES ('R', 'f-r', 2), ('A', 'f-a', 1), ('N', 'f-n', 0)) t(lane, facet, place))
SELECT topic, doc, string_agg(facet, ',' ORDER BY place) AS facets FROM lanes JOIN m USING (lane) GROUP BY topic, doc""",
    )
)
def facet_ids(spark, sf_dir):
    docs = lanes(spark, sf_dir).groupBy("topic", "doc").agg(F.collect_set("lane").alias("lanes"))
    manifest = spark.sql("SELECT * FROM VALUES ('R', 'f-r', 2), ('A', 'f-a', 1), ('N', 'f-n', 0) AS t(lane, facet, place)")
    return B.facet_ids(docs, manifest).withColumn("facets", F.array_join("facets", ","))


@query(
    """WITH c AS (SELECT o_orderkey AS claim, unnest([0, 1, 2, 3]) AS place, (o_custkey * (unnest([0, 1, 2, 3]) + 1)) % 40 AS alias FROM orders),
e AS (SELECT p_partkey AS alias, p_partkey % 9 AS doc FROM part WHERE p_partkey BETWEEN 1 AND 37),
r AS (SELECT claim, place, doc FROM c LEFT JOIN e USING (alias))
SELECT claim, string_agg(coalesce(CAST(doc AS VARCHAR), '?'), ',' ORDER BY place) AS docs, count(DISTINCT doc) AS "distinct",
  CASE WHEN count(*) > count(doc) THEN 'UNKNOWN_ALIAS' WHEN count(DISTINCT doc) > 3 THEN 'TOO_MANY_DOCUMENTS' ELSE 'ACCEPTED' END AS code FROM r GROUP BY claim"""
)
def claim_aliases(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), F.array(*[(F.col("o_custkey") * (k + 1)) % 40 for k in range(4)]).alias("aliases"))
    evidence = table(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 37").select(F.col("p_partkey").alias("alias"), (F.col("p_partkey") % 9).alias("doc"))
    out = B.resolve_claims(claims, evidence)
    return out.select("claim", F.array_join(F.transform("docs", lambda d: d.cast("string")), ",", "?").alias("docs"), "distinct", "code")


@query(
    """WITH c AS (SELECT l_orderkey AS k, max(l_extendedprice) AS score FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1)
SELECT o_orderkey AS k, score, score IS NOT NULL AS hit FROM orders LEFT JOIN c ON k = o_orderkey"""
)
def cache_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("score"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(c, "k", "left").withColumn("hit", F.col("score").isNotNull())


@query("SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_orderkey % 4 <> 0)")
def cache_misses(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("k"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(c, "k", "left_anti")


@query(
    """WITH c AS (SELECT conv_id AS topic, turn, role, text FROM conversations), a AS (SELECT topic, min(turn) AS turn FROM c WHERE role = 'assistant' GROUP BY topic)
SELECT c.topic, c.turn, strlen(c.text) AS bytes FROM c JOIN a USING (topic) WHERE c.turn > a.turn AND c.role = 'user' AND c.topic IN (SELECT topic FROM c INTERSECT SELECT item_id FROM benchmark)"""
)
def answer_topics(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("topic"), "turn", "role", "text")
    first = c.where("role = 'assistant'").groupBy("topic").agg(F.min("turn").alias("first"))
    both = c.select("topic").intersect(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic")))
    own = c.join(first, "topic").where("turn > first AND role = 'user'").join(both, "topic", "left_semi")
    return own.select("topic", "turn", F.octet_length("text").cast("bigint").alias("bytes"))


@query(
    sql(
        "streams qrels",
        """, b AS (SELECT topic, doc, rank FROM streams WHERE stream = 'length' AND rank <= 30), c AS (SELECT topic, doc, rank FROM streams WHERE stream = 'early' AND rank <= 30),
s AS (SELECT 'baseline' AS arm, topic, doc FROM b UNION ALL SELECT 'candidate', topic, doc FROM c UNION ALL SELECT DISTINCT 'union', topic, doc FROM (SELECT topic, doc FROM b UNION SELECT topic, doc FROM c))
SELECT arm, count(*) AS pooled, count(*) FILTER (grade >= 2) AS captured FROM s LEFT JOIN qrels USING (topic, doc) GROUP BY arm""",
    )
)
def pooled_capture(spark, sf_dir):
    rows = streams(spark, sf_dir).where("rank <= 30")
    b, c = (rows.where(F.col("stream") == s).select("topic", "doc") for s in ("length", "early"))
    every = b.withColumn("arm", F.lit("baseline")).unionByName(c.withColumn("arm", F.lit("candidate"))).unionByName(b.union(c).distinct().withColumn("arm", F.lit("union")))
    own = every.join(qrels(spark, sf_dir), ["topic", "doc"], "left")
    return own.groupBy("arm").agg(F.count(F.lit(1)).alias("pooled"), F.sum(F.coalesce(F.col("grade") >= 2, F.lit(False)).cast("bigint")).alias("captured"))


@query(sql("windows", """ SELECT topic, doc, string_agg(chunk, ',' ORDER BY score DESC, "start", "end") AS chunks, count(*) AS n FROM windows GROUP BY topic, doc"""))
def grouped_passages(spark, sf_dir):
    w = F.struct((-F.col("score")).alias("neg"), "start", "end", "chunk")
    own = windows(spark, sf_dir).groupBy("topic", "doc").agg(F.array_sort(F.collect_list(w)).alias("w"))
    return own.select("topic", "doc", F.array_join(F.transform("w", lambda x: x["chunk"].cast("string")), ",").alias("chunks"), F.size("w").cast("bigint").alias("n"))


@query(
    sql(
        "windows",
        """, r AS (SELECT topic, doc, chunk, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc, chunk) AS rank FROM windows) SELECT topic, doc, chunk, score, rank FROM r WHERE rank <= 100""",
    )
)
def passage_order(spark, sf_dir):
    return R.top(windows(spark, sf_dir).select("topic", "doc", "chunk", "score"), 100, F.desc("score"), "doc", "chunk")


@query(
    sql(
        "retrieved",
        """, d AS (SELECT topic, doc, min(rank) AS rank, arg_min(score, struct_pack(a := rank, b := -score)) AS score FROM retrieved GROUP BY ALL),
r AS (SELECT topic, doc, rank AS source_rank, round(score, 4) AS score, row_number() OVER (PARTITION BY topic ORDER BY rank, score DESC, doc) AS place FROM d) SELECT * FROM r WHERE place <= 25""",
    )
)
def document_retention(spark, sf_dir):
    own = retrieved(spark, sf_dir).groupBy("topic", "doc").agg(F.min("rank").alias("source_rank"), F.min_by("score", F.struct(F.col("rank"), -F.col("score"))).alias("score"))
    return R.top(own, 25, "source_rank", F.desc("score"), "doc", name="place").withColumn("score", F.round("score", 4))


@query(
    sql(
        "lanes",
        """, m AS (SELECT topic % 2 AS model, lane AS instruction, topic, round(avg(score), 6) AS v FROM lanes GROUP BY ALL)
SELECT model, instruction, round(avg(v), 4) AS mean, round(min(v), 4) AS worst, arg_min(topic, struct_pack(a := v, b := topic)) AS worst_topic, count(*) AS topics FROM m GROUP BY ALL""",
    )
)
def prompt_probe(spark, sf_dir):
    own = lanes(spark, sf_dir).groupBy((F.col("topic") % 2).alias("model"), F.col("lane").alias("instruction"), "topic").agg(F.round(F.avg("score"), 6).alias("v"))
    return own.groupBy("model", "instruction").agg(
        F.round(F.avg("v"), 4).alias("mean"), F.round(F.min("v"), 4).alias("worst"), F.min_by("topic", F.struct("v", "topic")).alias("worst_topic"), F.count(F.lit(1)).alias("topics")
    )


@query(
    """SELECT event_type AS tool, user_id % 10 AS topic, count(*) AS calls, count(*) FILTER (value < 10) AS failures, round(sum(value), 4) AS spent FROM events GROUP BY ALL"""
)
def call_accounting(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool"), (F.col("user_id") % 10).alias("topic")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum((F.col("value") < 10).cast("bigint")).alias("failures"), F.round(F.sum("value"), 4).alias("spent")
    )


@query(
    sql(
        "run",
        """ SELECT count(DISTINCT topic) AS topics, count(*) AS hits, count(DISTINCT doc) AS documents, CAST(min(n) AS BIGINT) AS least, CAST(median(n) AS DOUBLE) AS median, CAST(max(n) AS BIGINT) AS most
FROM (SELECT topic, doc, count(*) OVER (PARTITION BY topic) AS n, row_number() OVER (PARTITION BY topic ORDER BY rank) AS r FROM run)""",
    )
)
def run_summary(spark, sf_dir):
    own = run(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("topic")))
    return own.agg(F.countDistinct("topic").alias("topics"), F.count(F.lit(1)).alias("hits"), F.countDistinct("doc").alias("documents"), F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))


@query(
    sql(
        "retrieved",
        """, w AS (SELECT topic, stream, round(avg(score), 4) AS v FROM retrieved GROUP BY ALL) PIVOT w ON stream IN ('F', 'O', 'P') USING first(v) GROUP BY topic""",
    )
)
def wide_comparison(spark, sf_dir):
    own = retrieved(spark, sf_dir).groupBy("topic", "stream").agg(F.round(F.avg("score"), 4).alias("v"))
    return own.groupBy("topic").pivot("stream", ["F", "O", "P"]).agg(F.first("v"))


@query("SELECT approx AS ok, n FROM (SELECT true AS approx, count(*) AS n FROM (SELECT l_suppkey % 10 AS t FROM lineitem GROUP BY 1))")
def approximate_distinct(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("t")).agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("n"))
    return own.agg(F.min(F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("ok"), F.count(F.lit(1)).alias("n"))
