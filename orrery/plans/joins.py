"""Queries: joins with guards, differences, merges, digests, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import numbers as N
from orrery.operators import joins as J
from orrery.operators.evidence import exact_groups, pool, supports
from orrery.plans.registry import query
from orrery.plans.relations import lanes, qrels, retrieved, run, sql, streams, table, windows


@query(sql("run qrels", " SELECT r.topic, r.doc, r.rank, coalesce(q.grade, 0) AS grade, q.grade IS NOT NULL AS judged FROM run r LEFT JOIN qrels q USING (topic, doc)"))
def judged_run(spark, sf_dir):
    from orrery.operators.measures import judged

    return judged(run(spark, sf_dir), qrels(spark, sf_dir)).select("topic", "doc", "rank", "grade", "judged")


@query("SELECT l_orderkey AS doc, l_linenumber AS chunk, o_custkey AS customer, o_orderpriority AS topic FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def strict_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("topic"))
    return J.strict_lookup(rows, known, ["doc"], "a line has no order")


@query(
    sql(
        "windows",
        """, c AS (SELECT topic, doc, count(*) AS n, max(chunk) AS last, count(DISTINCT chunk) AS d FROM windows GROUP BY ALL) SELECT topic, doc, n, n = last + 1 AND d = n AS complete FROM c""",
    )
)
def window_completeness(spark, sf_dir):
    own = windows(spark, sf_dir).groupBy("topic", "doc").agg(F.count(F.lit(1)).alias("n"), F.max("chunk").alias("last"), F.countDistinct("chunk").alias("d"))
    return own.select("topic", "doc", "n", ((F.col("n") == F.col("last") + 1) & (F.col("d") == F.col("n"))).alias("complete"))


@query(sql("retrieved", " SELECT topic, doc, string_agg(stream || '@' || rank, ' ' ORDER BY stream, rank) AS provenance, count(DISTINCT stream) AS streams FROM retrieved GROUP BY topic, doc"))
def union_provenance(spark, sf_dir):
    out = J.union_provenance(retrieved(spark, sf_dir))
    text = F.array_join(F.transform("seen", lambda s: F.concat(s["stream"], F.lit("@"), s["rank"].cast("string"))), " ")
    return out.select("topic", "doc", text.alias("provenance"), "streams")


@query(
    sql(
        "lanes",
        """ SELECT topic, doc, arg_min(lane, struct_pack(a := CASE lane WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, b := lane)) AS first_lane, count(DISTINCT lane) AS lanes FROM lanes GROUP BY topic, doc""",
    )
)
def first_seen_lane(spark, sf_dir):
    order = F.when(F.col("lane") == "N", 0).when(F.col("lane") == "A", 1).otherwise(2)
    return J.first_seen_lane(lanes(spark, sf_dir), order)


@query(
    sql(
        "streams",
        """, a AS (SELECT topic, doc, rank FROM streams WHERE stream = 'length' AND rank <= 40), b AS (SELECT topic, doc, rank FROM streams WHERE stream = 'early' AND rank <= 30)
SELECT coalesce(a.topic, b.topic) AS topic, coalesce(a.doc, b.doc) AS doc, a.rank AS a_rank, b.rank AS b_rank FROM a FULL JOIN b ON a.topic = b.topic AND a.doc = b.doc WHERE a.rank IS DISTINCT FROM b.rank""",
    )
)
def rank_diff(spark, sf_dir):
    rows = streams(spark, sf_dir)
    return J.rank_diff(rows.where("stream = 'length' AND rank <= 40"), rows.where("stream = 'early' AND rank <= 30"))


@query(
    """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 10 <> 0),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nat FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN '<only right>' WHEN b.k IS NULL THEN '<only left>' WHEN a.seg IS DISTINCT FROM b.seg THEN 'seg' ELSE 'nat' END AS difference
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.seg IS DISTINCT FROM b.seg OR a.nat IS DISTINCT FROM b.nat"""
)
def artifact_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    b = c.where("c_custkey % 11 <> 0").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("nat")
    )
    return J.table_diff(a, b, ["k"])


MERGE = """WITH t AS (SELECT c_custkey AS k, round(c_acctbal, 2) AS old FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT c_custkey AS k, min(round(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2)) AS new FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1),
b AS (SELECT coalesce(t.k, s.k) AS k, old, new, coalesce(old <> new, false) AS conflict FROM t FULL JOIN s ON t.k = s.k)"""


def _merge(spark, sf_dir, strict):
    c = table(spark, sf_dir, "customer")
    target = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("score"))
    new = F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    source = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.round(new, 2).alias("score"))
    return J.merge(target, source.unionAll(source), ["k"], "score", strict)


@query(MERGE + " SELECT k, coalesce(old, new) AS score, CASE WHEN conflict THEN 'kept' WHEN old IS NULL THEN 'inserted' WHEN new IS NULL THEN 'untouched' ELSE 'equal' END AS action FROM b")
def score_merge(spark, sf_dir):
    return _merge(spark, sf_dir, False)[0]


@query(MERGE + " SELECT k, old, new FROM b WHERE conflict")
def score_merge_conflicts(spark, sf_dir):
    return _merge(spark, sf_dir, True)[1]


@query(
    """WITH a AS (SELECT doc_id AS a_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT doc_id AS b_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 2 = 1)
SELECT a_id, b_id FROM a JOIN b USING (text, nth)"""
)
def exact_text_matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return J.bag_intersection(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"), "text").drop("text")


@query(
    """WITH r AS (SELECT o_orderkey AS request FROM orders WHERE o_orderkey % 5 <> 0), o AS (SELECT o_orderkey AS request, o_orderstatus <> 'P' AS ok FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(r.request, o.request) AS request, CASE WHEN r.request IS NULL THEN 'orphan' WHEN ok IS NULL THEN 'pending' WHEN ok THEN 'success' ELSE 'failure' END AS state FROM r FULL JOIN o ON r.request = o.request"""
)
def reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reserved = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("request"))
    return J.reconcile(reserved, o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("request"), (F.col("o_orderstatus") != "P").alias("ok")), ["request"])


@query(
    sql(
        "streams",
        """, e AS (SELECT topic, doc, rank AS "at", 0 AS tier FROM streams WHERE stream = 'length' AND rank <= 15 UNION ALL SELECT topic, doc, rank, 1 FROM streams WHERE stream = 'early'),
b AS (SELECT topic, doc, min(struct_pack(t := tier, a := "at")) AS b FROM e GROUP BY topic, doc)
SELECT topic, doc, CAST(b.t AS BIGINT) AS tier, b.a AS "at", row_number() OVER (PARTITION BY topic ORDER BY b.t, b.a, doc) AS final_rank FROM b""",
    )
)
def tiered_placement(spark, sf_dir):
    rows = streams(spark, sf_dir)
    return J.tiered(rows.where("stream = 'length' AND rank <= 15"), rows.where("stream = 'early'")).withColumn("tier", F.col("tier").cast("bigint"))


@query(
    """WITH g AS (SELECT source AS topic, lang AS kind, text, list(doc_id ORDER BY n_chars DESC, doc_id) AS m, max(n_chars) AS score FROM documents GROUP BY ALL)
SELECT topic, m[1] AS id, kind, len(m) AS members, array_to_string(m, ',') AS ids, row_number() OVER (PARTITION BY topic ORDER BY score DESC, m[1]) AS rank,
  round(1.0::DOUBLE / row_number() OVER (PARTITION BY topic ORDER BY score DESC, m[1]), 6) AS relevance FROM g"""
)
def exact_group_collapse(spark, sf_dir):
    out = exact_groups(_items(spark, sf_dir))
    return out.select("topic", "id", "kind", F.size("members").cast("bigint").alias("members"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("ids"), "rank", F.round("relevance", 6).alias("relevance"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), F.col("lang").alias("kind"), "text", F.col("n_chars").cast("double").alias("score"))


@query(
    """WITH g AS (SELECT source AS topic, lang AS kind, text, max(n_chars) AS best, arg_min(doc_id, struct_pack(a := -n_chars, b := doc_id)) AS first FROM documents GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY best DESC, first) AS place FROM g)
SELECT d.source AS topic, d.doc_id AS id, p.place FROM documents d JOIN p ON p.topic = d.source AND p.kind = d.lang AND p.text = d.text WHERE place <= 5"""
)
def precluster_pool(spark, sf_dir):
    return pool(_items(spark, sf_dir), 5).select("topic", "id", F.col("place").cast("bigint").alias("place"))


@query(
    sql(
        "retrieved",
        """, f AS (SELECT topic, stream, doc, min(struct_pack(a := -score, b := hit)) AS s FROM retrieved GROUP BY ALL),
r AS (SELECT topic, stream, doc, s.b AS id, row_number() OVER (PARTITION BY topic, stream ORDER BY s) AS place FROM f) SELECT * FROM r WHERE place <= 3""",
    )
)
def distinct_document_supports(spark, sf_dir):
    return supports(retrieved(spark, sf_dir).withColumnRenamed("hit", "id"), ("topic", "stream"), 3)


@query(
    """WITH r AS (SELECT sha256(concat_ws(chr(31), 'n_name=' || n_name, 'n_nationkey=' || n_nationkey, 'n_regionkey=' || n_regionkey)) AS d FROM nation),
c AS (SELECT d, count(*) AS n FROM r GROUP BY d), p AS (SELECT substring(d, 1, 2) AS part, sha256(string_agg(d || '*' || n, ',' ORDER BY d, n)) AS p, sum(n) AS n FROM c GROUP BY 1)
SELECT sha256(string_agg(p, ',' ORDER BY part)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM p"""
)
def table_digest(spark, sf_dir):
    return N.table_digest(table(spark, sf_dir, "nation"))


@query(
    """WITH a AS (SELECT DISTINCT source AS topic, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source AS topic, lang FROM documents WHERE doc_id % 3 = 0)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT ALL SELECT lang FROM documents WHERE doc_id % 3 = 0)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang FROM documents WHERE doc_id % 3 = 0)"""
)
def set_operations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), "lang", "doc_id")
    even, third = d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0")
    a, b = even.select("topic", "lang").distinct(), third.select("topic", "lang").distinct()
    ops = {
        "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b),
        "intersect_all": even.select("lang").intersectAll(third.select("lang")), "except_all": even.select("lang").exceptAll(third.select("lang")),
    }
    out = None
    for name, df in ops.items():
        row = df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.union(row)
    return out


@query(
    sql(
        "retrieved",
        """, o AS (SELECT topic, doc, min(rank) AS "at" FROM retrieved GROUP BY ALL) SELECT topic, doc, "at", row_number() OVER (PARTITION BY topic ORDER BY "at", doc) AS place FROM o""",
    )
)
def ordered_distinct(spark, sf_dir):
    from orrery.operators.ranking import ranked

    return ranked(retrieved(spark, sf_dir).groupBy("topic", "doc").agg(F.min("rank").alias("at")), "at", "doc", name="place")


@query(
    sql(
        "lanes",
        """, b AS (SELECT topic, lane, CASE WHEN r <= 50 THEN '001-050' WHEN r <= 100 THEN '051-100' WHEN r <= 150 THEN '101-150' WHEN r <= 200 THEN '151-200' END AS bucket, doc
  FROM (SELECT *, row_number() OVER (PARTITION BY topic, lane ORDER BY score DESC, doc) AS r FROM lanes)) SELECT topic, bucket, count(DISTINCT doc) AS documents, count(*) AS hits FROM b WHERE bucket IS NOT NULL GROUP BY ALL""",
    )
)
def rank_bucket_yield(spark, sf_dir):
    from orrery.operators.ranking import ranked

    r = F.col("rank")
    bucket = F.when(r <= 50, "001-050").when(r <= 100, "051-100").when(r <= 150, "101-150").when(r <= 200, "151-200")
    rows = ranked(lanes(spark, sf_dir), F.desc("score"), "doc", by=("topic", "lane")).withColumn("bucket", bucket).where("bucket IS NOT NULL")
    return rows.groupBy("topic", "bucket").agg(F.countDistinct("doc").alias("documents"), F.count(F.lit(1)).alias("hits"))


@query(
    """SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderstatus) AS g0, grouping(o_orderpriority) AS g1
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def cube_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o = o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return o.cube("status", "priority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("status").cast("bigint").alias("g0"), F.grouping("priority").cast("bigint").alias("g1")
    )


@query(
    """WITH d AS (SELECT l_suppkey % 10 AS topic, l_returnflag AS lane, l_partkey AS doc, l_extendedprice AS score FROM lineitem)
SELECT topic, lane, count(*) AS hits, count(DISTINCT doc) AS documents, max(score) AS best FROM d GROUP BY ROLLUP (topic, lane)"""
)
def funnel_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("topic"), F.col("l_returnflag").alias("lane"), F.col("l_partkey").alias("doc"), F.col("l_extendedprice").alias("score"))
    return rows.rollup("topic", "lane").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc").alias("documents"), F.max("score").alias("best"))


@query("SELECT lang, count(*) AS n, CAST(median(n_chars) AS DOUBLE) AS median_length, round(avg(CASE WHEN n_chars < 500 THEN 1.0 ELSE 0.0 END), 6) AS short_share, round(avg(CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 1.0 ELSE 0.0 END), 6) AS fragment_share FROM documents GROUP BY lang")
def text_shape(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median_length"), share(F.col("n_chars") < 500).alias("short_share"), share(~F.col("text").rlike("[.!?]$")).alias("fragment_share")
    )
