"""Queries: window planning, candidate extraction, evidence chains, fixed orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.text import tokens
from orrery.operators import planning as P
from orrery.operators import ranking as R
from orrery.operators.lexical import unit_hits
from orrery.plans.registry import query
from orrery.plans.relations import lanes, run, sql, streams, table, windows


@query(
    """WITH t AS (SELECT doc_id AS doc, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens FROM documents), n AS (SELECT *, CAST(greatest(1, ceil((tokens - 64) / 413.0)) AS BIGINT) AS n FROM t WHERE tokens > 0),
w AS (SELECT doc, tokens, n, unnest(range(0, least(n, 32))) AS j FROM n), p AS (SELECT doc, tokens, j AS "window", CASE WHEN n <= 32 THEN j ELSE (j * (n - 1) * 2 + 31) // 62 END AS pos FROM w)
SELECT doc, "window", pos * 413 AS start, least(pos * 413 + 477, tokens) AS "end" FROM p"""
)
def window_planning(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.size(tokens(F.col("text"))).cast("bigint").alias("tokens"))
    return P.token_windows(docs)


@query(
    sql(
        "windows",
        """, s AS (SELECT doc, chunk // 3 AS paragraph, "start", "start" + 400 AS "end", chunk % 4 <> 3 AS complete, chunk % 2 = 1 AS leans, score FROM windows),
a AS (SELECT *, lead("end") OVER w AS e2, lead(complete) OVER w AS c2, lead(leans) OVER w AS l2, lead(score) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY doc, paragraph ORDER BY "start")),
c AS (SELECT doc, "start", "end", 'sentence' AS kind, score FROM a WHERE complete UNION ALL SELECT doc, "start", e2, 'pair', least(score, s2) FROM a WHERE complete AND c2 AND l2 AND e2 - "start" <= 1500)
SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, "start", "end") AS rank FROM c""",
    )
)
def candidate_extraction(spark, sf_dir):
    c = F.col("chunk")
    rows = windows(spark, sf_dir).select(
        "doc", F.floor(c / 3).alias("paragraph"), "start", (F.col("start") + 400).alias("end"), (c % 4 != 3).alias("complete"), (c % 2 == 1).alias("leans"), "score"
    )
    return P.candidates(rows, 1500)


LINKS = """WITH n AS (SELECT l_orderkey % 50 AS need, l_orderkey * 10 + l_linenumber AS nugget, min(l_partkey) AS passage, CASE WHEN l_orderkey % 6 = 0 THEN 1 END AS superseded FROM lineitem GROUP BY ALL)"""


def _nuggets(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    own = l.groupBy((F.col("l_orderkey") % 50).alias("need"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nugget"), F.when(F.col("l_orderkey") % 6 == 0, 1).alias("superseded_by"))
    return own.agg(F.min("l_partkey").alias("passage"))


@query(
    LINKS
    + """, p AS (SELECT p_partkey AS passage, p_size AS doc FROM part WHERE p_partkey % 4 <> 0), d AS (SELECT DISTINCT p_size AS doc, sha256(CAST(p_size AS VARCHAR)) AS digest FROM part WHERE p_size % 2 = 0)
SELECT need, nugget, passage, doc, digest FROM n JOIN p USING (passage) JOIN d USING (doc) WHERE superseded IS NULL AND need < 30"""
)
def evidence_chain(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    passages = part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("passage"), F.col("p_size").alias("doc"))
    documents = part.where("p_size % 2 = 0").select(F.col("p_size").alias("doc"), F.sha2(F.col("p_size").cast("string"), 256).alias("digest")).distinct()
    needs = spark.range(30).withColumnRenamed("id", "need")
    return P.chain(needs, _nuggets(spark, sf_dir), passages, documents)


@query(LINKS + " SELECT nugget, need, passage FROM n WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey * 10 + 1 = n.nugget)")
def uncited_nuggets(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).alias("nugget"))
    return P.uncited(_nuggets(spark, sf_dir), cited).select("nugget", "need", "passage")


@query(
    """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS down, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS up, count(*) OVER () AS n FROM documents),
j AS (SELECT DISTINCT (j * (n - 1) * 2 + 63) // 126 AS spot FROM (SELECT unnest(range(0, 64)) AS j) CROSS JOIN (SELECT count(*) AS n FROM documents))
SELECT doc_id, n_chars, down <= 32 AS warm, up IN (SELECT spot FROM j) AS timed FROM r WHERE down <= 32 OR up IN (SELECT spot FROM j)"""
)
def benchmark_plan(spark, sf_dir):
    return P.longest_then_even(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32, 64)


@query("SELECT doc_id AS doc, CAST(n_chars AS DOUBLE) AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def keyset_page(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("score"))
    first, own = P.page_after(rows, None, 20, "documents by length")
    last = first.orderBy("score", F.desc("doc")).first()
    return P.page_after(rows, {"score": last["score"], "doc": last["doc"], "identity": own}, 20, "documents by length")[0]


@query(
    sql(
        "lanes",
        """, w AS (SELECT topic, doc, max(score) AS g, coalesce(max(score) FILTER (lane = 'N'), 0) AS n, min(score) AS r FROM lanes GROUP BY ALL)
SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY round(0.7 * g + 0.3 * n, 6) DESC, r DESC, doc) AS rank, row_number() OVER (PARTITION BY topic ORDER BY g DESC, doc) AS without_narrative FROM w""",
    )
)
def global_order(spark, sf_dir):
    n = F.coalesce(F.max(F.when(F.col("lane") == "N", F.col("score"))), F.lit(0.0))
    own = lanes(spark, sf_dir).groupBy("topic", "doc").agg(F.max("score").alias("g"), n.alias("n"), F.min("score").alias("r"))
    own = R.ranked(own, F.desc(F.round(0.7 * F.col("g") + 0.3 * F.col("n"), 6)), F.desc("r"), "doc")
    return R.ranked(own, F.desc("g"), "doc", name="without_narrative").select("topic", "doc", "rank", "without_narrative")


@query(sql("streams run", " SELECT topic, count(*) FILTER (s.doc IS NULL) AS missing, count(*) FILTER (r.doc IS NULL) AS extra, count(*) FILTER (s.doc IS NULL OR r.doc IS NULL) = 0 AS permutation FROM (SELECT topic, doc FROM run) r FULL JOIN (SELECT topic, doc FROM streams WHERE stream = 'early') s USING (topic, doc) GROUP BY topic"))
def permutation_check(spark, sf_dir):
    a = run(spark, sf_dir).select("topic", "doc", F.lit(1).alias("a"))
    b = streams(spark, sf_dir).where("stream = 'early'").select("topic", "doc", F.lit(1).alias("b"))
    count = lambda c: F.sum(c.cast("bigint"))
    own = a.join(b, ["topic", "doc"], "full").groupBy("topic").agg(count(F.col("b").isNull()).alias("missing"), count(F.col("a").isNull()).alias("extra"))
    return own.withColumn("permutation", (F.col("missing") == 0) & (F.col("extra") == 0))


@query(
    """SELECT item_id AS topic, d.doc_id AS doc, CAST(len(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]+'), lambda w: contains(lower(d.text), w))) AS BIGINT) AS hits
FROM benchmark b CROSS JOIN documents d"""
)
def unit_cross_product_all(spark, sf_dir):
    """Every document and every unit."""
    units = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), tokens(F.col("text")).alias("words"))
    return unit_hits(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), units)


@query(
    sql(
        "windows",
        """, t AS (SELECT topic, doc, sum(score) AS s, max(score) AS m FROM windows GROUP BY ALL) SELECT topic, doc, round(0.75 * s + 0.25 * m, 6) AS score FROM t""",
    )
)
def score_reconstruction(spark, sf_dir):
    own = windows(spark, sf_dir).groupBy("topic", "doc").agg(F.sum("score").alias("s"), F.max("score").alias("m"))
    part = lambda w, c: F.struct(F.lit(w).alias("weight"), F.col(c).alias("value"))
    rows = own.select("topic", "doc", (0.75 * F.col("s") + 0.25 * F.col("m")).alias("score"), F.array(part(0.75, "s"), part(0.25, "m")).alias("parts"))
    return P.reconstructed(rows).select("topic", "doc", F.round("score", 6).alias("score"))
