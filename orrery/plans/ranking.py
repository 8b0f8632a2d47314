"""Queries: deduplication, fusion, rank statistics, orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import ranking as R
from orrery.plans.registry import query
from orrery.plans.relations import lanes, retrieved, run, sql, streams, table

BEST = """, best AS (
  SELECT topic, stream, doc, min(rank) AS rank FROM {} GROUP BY ALL)"""


@query(
    sql(
        "retrieved",
        """
SELECT topic, doc, min(rank) AS best_rank, round(arg_max(score, struct_pack(a := -rank, b := score)), 6) AS best_score, count(*) AS sightings,
  string_agg(stream || ':' || rank, ',' ORDER BY rank, score DESC, stream) AS provenance
FROM retrieved GROUP BY topic, doc""",
    )
)
def dedup_best_rank(spark, sf_dir):
    rows = R.best_per_document(retrieved(spark, sf_dir))
    seen = F.transform("provenance", lambda p: F.concat_ws(":", p["stream"], p["rank"].cast("string")))
    return rows.select("topic", "doc", "best_rank", F.round("best_score", 6).alias("best_score"), F.size("provenance").cast("bigint").alias("sightings"), F.array_join(seen, ",").alias("provenance"))


@query(
    sql(
        "retrieved",
        BEST.format("retrieved")
        + """, f AS (SELECT topic, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank FROM best GROUP BY ALL)
SELECT topic, doc, round(score, 9) AS score, best_rank,
  row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, best_rank, doc) AS rank FROM f""",
    )
)
def rrf_fuse(spark, sf_dir):
    return R.rrf(retrieved(spark, sf_dir)).withColumn("score", F.round("score", 9))


WEIGHTS = {"F": 1.0, "O": 0.5, "P": 2.0}


@query(
    sql(
        "retrieved",
        BEST.format("retrieved")
        + """, f AS (SELECT topic, doc, sum(CASE stream WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 2.0 END::DOUBLE / (20 + rank)) AS score, min(rank) AS best_rank FROM best GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, best_rank, doc) AS rank FROM f)
SELECT topic, doc, round(score, 9) AS score, best_rank, rank FROM r WHERE rank <= 100""",
    )
)
def rrf_weighted_topk(spark, sf_dir):
    return R.rrf(retrieved(spark, sf_dir), 20, WEIGHTS, 100).withColumn("score", F.round("score", 9))


@query(
    sql(
        "retrieved",
        """, f AS (SELECT topic, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM retrieved GROUP BY ALL)
SELECT topic, doc, round(score, 9) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, doc) AS rank FROM f""",
    )
)
def rrf_of_searches(spark, sf_dir):
    return R.rrf_of_searches(retrieved(spark, sf_dir)).withColumn("score", F.round("score", 9))


FAMILY = (
    BEST.format("retrieved")
    + """, n AS (SELECT topic, count(DISTINCT stream) AS facets FROM best WHERE stream <> 'O' GROUP BY topic),
f AS (SELECT topic, doc, sum(CASE WHEN stream <> 'O' THEN 0.5::DOUBLE / facets WHEN facets IS NULL THEN {} ELSE 0.5 END / (60 + rank)) AS score, min(rank) AS best_rank
  FROM best LEFT JOIN n USING (topic) GROUP BY topic, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, best_rank, doc) AS rank FROM f)
SELECT topic, doc, round(score, 9) AS score, best_rank, rank FROM r"""
)


@query(sql("retrieved", FAMILY.format("0.5") + " WHERE rank <= 100"))
def rrf_family_balanced(spark, sf_dir):
    return R.rrf_family(retrieved(spark, sf_dir), "O", limit=100).withColumn("score", F.round("score", 9))


@query(sql("retrieved", FAMILY.format("1.0")))
def rrf_family_full_union(spark, sf_dir):
    return R.rrf_family(retrieved(spark, sf_dir), "O", lone_original=1.0).withColumn("score", F.round("score", 9))


@query(
    sql(
        "lanes",
        """, t AS (SELECT *, count(*) OVER (PARTITION BY topic, lane) AS n,
    rank() OVER (PARTITION BY topic, lane ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY topic, lane, score) AS ties FROM lanes)
SELECT topic, lane, doc, round((n - (r + (ties - 1) / 2.0) + 1) / n, 9) AS percentile FROM t""",
    )
)
def percentile_best_one(spark, sf_dir):
    out = R.percentile_best_one(lanes(spark, sf_dir), "score", ("topic", "lane"))
    return out.select("topic", "lane", "doc", F.round("percentile", 9).alias("percentile"))


@query(
    sql(
        "lanes",
        """, t AS (SELECT *, count(*) OVER (PARTITION BY topic, lane) AS n,
    rank() OVER (PARTITION BY topic, lane ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY topic, lane, score) AS ties FROM lanes)
SELECT topic, lane, doc, round(CASE WHEN n = 1 THEN 1.0 ELSE (n - (r + (ties - 1) / 2.0)) / nullif(n - 1, 0) END, 9) AS percentile FROM t""",
    )
)
def percentile_average_rank(spark, sf_dir):
    out = R.percentile_average_rank(lanes(spark, sf_dir), "score", ("topic", "lane"))
    return out.select("topic", "lane", "doc", F.round("percentile", 9).alias("percentile"))


@query(
    sql(
        "lanes",
        """, t AS (SELECT *, count(*) OVER (PARTITION BY topic) AS n,
    rank() OVER (PARTITION BY topic ORDER BY score) - 1 AS below, count(*) OVER (PARTITION BY topic, score) AS ties FROM lanes)
SELECT topic, lane, doc, round(CASE WHEN n = 1 THEN 1.0 ELSE (below + (ties - 1) / 2.0) / nullif(n - 1, 0) END, 9) AS percentile FROM t""",
    )
)
def percentile_midrank(spark, sf_dir):
    out = R.percentile_midrank(lanes(spark, sf_dir), "score")
    return out.select("topic", "lane", "doc", F.round("percentile", 9).alias("percentile"))


@query(
    sql(
        "lanes",
        """
SELECT topic, lane, doc, CAST(rank() OVER (PARTITION BY topic, lane ORDER BY round(score / 10000)) + (count(*) OVER (PARTITION BY topic, lane, round(score / 10000)) - 1) / 2.0 AS DOUBLE) AS fractional FROM lanes""",
    )
)
def fractional_ranks(spark, sf_dir):
    rows = lanes(spark, sf_dir).withColumn("band", F.round(F.col("score") / 10000))
    return R.fractional_rank(rows, "band", ("topic", "lane"), "fractional").select("topic", "lane", "doc", "fractional")


@query(
    sql(
        "streams",
        """
SELECT topic, doc, min(rank) AS best_stream_rank, coalesce(min(CASE WHEN stream = 'early' THEN rank END), 1000000000) AS best_facet_rank,
  arg_min(stream, struct_pack(a := rank, b := stream)) AS best_stream FROM streams GROUP BY topic, doc""",
    )
)
def best_stream_ranks(spark, sf_dir):
    return streams(spark, sf_dir).groupBy("topic", "doc").agg(
        F.min("rank").alias("best_stream_rank"),
        F.coalesce(F.min(F.when(F.col("stream") == "early", F.col("rank"))), F.lit(10**9)).cast("bigint").alias("best_facet_rank"),
        F.min_by("stream", F.struct("rank", "stream")).alias("best_stream"),
    )


@query(
    """
SELECT DISTINCT source AS topic, dense_rank() OVER (ORDER BY regexp_replace(source, '[0-9]+$', ''),
  coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]*)$', 1), '') AS BIGINT), -1), source) AS place FROM documents"""
)
def natural_topic_order(spark, sf_dir):
    topics = table(spark, sf_dir, "documents").select(F.col("source").alias("topic")).distinct().withColumn("every", F.lit(1))
    return R.ranked(topics, *R.natural_key("topic"), by="every", name="place").drop("every")


@query(
    sql(
        "streams",
        """, p AS (SELECT topic, doc, rank FROM streams WHERE stream = 'length' AND rank <= 10),
b AS (SELECT topic, doc, rank, 0 AS part FROM p UNION ALL
  SELECT s.topic, s.doc, s.rank, 1 FROM streams s WHERE stream = 'early' AND NOT EXISTS (SELECT 1 FROM p WHERE p.topic = s.topic AND p.doc = s.doc))
SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY part, rank, doc) AS final_rank FROM b""",
    )
)
def prefix_splice(spark, sf_dir):
    rows = streams(spark, sf_dir)
    return R.splice(rows.where("stream = 'length' AND rank <= 10"), rows.where("stream = 'early'"))


@query(
    sql(
        "streams",
        """, e AS (SELECT topic, doc, bool_or(stream = 'length' AND rank <= 20 OR stream = 'early' AND rank BETWEEN 1 AND 15) AS eligible FROM streams
  WHERE stream = 'early' OR rank <= 20 GROUP BY ALL),
o AS (SELECT topic, doc, rank FROM streams WHERE stream = 'early')
SELECT topic, doc, rank, eligible, row_number() OVER (PARTITION BY topic ORDER BY
  CASE WHEN rank <= 5 THEN 0 WHEN eligible THEN 1 ELSE 2 END, rank, doc) AS final_rank
FROM o LEFT JOIN e USING (topic, doc)""",
    )
)
def facet_cap_replay(spark, sf_dir):
    rows = streams(spark, sf_dir)
    some = rows.where("stream = 'early' OR rank <= 20")
    eligible = R.eligible_for_cap(some, "length", 15)
    return R.cap_replay(rows.where("stream = 'early'").select("topic", "doc", "rank"), eligible, 5).drop("tier")


@query(
    sql(
        "run",
        """
SELECT topic, count(*) FILTER (rank BETWEEN 11 AND 30) AS returned, count(*) FILTER (rank > 30) AS "left",
  max(score) FILTER (rank > 30) AS left_best, min(score) FILTER (rank BETWEEN 11 AND 30) AS returned_least,
  CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM run GROUP BY topic""",
    )
)
def pagination(spark, sf_dir):
    return R.page(run(spark, sf_dir), 10, 20, F.desc("score"), "doc")


@query(
    sql(
        "run",
        """, c AS (SELECT topic, rank, score, row_number() OVER (PARTITION BY topic ORDER BY rank) AS place,
  lag(score) OVER (PARTITION BY topic ORDER BY rank) AS before FROM run)
SELECT topic, count(*) AS rows, count(*) FILTER (rank <> place) AS rank_faults, count(*) FILTER (before < score) AS score_faults FROM c GROUP BY topic""",
    )
)
def run_validation(spark, sf_dir):
    from orrery.sources.runs import faults

    return faults(run(spark, sf_dir))


@query(
    sql(
        "lanes",
        """, r AS (SELECT *, row_number() OVER (PARTITION BY topic, lane ORDER BY score DESC, doc) AS rank FROM lanes),
a AS (SELECT topic, lane, doc, rank, 20 AS cut FROM r UNION ALL SELECT topic, lane, doc, rank, 50 FROM r UNION ALL SELECT topic, lane, doc, rank, 100 FROM r)
SELECT topic, cut AS arm, lane, doc, rank FROM a WHERE lane = 'N' AND rank <= 200 OR lane <> 'N' AND rank <= cut""",
    )
)
def arm_construction(spark, sf_dir):
    rows = R.ranked(lanes(spark, sf_dir), F.desc("score"), "doc", by=("topic", "lane"))
    arms = rows.select("topic", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100))).alias("arm"), "lane", "doc", "rank")
    return arms.where(F.when(F.col("lane") == "N", F.col("rank") <= 200).otherwise(F.col("rank") <= F.col("arm"))).withColumn("arm", F.col("arm").cast("bigint"))


@query(
    sql(
        "lanes",
        """, w AS (SELECT topic, doc, max(score) FILTER (lane = 'N') AS a, max(score) FILTER (lane = 'R') AS b FROM lanes GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
u AS (UNPIVOT w ON a, b INTO NAME component VALUE value)
SELECT component, topic, doc, row_number() OVER (PARTITION BY component, topic ORDER BY value DESC, doc) AS rank FROM u""",
    )
)
def counterfactual_orders(spark, sf_dir):
    wide = lanes(spark, sf_dir).groupBy("topic", "doc").agg(
        F.max(F.when(F.col("lane") == "N", F.col("score"))).alias("a"), F.max(F.when(F.col("lane") == "R", F.col("score"))).alias("b")
    )
    long = wide.where("a IS NOT NULL AND b IS NOT NULL").unpivot(["topic", "doc"], ["a", "b"], "component", "value")
    return R.ranked(long, F.desc("value"), "doc", by=("component", "topic")).select("component", "topic", "doc", "rank")
