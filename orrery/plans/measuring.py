"""Queries: effectiveness measures, comparisons, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import measures as M
from orrery.operators import ranking as R
from orrery.operators import stats as X
from orrery.plans.registry import query
from orrery.plans.relations import qrels, run, sql, streams

RUN_QRELS = "run qrels"
GOT = """, j AS (SELECT r.topic, r.doc, r.rank, coalesce(q.grade, 0) AS grade, q.grade IS NOT NULL AS judged
  FROM run r LEFT JOIN qrels q USING (topic, doc)),
i AS (SELECT topic, grade, row_number() OVER (PARTITION BY topic ORDER BY grade DESC, doc) AS place FROM qrels),
t AS (SELECT topic, count(*) FILTER (grade >= 2) AS all_relevant, sum(greatest(grade, 0)) AS all_graded FROM qrels GROUP BY topic)"""


def ndcg_sql(k: int, gain: str = "(pow(2, grade) - 1)") -> str:
    return f""", ideal AS (SELECT topic, sum({gain} / log2(place + 1)) AS ideal FROM i WHERE place <= {k} GROUP BY topic),
d AS (SELECT topic, sum({gain} / log2(rank + 1)) AS dcg FROM j WHERE rank <= {k} GROUP BY topic)
SELECT topic, round(coalesce(dcg, 0), 6) AS dcg, round(ideal, 6) AS ideal,
  round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM ideal LEFT JOIN d USING (topic)"""


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(
    sql(
        "streams qrels",
        """, f AS (SELECT topic, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best FROM streams GROUP BY ALL),
run AS (SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY round(score, 12) DESC, best, doc) AS rank FROM f)"""
        + GOT
        + ndcg_sql(10),
    )
)
def fused_ndcg_at_10(spark, sf_dir):
    fused = R.rrf(streams(spark, sf_dir), limit=10)
    return rounded(M.ndcg(fused, qrels(spark, sf_dir), 10), "dcg", "ideal", "ndcg")


@query(sql(RUN_QRELS, GOT + ndcg_sql(10)))
def ndcg_at_10(spark, sf_dir):
    return rounded(M.ndcg(run(spark, sf_dir), qrels(spark, sf_dir), 10), "dcg", "ideal", "ndcg")


@query(sql(RUN_QRELS, GOT + ndcg_sql(50, "(CASE WHEN grade >= 2 THEN pow(2, grade) - 1 ELSE 0 END)")))
def ndcg_thresholded_at_50(spark, sf_dir):
    return rounded(M.ndcg(run(spark, sf_dir), qrels(spark, sf_dir), 50, M.thresholded_gain), "dcg", "ideal", "ndcg")


DEPTHS = (5, 10, 50, 100)


@query(
    sql(
        RUN_QRELS,
        GOT
        + """, k AS (SELECT unnest([5, 10, 50, 100]) AS k),
g AS (SELECT topic, k, count(*) FILTER (grade >= 2) AS relevant, count(*) FILTER (judged) AS judged, sum(greatest(grade, 0)) AS graded, count(*) AS returned
  FROM j JOIN k ON rank <= k GROUP BY topic, k)
SELECT topic, k, coalesce(relevant, 0) AS relevant, coalesce(judged, 0) AS judged,
  round(CASE WHEN all_relevant > 0 THEN coalesce(relevant, 0) / all_relevant ELSE 0 END, 6) AS recall,
  round(coalesce(relevant, 0) / k, 6) AS precision, CASE WHEN relevant > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_rate,
  round(coalesce(judged, 0) / k, 6) AS judged_rate,
  round(CASE WHEN all_graded > 0 THEN coalesce(graded, 0) / all_graded ELSE 0 END, 6) AS graded_recall,
  round(CASE WHEN returned > 0 THEN relevant / returned ELSE 0 END, 6) AS precision_prefix,
  round(CASE WHEN returned > 0 THEN judged / returned ELSE 0 END, 6) AS judged_rate_prefix
FROM t CROSS JOIN k LEFT JOIN g USING (topic, k)""",
    )
)
def set_measures_at_depths(spark, sf_dir):
    out = M.at_depths(run(spark, sf_dir), qrels(spark, sf_dir), DEPTHS)
    return rounded(out, "recall", "precision", "judged_rate", "graded_recall", "precision_prefix", "judged_rate_prefix")


@query(
    sql(
        RUN_QRELS,
        GOT
        + """, ideal AS (SELECT topic, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM i WHERE place <= 20 GROUP BY topic),
b AS (SELECT topic, grade, row_number() OVER (PARTITION BY topic ORDER BY grade DESC, rank) AS place FROM j WHERE rank <= 20),
s AS (SELECT topic, sum((pow(2, grade) - 1) / log2(place + 1)) AS best FROM b GROUP BY topic)
SELECT topic, round(CASE WHEN ideal > 0 THEN coalesce(best, 0) / ideal ELSE 0 END, 6) AS coverage FROM ideal LEFT JOIN s USING (topic)""",
    )
)
def ideal_dcg_coverage(spark, sf_dir):
    return rounded(M.ideal_coverage(run(spark, sf_dir), qrels(spark, sf_dir), 20), "coverage")


@query(
    sql(
        RUN_QRELS,
        GOT
        + """, n AS (SELECT topic, unnest(range(1, 51)) AS r, all_relevant FROM t),
f AS (SELECT n.topic, n.r, all_relevant, (SELECT count(*) FROM j WHERE j.topic = n.topic AND j.rank <= n.r AND j.grade >= 2) AS found FROM n)
SELECT topic, round(CASE WHEN max(all_relevant) > 0 THEN avg(found / nullif(all_relevant, 0)) ELSE 0 END, 6) AS auc FROM f GROUP BY topic""",
    )
)
def recall_auc(spark, sf_dir):
    return rounded(M.recall_auc(run(spark, sf_dir), qrels(spark, sf_dir), 50), "auc")


@query(
    sql(
        RUN_QRELS,
        GOT
        + """, k AS (SELECT unnest([10, 50, 100]) AS k), g AS (SELECT topic, k, count(*) FILTER (grade >= 2) AS relevant FROM j JOIN k ON rank <= k GROUP BY topic, k),
e AS (SELECT t.topic, k.k, coalesce(relevant, 0) AS relevant, all_relevant FROM t CROSS JOIN k LEFT JOIN g USING (topic, k))
SELECT k, CAST(sum(relevant) AS BIGINT) AS relevant, round(sum(relevant) / nullif(sum(all_relevant), 0), 6) AS pooled_recall,
  round(avg(CASE WHEN all_relevant > 0 THEN relevant / all_relevant ELSE 0 END), 6) AS macro_recall FROM e GROUP BY k""",
    )
)
def macro_pooled_metrics(spark, sf_dir):
    return rounded(M.pooled(run(spark, sf_dir), qrels(spark, sf_dir), (10, 50, 100)), "pooled_recall", "macro_recall")


@query(
    sql(
        RUN_QRELS,
        GOT
        + """, p AS (SELECT DISTINCT topic FROM run), m AS (
  SELECT topic, 'precision@10' AS metric, count(*) FILTER (grade >= 2) / 10 AS value FROM j WHERE rank <= 10 GROUP BY topic
  UNION ALL SELECT t.topic, 'recall@50', coalesce((SELECT count(*) FROM j WHERE j.topic = t.topic AND rank <= 50 AND grade >= 2) / nullif(all_relevant, 0), 0) FROM t)
SELECT metric, round(avg(coalesce(value, 0)), 6) AS mean, count(*) AS topics
FROM (SELECT * FROM p CROSS JOIN (SELECT DISTINCT metric FROM m)) LEFT JOIN m USING (topic, metric) GROUP BY metric""",
    )
)
def macro_mean(spark, sf_dir):
    ranked, judgments = run(spark, sf_dir), qrels(spark, sf_dir)
    values = M.dispatch(ranked, judgments, ("precision@10", "recall@50"))
    return rounded(M.macro(values, ranked), "mean")


@query(
    sql(
        RUN_QRELS,
        GOT
        + """ SELECT topic, count(*) FILTER (judged AND grade >= 2) AS relevant, count(*) FILTER (judged AND grade < 2) AS below,
  count(*) FILTER (NOT judged) AS unjudged FROM j WHERE rank <= 100 GROUP BY topic""",
    )
)
def label_partition_counts(spark, sf_dir):
    return M.partition_counts(run(spark, sf_dir), qrels(spark, sf_dir), 100)


@query(
    sql(
        RUN_QRELS,
        GOT
        + """, r AS (SELECT topic, count(*) FILTER (grade >= 2) AS hits, count(*) AS num_ret FROM j GROUP BY topic)
SELECT topic, round(coalesce(hits / num_ret, 0), 6) AS set_p, round(CASE WHEN all_relevant > 0 THEN coalesce(hits, 0) / all_relevant ELSE 0 END, 6) AS set_recall,
  coalesce(num_ret, 0) AS num_ret FROM t LEFT JOIN r USING (topic)""",
    )
)
def set_precision_recall(spark, sf_dir):
    return rounded(M.set_measures(run(spark, sf_dir), qrels(spark, sf_dir)), "set_p", "set_recall")


def _pair(spark, sf_dir):
    """Precision at 10 of two runs per topic."""
    rows, judgments = streams(spark, sf_dir), qrels(spark, sf_dir)
    of = lambda s: M.dispatch(rows.where(F.col("stream") == s), judgments, ("precision@10",))
    return of("length"), of("early")


PAIR = """, j AS (SELECT s.topic, s.stream, count(*) FILTER (coalesce(q.grade, 0) >= 2) / 10 AS value
  FROM streams s LEFT JOIN qrels q USING (topic, doc) WHERE rank <= 10 GROUP BY ALL),
c AS (SELECT q.topic, coalesce(a.value, 0) AS baseline, coalesce(b.value, 0) AS candidate FROM (SELECT DISTINCT topic FROM qrels) q
  LEFT JOIN j a ON a.topic = q.topic AND a.stream = 'length' LEFT JOIN j b ON b.topic = q.topic AND b.stream = 'early'),
x AS (SELECT *, candidate - baseline AS delta, CASE WHEN candidate - baseline > 1e-12 THEN 'improved' WHEN candidate - baseline < -1e-12 THEN 'degraded' ELSE 'tied' END AS status FROM c)"""


@query(sql("streams qrels", PAIR + " SELECT topic, baseline, candidate, round(delta, 6) AS delta, status FROM x"))
def metric_comparison(spark, sf_dir):
    return rounded(X.compare(*_pair(spark, sf_dir)), "delta")


@query(
    sql(
        "streams qrels",
        PAIR
        + """ SELECT count(*) FILTER (status = 'improved') AS wins, count(*) FILTER (status = 'tied') AS ties, count(*) FILTER (status = 'degraded') AS losses,
  count(*) FILTER (delta <= -0.05) AS big_losses, round(avg(delta), 6) AS mean_delta, round(avg(delta) / nullif(avg(baseline), 0), 6) AS lift,
  arg_min(topic, struct_pack(a := round(delta, 9), b := topic)) AS worst FROM x""",
    )
)
def win_tie_loss(spark, sf_dir):
    return rounded(X.summary(X.compare(*_pair(spark, sf_dir))), "mean_delta", "lift")


@query(
    sql(
        "streams qrels",
        PAIR
        + """, s AS (SELECT topic, abs(delta) AS p, row_number() OVER (ORDER BY abs(delta), topic) AS i, count(*) OVER () AS m FROM x)
SELECT topic AS id, round(p, 6) AS p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i), 6) AS adjusted FROM s""",
    )
)
def holm_adjustment(spark, sf_dir):
    rows = X.compare(*_pair(spark, sf_dir)).select(F.col("topic").alias("id"), F.abs("delta").alias("p"))
    return rounded(X.holm(rows), "p", "adjusted")


@query(
    sql(
        "streams qrels",
        PAIR
        + """, w AS (SELECT topic, CAST(round(delta * 1000000) AS BIGINT) AS delta FROM x), d AS (SELECT abs(delta) AS x, row_number() OVER (ORDER BY abs(delta), topic) - 1 AS k FROM w WHERE delta <> 0),
o AS (SELECT coalesce(sum(delta), 0) AS observed FROM w),
b AS (SELECT unnest(range(0, CAST(pow(2, (SELECT count(*) FROM d)) AS BIGINT))) AS id),
s AS (SELECT id, coalesce(sum(CASE WHEN (id >> k) & 1 = 1 THEN x ELSE -x END), 0) AS total FROM b LEFT JOIN d ON true GROUP BY id)
SELECT count(*) FILTER (total >= observed) AS reached, count(*) AS patterns, round(count(*) FILTER (total >= observed) / count(*), 9) AS p FROM s CROSS JOIN o""",
    )
)
def sign_flip_all_topics(spark, sf_dir):
    """Every topic; changes in whole millionths, whose sums are exact."""
    rows = X.compare(*_pair(spark, sf_dir)).withColumn("delta", F.round(F.col("delta") * 1_000_000))
    return X.sign_flip(rows).withColumn("p", F.round("p", 9))


@query()
def bootstrap_ci(spark, sf_dir):
    return rounded(X.bootstrap(X.compare(*_pair(spark, sf_dir)), samples=20_000), "mean", "low", "high")


CORR = """, p AS (SELECT d.source AS topic, d.n_chars AS x, 2 * l.quality + 1 - l.toxic AS grade FROM labels l JOIN documents d USING (doc_id)),
f AS (SELECT topic, rank() OVER (PARTITION BY topic ORDER BY x) + (count(*) OVER (PARTITION BY topic, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY topic ORDER BY grade) + (count(*) OVER (PARTITION BY topic, grade) - 1) / 2.0 AS ry, grade FROM p)"""


def _graded(spark, sf_dir):
    return qrels(spark, sf_dir).join(run(spark, sf_dir).select("topic", "doc", "score"), ["topic", "doc"])


@query(
    sql(
        "qrels",
        CORR
        + """ SELECT topic, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 6) END AS rho FROM f GROUP BY topic""",
    )
)
def spearman_by_topic(spark, sf_dir):
    return rounded(X.spearman(_graded(spark, sf_dir), "score", "grade", ("topic",)), "rho")


@query(
    sql(
        "qrels",
        CORR
        + """ SELECT topic, count(*) FILTER (grade >= 2) AS positives, count(*) FILTER (grade < 2) AS negatives,
  CASE WHEN count(*) FILTER (grade >= 2) > 0 AND count(*) FILTER (grade < 2) > 0 THEN
  round((sum(CASE WHEN grade >= 2 THEN rx ELSE 0 END) - count(*) FILTER (grade >= 2) * (count(*) FILTER (grade >= 2) + 1) / 2.0)
    / (count(*) FILTER (grade >= 2) * count(*) FILTER (grade < 2)), 6) END AS auc FROM f GROUP BY topic""",
    )
)
def roc_auc(spark, sf_dir):
    rows = _graded(spark, sf_dir).withColumn("positive", F.col("grade") >= 2)
    return rounded(X.auc(rows, "score", "positive", ("topic",)), "auc")


@query(
    sql(
        "qrels run",
        """, p AS (SELECT q.topic, q.grade, r.score AS a, -r.rank AS b FROM qrels q JOIN run r USING (topic, doc)),
u AS (SELECT topic, grade, 'score' AS component, a AS x FROM p UNION ALL SELECT topic, grade, 'place', CAST(b AS DOUBLE) FROM p),
f AS (SELECT *, rank() OVER (PARTITION BY topic, component ORDER BY x) + (count(*) OVER (PARTITION BY topic, component, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY topic, component ORDER BY grade) + (count(*) OVER (PARTITION BY topic, component, grade) - 1) / 2.0 AS ry FROM u)
SELECT topic, component, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 6) END AS rho,
  CASE WHEN count(*) FILTER (grade >= 2) > 0 AND count(*) FILTER (grade < 2) > 0 THEN
   round((sum(CASE WHEN grade >= 2 THEN rx ELSE 0 END) - count(*) FILTER (grade >= 2) * (count(*) FILTER (grade >= 2) + 1) / 2.0)
    / (count(*) FILTER (grade >= 2) * count(*) FILTER (grade < 2)), 6) END AS auc,
  count(*) FILTER (grade >= 2) AS positives, count(*) FILTER (grade < 2) AS negatives,
  round(avg(x) FILTER (grade >= 2), 6) AS mean_positive, round(avg(x) FILTER (grade < 2), 6) AS mean_negative
FROM f GROUP BY topic, component""",
    )
)
def calibration_rows(spark, sf_dir):
    both = qrels(spark, sf_dir).join(run(spark, sf_dir), ["topic", "doc"]).withColumn("place", -F.col("rank"))
    return rounded(X.calibration(both, ("score", "place")), "rho", "auc", "mean_positive", "mean_negative")


@query(
    sql(
        "lanes",
        """, r AS (SELECT topic, lane, score, row_number() OVER (PARTITION BY topic, lane ORDER BY score) - 1 AS pos, count(*) OVER (PARTITION BY topic, lane) AS n FROM lanes)
SELECT topic, lane, max(score) FILTER (pos = floor(0.25 * (n - 1) + 0.5)) AS q25, max(score) FILTER (pos = floor(0.5 * (n - 1) + 0.5)) AS q50,
  max(score) FILTER (pos = floor(0.9 * (n - 1) + 0.5)) AS q90 FROM r GROUP BY ALL""",
    )
)
def nearest_rank_quantiles(spark, sf_dir):
    from orrery.plans.relations import lanes

    return X.quantiles_nearest(lanes(spark, sf_dir), "score", (0.25, 0.5, 0.9), ("topic", "lane"))


@query(sql("lanes", " SELECT topic, min(score) AS least, round(median(score), 6) AS median, max(score) AS most FROM lanes GROUP BY topic"))
def distribution(spark, sf_dir):
    from orrery.plans.relations import lanes

    return rounded(X.distribution(lanes(spark, sf_dir), "score", ("topic",)), "median")


@query(
    sql(
        "streams qrels",
        """, a AS (SELECT topic, doc, rank AS a_rank FROM streams WHERE stream = 'length'), b AS (SELECT topic, doc, rank AS b_rank FROM streams WHERE stream = 'early')
SELECT topic, doc, a_rank, b_rank, grade, CASE WHEN a_rank <= 10 AND b_rank <= 10 THEN 'kept' WHEN b_rank <= 10 THEN 'incoming' ELSE 'outgoing' END AS movement,
  a_rank - b_rank AS moved FROM a JOIN b USING (topic, doc) LEFT JOIN qrels USING (topic, doc) WHERE a_rank <= 10 OR b_rank <= 10""",
    )
)
def boundary_changes(spark, sf_dir):
    from orrery.operators.joins import movement

    rows = streams(spark, sf_dir)
    return movement(rows.where("stream = 'length'"), rows.where("stream = 'early'"), qrels(spark, sf_dir), 10)


@query(
    sql(
        "streams",
        """, a AS (SELECT topic, doc, rank FROM streams WHERE stream = 'length' AND rank <= 20), b AS (SELECT topic, doc, rank FROM streams WHERE stream = 'early' AND rank <= 20)
SELECT coalesce(a.topic, b.topic) AS topic, count(a.doc) FILTER (b.doc IS NOT NULL) AS shared, count(*) AS every,
  round(count(a.doc) FILTER (b.doc IS NOT NULL) / 20, 6) AS overlap FROM a FULL JOIN b ON a.topic = b.topic AND a.doc = b.doc GROUP BY 1""",
    )
)
def ranking_agreement(spark, sf_dir):
    from orrery.operators.joins import agreement

    rows = streams(spark, sf_dir)
    return rounded(agreement(rows.where("stream = 'length'"), rows.where("stream = 'early'"), 20), "overlap")
