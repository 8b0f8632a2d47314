"""Queries: robust admission, greedy selections, clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import admission as A
from orrery.operators import greedy as G
from orrery.operators import ranking as R
from orrery.operators.joins import cosine_pairs as pairs_above
from orrery.plans.registry import query
from orrery.plans.relations import lanes, sql, streams, table
from orrery.plans.text import STOP, _stem_sql
from orrery.session import spread

ROBUST = """, m AS (SELECT topic, lane, median(score) AS median FROM lanes GROUP BY ALL),
d AS (SELECT l.topic, l.lane, any_value(m.median) AS median, median(abs(l.score - m.median)) AS mad FROM lanes l JOIN m ON l.topic = m.topic AND l.lane = m.lane GROUP BY l.topic, l.lane),
a AS (SELECT l.*, CASE WHEN mad > 0 THEN score >= median + 2.5 * 1.4826 * mad ELSE score > median END AS admitted
  FROM lanes l JOIN d ON l.topic = d.topic AND l.lane = d.lane)"""


def _narrow(spark, sf_dir):
    """Lane scores with a long upper tail: cubes of the prices' digits."""
    return lanes(spark, sf_dir).withColumn("score", F.pow(F.col("score") % 1000, F.lit(3)))


NARROW = """, _l AS (SELECT topic, lane, doc, pow(score % 1000, 3) AS score FROM lanes)"""
TAIL = NARROW + ROBUST.replace("FROM lanes", "FROM _l")


@query(sql("lanes", TAIL + " SELECT topic, lane, round(median, 3) AS median, round(mad, 3) AS mad, round(median + 2.5 * 1.4826 * mad, 3) AS threshold FROM d"))
def mad_thresholds(spark, sf_dir):
    out = A.thresholds(_narrow(spark, sf_dir))
    return out.withColumns({c: F.round(c, 3) for c in ("median", "mad", "threshold")})


@query(
    sql(
        "lanes",
        TAIL
        + """, p AS (SELECT topic, doc, count(*) FILTER (admitted) AS lanes, max(score) AS score FROM a GROUP BY ALL),
t AS (SELECT topic, max(lanes) AS most, arg_min(doc, struct_pack(a := -score, b := doc)) AS fallback FROM p GROUP BY topic)
SELECT p.topic, doc, lanes FROM p JOIN t ON p.topic = t.topic WHERE lanes > 0 OR (most = 0 AND doc = fallback)""",
    )
)
def mad_admission(spark, sf_dir):
    return A.core(_narrow(spark, sf_dir))


@query(
    sql(
        "lanes",
        TAIL
        + """, p AS (SELECT topic, doc, count(*) FILTER (admitted) AS lanes FROM a GROUP BY ALL) SELECT topic, lanes, count(*) AS documents FROM p WHERE lanes > 0 GROUP BY ALL""",
    )
)
def multiplicity_histogram(spark, sf_dir):
    return A.multiplicity(A.core(_narrow(spark, sf_dir)).where("lanes > 0"))


@query(
    sql(
        "lanes",
        TAIL
        + """, h AS (SELECT topic, doc, lane, count(*) AS hits FROM a WHERE admitted GROUP BY ALL)
SELECT topic, doc, count(*) AS n_lanes, CAST(sum(least(hits, 3)) AS BIGINT) AS n_hits FROM h GROUP BY ALL""",
    )
)
def breadth_counts(spark, sf_dir):
    return A.breadth(_narrow(spark, sf_dir))


@query(
    sql(
        "lanes",
        """, w AS (SELECT topic, doc, max(score) FILTER (lane = 'N') AS narrative, list_reverse_sort(list(score) FILTER (lane <> 'N')) AS f FROM lanes GROUP BY ALL),
s AS (SELECT *, CASE WHEN len(f) > 1 THEN 0.7 * f[1] + 0.3 * f[2] ELSE f[1] END AS facet FROM w)
SELECT topic, doc, round(narrative, 4) AS narrative, round(facet, 4) AS facet, round(0.5 * narrative + 0.5 * facet, 4) AS combo,
  row_number() OVER (PARTITION BY topic ORDER BY round(0.5 * narrative + 0.5 * facet, 4) DESC NULLS LAST, doc) AS rank FROM s""",
    )
)
def combo_ranking(spark, sf_dir):
    out = A.strongest(lanes(spark, sf_dir), "N").withColumns({c: F.round(c, 4) for c in ("narrative", "facet", "combo")})
    return R.ranked(out, F.desc_nulls_last("combo"), "doc")


def features(spark, sf_dir, terms=True):
    """What the greedy arms need, for the documents of each source: facets are four length-based scores.

    ``terms`` come last, as texts: ranks within a topic are found on narrow rows.
    """
    rows = streams(spark, sf_dir)
    fused = R.rrf(rows).select("topic", "doc", F.col("rank").alias("fused_rank"), F.col("score").alias("fused"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), "n_chars")
    ranks = rows.groupBy("topic", "doc").agg(
        F.min(F.when(F.col("stream") == "length", F.col("rank"))).alias("original_rank"), F.min(F.when(F.col("stream") == "early", F.col("rank"))).alias("best_facet_rank")
    )
    both = docs.join(fused, ["topic", "doc"]).join(ranks, ["topic", "doc"])
    both = R.percentile_best_one(both, "fused", name="r")
    both = R.percentile_best_one(both, "n_chars", name="g")
    narrative = (F.col("doc") * 7919 % 101) / 100
    facet = F.array(*[(F.col("doc") * p % 97) / 97 for p in (31, 57, 71, 83)])
    if terms:
        texts = spread(table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), "text"))
        both = both.join(texts.select("topic", "doc", F.array_join(X.terms(F.col("text")), " ").alias("terms")), ["topic", "doc"])
    return both.select("topic", "doc", *(["terms"] if terms else []), "g", narrative.alias("n"), "r", facet.alias("facets"), "original_rank", "best_facet_rank")


FEATURES = """, fu AS (SELECT e.topic, e.doc, 0.0::DOUBLE + 1.0::DOUBLE / (60 + e.rank) + 1.0::DOUBLE / (60 + l.rank) AS fused, l.rank AS original_rank, e.rank AS best_facet_rank
  FROM streams e JOIN streams l ON l.topic = e.topic AND l.doc = e.doc AND l.stream = 'length' WHERE e.stream = 'early'),
ft AS (SELECT fu.*, n_chars, text, count(*) OVER t AS n FROM fu JOIN documents d ON d.doc_id = fu.doc AND d.source = fu.topic WINDOW t AS (PARTITION BY topic)),
pc AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY fused DESC) - 1 AS af, count(*) OVER (PARTITION BY topic, fused) AS tf, rank() OVER (PARTITION BY topic ORDER BY n_chars DESC) - 1 AS ac, count(*) OVER (PARTITION BY topic, n_chars) AS tc FROM ft),
x AS (SELECT topic, doc, text, fused, original_rank, best_facet_rank, (n - (af + (tf + 1) / 2) + 1) / n AS r, (n - (ac + (tc + 1) / 2) + 1) / n AS g, (doc * 7919 % 101) / 100 AS narrative,
  [(doc * 31 % 97) / 97, (doc * 57 % 97) / 97, (doc * 71 % 97) / 97, (doc * 83 % 97) / 97] AS m FROM pc)"""
# Step by step: of the documents left, the one of the greatest value; covered facets then count for less.
FACET = """, f AS (SELECT CAST(0 AS BIGINT) AS step, topic, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS cov, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS doc, CAST(NULL AS DOUBLE) AS objective, CAST(NULL AS DOUBLE) AS bonus FROM (SELECT DISTINCT topic FROM x)
  UNION ALL SELECT w.step, w.topic, list_transform([1, 2, 3, 4], lambda k: greatest(w.cov[k], w.b.m[k])), list_append(w.chosen, w.b.doc), w.b.doc, w.b.value, w.b.bonus FROM (
    SELECT v.step, v.topic, v.cov, v.chosen, min(struct_pack(neg := -(0.7::DOUBLE * v.local + 0.3::DOUBLE * list_max(v.gains)), r := -v.r, first := list_position(v.m, v.local), pos := list_position(v.gains, list_max(v.gains)), o := v.original_rank,
      bf := v.best_facet_rank, doc := v.doc, m := v.m, value := 0.7::DOUBLE * v.local + 0.3::DOUBLE * list_max(v.gains), bonus := list_max(v.gains))) AS b
    FROM (SELECT f.step + 1 AS step, f.topic, f.cov, f.chosen, x.doc, x.m, x.r, x.original_rank, x.best_facet_rank, list_max(x.m) AS local, list_transform([1, 2, 3, 4], lambda k: x.m[k] * (1 - f.cov[k])) AS gains
      FROM f JOIN x ON x.topic = f.topic AND NOT list_contains(f.chosen, x.doc)) v GROUP BY ALL) w)"""


def _dual(arms: str) -> str:
    """Steps of the two-sided objective for arms (name, redundancy, prefix): replayed ones first, then the best left."""
    return f""", tm AS (SELECT topic, doc, list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{STOP}], w)), lambda w: {_stem_sql("w")})), lambda w: w <> '') AS t FROM x),
pr AS (SELECT a.topic, a.doc AS i, b.doc AS j, len(list_intersect(a.t, b.t)) AS s, len(a.t) AS na, len(b.t) AS nb FROM tm a JOIN tm b ON a.topic = b.topic AND a.doc <> b.doc AND least(len(a.t), len(b.t)) > 0 AND least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t))),
pn AS (SELECT i, j, CASE WHEN s = na + nb - s THEN 1.0 ELSE (s / (na + nb - s) - 0.8::DOUBLE) / 0.2::DOUBLE END AS p FROM pr WHERE s / (na + nb - s) >= 0.8::DOUBLE),
ar AS (SELECT * FROM (VALUES {arms}) v(arm, redundant, prefix)),
f AS (SELECT CAST(0 AS BIGINT) AS step, arm, redundant, prefix, topic, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS cov, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS doc, CAST(NULL AS DOUBLE) AS objective, CAST(NULL AS DOUBLE) AS bonus FROM (SELECT DISTINCT topic FROM x) CROSS JOIN ar
  UNION ALL SELECT w.step, w.arm, w.redundant, w.prefix, w.topic, list_transform([1, 2, 3, 4], lambda k: greatest(w.cov[k], w.b.m[k])), list_append(w.chosen, w.b.doc), w.b.doc, w.b.value, w.b.bonus FROM (
    SELECT u.step, u.arm, u.redundant, u.prefix, u.topic, u.cov, u.chosen, min(struct_pack(replay := CASE WHEN u.step <= u.prefix THEN u.original_rank ELSE 0 END, neg := CASE WHEN u.step <= u.prefix THEN 0 ELSE -u.value END, r := -u.r, local := -u.local,
      o := u.original_rank, bf := u.best_facet_rank, doc := u.doc, m := u.m, value := u.value, bonus := u.bonus)) AS b FROM (
      SELECT v.*, 0.35::DOUBLE * v.g + 0.15::DOUBLE * v.narrative + 0.15::DOUBLE * v.r + 0.25::DOUBLE * v.local + 0.1::DOUBLE * v.bonus - 0.15::DOUBLE * coalesce(v.penalty, 0) AS value FROM (
        SELECT f.step + 1 AS step, f.arm, f.redundant, f.prefix, f.topic, f.cov, f.chosen, x.doc, x.m, x.r, x.g, x.narrative, x.original_rank, x.best_facet_rank, list_max(x.m) AS local,
          list_max(list_transform([1, 2, 3, 4], lambda k: x.m[k] * (1 - f.cov[k]))) AS bonus, CASE WHEN f.redundant THEN (SELECT max(pn.p) FROM pn WHERE pn.i = x.doc AND list_contains(f.chosen, pn.j)) END AS penalty
        FROM f JOIN x ON x.topic = f.topic AND NOT list_contains(f.chosen, x.doc)) v) u GROUP BY ALL) w)"""


ROWS = " SELECT topic, doc, step AS final_rank, round(objective, 6) AS objective, round(bonus, 6) AS bonus FROM f WHERE step > 0"
ARMS = FEATURES + _dual("('DUAL', true, 0), ('DUAL-10', true, 10), ('DUAL-20', true, 20), ('DUAL-50', true, 50), ('DUAL-NR', false, 0), ('DUAL-NR-10', false, 10), ('DUAL-NR-50', false, 50)")


@query(sql("streams", FEATURES + FACET + ROWS, recursive=True))
def facet_greedy(spark, sf_dir):
    return G.arm(features(spark, sf_dir, False), "FACET").withColumns({c: F.round(c, 6) for c in ("objective", "bonus")})


@query(sql("streams", ARMS + ROWS + " AND arm = 'DUAL'", recursive=True))
def dual_greedy(spark, sf_dir):
    return G.arm(features(spark, sf_dir), "DUAL").withColumns({c: F.round(c, 6) for c in ("objective", "bonus")})


@query(sql("streams", ARMS + ROWS + " AND arm = 'DUAL-NR'", recursive=True))
def dual_without_redundancy(spark, sf_dir):
    return G.arm(features(spark, sf_dir, False), "DUAL-NR").withColumns({c: F.round(c, 6) for c in ("objective", "bonus")})


@query(sql("streams", ARMS + ROWS + " AND arm = 'DUAL-20'", recursive=True))
def dual_reinitialised(spark, sf_dir):
    return G.arm(features(spark, sf_dir), "DUAL", prefix=20).withColumns({c: F.round(c, 6) for c in ("objective", "bonus")})


@query(
    sql(
        "streams",
        ARMS
        + """ SELECT arm, topic, doc, step AS final_rank FROM f WHERE step > 0 AND arm <> 'DUAL-20'
UNION ALL SELECT 'RRF', topic, doc, row_number() OVER (PARTITION BY topic ORDER BY round(fused, 12) DESC, least(original_rank, best_facet_rank), doc) FROM x""",
        recursive=True,
    )
)
def six_arms(spark, sf_dir):
    own = features(spark, sf_dir)
    fused = R.rrf(streams(spark, sf_dir))
    return G.arms(own, fused, (10, 50))


def _lane_ranks(spark, sf_dir):
    rows = lanes(spark, sf_dir).withColumn("topic", F.col("topic").cast("string"))
    return R.ranked(rows, F.desc("score"), "doc", by=("topic", "lane")).select("topic", "lane", "doc", "rank")


# Lanes take turns: in step n the lane whose turn it is gives its best document that nobody gave, if it has one left.
ROBIN = """, lr AS (SELECT CAST(topic AS VARCHAR) AS topic, lane, doc, row_number() OVER (PARTITION BY topic, lane ORDER BY score DESC, doc) AS rank FROM lanes),
q AS (SELECT topic, lane, row_number() OVER (PARTITION BY topic ORDER BY lane) - 1 AS turn, count(*) OVER (PARTITION BY topic) AS n FROM (SELECT DISTINCT topic, lane FROM lr)),
g AS (SELECT CAST(0 AS BIGINT) AS step, topic, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS VARCHAR) AS lane, CAST(NULL AS BIGINT) AS doc, CAST(NULL AS BIGINT) AS lane_rank FROM (SELECT DISTINCT topic FROM lr)
  UNION ALL SELECT s.step, s.topic, CASE WHEN s.hit IS NULL THEN s.taken ELSE list_append(s.taken, s.hit.doc) END, s.lane, s.hit.doc, s.hit.rank FROM (
    SELECT g.step + 1 AS step, g.topic, g.taken, q.lane, min(CASE WHEN NOT list_contains(g.taken, lr.doc) THEN struct_pack(rank := lr.rank, doc := lr.doc) END) AS hit
    FROM g JOIN q ON q.topic = g.topic AND q.turn = g.step % q.n JOIN lr ON lr.topic = q.topic AND lr.lane = q.lane AND lr.rank <= 200 WHERE len(g.taken) < 100 AND g.step < 400 GROUP BY ALL) s),
o AS (SELECT topic, doc, lane, lane_rank, row_number() OVER (PARTITION BY topic ORDER BY step) AS final_rank FROM g WHERE doc IS NOT NULL)"""


@query(sql("lanes", ROBIN + " SELECT * FROM o", recursive=True))
def round_robin_select(spark, sf_dir):
    return G.round_robin(_lane_ranks(spark, sf_dir), 100)


@query(
    sql(
        "lanes",
        ROBIN
        + """, a AS (SELECT topic, lane, count(*) AS available FROM lr GROUP BY ALL), s AS (SELECT topic, lane, count(*) AS selected, max(lane_rank) AS reached FROM o GROUP BY ALL)
SELECT a.topic, a.lane, available, coalesce(selected, 0) AS selected, coalesce(reached, 0) - coalesce(selected, 0) AS skipped FROM a LEFT JOIN s ON s.topic = a.topic AND s.lane = a.lane""",
        recursive=True,
    )
)
def round_robin_status(spark, sf_dir):
    own = _lane_ranks(spark, sf_dir)
    return G.lane_status(own, G.round_robin(own, 100))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


COSINE = """WITH e AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS topic, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT id, topic, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"""


@query(
    COSINE
    + """, p AS (SELECT a.topic, a.id AS i, b.id AS j, list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) AS cosine FROM n a JOIN n b ON a.topic = b.topic AND a.id < b.id)
SELECT topic, i, j, round(cosine, 6) AS cosine FROM p WHERE cosine >= 0.2"""
)
def cosine_pairs(spark, sf_dir):
    return pairs_above(_vectors(spark, sf_dir), 0.2).withColumn("cosine", F.round("cosine", 6))


@query(
    "WITH RECURSIVE "
    + COSINE.removeprefix("WITH ")
    + """, o AS (SELECT topic, id, v, row_number() OVER (PARTITION BY topic ORDER BY id) AS n FROM n),
s AS (SELECT a.topic, a.id AS i, b.id AS j FROM n a JOIN n b ON a.topic = b.topic AND b.id < a.id AND a.id % 2 = b.id % 2 WHERE list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) >= 0.3),
f AS (SELECT CAST(0 AS BIGINT) AS n, topic, CAST([] AS BIGINT[]) AS leaders, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader FROM (SELECT DISTINCT topic FROM o)
  UNION ALL SELECT x.n, x.topic, CASE WHEN x.found IS NULL THEN list_append(x.leaders, x.id) ELSE x.leaders END, x.id, coalesce(x.found, x.id) FROM (
    SELECT o.n, o.topic, f.leaders, o.id, (SELECT min(s.j) FROM s WHERE s.topic = o.topic AND s.i = o.id AND list_contains(f.leaders, s.j)) AS found FROM f JOIN o ON o.topic = f.topic AND o.n = f.n + 1) x)
SELECT topic, id, leader FROM f WHERE n > 0"""
)
def leader_clusters(spark, sf_dir):
    own = _vectors(spark, sf_dir).withColumn("signature", (F.col("id") % 2).cast("string"))
    return G.leader_clusters(own, 0.3)


@query(
    "WITH RECURSIVE "
    + COSINE.removeprefix("WITH ")
    + """, r AS (SELECT topic, id, v, 1.0::DOUBLE / row_number() OVER (PARTITION BY topic ORDER BY id) AS rel FROM n),
s AS (SELECT a.topic, a.id AS i, b.id AS j, list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) AS c FROM n a JOIN n b ON a.topic = b.topic),
m AS (
  SELECT topic, arg_min(id, struct_pack(a := -round(0.7 * rel, 9), b := id)) AS id, 1 AS place, max(round(0.7 * rel, 9)) AS value,
    [arg_min(id, struct_pack(a := -round(0.7 * rel, 9), b := id))] AS chosen FROM r GROUP BY topic
  UNION ALL
  SELECT x.topic, x.id, x.place, x.value, list_append(x.chosen, x.id) FROM (
    SELECT m.topic, r.id, m.place + 1 AS place, m.chosen,
      round(0.7 * r.rel - 0.3 * (SELECT max(c) FROM s WHERE s.i = r.id AND list_contains(m.chosen, s.j)), 9) AS value,
      row_number() OVER (PARTITION BY m.topic ORDER BY round(0.7 * r.rel - 0.3 * (SELECT max(c) FROM s WHERE s.i = r.id AND list_contains(m.chosen, s.j)), 9) DESC, r.id) AS o
    FROM m JOIN r ON r.topic = m.topic WHERE m.place < 5 AND NOT list_contains(m.chosen, r.id)) x WHERE o = 1
)
SELECT topic, id, CAST(place AS BIGINT) AS place, round(value, 6) AS value FROM m"""
)
def mmr_topk(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("topic").orderBy("id"))
    own = _vectors(spark, sf_dir).withColumn("relevance", 1 / rank)
    return G.mmr(own, 5).withColumn("value", F.round("value", 6))


@query(
    sql(
        "windows",
        """, i AS (SELECT doc, chunk AS id, "start" AS a, "end" AS b, 'part ' || chunk % 3 || ' ' || "end" % 700 AS t, row_number() OVER (PARTITION BY doc ORDER BY score DESC, chunk) AS n FROM windows),
f AS (SELECT doc, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS STRUCT(a BIGINT, b BIGINT, t VARCHAR)[]) AS kept FROM (SELECT DISTINCT doc FROM i)
  UNION ALL SELECT doc, n, CASE WHEN fresh THEN id END, CASE WHEN fresh THEN list_append(kept, struct_pack(a := a, b := b, t := t)) ELSE kept END FROM (
    SELECT i.*, f.kept, len(list_filter(f.kept, lambda k: k.t = i.t OR greatest(0, least(k.b, i.b) - greatest(k.a, i.a)) >= 0.8 * least(k.b - k.a, i.b - i.a))) = 0 AS fresh FROM f JOIN i ON i.doc = f.doc AND i.n = f.n + 1))
SELECT doc, id FROM f WHERE id IS NOT NULL""",
        recursive=True,
    )
)
def snippet_dedup(spark, sf_dir):
    from orrery.plans.relations import windows

    rows = windows(spark, sf_dir)
    text = F.concat(F.lit("part "), (F.col("chunk") % 3).cast("string"), F.lit(" "), (F.col("end") % 700).cast("string"))
    return G.distinct_snippets(rows.select("doc", F.col("chunk").alias("id"), "start", "end", text.alias("text"), "score"))


@query(
    """WITH RECURSIVE b AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS topic, l_partkey % 50 AS a, l_orderkey % 50 AS b, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
m AS (SELECT CAST(0 AS BIGINT) AS n, topic, CAST([] AS BIGINT[]) AS las, CAST([] AS BIGINT[]) AS lbs, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT topic FROM b)
  UNION ALL SELECT x.n, x.topic, list_append(x.las, x.best.a), list_append(x.lbs, x.best.b), x.best.a, x.best.b, -x.best.neg FROM (
    SELECT m.n + 1 AS n, m.topic, m.las, m.lbs, min(struct_pack(neg := -b.score, a := b.a, b := b.b)) AS best FROM m JOIN b ON b.topic = m.topic AND NOT list_contains(m.las, b.a) AND NOT list_contains(m.lbs, b.b) GROUP BY ALL) x)
SELECT topic, a, b, score FROM m WHERE n > 0"""
)
def one_to_one_matching(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).cast("string").alias("topic"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_orderkey") % 50).alias("b"), F.col("l_extendedprice").alias("score")
    )
    best = rows.groupBy("topic", "a", "b").agg(F.max("score").alias("score"))
    return G.one_to_one(best)


@query()
def evidence_selection(spark, sf_dir):
    from orrery.operators.evidence import select_evidence

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), "doc_id", "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    rows = docs.join(vectors, "doc").select("topic", F.col("doc").alias("id"), "doc", F.lit("sentence").alias("kind"), "text", F.length("text").cast("double").alias("score"), "vector")
    return select_evidence(rows, budgets=(5, 10), threshold=0.3)
