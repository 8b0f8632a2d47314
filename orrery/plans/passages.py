"""Queries: chunks, spans, window aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import passages as P
from orrery.plans.registry import query
from orrery.plans.relations import sql, table, windows

TOP4 = """, o AS (SELECT *, row_number() OVER (PARTITION BY topic, doc ORDER BY score DESC, "start", "end", chunk) AS r FROM windows)"""
WEIGHTS = "[0.55::DOUBLE, 0.25::DOUBLE, 0.13::DOUBLE, 0.07::DOUBLE]"

#: Windows folded one by one in order; spans are multiples of 100, so cells of 100 measure them.
FOLD = """, o AS (SELECT *, row_number() OVER (PARTITION BY topic, doc ORDER BY score DESC, "start", "end", chunk) AS r,
    max(score) OVER (PARTITION BY topic, doc) AS best FROM windows),
g AS (
  SELECT topic, doc, r, best, {first} AS kept FROM o WHERE r = 1
  UNION ALL
  SELECT o.topic, o.doc, o.r, o.best, CASE WHEN {accept} THEN list_append(g.kept, {item}) ELSE g.kept END
  FROM g JOIN o ON o.topic = g.topic AND o.doc = g.doc AND o.r = g.r + 1
), z AS (SELECT topic, doc, arg_max(kept, r) AS kept FROM g GROUP BY topic, doc)"""
ITEM = """struct_pack(a := o."start", b := o."end", s := o.score)"""
NEW = """100 * len(list_filter(range(o."start" // 100, o."end" // 100), lambda c: len(list_filter(g.kept, lambda k: k.a // 100 <= c AND c < k.b // 100)) = 0))"""
MEAN = f"""round(list_sum(list_transform(range(1, least(len(kept), 4) + 1), lambda i: kept[i].s * ({WEIGHTS})[i]))
  / list_sum(({WEIGHTS})[1:least(len(kept), 4)]), 9)"""


def fold(accept: str) -> str:
    first = '[struct_pack(a := "start", b := "end", s := score)]'
    return FOLD.format(first=first, accept=accept, item=ITEM)


@query(
    sql(
        "windows",
        TOP4
        + f""" SELECT topic, doc, round(sum(score * ({WEIGHTS})[r]) / sum(({WEIGHTS})[r]), 9) AS top4 FROM o WHERE r <= 4 GROUP BY topic, doc""",
    )
)
def window_top4(spark, sf_dir):
    return P.top4(windows(spark, sf_dir)).withColumn("top4", F.round("top4", 9))


@query(sql("windows", " SELECT topic, doc, max(score) AS maxp FROM windows GROUP BY topic, doc"))
def maxp(spark, sf_dir):
    return P.max_passage(windows(spark, sf_dir))


@query(sql("windows", fold(f"len(g.kept) < 4 AND {NEW} >= 2000") + f" SELECT topic, doc, len(kept) AS n_kept, {MEAN} AS score FROM z", True))
def span_distinct_top4(spark, sf_dir):
    return P.span_distinct_top4(windows(spark, sf_dir), 2000).withColumn("score", F.round("score", 9))


OVERLAP = """len(list_filter(g.kept, lambda k: greatest(0, least(k.b, o."end") - greatest(k.a, o."start")) / least(k.b - k.a, o."end" - o."start") >= 0.5)) = 0"""


@query(sql("windows", fold(OVERLAP) + f" SELECT topic, doc, len(kept) AS n_kept, {MEAN} AS score FROM z", True))
def suppressed_top4(spark, sf_dir):
    return P.suppressed_top4(windows(spark, sf_dir)).withColumn("score", F.round("score", 9))


# A first window shorter than the demand keeps nothing, but the fold goes on.
SUPPORT = (
    fold(f"o.score >= o.best - 1.0 AND {NEW} >= 800").replace(
        '[struct_pack(a := "start", b := "end", s := score)] AS kept', 'CASE WHEN "end" - "start" >= 800 THEN [struct_pack(a := "start", b := "end", s := score)] ELSE [] END AS kept'
    )
    + """, sp AS (SELECT w.topic, w.doc, CASE WHEN z.kept IS NULL THEN 0 ELSE least(len(z.kept), 6) END AS support FROM (SELECT DISTINCT topic, doc FROM windows) w LEFT JOIN z ON z.topic = w.topic AND z.doc = w.doc)"""
)


@query(sql("windows", SUPPORT + " SELECT * FROM sp", True))
def rel_span_support(spark, sf_dir):
    return P.span_support(windows(spark, sf_dir))


@query(
    sql(
        "windows",
        TOP4
        + f""", t AS (SELECT topic, doc, sum(score * ({WEIGHTS})[r]) / sum(({WEIGHTS})[r]) AS top4 FROM o WHERE r <= 4 GROUP BY topic, doc),
d AS (SELECT topic, doc, round(sum(score), 4) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(sum(score), 4) DESC, doc) AS rank FROM windows GROUP BY topic, doc),
u AS (SELECT d.topic, d.doc, d.rank, 0.5 * d.score + 0.5 * top4 AS total FROM d JOIN t ON d.topic = t.topic AND d.doc = t.doc)
SELECT topic, doc, rank, CASE WHEN rank <= 50 THEN round(total, 9) END AS total FROM u""",
    )
)
def coverage_aware_scores(spark, sf_dir):
    from orrery.operators.ranking import ranked

    own = windows(spark, sf_dir)
    documents = ranked(own.groupBy("topic", "doc").agg(F.round(F.sum("score"), 4).alias("score")), F.desc("score"), "doc")
    out = P.coverage_aware(documents, own, 50, c=0.0)
    return out.select("topic", "doc", "rank", "total")


@query(
    sql(
        "windows",
        SUPPORT
        + f""", tp AS (SELECT topic, doc, sum(score * ({WEIGHTS})[r]) / sum(({WEIGHTS})[r]) AS top4 FROM o WHERE r <= 4 GROUP BY topic, doc),
d AS (SELECT topic, doc, round(sum(score), 4) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(sum(score), 4) DESC, doc) AS rank FROM windows GROUP BY topic, doc),
h AS (SELECT d.topic, d.doc, d.rank, CASE WHEN d.rank <= 50 THEN round(0.5 * d.score + 0.5 * top4 + 0.25 * support, 9) END AS total FROM d JOIN tp ON tp.topic = d.topic AND tp.doc = d.doc JOIN sp ON sp.topic = d.topic AND sp.doc = d.doc),
e AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rank > 50, total DESC, rank) AS final_rank FROM h),
n AS (SELECT topic, CAST(50 AS BIGINT) AS place, min(total) AS score, count(*) AS many FROM e GROUP BY topic UNION ALL SELECT topic, place + 1, nextafter(score, '-infinity'::DOUBLE), many FROM n WHERE place < many)
SELECT e.topic, e.doc, e.rank, e.total, e.final_rank, CASE WHEN e.total IS NOT NULL THEN e.total ELSE n.score END AS final_score FROM e LEFT JOIN n ON n.topic = e.topic AND n.place = e.final_rank""",
        True,
    )
)
def coverage_aware_rerank(spark, sf_dir):
    from orrery.operators.ranking import ranked

    own = windows(spark, sf_dir)
    documents = ranked(own.groupBy("topic", "doc").agg(F.round(F.sum("score"), 4).alias("score")), F.desc("score"), "doc")
    return P.coverage_aware(documents, own)


@query(
    sql(
        "windows",
        """, c AS (SELECT DISTINCT topic, doc, unnest(range("start" // 100, "end" // 100)) AS c FROM windows)
SELECT topic, doc, count(*) * 100 AS length FROM c GROUP BY topic, doc""",
    )
)
def interval_union_length(spark, sf_dir):
    return P.union_length(windows(spark, sf_dir))


@query(
    """
WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, n, unnest(range(0, greatest(1, CAST(ceil((n - 350) / 3150.0) AS BIGINT)))) AS k FROM n)
SELECT doc_id AS doc, doc_id || ':' || lpad(CAST(k AS VARCHAR), 4, '0') AS chunk_id, k * 3150 AS start,
  k * 3150 + length(substring(text, k * 3150 + 1, 3500)) AS "end", sha256(substring(text, k * 3150 + 1, 3500)) AS text
FROM c WHERE trim(substring(text, k * 3150 + 1, 3500)) <> ''"""
)
def chunk_stride(spark, sf_dir):
    out = P.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.withColumn("text", F.sha2("text", 256))


def _spans(spark, sf_dir):
    return windows(spark, sf_dir).withColumnRenamed("chunk", "id")


@query(
    sql(
        "windows",
        """ SELECT a.topic, a.doc, a.chunk AS id, b.chunk AS other_id FROM windows a JOIN windows b ON a.topic = b.topic AND a.doc = b.doc AND a.chunk < b.chunk
  AND a."start" < b."end" AND a."end" > b."start" """,
    )
)
def interval_overlap_join(spark, sf_dir):
    own = _spans(spark, sf_dir)
    return P.overlapping(own, own).where("id < other_id").select("topic", "doc", "id", "other_id")


@query(
    sql(
        "windows",
        """ SELECT a.topic, a.doc, a.chunk AS id, b.chunk AS other_id FROM windows a JOIN windows b ON a.topic = b.topic AND a.doc = b.doc AND a.chunk <> b.chunk
  AND b."start" <= a."start" AND a."end" <= b."end" """,
    )
)
def interval_containment_join(spark, sf_dir):
    own = _spans(spark, sf_dir)
    return P.containing(own, own).where("id <> other_id").select("topic", "doc", "id", "other_id")


@query(
    sql(
        "windows",
        """ SELECT topic, doc, chunk, lead(score, 1) OVER w AS following, lag(score, 2) OVER w AS two_before FROM windows WINDOW w AS (PARTITION BY topic, doc ORDER BY chunk)""",
    )
)
def relative_neighbours(spark, sf_dir):
    own = P.neighbours(windows(spark, sf_dir), ("topic", "doc"), "chunk", "score", 1, "following")
    return P.neighbours(own, ("topic", "doc"), "chunk", "score", -2, "two_before").select("topic", "doc", "chunk", "following", "two_before")


@query(
    """
WITH r AS (SELECT source AS topic, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
j AS (SELECT unnest(range(0, 32)) AS j)
SELECT DISTINCT topic, doc FROM r JOIN j ON n <= 32 OR pos = (j * (n - 1) * 2 + 31) // 62"""
)
def window_sampling(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"))
    return P.evenly_spaced(rows, ("topic",), "doc", 32)


@query(
    sql(
        "windows",
        """, s AS (SELECT doc, "start", "end", chunk % 2 = 1 AS complete FROM windows),
g AS (SELECT *, coalesce(sum(CAST(complete AS INT)) OVER (PARTITION BY doc ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(CAST(complete AS INT)) OVER (PARTITION BY doc) AS total FROM s)
SELECT doc, CAST(CASE WHEN total = 0 THEN 0 ELSE least(before, total - 1) END AS BIGINT) AS "group", min("start") AS "start", max("end") AS "end", count(*) AS parts FROM g GROUP BY 1, 2""",
    )
)
def merge_incomplete(spark, sf_dir):
    rows = windows(spark, sf_dir).select("doc", "start", "end", (F.col("chunk") % 2 == 1).alias("complete"))
    return P.merge_incomplete(rows).withColumn("group", F.col("group").cast("bigint"))
