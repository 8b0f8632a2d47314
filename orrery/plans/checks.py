"""Queries: which rows of runs, judgments and rubrics break which rule, and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import checks as C
from orrery.operators.ranking import ordinals
from orrery.plans.registry import query
from orrery.plans.relations import qrels, run, sql, table

# Lines of a run file in which some lines break some rule, by number.
LINES = """, o AS (SELECT *, row_number() OVER (ORDER BY topic, rank) AS line FROM run),
l AS (SELECT line, topic, CASE WHEN line % 97 = 0 THEN 'Q1' ELSE 'Q0' END AS q, CASE WHEN line % 89 = 0 THEN 'd0' ELSE 'd' || doc END AS doc,
  CASE WHEN line % 83 = 0 THEN 'x' WHEN line % 79 = 0 THEN CAST(rank + 1 AS VARCHAR) ELSE CAST(rank AS VARCHAR) END AS rank,
  CASE WHEN line % 73 = 0 THEN 'nan' WHEN line % 71 = 0 THEN CAST(CAST(score AS BIGINT) + 100000 AS VARCHAR) ELSE CAST(CAST(score AS BIGINT) AS VARCHAR) END AS score,
  CASE WHEN line % 67 = 0 THEN 'other' ELSE 'own' END AS tag, line % 61 = 0 AS torn FROM o)"""


@query(
    sql(
        "run",
        LINES
        + """, w AS (SELECT *, row_number() OVER t AS place, lag(CASE WHEN score <> 'nan' THEN CAST(score AS DOUBLE) ELSE 'nan'::DOUBLE END) OVER t AS before, row_number() OVER (PARTITION BY topic, doc ORDER BY line) AS copy FROM l WHERE NOT torn WINDOW t AS (PARTITION BY topic ORDER BY line)),
x AS (SELECT line, topic, CASE WHEN q <> 'Q0' THEN 'second field' WHEN rank = 'x' THEN 'rank' WHEN score = 'nan' THEN 'score' WHEN CAST(rank AS BIGINT) <> place THEN 'rank order'
  WHEN copy > 1 THEN 'repeated document' WHEN tag <> (SELECT arg_min(tag, line) FROM l WHERE NOT torn) THEN 'tag' WHEN NOT isnan(before) AND CAST(score AS DOUBLE) > before THEN 'rising score' END AS fault FROM w)
SELECT line, topic, fault FROM x WHERE fault IS NOT NULL UNION ALL SELECT line, NULL, 'fields' FROM l WHERE torn
UNION ALL SELECT NULL, source, 'unexpected topic' FROM documents GROUP BY source HAVING source = 'src1' UNION ALL SELECT NULL, 'nowhere', 'missing topic'""",
    )
)
def strict_run_faults(spark, sf_dir):
    own = ordinals(run(spark, sf_dir), F.col("topic"), "rank").withColumnRenamed("ordinal", "line")
    n = lambda k: F.col("line") % k == 0
    whole = F.col("score").cast("bigint")
    value = F.concat_ws(
        " ", "topic", F.when(n(97), "Q1").otherwise("Q0"), F.when(n(89), "d0").otherwise(F.concat(F.lit("d"), F.col("doc").cast("string"))),
        F.when(n(83), "x").when(n(79), (F.col("rank") + 1).cast("string")).otherwise(F.col("rank").cast("string")),
        F.when(n(73), "nan").when(n(71), (whole + 100000).cast("string")).otherwise(whole.cast("string")),
        F.when(n(61), F.lit(None)).otherwise(F.when(n(67), "other").otherwise("own")),
    )
    topics = own.select("topic").distinct().where("topic <> 'src1'").unionByName(spark.sql("SELECT 'nowhere' AS topic"))
    return C.run_faults(own.select("line", value.alias("value")), topics)


@query(
    sql(
        "run qrels",
        """, o AS (SELECT topic, doc, rank - CAST(doc % 50 = 0 AS INT) AS rank FROM run WHERE topic IN (SELECT topic FROM qrels WHERE grade >= 2))
SELECT topic, doc, rank, row_number() OVER (PARTITION BY topic ORDER BY rank, doc) AS place, count(*) OVER (PARTITION BY topic, rank) > 1 AS clash FROM o""",
    )
)
def judged_topics_run(spark, sf_dir):
    own = run(spark, sf_dir).withColumn("rank", F.col("rank") - (F.col("doc") % 50 == 0).cast("int"))
    return C.judged_run(own, qrels(spark, sf_dir).where("grade >= 2"))


@query(
    """WITH l AS (SELECT row_number() OVER (ORDER BY source, doc_id) AS line, source AS topic, CASE WHEN doc_id % 53 = 0 THEN 7 ELSE doc_id END AS doc,
  CASE WHEN doc_id % 41 = 0 THEN '5' WHEN doc_id % 37 = 0 THEN '1.5' ELSE CAST(doc_id % 5 AS VARCHAR) END AS grade FROM documents),
m AS (SELECT line, CASE WHEN line % 101 = 0 THEN 'src0' WHEN line % 103 = 0 THEN 'lost' ELSE topic END AS topic, doc, grade FROM l),
t AS (SELECT topic, list_position((SELECT list(DISTINCT source ORDER BY source) FROM documents), topic) AS pos FROM m GROUP BY topic),
o AS (SELECT m.*, t.pos, row_number() OVER (PARTITION BY m.topic, doc ORDER BY line) AS copy FROM m JOIN t USING (topic)),
p AS (SELECT o.*, (SELECT max(b.line) FROM o b WHERE b.pos < o.pos) AS passed FROM o)
SELECT line, CASE WHEN pos IS NULL THEN 'topic' WHEN grade IN ('5', '1.5') THEN 'grade' WHEN copy > 1 THEN 'repeated document' ELSE 'topic order' END AS fault
FROM p WHERE pos IS NULL OR grade IN ('5', '1.5') OR copy > 1 OR passed > line"""
)
def strict_qrels_faults(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    grade = F.when(i % 41 == 0, "5").when(i % 37 == 0, "1.5").otherwise((i % 5).cast("string"))
    lines = ordinals(d.select("source", "doc_id"), F.col("source"), "doc_id")
    own = lines.select(F.col("ordinal").alias("line"), "source", F.when(i % 53 == 0, 7).otherwise(i).alias("doc"), grade.alias("grade"))
    own = own.select("line", F.when(F.col("line") % 101 == 0, "src0").when(F.col("line") % 103 == 0, "lost").otherwise(F.col("source")).alias("topic"), "doc", "grade")
    order = [r[0] for r in d.select("source").distinct().orderBy("source").collect()]  # the population's topics
    return C.qrels_faults(own, order)


@query(
    sql(
        "qrels",
        """, t AS (SELECT DISTINCT topic FROM qrels WHERE topic <> 'src2'), p AS (SELECT topic, doc, grade FROM qrels WHERE topic <> 'src3')
SELECT (SELECT count(*) FROM p) AS rows, (SELECT count(*) FROM (SELECT DISTINCT topic FROM p WHERE topic NOT IN (SELECT topic FROM t))) AS extra_topics,
  (SELECT count(*) FROM t WHERE topic NOT IN (SELECT topic FROM p)) AS missing_topics,
  NOT EXISTS (SELECT * FROM p EXCEPT ALL SELECT * FROM qrels WHERE topic IN (SELECT topic FROM t)) AND NOT EXISTS (SELECT topic, doc, grade FROM qrels WHERE topic IN (SELECT topic FROM t) EXCEPT ALL SELECT * FROM p) AS same_rows""",
    )
)
def projection_validation(spark, sf_dir):
    own = qrels(spark, sf_dir)
    return C.projection_faults(own.where("topic <> 'src3'"), own, own.where("topic <> 'src2'").select("topic"))


ITEMS = """WITH i AS (SELECT 'r' || l_suppkey % 4 AS run, l_orderkey % 30 AS topic, row_number() OVER (PARTITION BY l_suppkey % 4, l_orderkey % 30 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place,
  CASE WHEN l_linenumber % 3 = 0 THEN 'vital' ELSE 'okay' END AS importance, CAST(l_returnflag = 'R' AS INT) AS met FROM lineitem WHERE (l_suppkey % 4) * 30 + l_orderkey % 30 <> 47)"""


def _items(spark, sf_dir):
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    run, topic = F.col("l_suppkey") % 4, F.col("l_orderkey") % 30
    place = F.row_number().over(Window.partitionBy(run, topic).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return l.where(run * 30 + topic != 47).select(
        F.concat(F.lit("r"), run.cast("string")).alias("run"), topic.alias("topic"), place.alias("place"),
        F.when(F.col("l_linenumber") % 3 == 0, "vital").otherwise("okay").alias("importance"), (F.col("l_returnflag") == "R").cast("int").alias("met"),
    )


@query(
    ITEMS
    + """, s AS (SELECT run, topic, coalesce(sum(met) FILTER (importance = 'vital') / nullif(count(*) FILTER (importance = 'vital'), 0), 0) AS v, sum(met) / count(*) AS a FROM i GROUP BY ALL),
g AS (SELECT r.run, CAST(t.topic AS VARCHAR) AS topic, coalesce(s.v, 0) AS v, coalesce(s.a, 0) AS a, s.v IS NOT NULL AS assigned FROM (SELECT DISTINCT run FROM i) r CROSS JOIN (SELECT unnest(range(0, 31)) AS topic) t LEFT JOIN s ON s.run = r.run AND s.topic = t.topic)
SELECT run, topic, round(v, 9) AS vital_strict, round(a, 9) AS all_strict, assigned FROM g UNION ALL SELECT run, 'all', round(avg(v), 9), round(avg(a), 9), bool_and(assigned) FROM g GROUP BY run"""
)
def rubric_completeness(spark, sf_dir):
    own = _items(spark, sf_dir)
    out = C.rubric_assignments(own, own, spark.range(31).select(F.col("id").alias("topic")))
    return out.withColumns({c: F.round(c, 9) for c in ("vital_strict", "all_strict")})


@query(
    ITEMS
    + """, t AS (SELECT run, topic, string_agg(place || ':' || CASE WHEN topic % 3 = 0 THEN 'same' ELSE importance END, ',' ORDER BY place) AS t FROM i WHERE place <= 5 GROUP BY ALL)
SELECT topic, count(DISTINCT t) AS templates FROM t GROUP BY topic HAVING count(DISTINCT t) > 1"""
)
def rubric_templates(spark, sf_dir):
    own = _items(spark, sf_dir).where("place <= 5").withColumn("text", F.lit("item"))
    return C.template_faults(own.withColumn("importance", F.when(F.col("topic") % 3 == 0, "same").otherwise(F.col("importance"))))


@query(
    """WITH d AS (SELECT l_suppkey % 12 AS a, l_orderkey % 25 AS topic, round(avg(l_discount), 4) - 0.049 AS delta FROM lineitem GROUP BY ALL),
m AS (SELECT 'arm' || a AS arm, count(*) FILTER (delta < -0.02) AS l2, count(*) FILTER (delta < -0.015) AS l5, count(*) FILTER (delta < -0.01) AS l1, round(sum(delta), 6) AS pooled, round(avg(delta), 6) AS macro,
  count(*) FILTER (delta > 0) AS wins, CASE WHEN a % 4 <> 0 THEN round(avg(delta) - 0.0005, 6) END AS ci, CASE WHEN a % 3 <> 0 THEN round(abs(avg(delta)) * 20, 6) END AS p, CASE WHEN a % 7 <> 0 THEN a % 5 <> 0 END AS prefix, CASE WHEN a % 11 <> 0 THEN round(max(delta), 6) - 0.001 END AS judged FROM d GROUP BY a),
g AS (SELECT arm, [['no_losses_250', CAST(l2 = 0 AS VARCHAR)], ['no_losses_500', CAST(l5 = 0 AS VARCHAR)], ['no_losses_1000', CAST(l1 = 0 AS VARCHAR)], ['pooled_gain', CAST(pooled > 0 AS VARCHAR)], ['macro_gain', CAST(macro > 0 AS VARCHAR)], ['enough_wins', CAST(wins >= 8 AS VARCHAR)],
  ['significant', CAST(coalesce(ci > 0, false) OR coalesce(p < 0.05, false) AS VARCHAR)], ['same_prefix', CAST(coalesce(prefix, false) AS VARCHAR)], ['judged_no_worse', CAST(coalesce(judged >= 0, false) AS VARCHAR)]] AS c FROM m WHERE arm <> 'arm0'),
h AS (SELECT arm, list_transform(list_filter(c, lambda x: x[2] = 'false'), lambda x: x[1]) AS failed FROM g),
b AS (SELECT first(arm ORDER BY list_position(['arm7', 'arm3', 'arm1', 'arm9', 'arm2', 'arm4', 'arm6', 'arm8', 'arm11'], arm)) AS best FROM h WHERE len(failed) = 0 AND arm NOT IN ('arm5', 'arm10'))
SELECT arm, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed, coalesce(best, 'arm0') AS selected FROM h CROSS JOIN b WHERE arm NOT IN ('arm5', 'arm10')"""
)
def promotion_rules(spark, sf_dir):
    l, n = table(spark, sf_dir, "lineitem"), F.col("a")  # noqa: E741
    d = l.groupBy((F.col("l_suppkey") % 12).alias("a"), (F.col("l_orderkey") % 25).alias("topic")).agg((F.round(F.avg("l_discount"), 4) - 0.049).alias("delta"))
    below = lambda x: F.sum((F.col("delta") < x).cast("bigint"))
    m = d.groupBy("a").agg(
        below(-0.02).alias("losses_250"), below(-0.015).alias("losses_500"), below(-0.01).alias("losses_1000"), F.round(F.sum("delta"), 6).alias("pooled_delta"),
        F.round(F.avg("delta"), 6).alias("macro_delta"), F.sum((F.col("delta") > 0).cast("bigint")).alias("wins"), F.avg("delta").alias("mean"), F.max("delta").alias("most"),
    )
    arms = m.withColumns(
        {
            "arm": F.concat(F.lit("arm"), n.cast("string")), "ci_low": F.when(n % 4 != 0, F.round(F.col("mean") - 0.0005, 6)), "p": F.when(n % 3 != 0, F.round(F.abs("mean") * 20, 6)),
            "same_prefix": F.when(n % 7 != 0, n % 5 != 0), "judged_delta": F.when(n % 11 != 0, F.round("most", 6) - 0.001),
        }
    )
    out = C.promotion(arms, [f"arm{k}" for k in (7, 3, 1, 9, 2, 4, 6, 8, 11)], "arm0")
    return out.withColumn("failed", F.array_join("failed", ","))
