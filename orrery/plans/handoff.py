"""Queries: evidence handed to generation, citations, judgments and identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import handoff as H
from orrery.plans.registry import query
from orrery.plans.relations import run, sql, table, windows

# Suppliers as topics, parts as evidence, parts' sizes as groups.
EVIDENCE = """e AS (SELECT DISTINCT 't' || l_suppkey % 20 AS topic, 'e' || l_partkey AS id, 'g' || l_partkey % 7 AS grp, l_partkey AS part, 'd' || l_partkey % 50 AS doc FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT DISTINCT 't' || l_suppkey % 20 AS topic, 'c' || l_partkey % 90 AS id, 'g' || (l_partkey % 90) % 7 AS grp FROM lineitem WHERE l_linenumber = 2)"""


def _evidence(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    p, t = F.col("l_partkey"), name("t", F.col("l_suppkey") % 20).alias("topic")
    e = l.where("l_linenumber = 1").select(t, name("e", p).alias("id"), name("g", p % 7).alias("group"), p.alias("part"), name("d", p % 50).alias("doc")).distinct()
    c = l.where("l_linenumber = 2").select(t, name("c", p % 90).alias("id"), name("g", p % 90 % 7).alias("group")).distinct()
    return e, c


NESTED = (
    "WITH "
    + EVIDENCE
    + """, k AS (SELECT topic, grp, id, row_number() OVER (PARTITION BY topic ORDER BY grp, id) AS ordinal FROM c),
v AS (SELECT topic, grp, id, doc, row_number() OVER (PARTITION BY topic ORDER BY grp, id) AS ordinal FROM e),
g AS (SELECT topic, grp AS id, row_number() OVER (PARTITION BY topic ORDER BY grp) AS ordinal FROM (SELECT DISTINCT topic, grp FROM e))"""
)


@query(NESTED + " SELECT 'group' AS kind, topic, ordinal, id, NULL AS grp, NULL AS doc FROM g UNION ALL SELECT 'evidence', topic, ordinal, id, grp, doc FROM v UNION ALL SELECT 'claim', k.topic, k.ordinal, k.id, k.grp, NULL FROM k WHERE topic IN (SELECT topic FROM e)")
def handoff_round_trip(spark, sf_dir):
    """Topics nested, written as JSON text, read by the schema and laid flat again."""
    e, c = _evidence(spark, sf_dir)
    groups = e.select("topic", F.col("group").alias("id"), F.upper("group").alias("label")).distinct()
    claims = c.withColumn("text", F.lit("claim")).withColumn("evidence", F.array(F.lit("e2"), F.lit("e1")))
    nested = H.generation_topics(groups, e.withColumn("text", F.lit("text")), claims)
    lines = nested.select(F.to_json(F.struct("topic", "groups", "evidence", "claims")).alias("value"))
    read = lines.select(F.from_json("value", H.HANDOFF, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    g, v, k = H.flattened(read)
    none = F.lit(None).cast("string")
    rows = lambda df, kind, grp, doc: df.select(F.lit(kind).alias("kind"), "topic", "ordinal", "id", grp.alias("grp"), doc.alias("doc"))
    return rows(g, "group", none, none).unionByName(rows(v, "evidence", F.col("group"), F.col("doc"))).unionByName(rows(k, "claim", F.col("group"), none))


@query(
    "WITH "
    + EVIDENCE
    + """, s AS (SELECT topic, grp AS cluster, id AS evidence, row_number() OVER (PARTITION BY topic, grp ORDER BY id) - 1 AS pos FROM e UNION ALL SELECT topic, 'zz', min(id), 0 FROM e GROUP BY topic),
n AS (SELECT *, dense_rank() OVER (PARTITION BY topic ORDER BY cluster) AS c, row_number() OVER (PARTITION BY topic ORDER BY cluster, pos) AS e FROM s)
SELECT topic, cluster, 'c' || lpad(CAST(c AS VARCHAR), 3, '0') AS cluster_alias, evidence, 'e' || CASE WHEN e < 1000 THEN lpad(CAST(e AS VARCHAR), 3, '0') ELSE CAST(e AS VARCHAR) END AS evidence_alias,
  CASE WHEN row_number() OVER (PARTITION BY topic, evidence ORDER BY cluster, pos) > 1 THEN 'duplicate evidence' END AS fault FROM n"""
)
def evidence_request_view(spark, sf_dir):
    e, _ = _evidence(spark, sf_dir)
    clusters = e.groupBy("topic", F.col("group").alias("cluster")).agg(F.array_sort(F.collect_list("id")).alias("supports"))
    again = e.groupBy("topic").agg(F.min("id").alias("id")).select("topic", F.lit("zz").alias("cluster"), F.array("id").alias("supports"))
    return H.request_view(clusters.unionByName(again))


@query(
    """WITH p AS (SELECT item_id AS topic, text, [struct_pack(v := 'original', q := text), struct_pack(v := 'facet:a:q1', q := string_split(text, ' ')[1]), struct_pack(v := 'facet:b:q1', q := string_split(text, ' ')[2]),
  struct_pack(v := CASE WHEN item_id % 3 = 0 THEN 'facet:a:q1' ELSE 'facet:a:q2' END, q := string_split(text, ' ')[1])] AS qs FROM benchmark),
u AS (SELECT topic, unnest(qs) AS q, generate_subscripts(qs, 1) - 1 AS query_order FROM p)
SELECT topic, dense_rank() OVER (ORDER BY topic) - 1 AS topic_order, query_order, q.v AS variant, CASE WHEN q.v LIKE 'facet:%' THEN split_part(q.v, ':', 2) END AS facet, sha256(q.q) AS digest,
  CASE WHEN row_number() OVER (PARTITION BY topic, q.v, q.q ORDER BY query_order) > 1 THEN 'repeated query' END AS fault FROM u"""
)
def planner_records(spark, sf_dir):
    word = lambda k: F.get(F.split("text", " "), F.lit(k))
    q = lambda v, t: F.struct(v.alias("variant"), t.alias("query"))
    last = F.when(F.col("item_id") % 3 == 0, "facet:a:q1").otherwise("facet:a:q2")
    plans = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), F.array(q(F.lit("original"), F.col("text")), q(F.lit("facet:a:q1"), word(0)), q(F.lit("facet:b:q1"), word(1)), q(last, word(0))).alias("queries"))
    return H.planner_records(plans)


@query(
    "WITH "
    + EVIDENCE
    + """, k AS (SELECT topic, id, grp, row_number() OVER (PARTITION BY topic ORDER BY id) AS n FROM c), o AS (SELECT t.topic, o.obligation, CASE WHEN o.obligation % 2 = 0 THEN 'must' ELSE 'should' END AS priority FROM (SELECT DISTINCT topic FROM c) t CROSS JOIN (SELECT unnest(range(1, 6)) AS obligation) o),
m AS (SELECT o.topic, o.obligation, o.priority, k.id, k.grp, k.n FROM o JOIN k ON k.topic = o.topic AND k.n % 7 = o.obligation),
x AS (SELECT DISTINCT m.topic, m.obligation, e.id, e.part FROM m JOIN e ON e.topic = m.topic AND CASE WHEN m.priority = 'must' THEN e.grp = m.grp ELSE e.part % 90 = CAST(m.id[2:] AS INT) AND e.part % 3 = 0 END),
a AS (SELECT topic, id, 'e' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS alias FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY part) AS r FROM (SELECT DISTINCT topic, id, part FROM x)))
SELECT o.topic, o.obligation, coalesce(string_agg(x.id, ',' ORDER BY x.part), '') AS evidence, coalesce(string_agg(a.alias, ',' ORDER BY x.part), '') AS aliases
FROM o LEFT JOIN x ON x.topic = o.topic AND x.obligation = o.obligation LEFT JOIN a ON a.topic = x.topic AND a.id = x.id GROUP BY o.topic, o.obligation"""
)
def blueprint_projection(spark, sf_dir):
    e, c = _evidence(spark, sf_dir)
    evidence = e.select("topic", F.col("part").alias("place"), "id", "group")
    n = F.row_number().over(Window.partitionBy("topic").orderBy("id"))
    named = e.where("part % 3 = 0").groupBy("topic", F.concat(F.lit("c"), (F.col("part") % 90).cast("string")).alias("id")).agg(F.collect_list(F.col("id")).alias("evidence"))
    k = c.withColumn("n", n).join(named, ["topic", "id"], "left").withColumn("alias", F.concat(F.lit("k"), F.col("n").cast("string")))
    claims = k.select("topic", "alias", "group", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    asked = k.withColumn("obligation", F.col("n") % 7).groupBy("topic", "obligation").agg(F.collect_list("alias").alias("aliases"))
    every = c.select("topic").distinct().join(spark.range(1, 6).select(F.col("id").alias("obligation")))
    rows = every.join(asked, ["topic", "obligation"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    out = H.projected(rows.withColumn("priority", F.when(F.col("obligation") % 2 == 0, "must").otherwise("should")), claims, evidence)
    return out.select("topic", "obligation", F.array_join("evidence", ",").alias("evidence"), F.array_join("aliases", ",").alias("aliases"))


@query(
    sql(
        "run",
        """, a AS (SELECT topic, rank AS sentence, unnest([doc, doc + 1, doc]) AS doc, unnest([0, 1, 2]) AS place FROM run WHERE rank <= 40)
SELECT a.topic, a.sentence, a.place, a.doc, length(d.text) AS chars, CASE WHEN d.doc_id IS NULL OR d.text IS NULL THEN 'missing text' END AS fault FROM a LEFT JOIN documents d ON d.source = a.topic AND d.doc_id = a.doc""",
    )
)
def citations_with_text(spark, sf_dir):
    own = run(spark, sf_dir).where("rank <= 40").select("topic", F.col("rank").alias("sentence"), F.array(F.col("doc"), F.col("doc") + 1, F.col("doc")).alias("citations"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), "text")
    out = H.cited_texts(own, docs)
    return out.select("topic", "sentence", "place", "doc", F.length("text").cast("bigint").alias("chars"), "fault")


@query(
    """WITH b AS (SELECT item_id AS topic FROM benchmark), j AS (SELECT topic, place, place + (topic + place) % 2 * (place = 4)::INT AS ob, ['full', 'partial', 'unsupported', 'odd'][CASE WHEN (topic * 3 + place) % 11 = 0 THEN 4 ELSE (topic + place) % 3 + 1 END] AS label,
  CASE WHEN (topic + place) % 3 = 2 THEN (topic + place) % 5 ELSE 1 + (topic + place) % 5 END % 5 AS n, CASE WHEN (topic + place) % 3 = 0 AND topic % 7 <> 0 THEN '' WHEN topic % 13 = 0 THEN '  ' ELSE 'more' END AS missing FROM b CROSS JOIN (SELECT unnest(range(1, 7)) AS place) WHERE NOT (place = 6 AND topic % 4 = 0)),
s AS (SELECT j.*, row_number() OVER (PARTITION BY topic, ob ORDER BY place) AS copy FROM j), a AS (SELECT s.*, list_transform(range(1, n + 1), lambda k: CASE WHEN k = 4 THEN (topic % 6) + 1 ELSE k END) AS ks FROM s),
w AS (SELECT topic, unnest(range(1, 7)) AS ob FROM b)
SELECT coalesce(a.topic, w.topic) AS topic, coalesce(a.ob, w.ob) AS obligation, label, f.fault, CASE WHEN f.fault IS NULL THEN array_to_string(list_transform(ks, lambda k: 'nugget' || k), ',') END AS nuggets
FROM a FULL JOIN w ON a.topic = w.topic AND a.ob = w.ob, LATERAL (SELECT CASE WHEN a.copy IS NULL THEN 'unjudged' WHEN w.ob IS NULL THEN 'unknown obligation' WHEN a.copy > 1 THEN 'repeated obligation' WHEN label = 'odd' THEN 'label'
  WHEN len(list_filter(ks, lambda k: k > 5)) > 0 THEN 'unknown alias' WHEN len(list_distinct(ks)) < len(ks) THEN 'repeated alias' WHEN label = 'unsupported' AND n > 0 THEN 'support of the unsupported' WHEN label <> 'unsupported' AND n = 0 THEN 'no support'
  WHEN (label = 'full') <> (missing = '') THEN 'missing elements' WHEN label <> 'full' AND trim(missing) = '' THEN 'missing elements' END AS fault) f"""
)
def judgment_aliases(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"))
    t, p = F.col("topic"), F.col("place")
    m = (t + p) % 3
    n = F.when(m == 2, (t + p) % 5).otherwise(1 + (t + p) % 5) % 5
    label = F.element_at(F.array(*map(F.lit, (*H.LABELS, "odd"))), F.when((t * 3 + p) % 11 == 0, 4).otherwise(m + 1).cast("int"))
    aliases = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.when(k <= n, H.alias("n", F.when(k == 4, t % 6 + 1).otherwise(k)))), lambda a: a.isNotNull())
    missing = F.when((m == 0) & (t % 7 != 0), "").when(t % 13 == 0, "  ").otherwise("more")
    rows = b.join(spark.range(1, 7).select(F.col("id").alias("place"))).where(~((p == 6) & (t % 4 == 0)))
    judgments = rows.select("topic", "place", (p + (t + p) % 2 * (p == 4).cast("int")).alias("obligation"), label.alias("label"), aliases.alias("aliases"), missing.alias("missing"))
    five = b.join(spark.range(1, 6).select(F.col("id").alias("place"))).withColumn("nugget", F.concat(F.lit("nugget"), p.cast("string")))
    out = H.resolved_judgments(b.join(spark.range(1, 7).select(F.col("id").alias("obligation"))), judgments, five)
    return out.withColumn("nuggets", F.array_join("nuggets", ","))


@query(
    """SELECT a.c_custkey AS k, CASE WHEN b.c_custkey IS NULL THEN 'missing' WHEN a.c_custkey % 9 = 0 THEN 'segment' ELSE 'nation' END AS fault FROM customer a LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) b USING (c_custkey)
WHERE b.c_custkey IS NULL OR a.c_custkey % 9 = 0 OR (a.c_custkey % 5 = 0 AND a.c_nationkey IS NOT NULL)"""
)
def member_identity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    other = c.where("k % 13 <> 0").withColumn("segment", F.when(F.col("k") % 9 == 0, "OTHER").otherwise(F.col("segment"))).withColumn("nation", F.when(F.col("k") % 5 != 0, F.col("nation")))
    return H.identity_faults(other, c, ["k"])


@query(
    sql(
        "run",
        """, r AS (SELECT topic, doc, rank + CAST(doc % 47 = 0 AS INT) AS rank, count(*) OVER (PARTITION BY topic) - rank + 1 + CAST(doc % 43 = 0 AS INT) AS score, CASE WHEN doc % 41 = 0 THEN doc + 1000000 ELSE doc END AS d FROM run),
p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rank, d) AS place, count(*) OVER (PARTITION BY topic) AS n FROM r)
SELECT p.topic, p.d AS doc, p.rank, CASE WHEN p.rank <> place THEN 'rank' WHEN score <> n - p.rank + 1 THEN 'score' WHEN t.doc_id IS NULL THEN 'unknown document' WHEN t.doc_id % 37 = 0 OR t.text IS NULL OR t.text = '' THEN 'empty text' WHEN t.doc_id % 31 = 0 THEN 'digest' END AS fault,
  CASE WHEN p.rank = place AND score = n - p.rank + 1 AND t.doc_id IS NOT NULL AND t.doc_id % 37 <> 0 AND coalesce(t.text, '') <> '' AND t.doc_id % 31 <> 0 THEN length(t.text) END AS chars FROM p LEFT JOIN documents t ON t.doc_id = p.d""",
    )
)
def ranked_stored_texts(spark, sf_dir):
    d = F.col("doc")
    n = F.count(F.lit(1)).over(Window.partitionBy("topic"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 37 != 0, F.col("text")).alias("text"))
    digests = docs.select("doc", F.when(d % 31 == 0, "stale").otherwise(F.sha2("text", 256)).alias("digest"))
    own = run(spark, sf_dir).join(digests, "doc").withColumn("score", n - F.col("rank") + 1 + (d % 43 == 0).cast("int")).withColumn("rank", F.col("rank") + (d % 47 == 0).cast("int"))
    out = H.stored_texts(own.withColumn("doc", F.when(d % 41 == 0, d + 1000000).otherwise(d)).select("topic", "doc", "rank", "score", "digest"), docs)
    return out.select("topic", "doc", "rank", "fault", F.length("text").cast("bigint").alias("chars"))


@query(
    sql(
        "run",
        """, a AS (SELECT topic, doc FROM run UNION ALL SELECT topic, doc FROM run WHERE doc % 100 = 1), b AS (SELECT topic, doc FROM run WHERE topic <> 'src4' OR doc % 3 <> 0),
x AS (SELECT topic, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY topic), y AS (SELECT topic, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY topic)
SELECT coalesce(x.topic, y.topic) AS topic, coalesce(x.n, 0) AS only_a, coalesce(y.n, 0) AS only_b FROM x FULL JOIN y ON x.topic = y.topic""",
    )
)
def pool_equality(spark, sf_dir):
    own = run(spark, sf_dir).select("topic", "doc")
    return H.pool_differences(own.unionAll(own.where("doc % 100 = 1")), own.where("topic <> 'src4' OR doc % 3 <> 0"))


@query(
    """WITH s AS (SELECT o_orderpriority AS topic, 'r' || o_custkey % 5 AS run, round(avg(o_totalprice), 4) AS value, median(o_totalprice) AS med FROM orders GROUP BY ALL),
x AS (SELECT l_shipmode AS topic, 'r' || l_suppkey % 4 AS run, count(*) FILTER (l_returnflag = 'A') AS wins, count(*) FILTER (l_returnflag = 'N') AS ties, count(*) FILTER (l_returnflag = 'R') AS losses FROM (SELECT *, ['1-URGENT', '2-HIGH', '5-LOW'][l_linenumber % 3 + 1] AS l_shipmode FROM (SELECT l_linenumber, l_suppkey, l_returnflag FROM lineitem)) GROUP BY ALL)
SELECT s.topic, s.run, s.value, round(s.med, 4) AS med, x.wins, x.ties, x.losses FROM s LEFT JOIN x USING (topic, run)"""
)
def scores_side_by_side(spark, sf_dir):
    name = lambda n: F.concat(F.lit("r"), n.cast("string")).alias("run")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("topic"), name(F.col("o_custkey") % 5)).agg(F.round(F.avg("o_totalprice"), 4).alias("value"), F.round(F.median("o_totalprice"), 4).alias("med"))
    topic = F.element_at(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW")), F.col("l_linenumber") % 3 + 1)
    count = lambda flag: F.sum((F.col("l_returnflag") == flag).cast("bigint"))
    x = table(spark, sf_dir, "lineitem").groupBy(topic.alias("topic"), name(F.col("l_suppkey") % 4)).agg(count("A").alias("wins"), count("N").alias("ties"), count("R").alias("losses"))
    return s.join(x, ["topic", "run"], "left")


@query(sql("windows", """ SELECT doc, chunk, "start", "end" FROM windows w WHERE chunk % 4 = 3 AND NOT EXISTS (SELECT 1 FROM windows p WHERE p.doc = w.doc AND p.chunk % 4 = 1 AND w."start" < p."end" AND p."start" < w."end")"""))
def passages_outside_paragraphs(spark, sf_dir):
    own = windows(spark, sf_dir).select("doc", "chunk", "start", "end")
    return H.outside_paragraphs(own.where("chunk % 4 = 3"), own.where("chunk % 4 = 1"))


@query(
    """WITH r AS (SELECT sha256(CAST(l_orderkey AS VARCHAR)) AS q, sha256(CAST(l_suppkey % 3 AS VARCHAR)) AS t, l_linenumber - 1 AS chunk, round(l_discount, 2) AS score FROM lineitem),
o AS (SELECT q, t, chunk, min(score) <> max(score) AS torn FROM r GROUP BY ALL)
SELECT q AS query, t AS text, count(*) AS chunks, CASE WHEN bool_or(torn) THEN 'conflicting scores' WHEN min(chunk) <> 0 OR max(chunk) <> count(*) - 1 THEN 'chunks with gaps' END AS fault FROM o GROUP BY q, t"""
)
def score_identities(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    digest = lambda c: F.sha2(c.cast("string"), 256)
    return H.score_identity(l.select(digest(F.col("l_orderkey")).alias("query_sha256"), digest(F.col("l_suppkey") % 3).alias("text_sha256"), (F.col("l_linenumber") - 1).alias("chunk"), F.round("l_discount", 2).alias("score")))


@query(
    """WITH a AS (SELECT l_orderkey % 900 AS topic, count(*) AS times FROM lineitem WHERE l_linenumber = 7 GROUP BY 1), o AS (SELECT c_custkey AS topic, row_number() OVER (ORDER BY c_custkey % 10, c_custkey) AS place FROM customer WHERE c_custkey <= 800)
SELECT topic, place, CASE WHEN place IS NULL THEN 'unknown topic' WHEN times > 1 THEN 'repeated topic' END AS fault FROM a LEFT JOIN o USING (topic)"""
)
def topic_selection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey <= 800")
    official = c.select(F.col("c_custkey").alias("topic"), F.row_number().over(Window.orderBy(F.col("c_custkey") % 10, "c_custkey")).cast("bigint").alias("place"))
    return H.selected_topics(official, table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select((F.col("l_orderkey") % 900).alias("topic")))


@query(
    """WITH l AS (SELECT l_suppkey % 20 AS topic, l_partkey % 15 AS ob, l_partkey % 15 % 2 = 0 AS req, sum(l_linenumber) AS x, sum(l_orderkey) AS y FROM lineitem WHERE l_quantity < 20 GROUP BY ALL),
w AS (SELECT topic, ob, req, (x % 3) / 2.0 AS a, (y % 3) / 2.0 AS b FROM l),
p AS (SELECT topic, coalesce(avg(a) FILTER (req), 0) AS ra, coalesce(avg(b) FILTER (req), 0) AS rb, avg(CAST(a = 1 AS INT)) AS sa, avg(CAST(b = 1 AS INT)) AS sb FROM w GROUP BY topic)
SELECT CAST(topic AS VARCHAR) AS topic, CAST(ob AS VARCHAR) AS obligation, 'obligation' AS gate FROM w WHERE b < a UNION ALL SELECT CAST(topic AS VARCHAR), NULL, 'required' FROM p WHERE rb < ra UNION ALL SELECT CAST(topic AS VARCHAR), NULL, 'strict' FROM p WHERE sb < sa
UNION ALL SELECT NULL, NULL, 'macro required' FROM p HAVING avg(rb) < avg(ra) UNION ALL SELECT NULL, NULL, 'macro strict' FROM p HAVING avg(sb) < avg(sa)"""
)
def semantic_gates(spark, sf_dir):
    ob = F.col("l_partkey") % 15
    own = table(spark, sf_dir, "lineitem").where("l_quantity < 20").groupBy((F.col("l_suppkey") % 20).alias("topic"), ob.alias("obligation"), (ob % 2 == 0).alias("required")).agg(F.sum("l_linenumber").alias("x"), F.sum("l_orderkey").alias("y"))
    label = lambda c: F.element_at(F.array(F.lit("unsupported"), F.lit("partial"), F.lit("full")), (F.col(c) % 3 + 1).cast("int"))
    side = lambda c: own.select("topic", "obligation", "required", label(c).alias("label"))
    return H.semantic_gates(side("x"), side("y"))
