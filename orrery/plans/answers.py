"""Queries: answers, citations, judged coverage.

``conversations`` serve as answers: topic = conversation, sentence = turn; citations and
judgments are made from hashes of ids, so that both engines make the same ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import answers as A
from orrery.operators import judged as J
from orrery.plans.registry import query
from orrery.plans.relations import qrels, run, sql, table

SENTENCES = "s AS (SELECT conv_id AS topic, turn AS idx, text FROM conversations)"
CITED = SENTENCES + """, p AS (SELECT unnest([0, 1, 2]) AS place), c AS (SELECT topic, idx AS sentence, place, (topic * 31 + idx * 17 + place * 7 + (idx * place) % 3) % 23 AS doc
  FROM s CROSS JOIN p WHERE (topic + idx + place) % 4 <> 0)"""


def sentences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("topic"), F.col("turn").alias("idx"), "text")


def citations(spark, sf_dir):
    own = sentences(spark, sf_dir).select("topic", F.col("idx").alias("sentence"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)])).alias("place"))
    doc = (F.col("topic") * 31 + F.col("sentence") * 17 + F.col("place") * 7 + (F.col("sentence") * F.col("place")) % 3) % 23
    return own.withColumn("doc", doc).where("(topic + sentence + place) % 4 <> 0")


def _words(text: str = "text") -> str:
    own = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {own} = '' THEN 0 ELSE len(string_split({own}, ' ')) END"


@query(
    f"WITH {SENTENCES}, w AS (SELECT *, {_words()} AS words FROM s), r AS (SELECT *, CAST(sum(words) OVER (PARTITION BY topic ORDER BY idx) AS BIGINT) AS running FROM w) "
    "SELECT topic, idx, words, running FROM r WHERE running <= 200"
)
def word_budget_trim(spark, sf_dir):
    return A.trim_to_budget(sentences(spark, sf_dir), 200).drop("text")


FIRST = """, f AS (SELECT topic, doc, min(struct_pack(a := sentence, b := place)) AS first FROM c GROUP BY ALL),
r AS (SELECT topic, doc, row_number() OVER (PARTITION BY topic ORDER BY first, doc) - 1 AS number FROM f)"""


@query(
    f"WITH {CITED}{FIRST}"
    + """, d AS (SELECT topic, sentence, doc, min(place) AS place FROM c GROUP BY ALL)
SELECT topic, sentence, row_number() OVER (PARTITION BY topic, sentence ORDER BY place, doc) - 1 AS place, doc, number FROM d JOIN r USING (topic, doc)"""
)
def citation_normalise(spark, sf_dir):
    return A.normalise_citations(citations(spark, sf_dir))[0]


@query(f"WITH {CITED}{FIRST} SELECT * FROM r")
def citation_references(spark, sf_dir):
    return A.normalise_citations(citations(spark, sf_dir))[1]


@query(
    f"""WITH {CITED}, x AS (SELECT topic, doc FROM c UNION SELECT topic, 99 FROM s WHERE topic % 3 = 0),
n AS (SELECT s.topic, s.idx, {_words()} AS words, count(DISTINCT c.doc) AS n FROM s LEFT JOIN c ON c.topic = s.topic AND c.sentence = s.idx GROUP BY s.topic, s.idx, s.text),
u AS (SELECT topic, count(*) AS unused FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.topic = x.topic AND c.doc = x.doc) GROUP BY topic)
SELECT topic, CAST(sum(words) AS BIGINT) AS words, sum(words) > 300 AS over, count(*) FILTER (n > 2) AS too_many, count(*) FILTER (n = 0) AS uncited, coalesce(any_value(unused), 0) AS unused
FROM n LEFT JOIN u USING (topic) GROUP BY topic"""
)
def answer_validation(spark, sf_dir):
    own, cited = sentences(spark, sf_dir), citations(spark, sf_dir)
    references = cited.select("topic", "doc").union(own.where("topic % 3 = 0").select("topic", F.lit(99).cast("bigint").alias("doc"))).distinct()
    return A.answer_faults(own, cited, references, 300, 2)


@query(f"WITH {CITED}, l AS (SELECT DISTINCT topic, doc FROM (SELECT topic, unnest(range(0, 23)) AS doc FROM s)) SELECT * FROM l WHERE EXISTS (SELECT 1 FROM c WHERE c.topic = l.topic AND c.doc = l.doc)")
def grounded_documents(spark, sf_dir):
    own = sentences(spark, sf_dir).select("topic", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(22).cast("bigint"))).alias("doc")).distinct()
    return A.grounded(own, citations(spark, sf_dir))


OPS = SENTENCES + """, e AS (SELECT topic, max(idx) AS e FROM s GROUP BY topic),
ops AS (SELECT topic, 0 AS op, 0 AS first, 1 AS last FROM e UNION ALL SELECT topic, 1, topic % 3, topic % 3 FROM e UNION ALL SELECT topic, 2, 3, 40 FROM e UNION ALL SELECT topic, 3, 3, 3 FROM e),
o AS (SELECT ops.*, e.e, max(last) OVER (PARTITION BY topic ORDER BY first, last, op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (PARTITION BY topic ORDER BY first, last, op) AS place FROM ops JOIN e USING (topic)),
j AS (SELECT *, CASE WHEN last > e THEN 'range' WHEN before >= first THEN 'overlap' WHEN place > 6 THEN 'limit' END AS reason FROM o)"""


def _operations(spark, sf_dir):
    topics = sentences(spark, sf_dir).select("topic").distinct()
    third = F.col("topic") % 3
    op = lambda k, a, b: F.struct(F.lit(k).alias("op"), a.cast("bigint").alias("first"), b.cast("bigint").alias("last"), F.concat(F.lit("edit "), F.lit(str(k))).alias("text"))
    return topics.select("topic", F.inline(F.array(op(0, F.lit(0), F.lit(1)), op(1, third, third), op(2, F.lit(3), F.lit(40)), op(3, F.lit(3), F.lit(3)))))


@query(
    f"WITH {OPS}, g AS (SELECT * FROM j WHERE reason IS NULL), h AS (SELECT s.topic, s.idx, g.first FROM s LEFT JOIN g ON g.topic = s.topic AND s.idx BETWEEN g.first AND g.last) "
    "SELECT topic, idx, first IS NOT NULL AS edited, row_number() OVER (PARTITION BY topic ORDER BY idx) - 1 AS new_idx FROM h WHERE first IS NULL OR idx = first"
)
def bounded_splice(spark, sf_dir):
    return A.splice_operations(sentences(spark, sf_dir), _operations(spark, sf_dir))[0].drop("text")


@query(f"WITH {OPS} SELECT topic, CAST(op AS BIGINT) AS op, reason FROM j WHERE reason IS NOT NULL")
def operation_screening(spark, sf_dir):
    return A.splice_operations(sentences(spark, sf_dir), _operations(spark, sf_dir))[1].withColumn("op", F.col("op").cast("bigint"))


@query("SELECT source AS topic, doc_id AS doc, 'e' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS VARCHAR), 3, '0') AS alias FROM documents")
def positional_aliases(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), "n_chars")
    return A.aliases(rows, ("topic",), "e", F.desc("n_chars"), "doc").drop("n_chars")


# Obligations: every judged document is one, its facet by id, its label by grade.
OBLIGATIONS = """, o AS (SELECT topic, doc % 4 AS facet, doc AS obligation, doc % 5 <> 0 AS required, CASE WHEN grade >= 3 THEN 'full' WHEN grade = 2 THEN 'partial' ELSE 'unsupported' END AS label,
  CASE WHEN grade >= 3 THEN 1.0::DOUBLE WHEN grade = 2 THEN 0.5 ELSE 0.0 END AS value FROM qrels),
m AS (SELECT topic, avg(v) AS coverage FROM (SELECT topic, facet, avg(value) AS v FROM o WHERE required GROUP BY ALL) GROUP BY topic),
t AS (SELECT topic, avg(CAST(label = 'full' AS DOUBLE)) FILTER (required) AS strict_full, avg(value) FILTER (NOT required) AS supplemental,
  count(*) FILTER (label = 'full') AS full_, count(*) FILTER (label = 'partial') AS partial, count(*) FILTER (label = 'unsupported') AS unsupported FROM o GROUP BY topic)"""


def obligations(spark, sf_dir):
    label = F.when(F.col("grade") >= 3, "full").when(F.col("grade") == 2, "partial").otherwise("unsupported")
    return qrels(spark, sf_dir).select("topic", (F.col("doc") % 4).alias("facet"), F.col("doc").alias("obligation"), (F.col("doc") % 5 != 0).alias("required"), label.alias("label"))


@query(sql("qrels", OBLIGATIONS + ' SELECT topic, round(coverage, 6) AS coverage, round(strict_full, 6) AS strict_full, round(supplemental, 6) AS supplemental, full_ AS "full", partial, unsupported FROM t LEFT JOIN m USING (topic)'))
def obligation_coverage(spark, sf_dir):
    out = J.obligation_coverage(obligations(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "strict_full", "supplemental")})


@query(
    sql(
        "qrels",
        OBLIGATIONS
        + ' SELECT round(avg(coverage), 9) AS coverage, round(avg(strict_full), 9) AS strict_full, round(avg(supplemental), 9) AS supplemental, CAST(sum(full_) AS BIGINT) AS "full", CAST(sum(partial) AS BIGINT) AS partial, CAST(sum(unsupported) AS BIGINT) AS unsupported, count(*) AS topics FROM t LEFT JOIN m USING (topic)',
    )
)
def coverage_summary(spark, sf_dir):
    out = J.coverage_summary(J.obligation_coverage(obligations(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("coverage", "strict_full", "supplemental")})


LABELLED = CITED + """, l AS (SELECT s.topic, s.idx AS sentence, c.place, CASE WHEN c.doc IS NULL THEN NULL WHEN c.topic % 7 = 0 AND c.doc = 5 THEN NULL WHEN c.doc % 3 = 0 THEN 'FS' WHEN c.doc % 3 = 1 THEN 'PS' ELSE 'NS' END AS label
  FROM s LEFT JOIN c ON c.topic = s.topic AND c.sentence = s.idx), v AS (SELECT *, CASE label WHEN 'FS' THEN 1.0::DOUBLE WHEN 'PS' THEN 0.5 WHEN 'NS' THEN 0.0 END AS value FROM l)"""


def labelled(spark, sf_dir):
    own, cited = sentences(spark, sf_dir), citations(spark, sf_dir)
    label = F.when(F.col("doc").isNull() | ((F.col("topic") % 7 == 0) & (F.col("doc") == 5)), F.lit(None)).when(F.col("doc") % 3 == 0, "FS").when(F.col("doc") % 3 == 1, "PS").otherwise("NS")
    return own.select("topic", F.col("idx").alias("sentence")).join(cited, ["topic", "sentence"], "left").select("topic", "sentence", "place", label.alias("label"))


@query(
    f"""WITH {LABELLED}, n AS (SELECT topic, sentence, coalesce(max(value), 0) AS best, sum(value) AS sum, count(place) AS cited, max(CAST(place IS NOT NULL AND label IS NULL AS INT)) AS open FROM v GROUP BY ALL)
SELECT topic, count(*) AS sentences, count(*) FILTER (cited > 0) AS cited_sentences, CAST(sum(cited) AS BIGINT) AS citations, round(sum(sum) / nullif(sum(cited), 0), 6) AS precision, round(avg(best), 6) AS recall
FROM n GROUP BY topic HAVING max(open) = 0"""
)
def support_metrics(spark, sf_dir):
    return J.support_metrics(labelled(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    sql(
        "run qrels",
        """, n AS (SELECT topic, doc, doc % 12 AS nugget, CASE WHEN doc % 12 < 4 THEN 'vital' ELSE 'okay' END AS importance, CASE WHEN doc % 12 < 4 THEN 1.0::DOUBLE ELSE 0.5 END AS v FROM qrels WHERE grade >= 2),
e AS (SELECT topic, sum(v) AS ideal FROM (SELECT DISTINCT topic, nugget, v FROM n) GROUP BY topic),
g AS (SELECT topic, sum(v) AS got, count(*) AS found FROM (SELECT DISTINCT topic, nugget, v FROM n JOIN run USING (topic, doc) WHERE rank <= 15) GROUP BY topic),
f AS (SELECT topic, count(*) AS effort FROM run WHERE rank <= 15 GROUP BY topic)
SELECT topic, round(CASE WHEN ideal > 0 THEN coalesce(got, 0) / ideal ELSE 0 END, 6) AS gain, coalesce(found, 0) AS found, coalesce(effort, 0) AS effort FROM e LEFT JOIN g USING (topic) LEFT JOIN f USING (topic)""",
    )
)
def nugget_gain(spark, sf_dir):
    n = F.col("doc") % 12
    nuggets = qrels(spark, sf_dir).where("grade >= 2").select("topic", "doc", n.alias("nugget"), F.when(n < 4, "vital").otherwise("okay").alias("importance"))
    return J.nugget_gain(run(spark, sf_dir), nuggets, 15).withColumn("gain", F.round("gain", 6))


@query(
    sql(
        "qrels",
        """, a AS (SELECT 'r' || doc % 3 AS run, topic, doc % 2 = 0 AS vital, grade >= 3 AS met FROM qrels)
SELECT run, topic, round(CASE WHEN count(*) FILTER (vital) > 0 THEN count(*) FILTER (vital AND met) / count(*) FILTER (vital) ELSE 0 END, 6) AS vital_strict,
  round(count(*) FILTER (met) / count(*), 6) AS all_strict FROM a GROUP BY run, topic""",
    )
)
def strict_rubric(spark, sf_dir):
    rows = qrels(spark, sf_dir).select(
        F.concat(F.lit("r"), (F.col("doc") % 3).cast("string")).alias("run"), "topic", F.col("doc").alias("item"),
        F.when(F.col("doc") % 2 == 0, "vital").otherwise("okay").alias("importance"), F.when(F.col("grade") >= 3, "full").otherwise("partial").alias("label"),
    )
    return J.strict_rubric(rows).withColumns({c: F.round(c, 6) for c in ("vital_strict", "all_strict")})


@query(
    sql(
        "qrels",
        """, u AS (SELECT topic, doc, 3.0 * (grade % 3) + (doc % 4) + 0.5 * (doc % 6) + coalesce(CASE WHEN doc % 9 <> 0 THEN (doc % 11) / 10.0 END, 0) AS useful FROM qrels)
SELECT topic, doc, round(CAST(useful AS DOUBLE), 6) AS useful, row_number() OVER (PARTITION BY topic ORDER BY round(useful, 9) DESC, doc) AS rank FROM u""",
    )
)
def document_usefulness(spark, sf_dir):
    d = F.col("doc")
    rows = qrels(spark, sf_dir).select("topic", "doc", (F.col("grade") % 3).alias("drafted"), (d % 4).alias("needs"), (d % 6).alias("nuggets"), F.when(d % 9 != 0, (d % 11) / 10.0).alias("support"))
    return J.usefulness(rows).select("topic", "doc", F.round("useful", 6).alias("useful"), "rank")


