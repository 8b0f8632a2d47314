"""Queries: chunks, sentences, the scoring view and scored pairs of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import extensions as E
from orrery.operators import spans as S
from orrery.plans.registry import query
from orrery.plans.relations import table
from orrery.plans.text import STOP, _docs


@query()
def semantic_chunks(spark, sf_dir):
    """Every chunk of every document; a plain packer in the tests says which."""
    made = E.chunked(_docs(spark, sf_dir), "doc")
    return made.select("doc", "chunk_id", "start", "end", F.sha2("chunk", 256).alias("sha256"))


@query()
def sentence_spans(spark, sf_dir):
    """Every sentence of every document, exact to the character; a plain walk in the tests says which."""
    return E.segmented(_docs(spark, sf_dir)).select("doc", "place", "start", "end", "complete")


@query(
    """WITH w AS (SELECT doc_id AS doc, text, array_to_string(regexp_extract_all(text, '\\S+'), ' ') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc, length(s) AS scoring_chars, sha256(s) AS sha256, 1 + len(list_filter(regexp_extract_all(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '\\s+'), lambda g: length(g) > 1)) AS runs FROM w"""
)
def scoring_views(spark, sf_dir):
    view = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc", S.scoring_view(F.col("text")).alias("v"))
    return view.select("doc", F.length("v.text").alias("scoring_chars"), "v.sha256", F.size("v.scoring_at").alias("runs"))


@query(
    """WITH d AS (SELECT doc_id AS doc, text, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc, text, a, least(a + 700, n) AS b FROM (SELECT doc, text, n, unnest(range(0, n, 500)) AS a FROM d)),
t AS (SELECT doc, text, a, b, a + length(text[a + 1:b]) - length(ltrim(text[a + 1:b], e' \\t\\n\\x0b\\f\\r')) AS x, b - length(text[a + 1:b]) + length(rtrim(text[a + 1:b], e' \\t\\n\\x0b\\f\\r')) AS y FROM s),
p AS (SELECT *, array_to_string(regexp_extract_all(text[1:x], '\\S+'), ' ') AS before, array_to_string(regexp_extract_all(text[1:y], '\\S+'), ' ') AS upto FROM t WHERE x < y)
SELECT doc, a AS asked_start, b AS asked_end, x AS source_start, y AS source_end, length(before) + CASE WHEN before <> '' AND regexp_matches(text[x:x], '\\s') THEN 1 ELSE 0 END AS scoring_start, length(upto) AS scoring_end, strlen(text[1:x]) AS source_start_byte, strlen(text[1:y]) AS source_end_byte FROM p"""
)
def scoring_projections(spark, sf_dir):
    """Windows of 700 characters every 500, in scoring coordinates; blank ones have none."""
    own = _docs(spark, sf_dir).where(F.length("text") > 0)
    n = F.length("text")
    asked = F.transform(F.sequence(F.lit(0), n - 1, F.lit(500)), lambda a: F.struct(a.alias("start"), F.least(a + 700, n).alias("end")))
    made = own.withColumn("asked", asked).withColumn("found", S.to_scoring(F.col("text"), F.col("asked")))
    rows = made.select("doc", F.inline(F.arrays_zip("asked", "found"))).where(F.col("found.fault").isNull())
    return rows.select("doc", F.col("asked.start").alias("asked_start"), F.col("asked.end").alias("asked_end"), *(F.col(f"found.{c}") for c in ("source_start", "source_end", "scoring_start", "scoring_end", "source_start_byte", "source_end_byte")))


@query(
    f"""WITH s AS (SELECT doc_id % 10 AS topic, doc_id AS doc, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS t FROM documents),
w AS (SELECT topic, doc, list_distinct(regexp_extract_all(lower(t), '[a-z][a-z''-]+')) AS w FROM s WHERE trim(t) <> ''),
q AS (SELECT item_id % 10 AS topic, item_id AS sub, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]+')), lambda x: NOT list_contains([{STOP}], x)) AS c FROM benchmark)
SELECT w.topic, doc, sub, count(*) AS sentences, max(CASE WHEN len(c) = 0 THEN 0 ELSE round(len(list_intersect(c, w)) / len(c), 9) END) AS best FROM w JOIN q ON q.topic = w.topic GROUP BY ALL"""
)
def sentence_scores(spark, sf_dir):
    """Each document's best sentence for each subnarrative of its topic, by the registered scorer."""
    whole = _docs(spark, sf_dir).where("text IS NOT NULL").groupBy("doc").agg(F.collect_list("text").alias("texts"))
    own = whole.select((F.col("doc") % 10).alias("topic"), "doc", "texts")
    subs = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("topic"), F.col("item_id").alias("sub"), F.col("text").alias("query"))
    return E.best_sentences(own, subs)
