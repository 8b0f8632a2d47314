"""Queries: lexical retrieval and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import numbers as N
from orrery.functions import text as X
from orrery.operators.lexical import bm25
from orrery.plans.registry import query
from orrery.plans.relations import table
from orrery.session import spread

TERM_ID = "[a-z0-9]+"


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query(
    """WITH t AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), n AS (SELECT doc, len(w) AS n FROM t),
a AS (SELECT count(*) AS docs, avg(n) AS mean FROM n), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS topic, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT topic, p.doc, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * n / mean))) AS score FROM q JOIN d USING (term) JOIN p USING (term) JOIN n ON n.doc = p.doc CROSS JOIN a GROUP BY topic, p.doc),
r AS (SELECT topic, doc, round(score, 5) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 5) DESC, doc) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10"""
)
def bm25_topk(spark, sf_dir):
    topics = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), F.col("text").alias("query"))
    return bm25(_docs(spark, sf_dir), topics, 10)


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _stem_sql(t: str) -> str:
    arms = " ".join(f"WHEN {t} LIKE '%{s}' AND length({t}) - {len(s)} >= 3 THEN left({t}, length({t}) - {len(s)}) || '{e}'" for s, e in X.SUFFIXES)
    return f"CASE WHEN length({t}) <= 3 OR regexp_full_match({t}, '[0-9]+') THEN {t} {arms} ELSE {t} END"


@query(
    f"""WITH t AS (SELECT doc_id AS doc, list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{STOP}], w)), lambda w: {_stem_sql("w")}) AS w FROM documents),
u AS (SELECT doc, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM t), f AS (SELECT doc, term, min(pos) AS pos FROM u GROUP BY ALL)
SELECT t.doc, count(f.term) AS n, sha256(coalesce(string_agg(f.term, ' ' ORDER BY f.pos), '')) AS terms FROM t LEFT JOIN f ON f.doc = t.doc GROUP BY t.doc"""
)
def analysed_terms(spark, sf_dir):
    own = _docs(spark, sf_dir).withColumn("t", X.terms(F.col("text")))
    return own.select("doc", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("terms"))


@query("SELECT doc_id AS doc, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words FROM documents")
def whitespace_of_whole_texts(spark, sf_dir):
    """Whole texts, squeezed to their ends."""
    return _docs(spark, sf_dir).select("doc", X.squeezed(F.col("text")).alias("squeezed"), X.word_count(F.col("text")).alias("words"))


@query("SELECT item_id AS topic, array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+')[1:12], ' ') AS title, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM benchmark")
def topic_titles(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), X.title(F.col("text")).alias("title"), X.slug(F.col("text")).alias("slug"))


@query(
    f"""WITH w AS (SELECT item_id, text, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]+'), lambda x: lower(x)), lambda x: NOT list_contains([{STOP}], x))) AS c FROM benchmark)
SELECT a.item_id AS topic, b.item_id AS other, round(len(list_filter(a.c, lambda x: contains(lower(b.text), x))) / nullif(len(a.c), 0), 6) AS ratio
FROM w a CROSS JOIN benchmark b"""
)
def claim_support_all(spark, sf_dir):
    """Every claim against every evidence."""
    b = table(spark, sf_dir, "benchmark")
    left = b.select(F.col("item_id").alias("topic"), F.col("text").alias("claim"))
    right = b.select(F.col("item_id").alias("other"), F.col("text").alias("evidence"))
    return left.crossJoin(right).select("topic", "other", F.round(X.support_ratio(F.col("claim"), F.col("evidence")), 6).alias("ratio"))


@query(
    """WITH x AS (SELECT doc_id, text, list_sort(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'))) AS n, list_sort(list_distinct(list_transform(regexp_extract_all(text, ' ([A-Z][A-Za-z]+)', 1), lambda w: lower(w)))) AS e FROM documents)
SELECT doc_id AS doc, sha256(array_to_string(n, ',') || '|' || CASE WHEN regexp_matches(text, '(?i)\\b(no|not|never|none|without)\\b') THEN 'neg' ELSE '' END || '|' || array_to_string(e, ',')) AS signature FROM x"""
)
def guard_signatures(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc", F.sha2(X.guard_signature(F.col("text")), 256).alias("signature"))


@query(
    """WITH p AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]*')) AS s FROM documents)
SELECT doc_id AS doc, count(*) AS sentences, count(*) FILTER (regexp_matches(s, '[.!?]$')) AS complete, CAST(sum(length(s)) AS BIGINT) AS chars FROM p WHERE trim(s) <> '' GROUP BY doc_id"""
)
def sentence_segments(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc", F.inline(X.sentences(F.col("text"))))
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.col("complete").cast("bigint")).alias("complete"), F.sum((F.col("end") - F.col("start")).cast("bigint")).alias("chars"))


@query("SELECT doc_id AS doc, strlen(text[1:100]) AS bytes_100, strlen(text) AS bytes, length(text) AS chars, sha256(text) AS digest FROM documents")
def byte_offsets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc", X.byte_offset(F.col("text"), F.lit(100)).alias("bytes_100"), F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"))


@query(
    """WITH t AS (SELECT item_id AS topic, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
p AS (SELECT a.topic, b.topic AS other, len(a.w) AS x, len(b.w) AS y, len(list_intersect(a.w, b.w)) AS s FROM t a JOIN t b ON a.topic < b.topic)
SELECT topic, other, round(CASE WHEN least(x, y) > 0 AND least(x, y) / greatest(x, y) >= 0.8 THEN s / (x + y - s) ELSE 0 END, 6) AS jaccard FROM p"""
)
def jaccard_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    t = b.select(F.col("item_id").alias("topic"), F.array_distinct(X.tokens(F.col("text"))).alias("w"))
    o = t.select(F.col("topic").alias("other"), F.col("w").alias("v"))
    return t.join(o, F.col("topic") < F.col("other")).select("topic", "other", F.round(N.jaccard(F.col("w"), F.col("v"), 0.8), 6).alias("jaccard"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN abs(v) >= 100000000000000000 THEN v WHEN abs(v) >= 100000000000000 THEN v * 1000 WHEN abs(v) >= 100000000000 THEN v * 1000000 ELSE v * 1000000000 END AS ns,
  CAST((2 * o_custkey + 7) // 14 AS BIGINT) AS seventh, round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 4) AS single
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 1700000000 WHEN 1 THEN 1700000000123 WHEN 2 THEN 1700000000123456 ELSE 1700000000123456789 END + o_custkey AS v FROM orders)"""
)
def number_functions(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, F.lit(1700000000)).when(k == 1, F.lit(1700000000123)).when(k == 2, F.lit(1700000000123456)).otherwise(F.lit(1700000000123456789)) + F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), N.epoch_ns(v).alias("ns"), N.half_up_ratio(F.col("o_custkey"), F.lit(7)).alias("seventh"), F.round(N.single(F.col("o_totalprice")), 4).alias("single")
    )


@query("SELECT event_id AS id, sha256(length(CAST(user_id AS VARCHAR)) || ':' || user_id || ',' || length(event_type) || ':' || event_type) AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def identity_and_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), N.identity(F.col("user_id"), F.col("event_type")).alias("key"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(
    """SELECT item_id AS topic, unnest([0, 1, 2]) AS place, CASE unnest([0, 1, 2]) WHEN 0 THEN 'original' ELSE 'facet:' || unnest([0, 1, 2]) END AS variant,
  CASE unnest([0, 1, 2]) WHEN 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) WHEN 1 THEN array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+')[1:6], ' ') ELSE array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+')[7:12], ' ') END AS query FROM benchmark"""
)
def query_variants(spark, sf_dir):
    from orrery.operators.lexical import variants

    topics = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), "text")
    return variants(topics)


@query("SELECT conv_id AS topic, turn, trim(text) <> '' AND length(text) <= 400 AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x{9f}]') AND NOT regexp_matches(text, '[\"(){}\\[\\]^~*?:\\\\]|\\b(AND|OR|NOT)\\b') AS clean, regexp_matches(text, '^(?i)(this|that|these|those|it|they|he|she|however|therefore|thus|also|moreover|furthermore|but|and|or)\\b') AS leans FROM conversations")
def query_admission(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("topic"), "turn", X.clean_query(F.col("text")).alias("clean"), X.depends(F.col("text")).alias("leans"))
