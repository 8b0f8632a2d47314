"""Queries: claims with leases, evidence ledgers, paragraphs.  Their SQL steps through rows by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import folds
from orrery.plans.registry import query
from orrery.plans.relations import sql, table, windows


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS tm, 'w' || event_id % 3 AS worker, event_id % 40 = 0 AS done,
  row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT), event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, CASE WHEN done THEN 'lost' ELSE 'claimed' END AS result, CASE WHEN NOT done THEN worker END AS holder, tm + 3600 AS until, false AS scored FROM e WHERE n = 1
  UNION ALL SELECT event_id, user_id, n, result,
    CASE WHEN result IN ('scored', 'cached') THEN NULL WHEN result IN ('claimed', 'heartbeat', 'reclaimed') THEN worker ELSE held END,
    CASE WHEN result IN ('claimed', 'heartbeat', 'reclaimed') THEN tm + 3600 ELSE until END, result IN ('scored', 'cached') FROM (
    SELECT e.*, f.holder AS held, f.until, CASE WHEN f.scored THEN 'cached' WHEN e.done THEN CASE WHEN f.holder = e.worker THEN 'scored' ELSE 'lost' END
      WHEN f.holder IS NULL THEN 'claimed' WHEN f.holder = e.worker THEN 'heartbeat' WHEN e.tm >= f.until THEN 'reclaimed' ELSE 'busy' END AS result
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT event_id, user_id, result, holder FROM f"""
)
def claim_resolution(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("key"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("place"),
        F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("worker"), (F.col("event_id") % 40 == 0).alias("done"),
    )
    return folds.claims(rows).select(F.col("place").alias("event_id"), F.col("key").alias("user_id"), "result", "holder")


@query(
    """WITH RECURSIVE d AS (SELECT event_id AS i, user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  ['read', 'need', 'facet', 'nugget', 'evidence', 'need_status', 'supersede'][event_id % 7 + 1] AS section, value,
  's' || event_id % 4 AS s, 'n' || event_id % 5 AS need, 'f' || event_id % 6 AS facet, 'g' || event_id % 9 AS g, 'g' || (event_id + 1) % 9 AS g1, 'g' || (event_id * 2) % 9 AS g2 FROM events),
r AS (SELECT *, CASE section WHEN 'read' THEN s WHEN 'need' THEN need WHEN 'need_status' THEN need WHEN 'facet' THEN facet ELSE g END AS id,
  section = 'nugget' AND i % 4 = 0 AS opposes, ['partial', 'answerable', 'conflicted'][i % 3 + 1] AS status FROM d),
f AS (SELECT CAST(0 AS BIGINT) AS n, user_id AS ledger, CAST(NULL AS BIGINT) AS i, '' AS section, '' AS id, '' AS code, CAST(0 AS BIGINT) AS version, '' AS state,
    CAST([] AS VARCHAR[]) AS snippets, CAST([] AS VARCHAR[]) AS needs, CAST([] AS VARCHAR[]) AS facets, CAST([] AS VARCHAR[]) AS nuggets, CAST([] AS VARCHAR[]) AS serves,
    CAST([] AS VARCHAR[]) AS cites, CAST([] AS VARCHAR[]) AS against, CAST([] AS VARCHAR[]) AS gone FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT n, ledger, i, section, id, code, version + CAST(code = 'ACCEPTED' AS INT), CASE WHEN code = 'ACCEPTED' THEN sha256(state || '|' || section || ':' || id) ELSE state END,
    CASE WHEN section = 'read' THEN list_append(snippets, id) ELSE snippets END,
    CASE WHEN section = 'need' AND code = 'ACCEPTED' THEN list_append(needs, id) ELSE needs END,
    CASE WHEN section = 'facet' AND code = 'ACCEPTED' THEN list_append(facets, id) ELSE facets END,
    CASE WHEN section = 'nugget' AND code = 'ACCEPTED' THEN list_append(nuggets, id) ELSE nuggets END,
    CASE WHEN section = 'nugget' AND code = 'ACCEPTED' THEN list_append(serves, id || need) ELSE serves END,
    CASE WHEN section IN ('nugget', 'evidence') AND code = 'ACCEPTED' THEN list_append(cites, id || s) ELSE cites END,
    CASE WHEN opposes AND code = 'ACCEPTED' THEN list_append(list_append(against, id || g1), g1 || id) ELSE against END,
    CASE WHEN section = 'supersede' AND code = 'ACCEPTED' THEN list_append(gone, id) ELSE gone END FROM (
    SELECT r.*, f.version, f.state, f.snippets, f.needs, f.facets, f.nuggets, f.serves, f.cites, f.against, f.gone, CASE r.section
      WHEN 'read' THEN 'ACCEPTED'
      WHEN 'need' THEN CASE WHEN list_contains(f.needs, r.need) THEN 'DUPLICATE_ID' WHEN r.value < 20 THEN 'UNGROUNDED_NARRATIVE_SPAN' ELSE 'ACCEPTED' END
      WHEN 'facet' THEN CASE WHEN list_contains(f.facets, r.facet) THEN 'DUPLICATE_ID' WHEN NOT list_contains(f.needs, r.need) THEN 'UNKNOWN_NEED' ELSE 'ACCEPTED' END
      WHEN 'nugget' THEN CASE WHEN list_contains(f.nuggets, r.g) THEN 'DUPLICATE_ID' WHEN NOT list_contains(f.needs, r.need) THEN 'UNKNOWN_NEED'
        WHEN r.i % 2 = 0 AND NOT list_contains(f.facets, r.facet) THEN 'UNKNOWN_FACET' WHEN r.opposes AND NOT list_contains(f.nuggets, r.g1) THEN 'UNKNOWN_NUGGET'
        WHEN NOT list_contains(f.snippets, r.s) THEN 'UNKNOWN_SNIPPET' ELSE 'ACCEPTED' END
      WHEN 'evidence' THEN CASE WHEN NOT list_contains(f.nuggets, r.g) THEN 'UNKNOWN_NUGGET' WHEN NOT list_contains(f.snippets, r.s) THEN 'UNKNOWN_SNIPPET'
        WHEN list_contains(f.cites, r.g || r.s) THEN 'DUPLICATE_EVIDENCE' ELSE 'ACCEPTED' END
      WHEN 'need_status' THEN CASE WHEN NOT list_contains(f.needs, r.need) THEN 'UNKNOWN_NEED'
        WHEN NOT (list_contains(f.serves, r.g || r.need) AND list_contains(f.serves, r.g1 || r.need)) OR list_contains(f.gone, r.g) OR list_contains(f.gone, r.g1) THEN 'MISSING_GROUNDED_DRAFT'
        WHEN r.status = 'answerable' AND r.value < 30 THEN 'MISSING_GROUNDED_DRAFT'
        WHEN r.status = 'conflicted' AND NOT list_contains(f.against, r.g || r.g1) THEN 'MISSING_CONTRADICTION_LINK' ELSE 'ACCEPTED' END
      ELSE CASE WHEN NOT (list_contains(f.nuggets, r.g) AND list_contains(f.nuggets, r.g2)) THEN 'UNKNOWN_NUGGET' WHEN r.g = r.g2 THEN 'INVALID_SUPERSESSION' ELSE 'ACCEPTED' END END AS code
    FROM f JOIN r ON r.ledger = f.ledger AND r.n = f.n + 1))
SELECT i AS seq, ledger, section, id, code, version, state AS state_sha256 FROM f WHERE n > 0"""
)
def evidence_ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i, name = F.col("event_id"), lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    section = F.element_at(F.array(*map(F.lit, ("read", "need", "facet", "nugget", "evidence", "need_status", "supersede"))), (i % 7 + 1).cast("int"))
    need, facet, snippet = name("n", i % 5), name("f", i % 6), name("s", i % 4)
    g, g1, g2 = name("g", i % 9), name("g", (i + 1) % 9), name("g", (i * 2) % 9)
    id = F.when(section == "read", snippet).when(section.isin("need", "need_status"), need).when(section == "facet", facet).otherwise(g)
    none = F.array().cast("array<string>")
    rows = e.select(
        F.col("user_id").alias("ledger"), i.alias("seq"), F.lit(0).alias("place"), section.alias("section"), id.alias("id"), F.array(need).alias("needs"),
        F.when(i % 2 == 0, F.array(facet)).otherwise(none).alias("facets"),
        F.when(section == "need_status", F.array(g, g1)).when((section == "nugget") & (i % 4 == 0), F.array(g1)).otherwise(none).alias("nuggets"),
        F.array(snippet).alias("snippets"), F.element_at(F.array(*map(F.lit, ("partial", "answerable", "conflicted"))), (i % 3 + 1).cast("int")).alias("status"),
        F.when(F.col("value") >= 30, "because").alias("reason"), g2.alias("other"), (F.col("value") >= 20).alias("grounded"),
    )
    return folds.evidence_ledger(rows).select("seq", "ledger", "section", "id", "code", "version", "state_sha256")


@query(
    sql(
        "windows",
        """, s AS (SELECT doc, "start", "end", chunk % 2 = 1 AS complete, chunk % 3 = 0 AS blank, row_number() OVER (PARTITION BY doc ORDER BY "start") AS n FROM windows),
f AS (SELECT doc, n, "start", "end", complete, CAST(0 AS BIGINT) AS paragraph, "start" AS head FROM s WHERE n = 1
  UNION ALL SELECT s.doc, s.n, s."start", s."end", s.complete, f.paragraph + CASE WHEN (s.blank AND f.complete) OR s."end" - f.head > 3500 THEN 1 ELSE 0 END,
    CASE WHEN (s.blank AND f.complete) OR s."end" - f.head > 3500 THEN s."start" ELSE f.head END FROM f JOIN s ON s.doc = f.doc AND s.n = f.n + 1)
SELECT doc, paragraph, min("start") AS "start", max("end") AS "end", count(*) AS sentences FROM f GROUP BY doc, paragraph""",
        recursive=True,
    )
)
def paragraph_segmentation(spark, sf_dir):
    return folds.paragraphs(windows(spark, sf_dir).select("doc", "start", "end", (F.col("chunk") % 2 == 1).alias("complete"), (F.col("chunk") % 3 == 0).alias("blank_before")))
