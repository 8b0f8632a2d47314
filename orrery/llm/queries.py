"""The operators bound to the driver's tables: one query each, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, decontaminate, fim, jaccard, quality, secrets, sessions, substrings, tokens, topk, toxicity, warc
from orrery.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of ``documents``, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated(texts(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark, table(spark, sf_dir, "benchmark")))
    found = secrets.scan(texts(spark, sf_dir), model)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )




def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    return chat.digests(chat.format_chats(rows.unionByName(hostile)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    sample = quality.training_rows(documents, labels, "quality", allowed=~quality.held_out(F.col("doc_id")))
    scored = quality.score(documents, quality.train(sample))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made of ``pages``: each page's full response, and a later revisit of its URL.

    Every fifth revisit carries the tag of another body, and every eleventh no tag.
    """
    page = F.col("page_id")
    tag = F.md5(F.col("html"))
    kept = F.md5(F.concat(F.col("url"), F.lit("#changed")))
    records = F.array(
        F.struct(
            (page * 2).alias("record_id"),
            page.alias("captured_at"),
            F.lit("response").alias("kind"),
            tag.alias("etag"),
            F.concat(F.lit("day "), (page % 30).cast("string")).alias("last_modified"),
            F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), page.cast("string"), F.lit("ETag"), tag).alias("headers"),
        ),
        F.struct(
            (page * 2 + 1).alias("record_id"),
            (page + 1 + page % 7).alias("captured_at"),
            F.lit("revisit").alias("kind"),
            F.when(page % 11 == 0, F.lit(None)).when(page % 5 == 0, kept).otherwise(tag).alias("etag"),
            F.concat(F.lit("day "), (page % 30).cast("string")).alias("last_modified"),
            F.create_map(F.lit("Date"), (page + 1 + page % 7).cast("string"), F.lit("X-Cache"), F.lit("HIT")).alias("headers"),
        ),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("url", F.inline(records)).withColumn("digest", F.lit(None).cast("string"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(captures(spark, sf_dir)).withColumn("headers", warc.header_text(F.col("headers")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_hit", decontaminate.n_hit()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(texts(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "n_links", "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(texts(spark, sf_dir)).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.training_rows(documents, labels, allowed=~quality.held_out(F.col("doc_id"))))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", "expected_severity", "p_toxic", (F.col("p_toxic") >= toxicity.CALLED).cast("int").alias("toxic"))


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    restored = fim.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(tokens.write(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_session_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.close_sessions(table(spark, sf_dir, "clicks"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_secret_scans, op3_chat_formatting, op4_quality_classifier, op5_warc_revisits, op6_benchmark_decontamination, op7_ngram_jaccard_join, op8_bpe, op9_toxicity, op10_top_k_search, op11_fill_in_middle, op12_token_files, op13_session_closing)
}

# A-Z in lower case, and nothing else.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(1, n - 98)) AS p, t FROM d WHERE n >= 100),
h AS (SELECT doc_id, p, row_number() OVER (PARTITION BY t[p:p + 99] ORDER BY doc_id, p) > 1 AS again FROM w),
c AS (SELECT doc_id, p, p - max(CASE WHEN again THEN p END) OVER (PARTITION BY doc_id ORDER BY p) < 100 AS gone FROM (
  SELECT doc_id, p, again FROM h UNION ALL SELECT doc_id, unnest(range(greatest(n - 98, 1), n + 1)) AS p, false FROM d)),
b AS (SELECT doc_id, p, coalesce(gone, false) AS gone, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS before FROM c),
k AS (SELECT b.doc_id, count(*) FILTER (gone) AS removed, count(*) FILTER (gone AND NOT before) AS spans, string_agg(hex(d.t[p:p]), '' ORDER BY p) FILTER (NOT gone) AS kept FROM b JOIN d ON d.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op3_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, contains(role, '<s>') OR contains(role, '</s>') OR contains(role, '[INST]') OR contains(role, '[/INST]') OR regexp_matches(role, '\\[012]') AS role_out,
    contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') OR regexp_matches(text, '\\[012]') AS text_out FROM c
), f AS (
  SELECT *, CASE WHEN role_out THEN length(regexp_replace(role, '[\\<[]', '00', 'g')) ELSE length(role) END + CASE WHEN text_out THEN length(regexp_replace(text, '[\\<[]', '00', 'g')) ELSE length(text) END AS chars FROM w
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + length('[INST] ' || ' [/INST]' || '</s>')))::BIGINT AS formatted_chars, sum(role_out::INT + text_out::INT)::INT AS escaped, true AS identical FROM f GROUP BY conv_id
""",
    "op6_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[a:a + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS a FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM k))),
m AS (SELECT g.doc_id, g.p, g.n, k.item FROM g JOIN k ON k.n = g.n AND k.g = g.g),
h AS (SELECT doc_id, count(DISTINCT q) AS hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
""",
    "op7_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda a: array_to_string(w[a:a + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
u AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
o AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM o WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT i, i AS j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON l.i = r.j),
c AS (SELECT i, min(j) AS least FROM r GROUP BY i), k AS (SELECT i, count(*) AS links FROM l GROUP BY i)
SELECT s.doc_id, len(x) AS n_shingles, coalesce(links, 0) AS n_links, coalesce(least, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.i = s.doc_id LEFT JOIN k ON k.i = s.doc_id
""",
    "op5_warc_revisits": r"""
WITH u AS (
  SELECT page_id, md5(html) AS tag, md5(url || '#changed') AS other,
    regexp_replace(split_part(trim(url), '#', 1), '^https?://', '', 'i') AS k
  FROM pages
), w AS (
  SELECT page_id, tag, other, split_part(k, '?', 1) AS front,
    CASE WHEN strpos(k, '?') > 0 THEN array_to_string(list_filter(string_split(substr(k, strpos(k, '?') + 1), '&'),
      lambda p: NOT (split_part(p, '=', 1) = 'ref' OR regexp_full_match(split_part(p, '=', 1), 'utm_[a-z]+')) OR strpos(p, '=') = 0), '&') ELSE '' END AS tail
  FROM u
), x AS (
  SELECT page_id, tag, other, rtrim(rtrim(front || CASE WHEN tail = '' THEN '' ELSE '?' || tail END, '?&'), '/') AS k FROM w
), c AS (
  SELECT page_id, tag, other, CASE WHEN lower(host) LIKE 'www.%' THEN substr(lower(host), 5) ELSE lower(host) END || substr(k, length(host) + 1) AS url_key
  FROM (SELECT *, split_part(split_part(k, '/', 1), '?', 1) AS host FROM x)
), f AS (
  SELECT r.page_id AS page_id, r.url_key AS url_key, max(b.page_id) AS base
  FROM c r LEFT JOIN c b ON b.url_key = r.url_key AND b.page_id < r.page_id + 1 + r.page_id % 7
  GROUP BY r.page_id, r.url_key
), j AS (
  SELECT f.*, b.tag AS base_tag, b.page_id % 30 AS base_day,
    CASE WHEN f.page_id % 11 = 0 THEN NULL WHEN f.page_id % 5 = 0 THEN r.other ELSE r.tag END AS tag
  FROM f JOIN c r ON r.page_id = f.page_id LEFT JOIN c b ON b.page_id = f.base
), o AS (
  SELECT *, CASE WHEN base IS NULL THEN 'no_response'
    WHEN (tag IS NOT NULL AND tag = base_tag) OR (tag IS NULL AND base_day = page_id % 30) THEN 'resolved'
    ELSE 'mismatch' END AS outcome
  FROM j
)
SELECT 2 * page_id + 1 AS record_id, url_key, 2 * base AS base_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 1 + page_id % 7)
    || chr(10) || 'etag: ' || base_tag END AS headers
FROM o
""",
    "op10_top_k_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
""",
    "op11_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents
), n AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n
), p AS (
  SELECT *, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:], '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""",
    # A session is a run of kept rows: what has closed lies too far behind for any later row.
    # Merges are counted by cutting the rows through each batch anew.
    "op13_session_closing": r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
r AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(coalesce(arrived_at, ts)) AS arrived FROM clicks
  WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY arrived, us, client_id) = 1
), h AS (
  SELECT click_id, client_id, us, CAST(floor(arrived / 3600000000) AS BIGINT) AS h, client_id || ':' || CAST(floor(us / 3600000000) AS BIGINT) AS slot FROM r
), s AS (SELECT min(h) AS lo, max(h) AS hi FROM h),
sums AS (
  SELECT client_id, us, h, lo, hi,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS id_crc,
    xor(list_reduce([4294967295] || list_transform(string_split(slot, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS slot_crc
  FROM h, s, crc
), b AS (SELECT client_id, us, id_crc, least(10 * (h - lo) // (hi - lo + 1) + (slot_crc % 5 = 0)::INT, 9) AS batch FROM sums),
w AS (SELECT batch, max(max(us)) OVER (ORDER BY batch) - 172800000000 AS w FROM b GROUP BY batch),
k AS (SELECT b.* FROM b WHERE us >= coalesce((SELECT max(w.w) FROM w WHERE w.batch < b.batch), us)),
g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY client_id ORDER BY us) > 1800000000, true)::INT AS begins FROM k),
f AS (SELECT *, sum(begins) OVER (PARTITION BY client_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM g),
part AS (
  SELECT n.batch AS upto, f.client_id, f.no, f.us, f.batch,
    coalesce(f.us - lag(f.us) OVER (PARTITION BY n.batch, f.client_id, f.no ORDER BY f.us) > 1800000000, true)::INT AS begins
  FROM f JOIN w n ON f.batch <= n.batch
), piece AS (
  SELECT *, sum(begins) OVER (PARTITION BY upto, client_id, no ORDER BY us ROWS UNBOUNDED PRECEDING) AS piece FROM part
), had AS (SELECT upto, client_id, no, piece, bool_or(batch < upto) AS old FROM piece GROUP BY ALL),
each AS (SELECT upto, client_id, no, count(*) AS pieces, count(*) FILTER (old) AS olds FROM had GROUP BY ALL),
joined AS (
  SELECT client_id, no, sum(before - olds) AS merges FROM (
    SELECT client_id, no, olds, coalesce(lag(pieces) OVER (PARTITION BY client_id, no ORDER BY upto), 0) AS before FROM each
  ) GROUP BY ALL
), t AS (SELECT client_id, no, min(us) AS first_us, max(us) AS last_us, count(*) AS n_clicks, CAST(sum(id_crc) AS BIGINT) AS ids_crc32 FROM f GROUP BY ALL)
SELECT t.client_id, first_us, last_us, n_clicks, ids_crc32, CAST(merges AS BIGINT) AS n_merges,
  coalesce((SELECT min(w.batch) FROM w WHERE t.last_us < w.w - 1800000000), 10) AS close_batch
FROM t JOIN joined ON joined.client_id = t.client_id AND joined.no = t.no
""",
}
