"""From evidence to generation: aliases, projections, citations with text, judgments resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.checks import first_fault

#: Nested form of a handoff: one row per topic.
HANDOFF = """topic string, groups array<struct<id:string,label:string>>, evidence array<struct<id:string,group:string,doc:string,text:string>>,
claims array<struct<id:string,group:string,text:string,evidence:array<string>>>"""
LABELS = ("full", "partial", "unsupported")


def alias(letter: str, number: Column) -> Column:
    """A letter and a number of three digits or more."""
    text = number.cast("string")
    return F.concat(F.lit(letter), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def flattened(handoff: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, evidence, claims) of nested topics, each with its ordinal within the topic, from 1."""
    part = lambda c: handoff.select("topic", F.posexplode(c).alias("at", "x")).select("topic", (F.col("at") + 1).cast("bigint").alias("ordinal"), "x.*")
    return part("groups"), part("evidence"), part("claims")


def generation_topics(groups: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Nested topics as ``HANDOFF`` has them: groups by id, evidence by group and id, claims by group and id.

    ``groups``: topic, id, label.  ``evidence``: topic, id, group, doc, text.  ``claims``: topic, id,
    group, text, evidence (array).
    """
    ids = lambda order, *c: F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*c).alias("x")))), lambda s: s["x"])
    g = groups.groupBy("topic").agg(ids(["id"], "id", "label").alias("groups"))
    e = evidence.groupBy("topic").agg(ids(["group", "id"], "id", "group", "doc", "text").alias("evidence"))
    c = claims.withColumn("evidence", F.array_sort("evidence")).groupBy("topic").agg(ids(["group", "id"], "id", "group", "text", "evidence").alias("claims"))
    return g.join(e, "topic", "left").join(c, "topic", "left")


def request_view(clusters: DataFrame) -> DataFrame:
    """Aliases cNNN of clusters and eNNN of their supports, in order, with a fault where evidence comes twice.

    ``clusters``: topic, cluster, supports (array of evidence ids in order).
    """
    w = Window.partitionBy("topic").orderBy("cluster")
    own = clusters.withColumn("c", F.row_number().over(w)).select("topic", "cluster", "c", F.posexplode("supports").alias("at", "evidence"))
    e = F.row_number().over(Window.partitionBy("topic").orderBy("c", "at"))
    copy = F.row_number().over(Window.partitionBy("topic", "evidence").orderBy("c", "at"))
    return own.select("topic", "cluster", alias("c", F.col("c")).alias("cluster_alias"), "evidence", alias("e", e).alias("evidence_alias"), first_fault(("duplicate evidence", copy > 1)).alias("fault"))


def planner_records(plans: DataFrame) -> DataFrame:
    """One record per planned query: topic, its order, the query's order, variant, digest; repeats are a fault.

    ``plans``: topic, queries (array of struct(variant, query)).
    """
    order = F.dense_rank().over(Window.orderBy("topic")) - 1  # one row a topic
    own = plans.withColumn("topic_order", order.cast("bigint")).select("topic", "topic_order", F.posexplode("queries").alias("query_order", "q"))
    digest = F.sha2("q.query", 256)
    copy = F.row_number().over(Window.partitionBy("topic", "q.variant", "digest").orderBy("query_order"))
    facet = F.when(F.col("q.variant").startswith("facet:"), F.split_part("q.variant", F.lit(":"), F.lit(2)))
    return own.withColumn("digest", digest).select(
        "topic", "topic_order", F.col("query_order").cast("bigint").alias("query_order"), F.col("q.variant").alias("variant"), facet.alias("facet"), "digest", first_fault(("repeated query", copy > 1)).alias("fault")
    )


def projected(obligations: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each obligation, in the topic's order, with aliases eNNN counted over the topic.

    ``obligations``: topic, obligation, priority, aliases (of claims).  ``claims``: topic, alias, group,
    evidence (array).  ``evidence``: topic, place, id, group.  An obligation that must be met takes all
    evidence of its claims' groups, any other only what its claims name.
    """
    own = obligations.select("topic", "obligation", "priority", F.explode("aliases").alias("alias")).join(claims, ["topic", "alias"])
    must = own.where("priority = 'must'").select("topic", "obligation", "group").distinct().join(evidence, ["topic", "group"])
    named = own.where("priority <> 'must'").select("topic", "obligation", F.explode("evidence").alias("id")).distinct().join(evidence, ["topic", "id"])
    taken = must.select("topic", "obligation", "id", "place").unionByName(named.select("topic", "obligation", "id", "place"))
    number = F.dense_rank().over(Window.partitionBy("topic").orderBy("place", "id"))
    per = taken.withColumn("alias", alias("e", number)).groupBy("topic", "obligation").agg(F.array_sort(F.collect_list(F.struct("place", "id", "alias"))).alias("x"))
    out = obligations.select("topic", "obligation").join(per, ["topic", "obligation"], "left")
    empty = F.array().cast("array<string>")
    pick = lambda c: F.coalesce(F.transform("x", lambda s: s[c]), empty)
    return out.select("topic", "obligation", pick("id").alias("evidence"), pick("alias").alias("aliases"))


def cited_texts(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each citation with its text; a cited document without text is a fault.

    ``answers``: topic, sentence, citations (array of documents).  ``evidence``: topic, doc, text.
    """
    own = answers.select("topic", "sentence", F.posexplode("citations").alias("place", "doc"))
    return own.join(evidence.select("topic", "doc", "text"), ["topic", "doc"], "left").withColumn("fault", first_fault(("missing text", F.col("text").isNull())))


def resolved_judgments(obligations: DataFrame, judgments: DataFrame, nuggets: DataFrame) -> DataFrame:
    """Judgments with the nuggets that their aliases nNNN name, or the first rule they break; unjudged obligations too.

    ``obligations``: topic, obligation.  ``judgments``: topic, place, obligation, label, aliases, missing.
    ``nuggets``: topic, place, nugget.
    """
    named = nuggets.select("topic", alias("n", F.row_number().over(Window.partitionBy("topic").orderBy("place"))).alias("alias"), "nugget")
    copy = F.row_number().over(Window.partitionBy("topic", "obligation").orderBy("place"))
    rows = judgments.withColumn("copy", copy).withColumn("asked", F.coalesce("aliases", F.array().cast("array<string>")))
    found = rows.select("topic", "obligation", "copy", F.posexplode("asked").alias("at", "alias")).join(named, ["topic", "alias"], "left")
    found = found.groupBy("topic", "obligation", "copy").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "nugget"))), lambda s: s["nugget"]).alias("ids"))
    wanted = obligations.select("topic", "obligation", F.lit(True).alias("wanted"))
    own = rows.join(found, ["topic", "obligation", "copy"], "left").join(wanted, ["topic", "obligation"], "full")
    n, ids = F.size("asked"), F.coalesce("ids", F.array().cast("array<string>"))
    blank = F.trim(F.coalesce("missing", F.lit(""))) == ""
    fault = first_fault(
        ("unjudged", F.col("copy").isNull()), ("unknown obligation", F.col("wanted").isNull()), ("repeated obligation", F.col("copy") > 1), ("label", ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))),
        ("unknown alias", F.exists(ids, lambda x: x.isNull())), ("repeated alias", F.size(F.array_distinct("asked")) < n), ("support of the unsupported", (F.col("label") == "unsupported") & (n > 0)),
        ("no support", (F.col("label") != "unsupported") & (n == 0)), ("missing elements", (F.col("label") == "full") != (F.coalesce("missing", F.lit("")) == "")), ("missing elements", (F.col("label") != "full") & blank),
    )
    return own.select("topic", "obligation", "label", F.when(fault.isNull(), ids).alias("nuggets"), fault.alias("fault"))


def identity_faults(candidates: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Members whose candidate is missing or differs, with the first field that does."""
    fields = [c for c in members.columns if c not in key]
    both = members.select(*key, F.struct(*fields).alias("m")).join(candidates.select(*key, F.struct(*fields).alias("c")), key, "left")
    fault = first_fault(("missing", F.col("c").isNull()), *((f, ~F.col(f"m.{f}").eqNullSafe(F.col(f"c.{f}"))) for f in fields))
    return both.select(*key, fault.alias("fault")).where("fault IS NOT NULL")


def stored_texts(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranked documents with their stored text, or what is wrong with the rank or the text.

    ``ranked``: topic, doc, rank, score, digest.  ``documents``: doc, text.  Ranks are dense and
    scores count down to 1; a text must be there, not be empty, and have its digest.
    """
    w = Window.partitionBy("topic")
    place, n = F.row_number().over(w.orderBy("rank", "doc")), F.count(F.lit(1)).over(w)
    own = ranked.withColumn("place", place).withColumn("n", n).join(documents.select("doc", "text", F.lit(True).alias("known")), "doc", "left")
    fault = first_fault(
        ("rank", F.col("rank") != F.col("place")), ("score", F.col("score") != F.col("n") - F.col("rank") + 1), ("unknown document", F.col("known").isNull()),
        ("empty text", F.coalesce("text", F.lit("")) == ""), ("digest", F.sha2("text", 256) != F.col("digest")),
    )
    return own.select("topic", "doc", "rank", F.when(fault.isNull(), F.col("text")).alias("text"), fault.alias("fault"))


def pool_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(topic, only_a, only_b): topics whose candidates are not the same bag of rows; none where pools are equal."""
    columns = a.columns
    sides = a.withColumn("n", F.lit(1)).unionByName(b.select(*columns).withColumn("n", F.lit(-1)))
    left = sides.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    return left.groupBy("topic").agg(F.sum(F.greatest("n", F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("only_b"))


def outside_paragraphs(passages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Passages that meet no paragraph of their document: must be none."""
    p = paragraphs.select("doc", F.col("start").alias("a"), F.col("end").alias("b"))
    return passages.join(p, (passages["doc"] == p["doc"]) & (passages["start"] < p["b"]) & (p["a"] < passages["end"]), "left_anti")


def score_identity(rows: DataFrame) -> DataFrame:
    """(query, text, scores, chunks, fault) of each pair of digests: one score only, and chunks without gaps from 0.

    ``rows``: query_sha256, text_sha256, chunk, score.
    """
    one = rows.groupBy("query_sha256", "text_sha256", "chunk").agg((F.min("score") != F.max("score")).alias("torn"))
    own = one.groupBy(F.col("query_sha256").alias("query"), F.col("text_sha256").alias("text")).agg(
        F.max("torn").alias("torn"), F.count(F.lit(1)).alias("chunks"), F.min("chunk").alias("first"), F.max("chunk").alias("last")
    )
    fault = first_fault(("conflicting scores", F.col("torn")), ("chunks with gaps", (F.col("first") != 0) | (F.col("last") != F.col("chunks") - 1)))
    return own.select("query", "text", "chunks", fault.alias("fault"))


def selected_topics(official: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Topics in the official order: all, or those asked for; asked ones that are not official are a fault, and so are repeats.

    ``official``: topic, place.  ``asked``: topic.
    """
    if asked is None:
        return official.select("topic", "place", F.lit(None).cast("string").alias("fault"))
    wanted = asked.groupBy("topic").agg(F.count(F.lit(1)).alias("times"))
    return wanted.join(official, "topic", "left").select("topic", "place", first_fault(("unknown topic", F.col("place").isNull()), ("repeated topic", F.col("times") > 1)).alias("fault"))


def semantic_gates(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Failed gates of a candidate's labels: a topic's required coverage, its strict rate, single obligations, and both means.

    Both: topic, obligation, required (boolean), label.  full counts 1, partial 0.5, unsupported 0.
    """
    worth = F.when(F.col("label") == "full", 2).when(F.col("label") == "partial", 1).otherwise(0)
    side = lambda df, n: df.select("topic", "obligation", "required", worth.alias(n))
    both = side(baseline, "a").join(side(candidate, "b").drop("required"), ["topic", "obligation"])
    # Both sides of a topic share their counts, so whole numbers say which mean is lower.
    required, strict = F.when(F.col("required"), F.col("b") - F.col("a")), (F.col("b") == 2).cast("int") - (F.col("a") == 2).cast("int")
    per = both.groupBy("topic").agg(
        *(F.coalesce(F.sum(d), F.lit(0)).cast("decimal(18,0)").alias(g) for g, d in (("required", required), ("strict", strict))),
        *(F.nullif(F.count(d), F.lit(0)).cast("decimal(18,0)").alias(f"n_{g}") for g, d in (("required", required), ("strict", strict))),
    )
    none = F.lit(None).cast("string")
    lost = both.where("b < a").select("topic", F.col("obligation").cast("string").alias("obligation"), F.lit("obligation").alias("gate"))
    topics = [per.where(f"{g} < 0").select("topic", none.alias("obligation"), F.lit(g).alias("gate")) for g in ("required", "strict")]
    # Decimal sums are the same in any order; each topic's quotient is rounded at the 19th place.
    total = lambda g: F.coalesce(F.sum(F.col(g) / F.col(f"n_{g}")), F.lit(0)) + F.count(F.lit(1)) * F.lit("1e-19").cast("decimal(19,19)")
    macro = per.agg(total("required").alias("required"), total("strict").alias("strict"))
    means = [macro.where(f"{g} < 0").select(none.alias("topic"), none.alias("obligation"), F.lit(f"macro {g}").alias("gate")) for g in ("required", "strict")]
    out = lost.withColumn("topic", F.col("topic").cast("string"))
    for df in (*topics, *means):
        out = out.unionByName(df.withColumn("topic", F.col("topic").cast("string")))
    return out
