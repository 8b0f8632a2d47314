"""Projections and aggregates around runs: evidence lists, plans, bundles, gates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import clean_query, squeezed
from orrery.sources.runs import demand


def evidence_list(ranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows with text of each topic, with citation numbers from 0."""
    own = ranked.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    place = F.row_number().over(Window.partitionBy("topic").orderBy("rank", "doc")) - 1
    return own.withColumn("citation", place.cast("bigint")).where(F.col("citation") < k)


def lanes_of_plan(topics: DataFrame, most: int = 8) -> DataFrame:
    """One original lane, then one per facet of a valid plan, each with its query's digest.

    ``topics``: topic, narrative, facets (array).  A plan with a facet that may not be
    sent, or with two that differ in case only, or with too many, falls back to the
    original alone.  A facet's query is tethered to the first words of the narrative.
    """
    facets = F.coalesce("facets", F.array().cast("array<string>"))
    valid = (F.size(facets) <= most) & (F.size(F.array_distinct(F.transform(facets, F.lower))) == F.size(facets)) & ~F.exists(facets, lambda f: ~clean_query(f))
    anchor = F.array_join(F.slice(F.split(squeezed(F.col("narrative")), " "), 1, 3), " ")
    queries = F.concat(F.array(squeezed(F.col("narrative"))), F.when(valid, F.transform(facets, lambda f: F.concat_ws(" ", anchor, squeezed(f)))).otherwise(F.array().cast("array<string>")))
    return topics.select("topic", F.posexplode(queries).alias("lane", "query")).select(
        "topic", F.when(F.col("lane") == 0, "original").otherwise(F.concat(F.lit("facet:"), F.col("lane").cast("string"))).alias("lane"), "query", F.sha2("query", 256).alias("digest")
    )


def without_labels(df: DataFrame, forbidden: tuple[str, ...] = ("grade", "relevance", "qrels", "label")) -> DataFrame:
    """``df``; refused at once if a column is named like a judgment."""
    found = [c for c in df.columns if c.lower() in forbidden]
    if found:
        raise ValueError(f"judgments may not be used here: {found}")
    return df


def ranked_selection(union: DataFrame, selected: DataFrame, eligible: Column) -> DataFrame:
    """The whole union: whether a row was taken, at which rank, and why not."""
    own = union.join(selected.select("topic", "doc", F.col("rank").alias("output_rank")), ["topic", "doc"], "left")
    reason = F.when(F.col("output_rank").isNotNull(), F.lit(None)).when(~eligible, "ineligible").otherwise("below_cut")
    return own.withColumn("included", F.col("output_rank").isNotNull()).withColumn("reason", reason)


def topic_health(topics: DataFrame, least: int) -> DataFrame:
    """failed, empty, thin or ok. ``topics``: topic, hits, errors."""
    state = F.when(F.col("errors") > 0, "failed").when(F.col("hits") == 0, "empty").when(F.col("hits") < least, "thin").otherwise("ok")
    return topics.withColumn("health", state)


def regressions(components: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per topic: the component with the greatest loss, and what kind of regression that is.

    ``components``: topic, component, delta.
    """
    worst = components.groupBy("topic").agg(F.min_by("component", F.struct("delta", "component")).alias("component"), F.min("delta").alias("delta"), F.sum("delta").alias("total"))
    kind = F.when(F.col("total") >= 0, "none").when(F.col("delta") <= -tolerance, F.concat(F.lit("major:"), F.col("component"))).otherwise("minor")
    return worst.withColumn("kind", kind)


def expected_judgments(expected: DataFrame, judgments: DataFrame, fields: list[str]) -> DataFrame:
    """Every task of either side, and whether it is missing, unexpected, different or equal."""
    e = expected.select("task", F.struct(*fields).alias("e"))
    j = judgments.select("task", F.struct(*fields).alias("j"))
    state = F.when(F.col("j").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("e").eqNullSafe(F.col("j")), "equal").otherwise("different")
    return e.join(j, "task", "full").select("task", state.alias("state"))


def single_lineage(rows: DataFrame, by: tuple[str, ...], lineage: str) -> DataFrame:
    """Aggregated windows of each group; a group with two lineages is an error."""
    own = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.max("score").alias("best"), F.countDistinct(lineage).alias("lineages"), F.min(lineage).alias(lineage))
    return demand(own, F.col("lineages") != 1, "a group has several lineages").drop("lineages")


def bundle(events: DataFrame) -> DataFrame:
    """(topic, doc): its lanes, sightings and best rank; texts of a document must agree.

    ``events``: topic, lane, doc, rank, digest.
    """
    own = events.groupBy("topic", "doc").agg(
        F.array_sort(F.collect_set("lane")).alias("lanes"), F.count(F.lit(1)).alias("sightings"), F.min("rank").alias("best_rank"), F.countDistinct("digest").alias("texts")
    )
    return demand(own, F.col("texts") > 1, "a document has two texts").drop("texts")


def gates(a: DataFrame, b: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Per metric: worse, equal and better groups of b against a, and whether the gate passes.

    No group may be worse, and some group of some metric must be better.
    """
    key = "topic"
    long = lambda df: df.unpivot([key], list(metrics), "metric", "value")
    both = long(a).withColumnRenamed("value", "a").join(long(b).withColumnRenamed("value", "b"), [key, "metric"])
    count = lambda c: F.sum(c.cast("bigint"))
    per = both.groupBy("metric").agg(count(F.col("b") < F.col("a")).alias("worse"), count(F.col("b") == F.col("a")).alias("equal"), count(F.col("b") > F.col("a")).alias("better"))
    every = Window.partitionBy(F.lit(1))
    return per.withColumn("passes", (F.sum("worse").over(every) == 0) & (F.sum("better").over(every) > 0))


def merged_cards(cards: DataFrame, most: int) -> DataFrame:
    """Cards with one detail once, in order of importance, specificity, group and place, named a001 on.

    ``cards``: topic, group, ordinal, detail, importance, specificity.
    """
    normal = F.lower(squeezed(F.col("detail")))
    first = Window.partitionBy("topic", "normal").orderBy("group", "ordinal")
    own = cards.withColumn("normal", normal).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    order = Window.partitionBy("topic").orderBy(F.desc("importance"), F.desc("specificity"), "group", "ordinal")
    own = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return own.withColumn("label", F.concat(F.lit("a"), F.lpad(F.col("place").cast("string"), 3, "0"))).drop("normal", "nth")


def latest_attempts(attempts: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """The last attempt of each task, how many there were, and whether it is sealed."""
    return attempts.groupBy(*by).agg(F.max(order).alias("attempt"), F.max_by("status", order).alias("status"), F.count(F.lit(1)).alias("attempts"))


def facet_ids(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each document's facets by the manifest's order: an array lookup as explode and join."""
    rows = documents.select("topic", "doc", F.explode("lanes").alias("lane"))
    own = rows.join(manifest.select("lane", "facet", "place"), "lane")
    return own.groupBy("topic", "doc").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "facet"))), lambda x: x["facet"]).alias("facets"))


def resolve_claims(claims: DataFrame, evidence: DataFrame, most_docs: int = 3) -> DataFrame:
    """Claims with their aliases resolved in order; too many documents or an unknown alias rejects.

    ``claims``: claim, aliases (array).  ``evidence``: alias, doc.
    """
    rows = claims.select("claim", F.posexplode("aliases").alias("place", "alias")).join(evidence, "alias", "left")
    own = rows.groupBy("claim").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "doc"))), lambda x: x["doc"]).alias("docs"),
        F.countDistinct("doc").alias("distinct"), F.max(F.col("doc").isNull().cast("int")).alias("unknown"),
    )
    code = F.when(F.col("unknown") == 1, "UNKNOWN_ALIAS").when(F.col("distinct") > most_docs, "TOO_MANY_DOCUMENTS").otherwise("ACCEPTED")
    return own.withColumn("code", code)


def stage_deltas(counters: DataFrame) -> DataFrame:
    """What each stage added to running counters: topic, stage, counter, value, delta.

    ``counters``: topic, stage (ordered), counter, value (as it stood at the stage's end).  A
    counter that falls is an error: it was not carried from the stage before.
    """
    before = F.lag("value").over(Window.partitionBy("topic", "counter").orderBy("stage"))
    own = counters.withColumn("delta", F.col("value") - F.coalesce(before, F.lit(0)))
    fell = F.when(F.col("delta") < 0, F.raise_error(F.concat(F.lit("counter fell: "), F.col("counter"))).cast("boolean")).otherwise(F.lit(True))
    return own.where(fell).select("topic", "stage", "counter", "value", "delta")
