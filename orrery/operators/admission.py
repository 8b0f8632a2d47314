"""Robust admission of candidates: median and median absolute deviation per lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.passages import suppressed

#: Deviations above the median, and the factor that makes them standard ones.
DEVIATIONS, FACTOR = 2.5, 1.4826


def thresholds(lanes: DataFrame, by: tuple[str, ...] = ("topic", "lane")) -> DataFrame:
    """(by, median, mad, threshold).  Two aggregations on one partitioning."""
    med = lanes.groupBy(*by).agg(F.median("score").alias("median"))
    mad = lanes.join(med, list(by)).groupBy(*by).agg(
        F.first("median").alias("median"), F.median(F.abs(F.col("score") - F.col("median"))).alias("mad")
    )
    return mad.withColumn("threshold", F.col("median") + DEVIATIONS * FACTOR * F.col("mad"))


def admits(score: Column, median: Column, mad: Column) -> Column:
    """At the threshold or above; without deviation, strictly above the median."""
    return F.when(mad > 0, score >= median + DEVIATIONS * FACTOR * mad).otherwise(score > median)


def admitted(lanes: DataFrame) -> DataFrame:
    """lanes with median, mad and whether the row is admitted in its lane."""
    return lanes.join(thresholds(lanes), ["topic", "lane"]).withColumn("admitted", admits(F.col("score"), F.col("median"), F.col("mad")))


def core(lanes: DataFrame) -> DataFrame:
    """(topic, doc, lanes): documents that some lane admits, and how many do.

    A topic that admits none falls back to its single best (greatest score, least doc).
    """
    rows = admitted(lanes)
    per = rows.groupBy("topic", "doc").agg(F.sum(F.col("admitted").cast("bigint")).alias("lanes"), F.max("score").alias("score"))
    topics = per.groupBy("topic").agg(F.max("lanes").alias("most"), F.min_by("doc", F.struct(-F.col("score"), F.col("doc"))).alias("fallback"))
    joined = per.join(topics, "topic")
    return joined.where((F.col("lanes") > 0) | ((F.col("most") == 0) & (F.col("doc") == F.col("fallback")))).select("topic", "doc", "lanes")


def multiplicity(core_rows: DataFrame) -> DataFrame:
    """How many documents were admitted by how many lanes."""
    return core_rows.groupBy("topic", "lanes").agg(F.count(F.lit(1)).alias("documents"))


def breadth(lanes: DataFrame, per_document: int = 3) -> DataFrame:
    """(topic, doc, n_lanes, n_hits): distinct lanes and hits over the threshold, at most three hits a lane."""
    own = admitted(lanes).where("admitted").groupBy("topic", "doc", "lane").agg(F.count(F.lit(1)).alias("hits"))
    return own.groupBy("topic", "doc").agg(F.count(F.lit(1)).alias("n_lanes"), F.sum(F.least("hits", F.lit(per_document))).cast("bigint").alias("n_hits"))


def passage_breadth(passages: DataFrame, per_document: int = 3, most: float = 0.5) -> DataFrame:
    """(topic, doc, n_lanes, n_hits) of passages: topic, lane, doc, score, start, end.

    Of the passages over their lane's threshold, those that overlap a better one of the
    same lane and document by ``most`` or more are left out, and the best ``per_document`` count.
    """
    own = admitted(passages).where("admitted").groupBy("topic", "doc", "lane").agg(F.collect_list(F.struct((-F.col("score")).alias("neg"), "start", "end", "score")).alias("all"))
    ws = F.transform(F.array_sort("all"), lambda w: F.struct(w["score"].alias("score"), w["start"].alias("start"), w["end"].alias("end")))
    kept = own.withColumn("ws", ws).select("topic", "doc", "lane", F.least(F.size(suppressed(F.col("ws"), most)), F.lit(per_document)).alias("hits"))
    return kept.groupBy("topic", "doc").agg(F.count(F.lit(1)).alias("n_lanes"), F.sum("hits").cast("bigint").alias("n_hits"))


def strongest(lanes: DataFrame, narrative: str) -> DataFrame:
    """(topic, doc, narrative, facet, combo): facet = .7 best + .3 second best, combo = mean of both."""
    facet = F.sort_array(F.collect_list(F.when(F.col("lane") != narrative, F.col("score"))), False)
    own = lanes.groupBy("topic", "doc").agg(F.max(F.when(F.col("lane") == narrative, F.col("score"))).alias("narrative"), facet.alias("f"))
    f = F.when(F.size("f") > 1, 0.7 * F.get("f", F.lit(0)) + 0.3 * F.get("f", F.lit(1))).otherwise(F.get("f", F.lit(0)))
    return own.withColumn("facet", f).withColumn("combo", 0.5 * F.col("narrative") + 0.5 * F.col("facet")).drop("f")
