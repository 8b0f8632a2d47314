"""Effectiveness of rankings against graded judgments.

``run``: topic, doc, rank.  ``qrels``: topic, doc, grade.  Unjudged counts as grade 0 in
measures and stays apart in diagnostics.  Judgments are far fewer than hits, but nothing
here relies on it: joins are left to the optimiser's sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1


def thresholded_gain(grade: Column, least: int = 2) -> Column:
    """As ``gain``, but nothing below ``least``."""
    return F.when(grade >= least, gain(grade)).otherwise(0.0)


def discount(rank: Column) -> Column:
    return F.log2(rank.cast("double") + 1)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` with grade (0 where unjudged) and judged."""
    return run.join(qrels, ["topic", "doc"], "left").withColumn("judged", F.col("grade").isNotNull()).withColumn("grade", F.coalesce("grade", F.lit(0)).cast("bigint"))


def ideal(qrels: DataFrame, k: int, gain_of=gain) -> DataFrame:
    """(topic, ideal): discounted gain of the best possible first k."""
    order = Window.partitionBy("topic").orderBy(F.desc("grade"), "doc")
    best = qrels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.groupBy("topic").agg(F.sum(gain_of(F.col("grade")) / discount(F.col("place"))).alias("ideal"))


def ndcg(run: DataFrame, qrels: DataFrame, k: int, gain_of=gain) -> DataFrame:
    """(topic, dcg, ideal, ndcg) of every judged topic; 0 where nothing is to be gained."""
    got = judged(run.where(F.col("rank") <= k), qrels).groupBy("topic").agg(F.sum(gain_of(F.col("grade")) / discount(F.col("rank"))).alias("dcg"))
    both = ideal(qrels, k, gain_of).join(got, "topic", "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    return both.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.nullif("ideal", F.lit(0.0))).otherwise(0.0))


def at_depths(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...], least: int = 2) -> DataFrame:
    """Set measures of every judged topic at several depths, in one pass over the run.

    recall, precision (by k), hit_rate, relevant and judged counts, judged_rate (by k),
    graded_recall, precision_prefix (by what was returned) and judged_rate_prefix.
    """
    deep = judged(run.where(F.col("rank") <= max(depths)), qrels)
    at = F.explode(F.array(*map(F.lit, depths))).alias("k")
    rel = F.col("grade") >= least
    got = (
        deep.select("topic", "rank", "grade", "judged", at)
        .where(F.col("rank") <= F.col("k"))
        .groupBy("topic", "k")
        .agg(
            F.sum(rel.cast("bigint")).alias("relevant"),
            F.sum(F.col("judged").cast("bigint")).alias("judged"),
            F.sum(F.greatest("grade", F.lit(0))).alias("graded"),
            F.count(F.lit(1)).alias("returned"),
        )
    )
    known = qrels.groupBy("topic").agg(F.sum(rel.cast("bigint")).alias("all_relevant"), F.sum(F.greatest("grade", F.lit(0))).alias("all_graded"))
    every = known.select("*", at).join(got, ["topic", "k"], "left").na.fill(0, ["relevant", "judged", "graded", "returned"])
    by = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    c = F.col
    return every.select(
        "topic", c("k").cast("bigint").alias("k"), "relevant", "judged",
        by(c("relevant"), c("all_relevant")).alias("recall"),
        (c("relevant") / c("k")).alias("precision"),
        (c("relevant") > 0).cast("double").alias("hit_rate"),
        (c("judged") / c("k")).alias("judged_rate"),
        by(c("graded"), c("all_graded")).alias("graded_recall"),
        by(c("relevant"), c("returned")).alias("precision_prefix"),
        by(c("judged"), c("returned")).alias("judged_rate_prefix"),
    )


def ideal_coverage(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(topic, coverage): what the retrieved first k would gain in the best order, over the ideal."""
    got = judged(run.where(F.col("rank") <= k), qrels)
    order = Window.partitionBy("topic").orderBy(F.desc("grade"), "rank")
    best = got.withColumn("place", F.row_number().over(order)).groupBy("topic").agg(F.sum(gain(F.col("grade")) / discount(F.col("place"))).alias("best"))
    both = ideal(qrels, k).join(best, "topic", "left")
    return both.select("topic", F.when(F.col("ideal") > 0, F.coalesce("best", F.lit(0.0)) / F.nullif("ideal", F.lit(0.0))).otherwise(0.0).alias("coverage"))


def recall_auc(run: DataFrame, qrels: DataFrame, k: int, least: int = 2) -> DataFrame:
    """(topic, auc): mean over the first k ranks of the recall so far (later ranks repeat the last)."""
    known = qrels.groupBy("topic").agg(F.sum((F.col("grade") >= least).cast("bigint")).alias("all_relevant"))
    rows = judged(run.where(F.col("rank") <= k), qrels).where(F.col("grade") >= least)
    # A relevant document at rank r counts in the recall of ranks r .. k.
    got = rows.groupBy("topic").agg(F.sum(k - F.col("rank") + 1).alias("area"))
    return known.join(got, "topic", "left").select(
        "topic", F.when(F.col("all_relevant") > 0, F.coalesce("area", F.lit(0)) / F.nullif(F.col("all_relevant") * k, F.lit(0))).otherwise(0.0).alias("auc")
    )


def dispatch(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...], least: int = 2) -> DataFrame:
    """(topic, metric, value) for names such as ``ndcg@10``; an unknown name is an error."""
    out = None
    sets = ("recall", "precision", "hit_rate", "relevant", "judged", "judged_rate", "graded_recall")
    for name in metrics:
        kind, _, depth = name.partition("@")
        if not depth.isdigit() or int(depth) < 1:
            raise ValueError(f"metric without a depth: {name}")
        k = int(depth)
        if kind == "ndcg":
            own = ndcg(run, qrels, k).select("topic", F.col("ndcg").alias("value"))
        elif kind == "ideal_coverage":
            own = ideal_coverage(run, qrels, k).select("topic", F.col("coverage").alias("value"))
        elif kind == "recall_auc":
            own = recall_auc(run, qrels, k, least).select("topic", F.col("auc").alias("value"))
        elif kind in sets:
            own = at_depths(run, qrels, (k,), least).select("topic", F.col(kind).cast("double").alias("value"))
        else:
            raise ValueError(f"unknown metric: {name}")
        own = own.withColumn("metric", F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no metric is named")
    return out.select("topic", "metric", "value")


def macro(values: DataFrame, topics: DataFrame) -> DataFrame:
    """(metric, mean, topics) over the whole population; a topic without a value counts 0."""
    every = topics.select("topic").distinct().crossJoin(values.select("metric").distinct())
    return every.join(values, ["topic", "metric"], "left").groupBy("metric").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"), F.count(F.lit(1)).alias("topics"))


def pooled(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...], least: int = 2) -> DataFrame:
    """Per depth: recall over all topics together, and its mean over topics."""
    rows = at_depths(run, qrels, depths, least)
    known = qrels.groupBy("topic").agg(F.sum((F.col("grade") >= least).cast("bigint")).alias("all_relevant"))
    return rows.join(known, "topic").groupBy("k").agg(
        F.sum("relevant").alias("relevant"),
        (F.sum("relevant") / F.nullif(F.sum("all_relevant"), F.lit(0))).alias("pooled_recall"),
        F.avg("recall").alias("macro_recall"),
    )


def partition_counts(run: DataFrame, qrels: DataFrame, depth: int, least: int = 2) -> DataFrame:
    """Per topic: relevant, judged below, and unjudged among the first ``depth``."""
    rows = judged(run.where(F.col("rank") <= depth), qrels)
    count = lambda c: F.sum(c.cast("bigint"))
    rel = F.col("judged") & (F.col("grade") >= least)
    return rows.groupBy("topic").agg(count(rel).alias("relevant"), count(F.col("judged") & ~rel).alias("below"), count(~F.col("judged")).alias("unjudged"))


def set_measures(run: DataFrame, qrels: DataFrame, least: int = 2) -> DataFrame:
    """Per judged topic: set precision and recall of all that was returned, and how much that is."""
    rows = judged(run, qrels).groupBy("topic").agg(F.sum((F.col("grade") >= least).cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("num_ret"))
    known = qrels.groupBy("topic").agg(F.sum((F.col("grade") >= least).cast("bigint")).alias("all_relevant"))
    return known.join(rows, "topic", "left").select(
        "topic",
        F.coalesce(F.col("hits") / F.col("num_ret"), F.lit(0.0)).alias("set_p"),
        F.when(F.col("all_relevant") > 0, F.coalesce("hits", F.lit(0)) / F.nullif("all_relevant", F.lit(0))).otherwise(0.0).alias("set_recall"),
        F.coalesce("num_ret", F.lit(0)).alias("num_ret"),
    )
