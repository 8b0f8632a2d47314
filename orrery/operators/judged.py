"""Judged coverage: obligations, citation support, nuggets, rubrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of judgment labels.
COVERAGE = {"full": 1.0, "partial": 0.5, "unsupported": 0.0}
SUPPORT = {"FS": 1.0, "PS": 0.5, "NS": 0.0}
IMPORTANCE = {"vital": 1.0, "okay": 0.5}


def _value(column: str, table: dict[str, float]):
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in table.items():
        out = out.when(F.col(column) == name, F.lit(value))
    return out


def obligation_coverage(judgments: DataFrame) -> DataFrame:
    """Per topic: mean over facets of their required obligations' mean value, and the rest.

    ``judgments``: topic, facet, obligation, required, label.  Also the share of required
    ones that are full, the mean of supplemental ones (null without any), label counts.
    """
    own = judgments.withColumn("value", _value("label", COVERAGE))
    facets = own.where("required").groupBy("topic", "facet").agg(F.avg("value").alias("facet_mean"))
    macro = facets.groupBy("topic").agg(F.avg("facet_mean").alias("coverage"))
    count = lambda c: F.sum(c.cast("bigint"))
    rest = own.groupBy("topic").agg(
        F.avg(F.when(F.col("required"), (F.col("label") == "full").cast("double"))).alias("strict_full"),
        F.avg(F.when(~F.col("required"), F.col("value"))).alias("supplemental"),
        *[count(F.col("label") == n).alias(n) for n in COVERAGE],
    )
    return rest.join(macro, "topic", "left")


def coverage_summary(per_topic: DataFrame) -> DataFrame:
    """Over topics: means, and totals of labels."""
    return per_topic.agg(
        F.avg("coverage").alias("coverage"), F.avg("strict_full").alias("strict_full"), F.avg("supplemental").alias("supplemental"),
        *[F.sum(n).alias(n) for n in COVERAGE], F.count(F.lit(1)).alias("topics"),
    )


def support_metrics(citations: DataFrame) -> DataFrame:
    """Per topic that is judged in full: sentences, cited ones, weighted precision and recall.

    ``citations``: topic, sentence, place (null without a citation), label (null unjudged).
    Precision is the mean value of citations; recall the mean over sentences of their best.
    """
    own = citations.withColumn("value", _value("label", SUPPORT))
    open_ = F.max((F.col("place").isNotNull() & F.col("label").isNull()).cast("int"))
    sentences = own.groupBy("topic", "sentence").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("best"), F.sum("value").alias("sum"), F.count("place").alias("cited"), open_.alias("open"))
    return sentences.groupBy("topic").agg(
        F.max("open").alias("open"),
        F.count(F.lit(1)).alias("sentences"),
        F.sum((F.col("cited") > 0).cast("bigint")).alias("cited_sentences"),
        F.sum("cited").alias("citations"),
        (F.sum("sum") / F.nullif(F.sum("cited"), F.lit(0))).alias("precision"),
        F.avg("best").alias("recall"),
    ).where("open = 0").drop("open")


def nugget_gain(run: DataFrame, nuggets: DataFrame, depth: int) -> DataFrame:
    """Per topic: gain (each nugget once, at its importance's weight) over the ideal, and effort.

    ``nuggets``: topic, doc, nugget, importance, for the pairs that support.
    """
    value = _value("importance", IMPORTANCE)
    every = nuggets.select("topic", "nugget", value.alias("v")).distinct().groupBy("topic").agg(F.sum("v").alias("ideal"))
    top = run.where(F.col("rank") <= depth)
    seen = top.join(nuggets, ["topic", "doc"]).select("topic", "nugget", value.alias("v")).distinct().groupBy("topic").agg(F.sum("v").alias("got"), F.count(F.lit(1)).alias("found"))
    effort = top.groupBy("topic").agg(F.count(F.lit(1)).alias("effort"))
    return every.join(seen, "topic", "left").join(effort, "topic", "left").select(
        "topic",
        F.when(F.col("ideal") > 0, F.coalesce("got", F.lit(0.0)) / F.nullif("ideal", F.lit(0.0))).otherwise(0.0).alias("gain"),
        F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
        F.coalesce("effort", F.lit(0)).cast("bigint").alias("effort"),
    )


def strict_rubric(assignments: DataFrame) -> DataFrame:
    """Per (run, topic): share of vital, and of all, items met in full; 0 where there is none.

    ``assignments``: run, topic, item, importance, label.
    """
    met = (F.col("label") == "full").cast("bigint")
    vital = F.col("importance") == "vital"
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    return assignments.groupBy("run", "topic").agg(
        ratio(F.sum(F.when(vital, met).otherwise(0)), F.sum(vital.cast("bigint"))).alias("vital_strict"),
        ratio(F.sum(met), F.count(F.lit(1))).alias("all_strict"),
    )


def usefulness(documents: DataFrame) -> DataFrame:
    """3 x drafted + 1 x needs + .5 x nuggets + mean support, and the order that follows."""
    score = 3.0 * F.col("drafted") + 1.0 * F.col("needs") + 0.5 * F.col("nuggets") + F.coalesce("support", F.lit(0.0))
    own = documents.withColumn("useful", score)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("useful", 9)), "doc")).cast("bigint"))
