"""Evidence selection: exact groups, a bounded pool, clusters, diverse order, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import guard_signature
from orrery.operators.greedy import leader_clusters, mmr


def exact_groups(items: DataFrame) -> DataFrame:
    """Items of one topic, kind and text as one group: its best member, all members in order, its rank.

    ``items``: topic, id, doc, kind, text, score.  Members go by (-score, id); groups by
    their best member's, and a group's relevance is one over its rank.
    """
    member = F.struct((-F.col("score")).alias("neg"), "id", "doc")
    own = items.groupBy("topic", "kind", "text").agg(F.array_sort(F.collect_list(member)).alias("m"))
    order = Window.partitionBy("topic").orderBy(F.col("m")[0]["neg"], F.col("m")[0]["id"])
    rank = F.row_number().over(order).cast("bigint")
    return own.select(
        "topic", F.col("m")[0]["id"].alias("id"), "kind", "text", (-F.col("m")[0]["neg"]).alias("score"),
        F.transform("m", lambda x: x["id"]).alias("members"), F.transform("m", lambda x: x["doc"]).alias("docs"), rank.alias("rank"),
    ).withColumn("relevance", 1 / F.col("rank"))


def pool(items: DataFrame, groups: int) -> DataFrame:
    """Members of the first ``groups`` groups of each topic, groups by (-best score, its least id)."""
    own = items.groupBy("topic", "kind", "text").agg(F.max("score").alias("best"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("first"))
    order = Window.partitionBy("topic").orderBy(F.desc("best"), "first")
    kept = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= groups)
    return items.join(kept.select("topic", "kind", "text", "place"), ["topic", "kind", "text"])


def supports(items: DataFrame, by: tuple[str, ...], most: int = 3) -> DataFrame:
    """Up to ``most`` items of each group from distinct documents, best first."""
    first = items.groupBy(*by, "doc").agg(F.min(F.struct((-F.col("score")).alias("neg"), "id")).alias("s"))
    order = Window.partitionBy(*by).orderBy("s.neg", "s.id")
    return first.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most).select(*by, "doc", F.col("s.id").alias("id"), "place")


def select_evidence(items: DataFrame, budgets: tuple[int, ...] = (40, 80, 120), threshold: float = 0.92, weight: float = 0.7) -> DataFrame:
    """Clusters in diverse order, and the least budget that holds each.

    ``items``: topic, id, doc, kind, text, score, vector.  The pool has ten groups for
    each place of the largest budget.
    """
    most = max(budgets)
    groups = exact_groups(pool(items, 10 * most).drop("place"))
    vectors = items.select("topic", "id", "vector")
    own = groups.join(vectors, ["topic", "id"]).withColumn("signature", guard_signature(F.col("text")))
    # Clusters are led in the order of relevance, so ranks serve as ids meanwhile.
    led = leader_clusters(own.select("topic", F.col("rank").alias("id"), "signature", "vector"), threshold)
    heads = led.where("id = leader").select("topic", F.col("id").alias("rank")).join(own, ["topic", "rank"])
    sizes = led.groupBy("topic", F.col("leader").alias("rank")).agg(F.count(F.lit(1)).alias("groups"))
    order = mmr(heads.select("topic", F.col("rank").alias("id"), "relevance", "vector"), most, weight)
    return (
        order.withColumnRenamed("id", "rank")
        .join(sizes, ["topic", "rank"])
        .join(heads.select("topic", "rank", "id"), ["topic", "rank"])
        .select("topic", "id", "place", "groups", _budget(F.col("place"), budgets).alias("budget"))
    )


def _budget(place: Column, budgets: tuple[int, ...]) -> Column:
    return F.least(*[F.when(place <= b, F.lit(b)) for b in budgets]) if len(budgets) > 1 else F.when(place <= budgets[0], F.lit(budgets[0]))
