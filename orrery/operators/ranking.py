"""Deduplication, fusion, rank statistics and orderings.

Frames carry ``topic``, ``doc``, ``rank``, ``score`` and, where there are several lists,
``stream``.  Every order is total, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import keep


def ranked(df: DataFrame, *order: Column | str, by: str | tuple[str, ...] = "topic", name: str = "rank") -> DataFrame:
    """Dense final ranks from 1 under a total order."""
    by = (by,) if isinstance(by, str) else by
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def top(df: DataFrame, k: int, *order: Column | str, by: str | tuple[str, ...] = "topic", name: str = "rank") -> DataFrame:
    """The first ``k`` of each group; Spark prunes groups before the shuffle."""
    return ranked(df, *order, by=by, name=name).where(F.col(name) <= k)


def best_per_document(hits: DataFrame) -> DataFrame:
    """One row per (topic, doc): its least (rank, -score), and all sightings in that order."""
    seen = F.struct("rank", (-F.col("score")).alias("negative"), "stream")
    grouped = hits.groupBy("topic", "doc").agg(F.array_sort(F.collect_list(seen)).alias("seen"))
    best = F.col("seen")[0]
    return grouped.select(
        "topic", "doc", best["rank"].alias("best_rank"), (-best["negative"]).alias("best_score"),
        F.transform("seen", lambda s: F.struct(s["stream"].alias("stream"), s["rank"].alias("rank"))).alias("provenance"),
    )


def best_of_stream(hits: DataFrame) -> DataFrame:
    """One row per (topic, stream, doc): least rank, then greatest score."""
    return hits.groupBy("topic", "stream", "doc").agg(F.min("rank").alias("rank"), F.max_by("score", F.struct(-F.col("rank"), F.col("score"))).alias("score"))


def check_fusion(k: float, weights: Mapping[str, float] | None) -> None:
    if not (k >= 1 and k < float("inf")):
        raise ValueError("k must be finite and at least 1")
    for name, w in (weights or {}).items():
        if not 0 < w < float("inf"):
            raise ValueError(f"weight of {name} must be finite and positive")


def rrf(hits: DataFrame, k: float = 60, weights: Mapping[str, float] | None = None, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank) over each stream's best row.

    Ordered by (-score, best rank, doc).  A stream without a weight is an error when
    weights are given.  Terms are summed in the order of streams, so equal inputs give
    equal sums.
    """
    check_fusion(k, weights)
    own = best_of_stream(hits)
    if weights is None:
        weight = F.lit(1.0)
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(table[F.col("stream")], F.raise_error(F.concat(F.lit("no weight for stream "), F.col("stream"))).cast("double"))
    term = (weight / (F.lit(float(k)) + F.col("rank"))).alias("term")
    fused = own.select("topic", "doc", "stream", "rank", term).groupBy("topic", "doc").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("stream", "term"))), F.lit(0.0), lambda a, x: a + x["term"]).alias("score"),
        F.min("rank").alias("best_rank"),
    )
    order = (F.desc(F.round("score", 12)), "best_rank", "doc")
    return ranked(fused, *order) if limit is None else top(fused, limit, *order)


def rrf_of_searches(hits: DataFrame, k: float = 60) -> DataFrame:
    """Unweighted fusion that keeps repeated sightings; ties go to the smaller document."""
    fused = hits.groupBy("topic", "doc").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("score"))
    return ranked(fused, F.desc(F.round("score", 12)), "doc")


def rrf_family(hits: DataFrame, original: str, k: float = 60, limit: int | None = None, lone_original: float = 0.5) -> DataFrame:
    """Fusion with half the weight on the original stream, half shared by a topic's other streams.

    ``lone_original`` is the original's weight in a topic that has no other stream.
    """
    own = best_of_stream(hits)
    facets = own.where(F.col("stream") != original).groupBy("topic").agg(F.countDistinct("stream").alias("facets"))
    weight = F.when(F.col("stream") != original, F.lit(0.5) / F.col("facets")).when(F.col("facets").isNull(), F.lit(lone_original)).otherwise(F.lit(0.5))
    fused = (
        own.join(facets, "topic", "left")
        .withColumn("term", weight / (F.lit(float(k)) + F.col("rank")))
        .groupBy("topic", "doc")
        .agg(F.sum("term").alias("score"), F.min("rank").alias("best_rank"))
    )
    order = (F.desc(F.round("score", 12)), "best_rank", "doc")
    return ranked(fused, *order) if limit is None else top(fused, limit, *order)


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Inner join by keys that may be null."""
    own = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    return left.join(own, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys))).drop(*(f"_{k}_" for k in keys))


def _placed(df: DataFrame, by: tuple[str, ...], order: tuple[Column | str, ...], weight: Column) -> DataFrame:
    """``df`` sorted over many tasks and kept, with ``_at``, its ``_part`` of the order, and the weight ``_before`` that part and ``_n`` in all of its group."""
    rows = keep(df.sort(*by, *order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*by, "_part").agg(F.sum(weight).alias("_many"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_many").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _joined(rows, F.broadcast(parts.select(*by, "_part", "_first", before.alias("_before"), F.sum("_many").over(group).alias("_n"))), (*by, "_part"))


def numbered(df: DataFrame, *order: Column | str, by: str | tuple[str, ...] = "topic", name: str = "rank") -> DataFrame:
    """As ``ranked``, for groups too large for a task: no task holds one, and a sorted copy is kept in the checkpoint folder."""
    by = (by,) if isinstance(by, str) else by
    own = _placed(df, by, order, F.lit(1))
    return own.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_part", "_first", "_before", "_n")


def _tied(df: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """``df`` with ``_n`` rows of a group, ``_above`` before the ties when descending, and ``_ties``.

    Values are counted first, and counts are summed part by part of their order: no task holds a group.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    own = _placed(counts, by, (F.desc(value),), F.col("_ties"))
    within = F.sum("_ties").over(Window.partitionBy(*by, "_part").orderBy("_at")) - F.col("_ties")
    return _joined(df, own.select(*by, value, "_n", (F.col("_before") + within).alias("_above"), "_ties"), (*by, value))


def _with_tied(df: DataFrame, by: tuple[str, ...], value: str, name: str, rule) -> DataFrame:
    made = rule(F.col("_n"), F.col("_above"), F.col("_ties"))
    return _tied(df, by, value).withColumn(name, made).drop("_n", "_above", "_ties")


def percentile_best_one(df: DataFrame, value: str, by: tuple[str, ...] = ("topic",), name: str = "percentile") -> DataFrame:
    """(n - average rank + 1) / n: the best has 1."""
    return _with_tied(df, by, value, name, lambda n, above, ties: (n - (above + (ties + 1) / 2) + 1) / n)


def percentile_average_rank(df: DataFrame, value: str, by: tuple[str, ...] = ("topic",), name: str = "percentile") -> DataFrame:
    """(n - average rank) / (n - 1); a lone row has 1."""
    return _with_tied(df, by, value, name, lambda n, above, ties: F.when(n == 1, 1.0).otherwise((n - (above + (ties + 1) / 2)) / F.nullif(n - 1, F.lit(0))))


def percentile_midrank(df: DataFrame, value: str, by: tuple[str, ...] = ("topic",), name: str = "percentile") -> DataFrame:
    """(rows below + (ties - 1) / 2) / (n - 1); a lone row has 1."""
    return _with_tied(df, by, value, name, lambda n, above, ties: F.when(n == 1, 1.0).otherwise((n - above - ties + (ties - 1) / 2) / F.nullif(n - 1, F.lit(0))))


def fractional_rank(df: DataFrame, value: str, by: tuple[str, ...], name: str) -> DataFrame:
    """Ascending ranks from 1, ties sharing their average."""
    return _with_tied(df, by, value, name, lambda n, above, ties: n - above - ties + 1 + (ties - 1) / 2)


def natural_key(topic: str) -> tuple[Column, Column, Column]:
    """Sort keys of a natural order: text before a closing number, the number (-1: none), the whole."""
    number = F.nullif(F.regexp_extract(topic, "([0-9]*)$", 1), F.lit(""))
    return F.regexp_replace(topic, "[0-9]+$", ""), F.coalesce(number.cast("bigint"), F.lit(-1)), F.col(topic)


def splice(prefix: DataFrame, tail: DataFrame) -> DataFrame:
    """A protected prefix, then the tail without it, with new ranks."""
    rest = tail.join(prefix.select("topic", "doc"), ["topic", "doc"], "left_anti")
    both = prefix.select("topic", "doc", "rank", F.lit(0).alias("part")).unionByName(rest.select("topic", "doc", "rank", F.lit(1).alias("part")))
    return ranked(both, "part", "rank", "doc", name="final_rank").select("topic", "doc", "final_rank")


def eligible_for_cap(hits: DataFrame, original: str, cap: int) -> DataFrame:
    """Documents that the original stream has, or some other stream ranks within ``cap``."""
    return hits.groupBy("topic", "doc").agg(F.max((F.col("stream") == original) | F.col("rank").between(1, cap)).alias("eligible"))


def cap_replay(order: DataFrame, eligible: DataFrame, protected: int) -> DataFrame:
    """Protected prefix, then eligible documents, then the rest, each in its old order."""
    tier = F.when(F.col("rank") <= protected, 0).when(F.col("eligible"), 1).otherwise(2)
    both = order.join(eligible, ["topic", "doc"], "left").withColumn("tier", tier)
    return ranked(both, "tier", "rank", "doc", name="final_rank")


def page(df: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    """One page per topic, with what is left behind it: count, best score, and the page's least."""
    rows = ranked(df, *order, name="place")
    inside = F.col("place").between(offset + 1, offset + limit)
    after = F.col("place") > offset + limit
    return rows.groupBy("topic").agg(
        F.sum(inside.cast("bigint")).alias("returned"),
        F.sum(after.cast("bigint")).alias("left"),
        F.max(F.when(after, F.col("score"))).alias("left_best"),
        F.min(F.when(inside, F.col("score"))).alias("returned_least"),
        F.ceil(F.count(F.lit(1)) / limit).cast("bigint").alias("pages"),
    )


def ordinals(rows: DataFrame, bucket: Column, *order) -> DataFrame:
    """``rows`` with their ``ordinal`` in the order of all: counts of the buckets before, and the place within.

    ``bucket`` rises with the order; one row for each bucket meets in one task, not the table.
    """
    own = rows.withColumn("__bucket", bucket)
    counts = own.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return own.withColumn("__place", place).join(before, "__bucket").withColumn("ordinal", F.col("__before") + F.col("__place")).drop("__bucket", "__before", "__place")
