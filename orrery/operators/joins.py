"""Joins with guards: strict lookups, differences of rankings and tables, merges, pairings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.runs import demand


def strict_lookup(left: DataFrame, right: DataFrame, on: list[str], message: str = "a row has no match") -> DataFrame:
    """Inner join in which every left row must match; an action that meets one without fails."""
    both = left.join(right.withColumn("__found", F.lit(True)), on, "left")
    return demand(both, F.col("__found").isNull(), message).drop("__found")


def movement(before: DataFrame, after: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Documents of either top k, with both ranks, the grade, and how they moved."""
    a = before.select("topic", "doc", F.col("rank").alias("a_rank"))
    b = after.select("topic", "doc", F.col("rank").alias("b_rank"))
    both = a.join(b, ["topic", "doc"]).where((F.col("a_rank") <= k) | (F.col("b_rank") <= k)).join(qrels, ["topic", "doc"], "left")
    inside = lambda c: F.col(c) <= k
    how = F.when(inside("a_rank") & inside("b_rank"), "kept").when(inside("b_rank"), "incoming").otherwise("outgoing")
    return both.select("topic", "doc", "a_rank", "b_rank", "grade", how.alias("movement"), (F.col("a_rank") - F.col("b_rank")).alias("moved"))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per topic: documents in both top k, in either, and the share of k that both have."""
    top = lambda df, n: df.where(F.col("rank") <= k).select("topic", "doc", F.lit(1).alias(n))
    both = top(a, "a").join(top(b, "b"), ["topic", "doc"], "full")
    shared = F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("bigint"))
    return both.groupBy("topic").agg(shared.alias("shared"), F.count(F.lit(1)).alias("every"), (shared / k).alias("overlap"))


def rank_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either ranking whose rank differs, or that the other lacks."""
    both = a.select("topic", "doc", F.col("rank").alias("a_rank")).join(b.select("topic", "doc", F.col("rank").alias("b_rank")), ["topic", "doc"], "full")
    return both.where(~F.col("a_rank").eqNullSafe(F.col("b_rank")))


def table_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose values differ or that one side lacks, with the first differing column."""
    values = [c for c in a.columns if c not in key]
    left = a.select(*key, F.struct(*values).alias("a"))
    right = b.select(*key, F.struct(*values).alias("b"))
    both = left.join(right, key, "full")
    first = F.when(F.col("a").isNull(), "<only right>").when(F.col("b").isNull(), "<only left>")
    for c in values:
        first = first.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c)
    return both.withColumn("difference", first).where("difference IS NOT NULL").select(*key, "difference")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold equal bags of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merge(target: DataFrame, source: DataFrame, key: list[str], value: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(merged table, conflicts): new keys enter, equal ones stay, others conflict.

    With ``strict`` conflicts are for the caller to refuse; without, the target's value
    stands.  Source rows that repeat a key must agree; if not, that is a conflict too.
    """
    own = source.groupBy(*key).agg(F.min(value).alias("new"), (F.min(value) != F.max(value)).alias("torn"))
    both = target.select(*key, F.col(value).alias("old")).join(own, key, "full")
    conflict = F.coalesce(F.col("torn"), F.lit(False)) | (F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new")))
    merged = both.select(
        *key, F.coalesce("old", "new").alias(value),
        F.when(conflict, "conflict" if strict else "kept").when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "untouched").otherwise("equal").alias("action"),
    )
    return merged, both.where(conflict).select(*key, "old", "new")


def union_provenance(hits: DataFrame, text: str | None = None) -> DataFrame:
    """One row per (topic, doc) with all streams that hold it, by stream and rank.

    With ``text``, the streams' texts of a document must be one (nulls apart), and it comes along.
    """
    seen = F.array_sort(F.collect_list(F.struct("stream", "rank")))
    made = [seen.alias("seen"), F.countDistinct("stream").alias("streams")]
    if text is None:
        return hits.groupBy("topic", "doc").agg(*made)
    out = hits.groupBy("topic", "doc").agg(*made, F.min(text).alias(text), F.max(text).alias("_most"))
    torn = F.when(F.col(text) != F.col("_most"), F.raise_error(F.concat(F.lit("streams hold different texts of "), F.col("doc").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return out.where(torn).drop("_most")


def first_seen_lane(lanes: DataFrame, order: Column) -> DataFrame:
    """The lane that sees a document first, under ``order``, and how many do."""
    return lanes.groupBy("topic", "doc").agg(F.min_by("lane", F.struct(order, F.col("lane"))).alias("first_lane"), F.countDistinct("lane").alias("lanes"))


def bag_intersection(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """Texts of both sides, each as often as both have it; the k-th of one meets the k-th of the other."""
    nth = F.row_number().over(Window.partitionBy(text).orderBy("id"))
    left = a.select(F.col("id").alias("a_id"), text, nth.alias("nth"))
    right = b.select(F.col("id").alias("b_id"), text, nth.alias("nth"))
    return left.join(right, [text, "nth"]).select("a_id", "b_id", text)


def next_of(events: DataFrame, by: tuple[str, ...], order: str, ends: Column, value: str, name: str) -> DataFrame:
    """As-of join forwards: the first later row of the group for which ``ends`` holds."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn(name, F.first(F.when(ends, F.col(value)), ignorenulls=True).over(w))


def pair_calls(events: DataFrame, by: tuple[str, ...], order: str, starts: Column, ends: Column) -> DataFrame:
    """Starts with the end that follows them directly; unmatched starts and ends stay."""
    w = Window.partitionBy(*by).orderBy(order)
    own = events.where(starts | ends).withColumn("is_start", starts)
    own = own.withColumn("next_start", F.lead("is_start").over(w)).withColumn("next_at", F.lead(order).over(w)).withColumn("before_start", F.lag("is_start").over(w))
    matched = F.col("is_start") & (F.col("next_start") == F.lit(False))
    lone_end = ~F.col("is_start") & (F.col("before_start").isNull() | ~F.col("before_start"))
    kind = F.when(matched, "matched").when(F.col("is_start"), "open").when(lone_end, "orphan")
    return own.withColumn("pairing", kind).where("pairing IS NOT NULL").withColumn("ended", F.when(matched, F.col("next_at")))


def reconcile(reservations: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Every request of either side: success, failure, pending (no outcome) or orphan (no reservation)."""
    both = reservations.select(*key, F.lit(True).alias("reserved")).join(outcomes.select(*key, "ok"), key, "full")
    state = F.when(F.col("reserved").isNull(), "orphan").when(F.col("ok").isNull(), "pending").when(F.col("ok"), "success").otherwise("failure")
    return both.select(*key, state.alias("state"))


def tiered(ranked: DataFrame, *fallbacks: DataFrame) -> DataFrame:
    """Ranks from the first table that has the document; later tables come after all earlier ones."""
    tiers = [df.select("topic", "doc", F.col("rank").alias("at"), F.lit(k).alias("tier")) for k, df in enumerate((ranked, *fallbacks))]
    every = reduce(DataFrame.unionByName, tiers)
    best = every.groupBy("topic", "doc").agg(F.min(F.struct("tier", "at")).alias("b")).select("topic", "doc", "b.tier", "b.at")
    order = Window.partitionBy("topic").orderBy("tier", "at", "doc")
    return best.withColumn("final_rank", F.row_number().over(order).cast("bigint"))


#: Rows of a block of ``cosine_pairs``.
BLOCK_ROWS = 2048


def cosine_pairs(items: DataFrame, least: float) -> DataFrame:
    """Pairs i < j of a group whose cosine is at least ``least``.

    ``items``: topic, id, vector.  A group's rows are dealt into blocks of about
    ``BLOCK_ROWS``, and each pair of blocks is a task: none holds a group.  Rows are sent
    once for each block of their group, and only pairs that reach ``least`` come out.
    """
    import numpy as np
    import pandas as pd

    blocks = items.groupBy("topic").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    own = items.join(blocks, "topic").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.select("topic", "id", "vector", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("topic", "id", "vector", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") <= F.col("other")).alias("left"))

    def unit(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.sort_values("id", kind="stable")
        v = np.array([np.asarray(x, float) for x in rows["vector"]])
        norm = np.sqrt((v**2).sum(axis=1))
        return rows["id"].to_numpy(), v / np.where(norm == 0, 1, norm)[:, None]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        within = rows["x"].iloc[0] == rows["y"].iloc[0]
        out = pd.DataFrame({"i": np.empty(0, int), "j": np.empty(0, int), "cosine": np.empty(0)})
        if within or rows["left"].nunique() == 2:
            a, v = unit(rows if within else rows[rows["left"]])
            b, w = (a, v) if within else unit(rows[~rows["left"]])
            s = v @ w.T
            i, j = np.nonzero(s >= least)
            if within:
                i, j = i[i < j], j[i < j]
            out = pd.DataFrame({"i": np.minimum(a[i], b[j]), "j": np.maximum(a[i], b[j]), "cosine": s[i, j]})
        out.insert(0, "topic", rows["topic"].iloc[0])
        return out

    return met.groupBy("topic", "x", "y").applyInPandas(run, "topic string, i long, j long, cosine double")
