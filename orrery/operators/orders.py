"""Further orders, gains and summaries of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.ranking import numbered, ranked
from orrery.sources.runs import demand


def three_orders(documents: DataFrame) -> DataFrame:
    """Ranks of each document by narrative, by combination, and by breadth, ties always by retrieval rank and id.

    ``documents``: topic, doc, narrative, combo, best_rank, facets, passages.
    """
    last = ("best_rank", "doc")
    own = numbered(documents, F.desc("narrative"), *last, name="narrative_rank")
    own = numbered(own, F.desc("combo"), *last, name="combo_rank")
    return numbered(own, F.desc("facets"), F.desc("passages"), F.desc("combo"), *last, name="breadth_rank")


def reranked_stream(stream: DataFrame, scores: DataFrame) -> DataFrame:
    """A stream by its documents' aggregate scores; a topic with a document that has none is a fault and keeps its order.

    ``stream``: topic, doc, rank.  ``scores``: topic, doc, score.
    """
    both = stream.join(scores.groupBy("topic", "doc").agg(F.max("score").alias("score")), ["topic", "doc"], "left")
    missing = F.sum(F.col("score").isNull().cast("bigint")).over(Window.partitionBy("topic"))
    own = both.withColumn("missing", missing)
    key = F.when(F.col("missing") == 0, -F.col("score"))
    return ranked(own, key.asc_nulls_last(), "rank", "doc", name="new_rank").select("topic", "doc", "rank", "new_rank", "missing")


def without_part(ordered: DataFrame, weight: float = 0.15, protected: int = 100) -> DataFrame:
    """The order once a component's weighted part is taken off the objective; the first ``protected`` stay.

    ``ordered``: topic, doc, rank, objective, part.
    """
    left = F.round(F.col("objective") - weight * F.col("part"), 9)
    first = F.col("rank") <= protected
    return ranked(ordered, F.desc(first), F.when(first, F.lit(0.0)).otherwise(-left), "rank", name="new_rank").select("topic", "doc", "rank", "new_rank")


def bound_depth(run: DataFrame, depth: int, bound: int) -> DataFrame:
    """The first ``depth`` of each topic, where the adapter is bound to just this depth and no topic goes deeper."""
    if depth != bound:
        raise ValueError(f"depth {depth} differs from the bound depth {bound}")
    return demand(run, F.col("rank") > bound, "a run is deeper than its bound depth")


def submitted(documents: DataFrame, cap: int | None = None) -> DataFrame:
    """Useful documents in order, at most ``cap`` a topic, with scores that count down to 1.

    ``documents``: topic, doc, useful.
    """
    own = ranked(documents.where("useful > 0"), F.desc(F.round("useful", 9)), "doc")
    own = own if cap is None else own.where(F.col("rank") <= cap)
    n = F.count(F.lit(1)).over(Window.partitionBy("topic"))
    return own.select("topic", "doc", "rank", (n - F.col("rank") + 1).alias("score"))


def retention(ranking: DataFrame, qrels: DataFrame, seen: DataFrame, depths: tuple[int, ...], least: int = 2) -> DataFrame:
    """Per topic and depth: relevant documents, graded gain, precision over the prefix, and how many facet-only ones are kept.

    ``ranking``: topic, doc, rank.  ``seen``: topic, doc, stream.  Facet-only documents are relevant
    and no "original" stream has them.  Depth 0 is the whole union: its recall is the ceiling.
    """
    only = seen.groupBy("topic", "doc").agg((F.max((F.col("stream") == "original").cast("int")) == 0).alias("facet_only"))
    own = ranking.join(qrels, ["topic", "doc"], "left").join(only, ["topic", "doc"], "left")
    relevant = F.coalesce(F.col("grade") >= least, F.lit(False))
    gain = F.when(relevant, F.pow(F.lit(2.0), F.col("grade")) - 1).otherwise(0.0)
    facet = relevant & F.coalesce(F.col("facet_only"), F.lit(False))
    own = own.select("topic", "rank", relevant.alias("relevant"), gain.alias("gain"), facet.alias("facet"))
    known = qrels.where(F.col("grade") >= least).groupBy("topic").agg(F.count(F.lit(1)).alias("known"), F.sum(F.pow(F.lit(2.0), F.col("grade")) - 1).alias("known_gain"))
    deep = own.withColumn("depth", F.explode(F.array(*map(F.lit, (*depths, 0)))))
    inside = (F.col("depth") == 0) | (F.col("rank") <= F.col("depth"))
    count = lambda c: F.sum((c & inside).cast("bigint"))
    per = deep.groupBy("topic", "depth").agg(
        count(F.lit(True)).alias("prefix"), count(F.col("relevant")).alias("found"), F.sum(F.when(inside, F.col("gain")).otherwise(0.0)).alias("gain"),
        count(F.col("facet")).alias("kept"), F.sum(F.col("facet").cast("bigint")).alias("facet_only"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0))).otherwise(0.0)
    return per.join(known, "topic", "left").select(
        "topic", "depth", "prefix", "found", "gain", "kept", "facet_only", ratio("found", "prefix").alias("precision"), ratio("found", "known").alias("recall"),
        ratio("gain", "known_gain").alias("graded_recall"), ratio("kept", "facet_only").alias("retention"),
    )


def cosine_faults(cells: DataFrame, size: int, slack: float = 1e-12) -> DataFrame:
    """(i, j, fault) of a matrix's cells: outside -1 .. 1 or not finite, unlike its mirror, missing, or twice.

    ``cells``: i, j, value, for i and j below ``size``.
    """
    spark = cells.sparkSession
    grid = spark.range(size).select(F.col("id").alias("i")).join(spark.range(size).select(F.col("id").alias("j")))
    one = cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    mirror = one.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("other"))
    both = grid.join(one, ["i", "j"], "full").join(mirror, ["i", "j"], "left")
    v = F.col("value")
    fault = (
        F.when((F.col("i") >= size) | (F.col("j") >= size), "outside").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice")
        .when(v.isNull() | F.isnan(v) | (F.abs(v) > 1), "range").when(F.abs(v - F.col("other")) > slack, "symmetry")
    )
    return both.select("i", "j", fault.alias("fault")).where("fault IS NOT NULL")
