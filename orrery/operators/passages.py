"""Passages: chunks, spans, and document scores made from window scores.

Windows carry topic, doc, chunk, start, end (half-open) and score.  A document has a
bounded number of windows, so its sorted windows are one array and every greedy rule is
a fold over it, inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.numbers import next_below

#: Weights of a document's four best passages, renormalised over what there is.
TOP4 = (0.55, 0.25, 0.13, 0.07)


def by_document(windows: DataFrame) -> DataFrame:
    """(topic, doc, ws): windows by (-score, start, end, chunk)."""
    w = F.struct((-F.col("score")).alias("neg"), "start", "end", "chunk", "score")
    return windows.groupBy("topic", "doc").agg(F.array_sort(F.collect_list(w)).alias("ws"))


def weighted(scores: Column) -> Column:
    """Weighted mean of the first four scores of an ordered array."""
    pairs = F.zip_with(F.slice(scores, 1, 4), F.slice(F.lit(list(TOP4)), 1, F.least(F.size(scores), F.lit(4))), lambda s, w: F.struct(s.alias("s"), w.alias("w")))
    pairs = F.filter(pairs, lambda p: p["s"].isNotNull())
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + f(p))
    return total(lambda p: p["s"] * p["w"]) / total(lambda p: p["w"])


def top4(windows: DataFrame) -> DataFrame:
    """The weighted mean of each document's four best windows."""
    return by_document(windows).select("topic", "doc", weighted(F.transform("ws", lambda w: w["score"])).alias("top4"))


def max_passage(windows: DataFrame) -> DataFrame:
    finite = windows.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return finite.groupBy("topic", "doc").agg(F.max("score").alias("maxp"))


def covered(start: Column, end: Column, spans: Column) -> Column:
    """How much of [start, end) an array of spans covers."""
    clipped = F.filter(
        F.transform(spans, lambda s: F.struct(F.greatest(start, s["start"]).alias("a"), F.least(end, s["end"]).alias("b"))),
        lambda c: c["b"] > c["a"],
    )
    swept = F.aggregate(
        F.array_sort(clipped),
        F.struct(start.alias("at"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, c: F.when(c["b"] <= acc["at"], acc).otherwise(
            F.struct(c["b"].alias("at"), (acc["sum"] + c["b"] - F.greatest(c["a"], acc["at"])).alias("sum"))
        ),
    )
    return swept["sum"]


def _greedy(ws: Column, accept) -> Column:
    """Windows that ``accept(window, kept so far)`` lets in, in order."""
    none = F.filter(ws, lambda w: F.lit(False))
    return F.aggregate(ws, none, lambda kept, w: F.when(accept(w, kept), F.concat(kept, F.array(w))).otherwise(kept))


def span_distinct_top4(windows: DataFrame, least_new: int = 128) -> DataFrame:
    """Top-4 mean over windows that each add ``least_new`` units to what is covered; the first always counts."""
    kept = _greedy(
        F.col("ws"),
        lambda w, kept: (F.size(kept) < 4)
        & ((F.size(kept) == 0) | (w["end"] - w["start"] - covered(w["start"], w["end"], kept) >= least_new)),
    )
    own = by_document(windows).withColumn("kept", kept)
    return own.select("topic", "doc", F.size("kept").cast("bigint").alias("n_kept"), weighted(F.transform("kept", lambda w: w["score"])).alias("score"))


def overlap_coefficient(a: Column, b: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return shared / F.least(a["end"] - a["start"], b["end"] - b["start"])


def suppressed(ws: Column, most: float = 0.5) -> Column:
    """Windows whose overlap with every better kept one stays below ``most``."""
    return _greedy(ws, lambda w, kept: ~F.exists(kept, lambda k: overlap_coefficient(w, k) >= most))


def suppressed_top4(windows: DataFrame) -> DataFrame:
    own = by_document(windows).withColumn("kept", suppressed(F.col("ws")))
    return own.select("topic", "doc", F.size("kept").cast("bigint").alias("n_kept"), weighted(F.transform("kept", lambda w: w["score"])).alias("score"))


def span_support(windows: DataFrame, delta: float = 1.0, least_new: int = 800, cap: int = 6) -> DataFrame:
    """How many windows within ``delta`` of the best add ``least_new`` new characters, at most ``cap``."""
    near = F.filter("ws", lambda w: w["score"] >= F.col("ws")[0]["score"] - delta)
    kept = _greedy(near, lambda w, kept: w["end"] - w["start"] - covered(w["start"], w["end"], kept) >= least_new)
    return by_document(windows).select("topic", "doc", F.least(F.size(kept), F.lit(cap)).cast("bigint").alias("support"))


def coverage_aware(documents: DataFrame, windows: DataFrame, depth: int = 50, a: float = 0.5, b: float = 0.5, c: float = 0.25) -> DataFrame:
    """Re-ranks the first ``depth``: a * document + b * top-4 + c * support; the tail keeps its order.

    ``documents``: topic, doc, rank, score.  Tail rows score the next double below what
    precedes them, step by step; without a head they start below 0.
    """
    head = documents.where(F.col("rank") <= depth).join(top4(windows), ["topic", "doc"]).join(span_support(windows), ["topic", "doc"])
    head = head.withColumn("total", a * F.col("score") + b * F.col("top4") + c * F.col("support"))
    order = Window.partitionBy("topic").orderBy("tail", F.desc("total"), "rank")
    both = head.select("topic", "doc", "rank", F.round("total", 9).alias("total"), F.lit(0).alias("tail")).unionByName(
        documents.where(F.col("rank") > depth).select("topic", "doc", "rank", F.lit(None).cast("double").alias("total"), F.lit(1).alias("tail"))
    )
    every = Window.partitionBy("topic")
    ranked = both.withColumn("final_rank", F.row_number().over(order).cast("bigint"))
    last, heads = F.coalesce(F.min("total").over(every), F.lit(0.0)), F.sum(1 - F.col("tail")).over(every)
    score = F.when(F.col("tail") == 0, F.col("total")).otherwise(next_below(last, F.col("final_rank") - heads))
    return ranked.withColumn("final_score", score).drop("tail")


def union_length(spans: DataFrame) -> DataFrame:
    """Length of the union of each document's spans: a running maximum of ends."""
    before = Window.partitionBy("topic", "doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.col("start"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", reach))
    return spans.withColumn("new", new).groupBy("topic", "doc").agg(F.sum("new").cast("bigint").alias("length"))


def chunks(df: DataFrame, id: str, text: str, size: int = 3500, overlap: int = 350) -> DataFrame:
    """Chunks of at most ``size`` characters, neighbours sharing ``overlap``; blank ones are left out."""
    step = size - overlap
    n = F.length(text)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step)).cast("int"))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: k * step)).otherwise(F.array().cast("array<int>"))
    rows = df.select(F.col(id).alias("doc"), F.col(text).alias("text"), F.posexplode(starts).alias("chunk", "start"))
    piece = F.substring(F.col("text"), F.col("start") + 1, F.lit(size))
    return (
        rows.withColumn("piece", piece)
        .where(F.trim("piece") != "")
        .select(
            "doc",
            F.concat(F.col("doc").cast("string"), F.lit(":"), F.lpad(F.col("chunk").cast("string"), 4, "0")).alias("chunk_id"),
            F.col("start").cast("bigint").alias("start"),
            (F.col("start") + F.length("piece")).cast("bigint").alias("end"),
            F.col("piece").alias("text"),
        )
    )


def overlapping(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of spans of one document that overlap: a hash join on the document with a range test."""
    o = others.select(F.col("topic"), F.col("doc"), F.col("id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return spans.join(o, ["topic", "doc"]).where((F.col("start") < F.col("other_end")) & (F.col("end") > F.col("other_start")))


def containing(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs where ``others``' span holds the whole of ``spans``'."""
    o = others.select(F.col("topic"), F.col("doc"), F.col("id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return spans.join(o, ["topic", "doc"]).where((F.col("other_start") <= F.col("start")) & (F.col("end") <= F.col("other_end")))


def neighbours(df: DataFrame, by: tuple[str, ...], order: str, value: str, offset: int, name: str) -> DataFrame:
    """The value ``offset`` rows on (negative: back), null at the edge."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.lead(value, offset).over(w) if offset >= 0 else F.lag(value, -offset).over(w))


def evenly_spaced(df: DataFrame, by: tuple[str, ...], order: str, most: int = 32) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced and with both ends; halves round up."""
    w = Window.partitionBy(*by)
    n, at = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    # Row i is the j-th chosen where i = floor((j * (n - 1) * 2 + most - 1) / (2 * (most - 1))).
    j = F.floor((2 * at * (most - 1) + n - 1) / F.nullif(2 * (n - 1), F.lit(0)))
    chosen = lambda k: F.floor((2 * k * (n - 1) + most - 1) / (2 * (most - 1)))
    keep = (n <= most) | (chosen(j) == at) | (chosen(j + 1) == at) | (chosen(j - 1) == at)
    return df.withColumn("at", at).withColumn("keep", keep).where("keep").drop("keep", "at")


def merge_incomplete(sentences: DataFrame) -> DataFrame:
    """Incomplete sentences join the next complete one; closing ones fold back into the last.

    ``sentences``: doc, start, end, complete.
    """
    w = Window.partitionBy("doc").orderBy("start")
    closed = F.coalesce(F.sum(F.col("complete").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("complete").cast("int")).over(Window.partitionBy("doc"))
    group = F.when(total == 0, 0).otherwise(F.least(closed, total - 1))
    return (
        sentences.withColumn("group", group)
        .groupBy("doc", "group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts"))
    )
