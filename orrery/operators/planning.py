"""Windows to score, candidates to extract, chains to follow, pages to continue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.numbers import identity
from orrery.sources.runs import demand


def token_windows(docs: DataFrame, budget: int = 512, query: int = 32, special: int = 3, overlap: int = 64, most: int = 32) -> DataFrame:
    """Windows of tokens that fit beside a query: doc, window, start, end.

    ``docs``: doc, tokens (their number).  Windows share ``overlap`` tokens; where there
    would be more than ``most``, evenly spaced ones stay, the first and last among them.
    """
    size = budget - query - special
    step = size - overlap
    if step < 1:
        raise ValueError("the query leaves no room for a window")
    n = F.greatest(F.lit(1), F.ceil((F.col("tokens") - overlap) / F.lit(step))).cast("bigint")
    own = docs.where("tokens > 0").withColumn("n", n)
    picks = F.when(F.col("n") <= most, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")), lambda j: F.floor((j * (F.col("n") - 1) * 2 + most - 1) / (2 * (most - 1))))
    )
    return own.select("doc", "tokens", F.posexplode(picks).alias("window", "at")).select(
        "doc", F.col("window").cast("bigint").alias("window"), (F.col("at") * step).alias("start"), F.least(F.col("at") * step + size, F.col("tokens")).alias("end")
    )


def candidates(sentences: DataFrame, most_chars: int = 600) -> DataFrame:
    """Complete sentences, and admissible pairs of neighbours scored by the lesser of both.

    ``sentences``: doc, paragraph, start, end, complete, leans, score.  A pair lies in one
    paragraph, both are complete, the second leans on the first, and it is not too long.
    """
    w = Window.partitionBy("doc", "paragraph").orderBy("start")
    after = F.lead(F.struct("end", "complete", "leans", "score")).over(w)
    own = sentences.withColumn("after", after)
    one = own.where("complete").select("doc", "start", "end", F.lit("sentence").alias("kind"), "score")
    pair = own.where(F.col("complete") & F.col("after.complete") & F.col("after.leans") & (F.col("after.end") - F.col("start") <= most_chars))
    two = pair.select("doc", "start", F.col("after.end").alias("end"), F.lit("pair").alias("kind"), F.least("score", F.col("after.score")).alias("score"))
    every = one.unionByName(two)
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "start", "end"))
    return every.withColumn("rank", place.cast("bigint"))


def chain(needs: DataFrame, nuggets: DataFrame, passages: DataFrame, documents: DataFrame) -> DataFrame:
    """need, nugget, passage, document of every live link; superseded nuggets are out."""
    live = nuggets.where("superseded_by IS NULL")
    return needs.join(live, "need").join(passages, "passage").join(documents, "doc").select("need", "nugget", "passage", "doc", "digest")


def uncited(nuggets: DataFrame, citations: DataFrame) -> DataFrame:
    return nuggets.join(citations.select("nugget"), "nugget", "left_anti")


def longest_then_even(df: DataFrame, length: str, id: str, warm: int, timed: int) -> DataFrame:
    """A benchmark plan: the longest rows to warm up, and evenly spaced ones over all lengths to time."""
    # Places from both ends by the counts of each length: no window over the whole table.
    counts = df.groupBy(length).agg(F.count(F.lit(1)).alias("alike"))
    total = Window.orderBy(length)
    counts = counts.withColumn("shorter", F.sum("alike").over(total) - F.col("alike")).withColumn("n", F.sum("alike").over(total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    own = df.withColumn("place", F.row_number().over(Window.partitionBy(length).orderBy(id))).join(counts, length)
    own = own.withColumn("down", F.col("n") - F.col("shorter") - F.col("alike") + F.col("place")).withColumn("up", F.col("shorter") + F.col("place") - 1)
    # Row i is timed when it is floor((j (n - 1) 2 + timed - 1) / (2 (timed - 1))) for some j.
    j = F.floor((2 * F.col("up") * (timed - 1) + F.col("n") - 1) / F.nullif(2 * (F.col("n") - 1), F.lit(0)))
    spot = lambda k: F.floor((k * (F.col("n") - 1) * 2 + timed - 1) / (2 * (timed - 1)))
    hit = F.coalesce((spot(j) == F.col("up")) | (spot(j - 1) == F.col("up")) | (spot(j + 1) == F.col("up")), F.lit(True))
    return own.select(id, length, (F.col("down") <= warm).alias("warm"), ((F.col("n") <= timed) | hit).alias("timed")).where("warm OR timed")


def page_after(df: DataFrame, cursor: dict | None, limit: int, bound_to: str) -> tuple[DataFrame, str]:
    """Keyset pagination by (-score, doc): (the next rows, the identity that a cursor carries).

    ``cursor``: score, doc and identity of the last row seen; one of another query is refused.
    """
    own = df.sparkSession.range(1).select(identity(F.lit(bound_to), F.lit(str(limit)))).first()[0]
    if cursor is not None:
        if cursor["identity"] != own:
            raise ValueError("the cursor belongs to another query")
        df = df.where((F.col("score") < cursor["score"]) | ((F.col("score") == cursor["score"]) & (F.col("doc") > cursor["doc"])))
    return df.orderBy(F.desc("score"), "doc").limit(limit), own


def torn_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, lines that do not): an interrupted writer leaves a torn last line."""
    parsed = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.where("row._broken IS NULL").select("row.*").drop("_broken"), parsed.where("row._broken IS NOT NULL").select("value")


def reconstructed(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``rows`` (score, parts: array of struct(weight, value)); an action fails where the parts do not make the score."""
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["weight"] * p["value"])
    return demand(rows, F.abs(total - F.col("score")) > tolerance, "a score differs from its parts")
