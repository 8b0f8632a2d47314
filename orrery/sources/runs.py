"""Run and judgment files: readers with explicit schemas and checks, and writers.

Files are read as lines and split by expressions, so they are splittable and nothing is
inferred.  ``strict`` readers count what breaks the format and fail if there is any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.split(F.trim("value"), separator).alias("f"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def demand(df: DataFrame, broken, message: str) -> DataFrame:
    """``df``; an action that meets a row for which ``broken`` holds fails with ``message``."""
    checked = F.when(broken, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(checked)


def read_qrels(spark: SparkSession, path: str, strict: bool = False, grades: tuple[int, int] = (0, 4)) -> DataFrame:
    """topic, iteration, doc, grade.  Of repeated judgments the later line counts; strict forbids them."""
    rows = _fields(spark, path)
    rows = demand(rows, F.size("f") != 4, "a judgment line must have four fields")
    f = lambda k: F.col("f")[k]
    rows = rows.select(f(0).alias("topic"), f(1).alias("iteration"), f(2).alias("doc"), f(3).cast("bigint").alias("grade"), "line")
    if strict:
        rows = demand(rows, ~F.col("grade").between(*grades), "a grade is out of range")
        n = F.count(F.lit(1)).over(Window.partitionBy("topic", "doc"))
        return demand(rows.withColumn("n", n), F.col("n") > 1, "a document is judged twice").drop("n", "line")
    return rows.groupBy("topic", "doc").agg(F.max_by("iteration", "line").alias("iteration"), F.max_by("grade", "line").alias("grade"))


def read_run(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """topic, doc, rank, score, tag.  Strict: dense ranks, unique documents, one tag, falling scores."""
    rows = demand(_fields(spark, path), F.size("f") != 6, "a run line must have six fields")
    f = lambda k: F.col("f")[k]
    own = rows.select(f(0).alias("topic"), f(2).alias("doc"), f(3).cast("bigint").alias("rank"), f(4).cast("double").alias("score"), f(5).alias("tag"))
    if not strict:
        return own
    w = Window.partitionBy("topic").orderBy("rank", "doc")
    own = own.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("score").over(w))
    own = own.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("topic", "doc")))
    own = demand(own, F.col("place") != F.col("rank"), "ranks are not dense from 1")
    own = demand(own, F.col("before") < F.col("score"), "scores rise")
    own = demand(own, F.col("copies") > 1, "a document is ranked twice")
    tags = own.agg((F.min("tag") != F.max("tag")).alias("mixed"))  # one row
    own = demand(own.join(F.broadcast(tags)), F.coalesce("mixed", F.lit(False)), "a run has one tag")
    return own.drop("place", "before", "copies", "mixed")


def faults(run: DataFrame) -> DataFrame:
    """Per topic: rows, ranks out of place, and scores above the one before."""
    w = Window.partitionBy("topic").orderBy("rank")
    rows = run.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("score").over(w))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("rows"), count(F.col("place") != F.col("rank")).alias("rank_faults"), count(F.col("before") < F.col("score")).alias("score_faults"))


def write_run(df: DataFrame, path: str, tag: str, depth_scores: int | None = None) -> None:
    """Lines ``topic Q0 doc rank score tag`` in order; with ``depth_scores`` the score is depth - rank + 1."""
    score = F.col("score") if depth_scores is None else F.lit(depth_scores) - F.col("rank") + 1
    line = F.concat_ws(" ", F.col("topic").cast("string"), F.lit("Q0"), F.col("doc").cast("string"), F.col("rank").cast("string"), score.cast("string"), F.lit(tag))
    df.sort("topic", "rank").select(line.alias("value")).write.mode("errorifexists").text(path)


def write_runs(df: DataFrame, path: str, depth: int) -> None:
    """One folder per arm of ``df`` (arm, topic, doc, final_rank), each a run file set."""
    line = F.concat_ws(" ", F.col("topic").cast("string"), F.lit("Q0"), F.col("doc").cast("string"), F.col("final_rank").cast("string"), (F.lit(depth) - F.col("final_rank") + 1).cast("string"), F.col("arm"))
    own = df.where(F.col("final_rank") <= depth)
    own.repartition("arm").sortWithinPartitions("arm", "topic", "final_rank").select("arm", line.alias("value")).write.partitionBy("arm").text(path)
