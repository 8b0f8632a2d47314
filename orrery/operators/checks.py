"""Checks of runs, judgments, rubrics and populations: which row breaks which rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.numbers import finite, table_digest


def first_fault(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is broken (a rule that cannot be told is not)."""
    out = None
    for name, broken in rules:
        broken = F.coalesce(broken, F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, in file order; blank lines are left out but counted.

    Files are read in splits.  A line's number is its place in its split plus the lines of
    the file's splits before it: a table with one row per split.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.select("file", "split", (F.coalesce(before, F.lit(0)) - F.col("begin") + 1).alias("shift"))
    own = rows.join(placed, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")
    return own.where(F.trim("value") != "")


def run_faults(lines: DataFrame, topics: DataFrame) -> DataFrame:
    """(line, topic, fault) of a run's lines that break its format, and of topics that should not or should be there.

    ``lines``: line, value; ``topics``: topic.  Six fields, the second Q0; ranks dense from 1 in
    the order of lines; finite scores that never rise; each document once; one tag in the file;
    exactly the expected topics.
    """
    f = lambda k: F.get("f", F.lit(k))
    own = lines.select("line", F.split(F.trim("value"), r"\s+").alias("f")).select(
        "line", "f", f(0).alias("topic"), f(2).alias("doc"), f(3).try_cast("bigint").alias("rank"), f(4).try_cast("double").alias("score"), f(5).alias("tag")
    )
    shaped = own.where(F.size("f") == 6)
    by = Window.partitionBy("topic").orderBy("line")
    first_tag = shaped.agg(F.min_by("tag", "line").alias("first_tag"))  # one row
    seen = (
        shaped.withColumn("place", F.row_number().over(by))
        .withColumn("before", F.lag("score").over(by))
        .withColumn("copy", F.row_number().over(Window.partitionBy("topic", "doc").orderBy("line")))
        .join(F.broadcast(first_tag))
    )
    fault = first_fault(
        ("second field", f(1) != "Q0"), ("rank", F.col("rank").isNull() | (F.col("rank") < 1)), ("score", ~finite(F.col("score"))),
        ("rank order", F.col("rank") != F.col("place")), ("repeated document", F.col("copy") > 1), ("tag", F.col("tag") != F.col("first_tag")), ("rising score", F.col("score") > F.col("before")),
    )
    rows = seen.select("line", "topic", fault.alias("fault")).where("fault IS NOT NULL")
    torn = own.where(F.size("f") != 6).select("line", F.lit(None).cast("string").alias("topic"), F.lit("fields").alias("fault"))
    there = shaped.select("topic").distinct().withColumn("there", F.lit(True))
    both = there.join(topics.select(F.col("topic").cast("string")).distinct().withColumn("wanted", F.lit(True)), "topic", "full")
    population = both.where("there IS NULL OR wanted IS NULL").select(
        F.lit(None).cast("bigint").alias("line"), "topic", F.when(F.col("there").isNull(), "missing topic").otherwise("unexpected topic").alias("fault")
    )
    return rows.unionByName(torn).unionByName(population)


def judged_run(run: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of the judged topics by rank, with ``clash`` where a rank of a topic is taken twice."""
    own = run.join(topics.select("topic").distinct(), "topic", "left_semi")
    w = Window.partitionBy("topic")
    place = F.row_number().over(w.orderBy("rank", "doc")).cast("bigint")
    clash = F.count(F.lit(1)).over(Window.partitionBy("topic", "rank")) > 1
    return own.select("topic", "doc", "rank", place.alias("place"), clash.alias("clash"))


def qrels_faults(lines: DataFrame, order: list[str], grades: tuple[int, int] = (0, 4)) -> DataFrame:
    """(line, fault) of judgments: whole grades in range, no document twice, topics in runs and in ``order``.

    ``lines``: line, topic, doc, grade (text).
    """
    grade = F.when(F.col("grade").rlike("^[+-]?[0-9]+$"), F.col("grade").try_cast("bigint"))
    at = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("topic")), F.lit(0))
    copy = F.row_number().over(Window.partitionBy("topic", "doc").orderBy("line"))
    # Lines lie in order if no topic's place falls below that of any line before.
    spans = lines.groupBy("topic").agg(F.min("line").alias("begin"), F.max("line").alias("end")).withColumn("at", at)
    left = spans.withColumn("passed", F.max("end").over(Window.orderBy(F.col("at").asc_nulls_last(), "begin").rowsBetween(Window.unboundedPreceding, -1)))
    late = left.select("topic", "at", "passed")  # one row a topic
    own = lines.withColumn("copy", copy).join(late, "topic")
    fault = first_fault(("topic", F.col("at").isNull()), ("grade", grade.isNull() | ~grade.between(*grades)), ("repeated document", F.col("copy") > 1), ("topic order", F.col("passed") > F.col("line")))
    return own.select("line", fault.alias("fault")).where("fault IS NOT NULL")


def projection_faults(projected: DataFrame, source: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: whether a projected table holds exactly ``topics``, and the very rows that the source has for them."""
    wanted = topics.select("topic").distinct()
    own = source.join(wanted, "topic", "left_semi").select(*projected.columns)
    same = table_digest(projected).select(F.col("digest").alias("a"), F.col("n").alias("rows")).join(table_digest(own).select(F.col("digest").alias("b")))
    extra = projected.join(wanted, "topic", "left_anti").select("topic").distinct().agg(F.count(F.lit(1)).alias("extra_topics"))
    missing = wanted.join(projected, "topic", "left_anti").agg(F.count(F.lit(1)).alias("missing_topics"))
    return same.join(extra).join(missing).select("rows", "extra_topics", "missing_topics", F.col("a").eqNullSafe(F.col("b")).alias("same_rows"))


def rubric_assignments(items: DataFrame, runs: DataFrame, topics: DataFrame) -> DataFrame:
    """(run, topic, vital_strict, all_strict, assigned) of every run and topic, absent ones as zero, and each run's mean as topic "all".

    ``items``: run, topic, place, importance, met (0 or 1).
    """
    vital = F.col("importance") == "vital"
    share = lambda met, n: F.when(n > 0, met / F.nullif(n, F.lit(0))).otherwise(0.0)
    scored = items.groupBy("run", "topic").agg(
        share(F.sum(F.when(vital, F.col("met")).otherwise(0)), F.sum(vital.cast("bigint"))).alias("vital_strict"), share(F.sum("met"), F.count(F.lit(1))).alias("all_strict"), F.lit(True).alias("assigned")
    )
    grid = runs.select("run").distinct().join(topics.select("topic").distinct())
    every = grid.join(scored, ["run", "topic"], "left").na.fill(0.0, ["vital_strict", "all_strict"]).na.fill(False, ["assigned"])
    mean = every.groupBy("run").agg(F.lit("all").alias("topic"), F.avg("vital_strict").alias("vital_strict"), F.avg("all_strict").alias("all_strict"), F.min("assigned").alias("assigned"))
    return every.withColumn("topic", F.col("topic").cast("string")).unionByName(mean)


def template_faults(items: DataFrame) -> DataFrame:
    """(topic, templates): topics whose runs do not share one rubric of places, texts and importance."""
    one = items.groupBy("run", "topic").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("place", "text", "importance")))), 256).alias("template"))
    return one.groupBy("topic").agg(F.countDistinct("template").alias("templates")).where("templates > 1")


def promotion(arms: DataFrame, ladder: list[str], control: str, least_wins: int = 8, level: float = 0.05) -> DataFrame:
    """Nine guards for each arm of the ladder; the first of the ladder that passes all is selected, else the control.

    ``arms``: arm, losses_250, losses_500, losses_1000, pooled_delta, macro_delta, wins, ci_low, p,
    same_prefix, judged_delta.  A missing value fails its guard.
    """
    guards = {
        "no_losses_250": F.col("losses_250") == 0, "no_losses_500": F.col("losses_500") == 0, "no_losses_1000": F.col("losses_1000") == 0,
        "pooled_gain": F.col("pooled_delta") > 0, "macro_gain": F.col("macro_delta") > 0, "enough_wins": F.col("wins") >= least_wins,
        "significant": F.coalesce(F.col("ci_low") > 0, F.lit(False)) | F.coalesce(F.col("p") < level, F.lit(False)), "same_prefix": F.col("same_prefix"), "judged_no_worse": F.col("judged_delta") >= 0,
    }
    told = {name: F.coalesce(g, F.lit(False)) for name, g in guards.items()}
    failed = F.filter(F.array(*[F.when(~g, name) for name, g in told.items()]), lambda x: x.isNotNull())
    at = F.array_position(F.array(*map(F.lit, ladder)), F.col("arm"))
    own = arms.where(at > 0).select("arm", at.alias("at"), failed.alias("failed")).withColumn("passed", F.size("failed") == 0)
    best = own.where("passed").agg(F.min_by("arm", "at").alias("best"))  # one row
    return own.join(F.broadcast(best)).select("arm", "failed", "passed", F.coalesce("best", F.lit(control)).alias("selected"))
