"""A run's evaluation bound to what it was made from: run, judgments, topics and metrics by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.numbers import identity, table_digest
from orrery.operators.measures import dispatch, macro
from orrery.sources.runs import demand


def evaluate_run(
    run: DataFrame, qrels: DataFrame, topics: DataFrame, metrics: tuple[str, ...], least: int = 2, qrels_digest: str | None = None, variant: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values by topic, means over topics, binding) of a run.

    ``run``: topic, doc, rank, score; ``qrels``: topic, doc, grade; ``topics``: topic.  It is an
    error if a topic has no judgments, if the run's topics are not just these, if a document
    or a rank stands twice, if a metric is named twice, or if the judgments' digest is not
    ``qrels_digest``; judgments without a digest to meet need a ``variant`` that names them.

    The binding is one row: run_sha256, qrels_sha256, topics_sha256, metrics, least, variant,
    and evaluation_sha256 over all of them.  Every value carries evaluation_sha256, so
    none can be taken for another run's.
    """
    if not 1 <= least <= 4:
        raise ValueError("least must be a grade from 1 to 4")
    if len(set(metrics)) != len(metrics) or not metrics:
        raise ValueError("metrics must be named, and each once")
    if qrels_digest is None and not variant:
        raise ValueError("judgments without a digest to meet need a variant's name")
    wanted = topics.select("topic").distinct()
    judged = qrels.select("topic").distinct().withColumn("judged", F.lit(True))
    wanted = demand(wanted.join(judged, "topic", "left"), F.col("judged").isNull(), "a topic has no judgments").drop("judged")
    there = run.select("topic").distinct().withColumn("run", F.lit(True))
    both = demand(wanted.withColumn("asked", F.lit(True)).join(there, "topic", "full"), F.col("asked").isNull() | F.col("run").isNull(), "the run's topics are not those evaluated")
    own = run.join(both.select("topic"), "topic", "left_semi")
    places = own.groupBy("topic").agg((F.count(F.lit(1)) > F.least(F.count_distinct("doc"), F.count_distinct("rank"))).alias("twice"))
    own = demand(own.join(places, "topic"), F.col("twice"), "a document or a rank of the run stands twice").drop("twice")
    named = lambda df, name: table_digest(df).select(F.col("digest").alias(name))
    graded = named(qrels.select("topic", "doc", "grade"), "qrels_sha256")
    if qrels_digest is not None:
        graded = demand(graded, F.col("qrels_sha256") != qrels_digest, "the judgments are not those expected")
    # Each side is one row.
    binding = named(run.select("topic", "doc", "rank", "score"), "run_sha256").join(F.broadcast(graded)).join(F.broadcast(named(wanted, "topics_sha256")))
    binding = binding.withColumns({"metrics": F.lit(",".join(sorted(metrics))), "least": F.lit(least), "variant": F.lit(variant or "")})
    binding = binding.withColumn("evaluation_sha256", identity(*(F.col(c) for c in ("run_sha256", "qrels_sha256", "topics_sha256", "metrics", "least", "variant"))))
    values = dispatch(own, qrels.join(wanted, "topic", "left_semi"), metrics, least)
    sealed = binding.select("evaluation_sha256")
    return values.join(F.broadcast(sealed)), macro(values, wanted).join(F.broadcast(sealed)), binding
