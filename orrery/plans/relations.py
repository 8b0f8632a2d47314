"""Driver tables seen as retrieval relations, as DataFrames and as SQL common table expressions.

* ``run``: topic = source; documents ranked by length.
* ``streams``: two orders of the same documents per topic.
* ``qrels``: grade = 2 * quality + (1 - toxic) of the labelled documents.
* ``retrieved``: orders as hits; topic = priority, stream = status, document = customer.
* ``windows``: order lines as scored passages; document = order, spans in characters.
* ``lanes``: order lines as lane scores; topic = supplier mod 10, lane = return flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "doc")
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), F.col("n_chars").cast("double").alias("score"))
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
    )


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = run(spark, sf_dir).withColumn("stream", F.lit("length"))
    by_id = Window.partitionBy("topic").orderBy("doc")
    second = (
        table(spark, sf_dir, "documents")
        .select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), (-F.col("doc_id")).cast("double").alias("score"))
        .withColumn("rank", F.row_number().over(by_id).cast("bigint"))
        .withColumn("stream", F.lit("early"))
    )
    return first.unionByName(second)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"))
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select("topic", F.col("doc_id").alias("doc"), (2 * F.col("quality") + 1 - F.col("toxic")).cast("bigint").alias("grade"))
    )


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("topic", "stream").orderBy(F.desc("score"), "hit")
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderpriority").alias("topic"),
            F.col("o_orderstatus").alias("stream"),
            F.col("o_custkey").alias("doc"),
            F.col("o_totalprice").alias("score"),
            F.col("o_orderkey").alias("hit"),
        )
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_linenumber").cast("bigint") - 1) * 1000
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return lines.agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price")).select(
        (F.col("l_orderkey") % 10).alias("topic"),
        F.col("l_orderkey").alias("doc"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("chunk"),
        start.alias("start"),
        (start + 500 + F.col("quantity").cast("bigint") * 100).alias("end"),
        (F.floor("price") / 10000).alias("score"),
    )


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 10).alias("topic"), F.col("l_returnflag").alias("lane"), F.col("l_partkey").alias("doc"))
        .agg(F.max("l_extendedprice").alias("score"))
    )


SQL = {
    "run": """run AS (
  SELECT source AS topic, doc_id AS doc, CAST(n_chars AS DOUBLE) AS score,
         row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents)""",
    "streams": """streams AS (
  SELECT source AS topic, doc_id AS doc, CAST(n_chars AS DOUBLE) AS score, 'length' AS stream,
         row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL
  SELECT source, doc_id, CAST(-doc_id AS DOUBLE), 'early',
         row_number() OVER (PARTITION BY source ORDER BY doc_id) FROM documents)""",
    "qrels": """qrels AS (
  SELECT d.source AS topic, l.doc_id AS doc, 2 * l.quality + 1 - l.toxic AS grade
  FROM labels l JOIN documents d USING (doc_id))""",
    "retrieved": """retrieved AS (
  SELECT o_orderpriority AS topic, o_orderstatus AS stream, o_custkey AS doc, o_totalprice AS score, o_orderkey AS hit,
         row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders)""",
    "windows": """windows AS (
  SELECT l_orderkey % 10 AS topic, l_orderkey AS doc, CAST(l_linenumber - 1 AS BIGINT) AS chunk,
         (CAST(l_linenumber AS BIGINT) - 1) * 1000 AS "start",
         (CAST(l_linenumber AS BIGINT) - 1) * 1000 + 500 + CAST(max(l_quantity) AS BIGINT) * 100 AS "end",
         floor(max(l_extendedprice)) / 10000 AS score
  FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "lanes": """lanes AS (
  SELECT l_suppkey % 10 AS topic, l_returnflag AS lane, l_partkey AS doc, max(l_extendedprice) AS score
  FROM lineitem GROUP BY ALL)""",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the named relations; it may begin with further expressions after a comma."""
    with_ = "WITH RECURSIVE " if recursive else "WITH "
    return with_ + ",\n".join(SQL[n] for n in names.split()) + body
