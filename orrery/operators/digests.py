"""Digests that say where two tables differ: a tree over ranges of hashed keys.

A row's digest frames every field by name, type and length, so no two rows run together.
A leaf's digest is over the digests of its rows in order; a node's is over its sixteen
children's.  Two trees with one root belong to equal tables, in whatever order their rows
lie; else a descent through differing children finds a leaf that differs, and only that
leaf's rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "level int, prefix string, digest string, rows long"


def typed_row(df: DataFrame) -> Column:
    """SHA-256 of a row, its fields by name with their types and lengths; nulls differ from all values."""

    def framed(name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        text = F.col(f"`{name}`")
        text = F.hex(text) if kind == "binary" else F.to_json(F.struct(text.alias("v"))) if kind.startswith(("array", "map", "struct")) else text.cast("string")
        head = f"{len(name)}:{name}{len(kind)}:{kind}"
        return F.when(text.isNull(), F.lit(head + "-")).otherwise(F.concat(F.lit(head), F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[framed(c) for c in sorted(df.columns)]), 256)


def leaf_of(key: list[str], depth: int) -> Column:
    """The leaf of a row: the first ``depth`` hexadecimal digits of its key's hash."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in key])
    return F.substring(F.sha2(text, 256), 1, depth)


def tree(df: DataFrame, key: list[str], depth: int = 3) -> DataFrame:
    """TREE: all nodes, level 0 the root (prefix ""), level ``depth`` the 16 ** depth leaves.

    Choose ``depth`` by the table's size: a leaf's digests meet in one row of an aggregation.
    """
    if not 1 <= depth <= 8:
        raise ValueError("depth must be from 1 to 8")
    rows = df.select(leaf_of(key, depth).alias("prefix"), typed_row(df).alias("digest"), F.lit(1).cast("long").alias("rows"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"])), ","), 256)
    # A leaf: its rows' digests in order, each as often as it stands.
    level = rows.groupBy("prefix").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"), F.sum("rows").alias("rows"))
    out = level.withColumn("level", F.lit(depth))
    for at in range(depth - 1, -1, -1):
        level = level.withColumn("up", F.substring("prefix", 1, at) if at else F.lit("")).groupBy("up").agg(joined.alias("digest"), F.sum("rows").alias("rows")).withColumnRenamed("up", "prefix")
        out = out.unionByName(level.withColumn("level", F.lit(at)))
    return out.select("level", "prefix", "digest", "rows")


def database_digest(roots: dict[str, DataFrame]) -> DataFrame:
    """One digest over several tables' trees, by name: ``digest`` and ``rows``."""
    own = None
    for name in sorted(roots):
        root = roots[name].where("level = 0").select(F.lit(name).alias("name"), "digest", "rows")
        own = root if own is None else own.unionByName(root)
    if own is None:
        raise ValueError("a database has tables")
    line = F.concat(F.length("name").cast("string"), F.lit(":"), F.col("name"), F.lit("="), F.col("digest"))
    return own.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"), F.sum("rows").alias("rows"))


def first_difference(a: DataFrame, b: DataFrame) -> str | None:
    """The least prefix of a leaf in which two trees of one depth differ; None where they do not.

    One prefix is carried down; each level compares at most sixteen nodes of either tree.
    """
    prefix, level = "", 0
    while True:
        side = lambda t: t.where((F.col("level") == level) & F.startswith("prefix", F.lit(prefix))).select("prefix", "digest")  # noqa: B023, E731
        both = side(a).join(side(b).withColumnRenamed("digest", "other"), "prefix", "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        found = both.agg(F.min("prefix").alias("p")).first()["p"]
        if found is None:
            return prefix if level else None
        prefix, level = found, level + 1


def write_with_tree(df: DataFrame, path: str, key: list[str], depth: int = 3) -> None:
    """Writes ``df`` below ``path`` with its tree beside it, rows dealt by the tree's first digit.

    What ``first_difference`` names can then be read by itself: ``read_leaf`` opens one
    sixteenth of the files and the leaf's rows of them.
    """
    own = df.withColumn("_leaf", leaf_of(key, depth)).withColumn("_part", F.substring("_leaf", 1, 1))
    own.repartitionByRange("_part", "_leaf").sortWithinPartitions("_part", "_leaf").write.partitionBy("_part").parquet(f"{path}/rows")
    tree(read_rows(df.sparkSession, path), key, depth).write.parquet(f"{path}/tree")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("_leaf", "_part")


def read_leaf(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The rows of one leaf: its files by partition, its row groups by range."""
    own = spark.read.option("mergeSchema", False).parquet(f"{path}/rows")
    return own.where((F.col("_part").cast("string") == prefix[:1]) & (F.col("_leaf") == prefix)).drop("_leaf", "_part")
