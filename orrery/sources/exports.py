"""Tables that leave together: stores with a manifest, portable scores, retrieval exports, packages, reports."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.numbers import table_digest
from orrery.operators.joins import merge
from orrery.sources.runs import write_run

MANIFEST = "name string, rows long, digest string, columns string"


def described(tables: dict[str, DataFrame]) -> list[dict]:
    """Rows, digest and columns of each table: one small row a table comes to the driver."""
    out = []
    for name, df in sorted(tables.items()):
        r = table_digest(df).first()
        out.append({"name": name, "rows": int(r["n"] or 0), "digest": r["digest"], "columns": json.dumps(sorted(df.columns))})
    return out


def write_store(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> list[dict]:
    """Each table as Parquet under its name, and last the manifest of what was written: without it a store is unfinished."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    found = described({name: spark.read.parquet(f"{path}/{name}") for name in tables})
    spark.createDataFrame(found, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return found


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A store's tables, once they are what its manifest says."""
    listed = [r.asDict() for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()]
    tables = {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in listed}
    if sorted(listed, key=lambda r: r["name"]) != described(tables):
        raise ValueError(f"{path}: a table differs from the manifest")
    return tables


def export_scores(scores: DataFrame, path: str, key: list[str], value: str = "score") -> None:
    """Scores as JSON lines in the order of their keys, names in order; doubles as their shortest exact text."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted([*key, value])]))
    scores.orderBy(*key).select(line.alias("value")).write.mode("errorifexists").text(path)


def import_scores(target: DataFrame, path: str, key: list[str], value: str = "score", strict: bool = True) -> DataFrame:
    """``target`` with exported scores; strict imports fail on a key whose scores differ, others keep the target's."""
    spark, fields = target.sparkSession, [target.schema[c] for c in (*key, value)]
    source = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)).option("mode", "FAILFAST").json(path)
    merged, conflicts = merge(target, source, key, value, strict)
    if strict and not conflicts.isEmpty():
        raise ValueError("exported scores conflict with the table's")
    return merged.select(*key, value)


def write_retrieval(run: DataFrame, documents: DataFrame, handoff: DataFrame, path: str, tag: str) -> None:
    """A run file, the same hits with their texts as JSON lines, and the handoff as JSON lines, one topic each."""
    write_run(run, f"{path}/run", tag)
    texts = run.join(documents.select("doc", "text"), "doc", "left").withColumn("tag", F.lit(tag))
    texts.select("topic", "doc", "rank", "score", "tag", "text").sort("topic", "rank").write.mode("errorifexists").json(f"{path}/with_text")
    handoff.sort("topic").write.mode("errorifexists").json(f"{path}/handoff")


def write_package(requests: DataFrame, evidence: DataFrame, path: str) -> None:
    """One JSON object for each topic: its request and its evidence in order.

    ``requests``: topic, narrative.  ``evidence``: topic, place, doc, text.
    """
    own = evidence.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "doc", "text"))).alias("evidence"))
    requests.join(own, "topic", "left").sort("topic").write.mode("errorifexists").json(path)


def write_runs_with_manifest(spark: SparkSession, runs: dict[str, DataFrame], path: str, depth: int) -> None:
    """Run files whose scores are depth - rank + 1, and a manifest of their rows and digests."""
    for name, df in runs.items():
        write_run(df.where(F.col("rank") <= depth), f"{path}/{name}", name, depth)
    found = described({name: spark.read.text(f"{path}/{name}") for name in runs})
    spark.createDataFrame(found, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def write_report(spark: SparkSession, tables: dict[str, DataFrame], database: str) -> None:
    """Report tables in a database of the session's catalog, replaced one after another."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")


def zipped(members: dict[str, bytes]) -> bytes:
    """A ZIP of small members in the order of names, the same bytes for the same members whenever it is made."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
            z.writestr(info, members[name])
    return out.getvalue()
