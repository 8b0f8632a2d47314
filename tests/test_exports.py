"""Exports written and read again."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import checks
from orrery.operators import handoff as H
from orrery.sources import exports as E


@pytest.fixture
def run(spark):
    return spark.createDataFrame([("t", k, k, 10.0 - k) for k in range(1, 6)] + [("u", 9, 1, 0.1)], "topic string, doc long, rank long, score double")


def test_store_round_trip(spark, run, tmp_path):
    path = str(tmp_path / "store")
    E.write_store(spark, {"run": run, "none": run.limit(0)}, path)
    found = E.read_store(spark, path)
    assert set(found) == {"run", "none"} and found["run"].exceptAll(run).isEmpty() and found["none"].count() == 0
    run.limit(1).write.mode("overwrite").parquet(f"{path}/run")
    with pytest.raises(ValueError, match="manifest"):
        E.read_store(spark, path)


def test_portable_scores(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.1 + 0.2), ("b", -1e-300), ("c", 5.0)], "k string, score double")
    E.export_scores(scores, str(tmp_path / "s"), ["k"])
    target = spark.createDataFrame([("a", 0.1 + 0.2), ("z", 1.0)], "k string, score double")
    merged = {r["k"]: r["score"] for r in E.import_scores(target, str(tmp_path / "s"), ["k"]).collect()}
    assert merged == {"a": 0.1 + 0.2, "b": -1e-300, "c": 5.0, "z": 1.0}
    other = spark.createDataFrame([("a", 0.3)], "k string, score double")
    with pytest.raises(ValueError, match="conflict"):
        E.import_scores(other, str(tmp_path / "s"), ["k"])
    assert {r["k"]: r["score"] for r in E.import_scores(other, str(tmp_path / "s"), ["k"], strict=False).collect()}["a"] == 0.3


def test_retrieval_package_and_runs(spark, run, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(1, 6)], "doc long, text string")
    nested = H.generation_topics(
        spark.createDataFrame([("t", "g", "G")], "topic string, id string, label string"),
        spark.createDataFrame([("t", "e", "g", "1", "x")], "topic string, id string, group string, doc string, text string"),
        spark.createDataFrame([("t", "c", "g", "claim", ["e"])], "topic string, id string, group string, text string, evidence array<string>"),
    )
    E.write_retrieval(run, docs, nested, str(tmp_path / "r"), "tag")
    lines = checks.read_lines(spark, str(tmp_path / "r/run"))
    assert lines.count() == 6 and checks.run_faults(lines, spark.createDataFrame([("t",), ("u",)], "topic string")).count() == 0
    faults = {r["fault"] for r in checks.run_faults(lines, spark.createDataFrame([("t",), ("v",)], "topic string")).collect()}
    assert faults == {"missing topic", "unexpected topic"}
    texts = {(r["topic"], r["doc"]): r["text"] for r in spark.read.schema("topic string, doc long, text string").json(str(tmp_path / "r/with_text")).collect()}
    assert texts["t", 3] == "text 3" and texts["u", 9] is None
    groups, evidence, claims = H.flattened(spark.read.schema(H.HANDOFF).json(str(tmp_path / "r/handoff")))
    assert (groups.count(), evidence.count(), claims.first()["evidence"]) == (1, 1, ["e"])
    E.write_package(spark.createDataFrame([("t", "n"), ("x", "m")], "topic string, narrative string"), run.join(docs, "doc").withColumnRenamed("rank", "place"), str(tmp_path / "p"))
    sent = {r["topic"]: r["evidence"] for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert [e["doc"] for e in sent["t"]] == [1, 2, 3, 4, 5] and sent["x"] is None
    E.write_runs_with_manifest(spark, {"one": run, "two": run.where("topic = 't'")}, str(tmp_path / "runs"), 3)
    assert spark.read.text(str(tmp_path / "runs/one")).orderBy("value").first()[0] == "t Q0 1 1 3 one"
    assert {r["name"]: r["rows"] for r in spark.read.json(str(tmp_path / "runs/manifest")).collect()} == {"one": 4, "two": 3}


def test_report_tables(spark, run):
    E.write_report(spark, {"runs": run, "topics": run.select("topic").distinct()}, "orrery_report")
    try:
        assert spark.table("orrery_report.topics").count() == 2 and spark.table("orrery_report.runs").agg(F.sum("doc")).first()[0] == 24
    finally:
        spark.sql("DROP DATABASE orrery_report CASCADE")


def test_zips_are_the_same_bytes():
    a, b = E.zipped({"b": b"2" * 1000, "a": b"1"}), E.zipped({"a": b"1", "b": b"2" * 1000})
    assert a == b and len(a) < 500
