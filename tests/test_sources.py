"""Readers and writers: formats, checks, round trips."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import checks
from orrery.sources import runs, tables


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_topics(spark, tmp_path):
    j = write(tmp_path / "t.jsonl", json.dumps({"id": " 1 ", "title": "a  b", "narrative": "long\n text"}), json.dumps({"id": "2", "title": "c", "narrative": "d"}))
    assert [tuple(r) for r in tables.read_topics(spark, j).orderBy("id").collect()] == [("1", "a b", "long text"), ("2", "c", "d")]
    t = write(tmp_path / "t.tsv", "7\tone two " + "w " * 20, "8\tx\ty")
    rows = tables.read_topics(spark, t).orderBy("id").collect()
    assert len(rows[0]["title"].split()) == 12 and rows[1]["narrative"] == "x y"
    with pytest.raises(Exception, match="blank field"):
        tables.read_topics(spark, write(tmp_path / "b.jsonl", json.dumps({"id": "1", "title": "", "narrative": "n"}))).collect()
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        tables.read_topics(spark, str(tmp_path / "e.jsonl"))
    with pytest.raises(LookupError):
        tables.one(tables.read_topics(spark, j), "id", "3")


def test_narratives_are_strict(spark, tmp_path):
    good = write(tmp_path / "n.jsonl", '{"id": "1", "narrative": " kept  as is "}')
    assert tables.read_narratives(spark, good).first()["narrative"] == " kept  as is "
    for name, lines in {"twice": ['{"id": "1", "narrative": "a"}'] * 2, "key": ['{"id": "1", "id": "2", "narrative": "a"}']}.items():
        with pytest.raises(Exception):
            tables.read_narratives(spark, write(tmp_path / f"{name}.jsonl", *lines)).collect()


def test_qrels_and_runs(spark, tmp_path):
    q = write(tmp_path / "q.txt", "1 0 a 2", "1 0 b 0", "", "1 0 a 3")
    assert {(r["doc"], r["grade"]) for r in runs.read_qrels(spark, q).collect()} == {("a", 3), ("b", 0)}
    with pytest.raises(Exception, match="judged twice"):
        runs.read_qrels(spark, q, strict=True).collect()
    with pytest.raises(Exception, match="four fields"):
        runs.read_qrels(spark, write(tmp_path / "bad.txt", "1 0 a")).collect()
    df = spark.createDataFrame([("1", "b", 2, 0.5), ("1", "a", 1, 0.9), ("2", "c", 1, 0.1)], "topic string, doc string, rank long, score double")
    runs.write_run(df, str(tmp_path / "run"), "tag")
    back = runs.read_run(spark, str(tmp_path / "run"))
    assert sorted((r["topic"], r["doc"], r["rank"], r["score"], r["tag"]) for r in back.collect()) == [("1", "a", 1, 0.9, "tag"), ("1", "b", 2, 0.5, "tag"), ("2", "c", 1, 0.1, "tag")]
    for lines, message in {("1 Q0 a 2 1 t",): "dense", ("1 Q0 a 1 1 t", "1 Q0 b 2 2 t"): "rise", ("1 Q0 a 1 2 t", "1 Q0 a 2 1 t"): "twice", ("1 Q0 a 1 2 t", "1 Q0 b 2 1 u"): "one tag"}.items():
        with pytest.raises(Exception, match=message):
            runs.read_run(spark, write(tmp_path / f"{message}.run", *lines)).collect()
    arms = df.select("topic", "doc", F.col("rank").alias("final_rank"), F.lit("A").alias("arm"))
    runs.write_runs(arms, str(tmp_path / "arms"), 5)
    assert spark.read.text(str(tmp_path / "arms")).count() == 3


def test_scores_nuggets_answers(spark, tmp_path):
    s = write(tmp_path / "s.jsonl", json.dumps({"topic_id": "1", "docid": "a", "score": 1.5, "model": "m"}))
    assert tables.read_scores(spark, s, tables.DOCUMENT_SCORE, model="m").first()["score"] == 1.5
    with pytest.raises(Exception, match="another model"):
        tables.read_scores(spark, s, tables.DOCUMENT_SCORE, model="x").collect()
    n = write(tmp_path / "n.jsonl", *[json.dumps({"qid": "1", "docid": d, "nuggets": [{"id": "n", "text": t, "importance": "vital", "assignment": "support"}]}) for d, t in (("a", "x"), ("b", "x"))])
    assert tables.read_nuggets(spark, n).count() == 2
    a = write(tmp_path / "a.jsonl", json.dumps({"metadata": {"narrative_id": "1", "run_id": "r"}, "references": ["d1", "d2"], "answer": [{"text": "s", "citations": [1, 0]}]}))
    assert tables.read_answers(spark, a).first()["cited"] == ["d2", "d1"]
    t = write(tmp_path / "t.tsv", "run\tvalue", "a\t1.5", "b\tnone")
    assert [r["value"] for r in tables.read_table(spark, t, ("value",)).orderBy("run").collect()] == [1.5, None]


def test_responses_and_documents(spark, tmp_path):
    payloads = [(1, json.dumps({"hits": [{"id": "a", "contents": "t"}, {"docid": "b", "rank": 7, "score": 2.0}]})), (2, json.dumps({"candidates": [{"docid": "c", "text": "u"}]})), (3, "{}")]
    rows = tables.normalise_response(spark.createDataFrame(payloads, "q long, payload string")).orderBy("q", "rank").collect()
    assert [(r["q"], r["docid"], r["rank"], r["text"]) for r in rows] == [(1, "a", 1, "t"), (1, "b", 7, ""), (2, "c", 1, "u")]
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / hashlib.sha256(b"body").hexdigest()).write_bytes(b"body")
    assert tables.read_documents(spark, str(folder)).first()["text"] == "body"
    (folder / ("0" * 64)).write_bytes(b"other")
    with pytest.raises(Exception, match="differs from its digest"):
        tables.read_documents(spark, str(folder)).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.0)], "k long, z string, v double")
    tables.write_json(df, str(tmp_path / "j"))
    assert '{"k":1,"v":1.0,"z":"a"}' in [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()]
    tables.write_keyed(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(Exception, match="occurs twice"):
        tables.write_keyed(df.union(df), str(tmp_path / "q"), "k")
    wide, long = tables.comparison_tables(spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "k long, m string, v double"), "k", "m", "v")
    assert wide.first().asDict() == {"k": 1, "x": 1.0, "y": 2.0} and long.count() == 2
    tables.write_table(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "z", "v"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {"a.txt": "one\n\n two\n" + "".join(f"line {k}\n" for k in range(400)), "b.txt": "x\r\ny", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "500")
    try:
        found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in checks.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set(key, was)
    assert found == sorted((name, k, v) for name, text in texts.items() for k, v in enumerate(text.splitlines(), 1) if v.strip())


def test_required_headers_and_gold_nuggets(spark, tmp_path):
    t = write(tmp_path / "t.csv", "topic,score", "a,1.5")
    assert tables.read_table(spark, t, ("score",), ",", ("topic", "score")).first()["score"] == 1.5
    with pytest.raises(ValueError, match="lacks run"):
        tables.read_table(spark, t, separator=",", required=("topic", "run"))
    good = {"qid": "1", "nuggets": [{"text": "x", "importance": "vital"}, {"text": "y", "importance": "okay"}]}
    rows = tables.read_gold_nuggets(spark, write(tmp_path / "g.jsonl", json.dumps(good))).collect()
    assert [tuple(r) for r in rows] == [("1", 1, "x", True), ("1", 2, "y", False)]
    for name, lines, message in (("a", [good, good], "once"), ("b", [{"qid": "2", "nuggets": [{"text": " ", "importance": "vital"}]}], "malformed"), ("c", [{"qid": "2", "nuggets": [{"text": "x", "importance": "some"}]}], "malformed")):
        with pytest.raises(Exception, match=message):
            tables.read_gold_nuggets(spark, write(tmp_path / f"{name}.jsonl", *map(json.dumps, lines))).collect()
