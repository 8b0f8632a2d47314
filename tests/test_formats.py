"""Data sources over folders of small files."""

import json

import pytest

from orrery.sources import formats


@pytest.fixture(autouse=True)
def registered(spark):
    formats.register(spark)


def test_run_manifests(spark, tmp_path):
    pytest.importorskip("yaml")
    texts = {
        "a/manifest.yaml": "experiment: {id: e1, run_date: 2024-01-02}\ndata: {topics: x/y/topics.tsv, topic_count: 3, qrels: q/r.txt}\nscope: {candidate_depths: [100, 500]}\nmetrics: {ndcg_at_10: 0.5}\n",
        "b/manifest.json": json.dumps({"experiment": {"id": "e2"}, "config": {"hits": 7, "retriever": "bm25"}, "scope": {"candidate_depth": 9}, "notes": "n"}),
        "c/manifest.yaml": "- a\n- b\n", "d/manifest.yaml": "a: [1\n", "e/other.yaml": "x: 1\n",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["file"]: r for r in spark.read.format("run_manifests").load(str(tmp_path)).collect()}
    assert sorted(rows) == sorted(n for n in texts if "manifest" in n)
    a, b = rows["a/manifest.yaml"], rows["b/manifest.json"]
    assert (a["experiment_id"], a["run_date"], a["topics"], a["topic_count"], a["evaluation_qrels"], a["hits"], a["ndcg_at_10"], a["notes"]) == ("e1", "2024-01-02", "topics.tsv", "3", "r.txt", "100,500", "0.5", None)
    assert (b["hits"], b["retriever"], b["notes"], b["fault"]) == ("7", "bm25", "n", None)
    assert rows["c/manifest.yaml"]["fault"] == "a manifest is a mapping" and rows["d/manifest.yaml"]["fault"].startswith("not YAML")


def test_archived_responses(spark, tmp_path):
    hits = [{"docid": f"d{k}", "score": 1.0 / (1 + k % 3), "contents": f"text  {k}"} for k in range(150)]
    files = {"x.json": {"topic_id": "t1", "response": {"candidates": hits}}, "y.json": {"topic_id": 2, "response": {"results": []}}, "z.json": {"topic_id": "t3"}, "w.json": {"topic_id": "t4", "response": {"hits": {"a": 1}}}}
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "torn.json").write_text('{"topic_id"')
    rows = spark.read.format("archived_responses").load(str(tmp_path)).collect()
    own = sorted((r["place"], r["docid"], r["text"]) for r in rows if r["topic"] == "t1")
    assert own == [(k + 1, f"d{k}", f"text {k}") for k in range(100)]
    assert {r["file"]: r["fault"] for r in rows if r["fault"]}.keys() == {"z.json", "w.json", "torn.json"}
    assert spark.read.format("archived_responses").option("depth", 3).load(str(tmp_path)).where("topic = 't1'").count() == 3


def test_object_listings(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"path": "a/b.bin", "size": 3, "type": "file"}, {"path": "a", "type": "directory"}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"entries": [{"name": "c", "size": True}]}))
    (tmp_path / "lines.jsonl").write_text('{"path": "d"}\n\n{"files": [{"path": "e/f"}]}\n')
    (tmp_path / "empty.json").write_text(" \n")
    for k, bad in enumerate(["../x", "/x", "a//b", "a\\b", "", None]):
        (tmp_path / f"bad{k}.json").write_text(json.dumps([{"path": bad}]))
    (tmp_path / "torn.jsonl").write_text('{"path": "d"}\n{')
    rows = spark.read.format("object_listings").load(str(tmp_path)).collect()
    assert sorted((r["path"], r["size"], r["kind"]) for r in rows if not r["fault"]) == [("a", None, "directory"), ("a/b.bin", 3, "file"), ("c", None, None), ("d", None, None), ("e/f", None, None)]
    assert {r["file"] for r in rows if r["fault"]} == {f"bad{k}.json" for k in range(6)} | {"torn.jsonl"}


def test_files_are_dealt_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "PARTITION_BYTES", 100)
    for k in range(12):
        (tmp_path / f"{k:02d}.json").write_text(json.dumps([{"path": f"p{k}", "note": "x" * 30}]))
    reader = formats.ObjectListings({"path": str(tmp_path)}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 12 or len(parts) == 6 and sum(len(p.names) for p in parts) == 12
    assert sorted(r[1] for p in parts for r in reader.read(p)) == sorted(f"p{k}" for k in range(12))
    assert formats.ObjectListings({"path": str(tmp_path / "none")}).schema().startswith("file string")
