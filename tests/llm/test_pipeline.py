"""The pipeline's decisions against brute force over its own stages' inputs."""

import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from orrery.llm import quality, secrets
from tests.llm.test_classifiers import documents
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import link_rows, shuffled

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", len(t)) for i, t, *_ in documents(240, 7)]
    copies = [(1000 + k, rows[k][1] + (" extra" if k % 2 else ""), "en", "s", None) for k in range(30)]
    leak = rows[1][1] + " " + rows[2][1]
    odd = [(2000, "key token=abc123def456 here " + rows[5][1], None, None, 1), (2001, None, "en", "s", 0), (2002, "", "en", "s", 0), (2000, rows[12][1] + " another text of this id", "en", "s", 2), (None, rows[9][1] + " unlike all others here now", "en", "s", 3), (None, rows[9][1] + " unlike all others here now", "en", "s", 3)]
    spark.createDataFrame(rows + copies + odd, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, b) for i, _, q, b in documents(240, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak.split()[:60])), (2, "two words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def one_of_each(texts):
    """Of every component the least row by (id, nulls last); rows without words all stay."""
    root = link_rows(texts)
    first = {}
    for k, (i, t) in enumerate(texts):
        rank = (i is None, i or 0, hashlib.md5((t or "").encode()).digest())
        key = root[k] if (t or "").strip() else ("none", k)
        first[key] = min(first.get(key, (rank, (i, t))), (rank, (i, t)), key=lambda x: x[0])
    return [row for _, row in first.values()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        own, new = before.collect(), docs.collect()
        kept.append(len(new))
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        texts = [(r["doc_id"], r["text"]) for r in own]
        left = sorted((r["doc_id"] for r in new), key=repr)
        if k == 0:
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            model = quality.train(quality.training_rows(before, labels, "quality", allowed=~quality.held_out(F.col("doc_id"))))
            assert left == sorted((i for i, t in texts if quality.Scorer(model)((t or "").encode()) >= 0.5), key=repr)
        elif k == 1:
            assert sorted((tuple(r)[:2] for r in new), key=repr) == sorted(one_of_each(texts), key=repr)
        elif k == 2:
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert left == sorted((i for i, n, hit, _ in contaminated(texts, bench) if not (hit and 20 * hit >= n)), key=repr)
        elif k == 3:
            assert left == sorted((i for i, _ in texts), key=repr)
            clean = docs.withColumn("spans", secrets.base_spans(F.coalesce("text", F.lit(""))))
            assert not clean.where(F.size("spans") > 0).count()
            assert not docs.where("n_chars <> length(text)").count()
        else:
            assert left == sorted((i for i, _ in texts), key=repr) and all(r["identical"] for r in new)
    assert len(spark.read.parquet(f"{folder}/documents.parquet").collect()) > kept[0] > kept[1] > kept[2] == kept[3] == kept[4]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "token_ids"} <= set(out.columns) and out.count() > 0


def test_empty_tables_and_other_columns(spark, tmp_path):
    more = COLUMNS + ", key string, score double, place int, Spans string"
    long = "a long text of many words " * 30_000
    rows = [(1, long, "en", "s", 1, "k", 0.5, 3, "x"), (1, long, "en", "s", 1, "k", 0.5, 3, "x"), (None, None, None, None, None, None, None, None, None), (2, "secret=abcdef12345", "en", "s", 1, "k", 0.5, 3, "x")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, own in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(own, more)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == 4 or tuple(out.columns) == corpus_pipeline.COLUMNS
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        found = docs.collect()
        assert len(found) == (3 if own else 0) and all(r["identical"] for r in found)
    assert "[SECRET]" in {r["text"] for r in spark.read.parquet(f"{tmp_path}/some3").collect() if r["doc_id"] == 2}.pop()


def test_rows_without_near_copies_stay_where_they_lie(spark, tmp_path):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("etaoinshrdlucmwfgypb") for _ in range(9)) for _ in range(50_000)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(1_500)), "en", "s", 1) for k in range(400)]
    rows += [(1_000, rows[7][1] + " more", "en", "s", 1), rows[9], (None, rows[11][1], "en", "s", 1), (12, "other", "en", "s", 1), (13, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int").repartition(4).cache()
    size, before = sum(len(r[1] or "") for r in rows), shuffled(spark) if docs.count() else 0
    kept = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path)).collect()
    moved = shuffled(spark) - before
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted((r[0], r[1] or "") for r in rows[:400] + rows[403:])
    assert moved < size, (moved, size)
