"""Trees of digests and evaluations bound by digest."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import digests as D
from orrery.operators import evaluation as E


def rows(n, changed=None):
    return [(k, f"v{k}" if k != changed else "other", None if k % 7 == 0 else [k, k + 1], bytes([k % 256])) for k in range(n)]


SCHEMA = "k long, v string, a array<int>, b binary"


def test_one_changed_row_is_found_by_descent(spark, tmp_path):
    D.write_with_tree(spark.createDataFrame(rows(3000), SCHEMA), str(tmp_path / "a"), ["k"])
    D.write_with_tree(spark.createDataFrame(rows(3000, changed=1234)[::-1], SCHEMA).repartition(7), str(tmp_path / "b"), ["k"])
    a, b = (spark.read.parquet(str(tmp_path / x / "tree")) for x in "ab")
    leaf = D.first_difference(a, b)
    left, right = (D.read_leaf(spark, str(tmp_path / x), leaf) for x in "ab")
    assert 0 < left.count() < 30
    assert [r["k"] for r in left.exceptAll(right).collect()] == [1234]
    assert "_part" in left._jdf.queryExecution().toString() and D.first_difference(a, a) is None
    assert a.where("level = 0").first()["rows"] == 3000


def test_order_does_not_show_but_copies_types_and_nulls_do(spark):
    root = lambda data, schema=SCHEMA: D.tree(spark.createDataFrame(data, schema), ["k"], 2).where("level = 0").first()["digest"]
    base = root(rows(50))
    assert root(rows(50)[::-1]) == base and root(rows(50) + rows(1)) != base and root(rows(49)) != base
    assert root(rows(50), SCHEMA.replace("k long", "k int")) != base
    two = "k long, x string, y string"
    assert root([(1, "a", None)], two) != root([(1, None, "a")], two) != root([(1, "a", "")], two)
    assert root([(1, "ab", "c")], two) != root([(1, "a", "bc")], two)
    assert D.tree(spark.createDataFrame([], SCHEMA), ["k"]).where("level = 0").count() == 0
    with pytest.raises(ValueError):
        D.tree(spark.createDataFrame([], SCHEMA), ["k"], 0)


def test_database_digest(spark):
    one, two = (D.tree(spark.createDataFrame(rows(n), SCHEMA), ["k"], 1) for n in (10, 20))
    whole = D.database_digest({"x": one, "y": two}).first()
    assert whole["rows"] == 30 and D.database_digest({"y": two, "x": one}).first() == whole
    assert D.database_digest({"x": two, "y": one}).first()["digest"] != whole["digest"]


def test_evaluations_are_bound(spark):
    run = spark.createDataFrame([("1", "a", 1, 2.0), ("1", "b", 2, 1.0), ("2", "c", 1, 1.0)], "topic string, doc string, rank long, score double")
    qrels = spark.createDataFrame([("1", "a", 3), ("1", "x", 2), ("2", "c", 1), ("3", "z", 4)], "topic string, doc string, grade long")
    topics = spark.createDataFrame([("1",), ("2",)], "topic string")
    metrics = ("recall@2", "ndcg@10")
    values, means, binding = E.evaluate_run(run, qrels, topics, metrics, variant="own")
    sealed = binding.first()
    assert {(r["topic"], r["metric"]): round(r["value"], 3) for r in values.where("metric = 'recall@2'").collect()} == {("1", "recall@2"): 0.5, ("2", "recall@2"): 0.0}
    assert {r["metric"]: r["mean"] for r in means.collect()}["recall@2"] == 0.25
    assert {r["evaluation_sha256"] for r in values.collect()} == {sealed["evaluation_sha256"]}
    again = E.evaluate_run(run.repartition(3), qrels, topics, metrics[::-1], qrels_digest=sealed["qrels_sha256"], variant="own")[2].first()
    assert again == sealed
    for other in (dict(least=1), dict(variant="else"), dict(metrics=("recall@2",)), dict(run=run.withColumn("score", F.col("score") + 1))):
        own = {"run": run, "qrels": qrels, "topics": topics, "metrics": metrics, "variant": "own"} | other
        assert E.evaluate_run(**own)[2].first()["evaluation_sha256"] != sealed["evaluation_sha256"]


def test_evaluations_refuse(spark):
    run = spark.createDataFrame([("1", "a", 1, 2.0)], "topic string, doc string, rank long, score double")
    qrels = spark.createDataFrame([("1", "a", 3), ("2", "b", 3)], "topic string, doc string, grade long")
    topics = lambda *t: spark.createDataFrame([(x,) for x in t], "topic string")
    go = lambda **k: E.evaluate_run(**({"run": run, "qrels": qrels, "topics": topics("1"), "metrics": ("recall@5",), "variant": "v"} | k))
    for k, message in ((dict(metrics=()), "metrics"), (dict(metrics=("recall@5",) * 2), "metrics"), (dict(metrics=("x@5",)), "unknown"), (dict(least=5), "least"), (dict(variant=None), "variant")):
        with pytest.raises(ValueError, match=message):
            go(**k)
    for k, message in ((dict(topics=topics("9")), "no judgments"), (dict(topics=topics("1", "2")), "topics are not"), (dict(run=run.union(run)), "stands twice")):
        with pytest.raises(Exception, match=message):
            go(**k)[0].collect()
    with pytest.raises(Exception, match="not those expected"):
        go(qrels_digest="0" * 64)[0].collect()
