"""Streams run to their end against the batch form of the same rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from orrery.operators import folds, stores
from orrery.streaming import ledger as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    df = spark.read.parquet(f"{SF}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, "abcde")), (F.col("event_id") % 5 + 1).cast("int"))
    df.withColumn("event_type", kind).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def test_windows_on_a_stream(spark, events, tmp_path):
    batch = spark.read.schema(L.EVENTS).parquet(events)
    q = L.tumbling(L.read_stream(spark, events, 4)).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, L.tumbling(batch).collect()))


def test_reservations_on_a_stream(spark, events, tmp_path):
    out = L.reservations(L.read_stream(spark, events, 4), "a", 2)
    L.collect(out, str(tmp_path / "out"), str(tmp_path / "c"))
    batch = L.ledger_state(spark.read.schema(L.EVENTS).parquet(events), "a", "b", "c", 2, 10**6)
    found = {(r["event_id"], r["nth"], r["code"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(r["event_id"], r["nth"], r["code"]) for r in batch.collect()}


def test_waves_are_idempotent(spark, events, tmp_path):
    paths = str(tmp_path / "out"), str(tmp_path / "c")
    for _ in range(2):  # the second run finds nothing new
        L.collect_waves(L.read_stream(spark, events, 1), ["user_id"], *paths)
    rows = spark.read.option("recursiveFileLookup", True).schema(L.EVENTS).parquet(f"{paths[0]}/rows")
    users = spark.read.parquet(events).select("user_id").distinct().count()
    assert rows.count() == rows.select("user_id").distinct().count() == users
    receipts = spark.read.option("recursiveFileLookup", True).parquet(f"{paths[0]}/receipts")
    assert receipts.agg(F.sum("events"), F.sum("new")).first() == (spark.read.parquet(events).count(), users)


def test_dedup_on_a_stream(spark, events, tmp_path):
    L.collect(L.deduplicated(L.read_stream(spark, events, 4)), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(events).select("event_id").distinct().count()


def test_rules_end_on_streams_as_on_tables(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randrange(6), 200 * k, k, rnd.choice("abc"), rnd.random() < 0.03, rnd.randrange(3), rnd.choice(["search", "passage"])) for k in range(400)]
    schema = "key long, at long, place long, worker string, done boolean, task long, tool string"
    for part in range(5):  # in order, one file a batch
        spark.createDataFrame(rows[80 * part : 80 * part + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    table = spark.createDataFrame(rows, schema)
    cases = {
        "claims": (folds.claim_step(900), folds.CLAIMED, folds.claims(table, 900)),
        "budget": (stores.budget_step(40, 20, {"search": 8}), stores.ADMITTED, stores.budget(table.withColumnRenamed("key", "run"), 40, 20, {"search": 8}).withColumnRenamed("run", "key")),
    }
    for name, (step, added, expected) in cases.items():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        L.collect(L.folded_stream(stream, "key", ["at", "place"], step, added), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        found = spark.read.parquet(str(tmp_path / name))
        assert found.count() == 400 and found.select(*expected.columns).exceptAll(expected).isEmpty(), name


def test_a_wave_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    """Every key comes once however its bucket is met, and a wave opens key files of its buckets only."""
    rnd, rows = random.Random(6), []
    for k in range(200):
        rows.append((k, None, rnd.randrange(60), "a", 0.0, ""))
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], L.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.05)
    L.collect_waves(L.read_stream(spark, str(tmp_path / "in"), 1), ["user_id"], str(tmp_path / "out"), str(tmp_path / "c"), buckets=8)
    found = spark.read.option("recursiveFileLookup", True).schema(L.EVENTS).parquet(str(tmp_path / "out" / "rows")).select("user_id").collect()
    assert sorted(r["user_id"] for r in found) == sorted({r[2] for r in rows})
    keys = spark.read.parquet(str(tmp_path / "out" / "keys"))
    assert keys.count() == len({r[2] for r in rows}) and keys.select("_wave").distinct().count() > 1
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(8)).cast("int")
    assert keys.where(bucket != F.col("_bucket")).isEmpty()
    one = keys.where("_bucket = 3")
    assert all("_bucket=3" in f for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
