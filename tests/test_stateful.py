"""Stateful streams against the batch form of their rules, and rules against plain cases."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from orrery.streaming import ledger as L
from orrery.streaming import stateful as S

LEASE = "topic string, place long, at long, kind string, owner string, ticket string, retry_ms long"


def in_files(spark, rows, schema, path, parts):
    """Rows as files of successive times, so that a stream takes them in order, one a batch."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def leased(spark, rows, lease_ms=100):
    df = spark.createDataFrame(rows, LEASE)
    return [(r["result"], r["holder"], r["open_ticket"]) for r in S.leases(df, lease_ms).orderBy("place").collect()]


def test_leases_and_tickets(spark):
    rows = [
        ("t", 1, 0, "ask", "a", None, None), ("t", 2, 50, "ask", "b", None, None), ("t", 3, 60, "beat", "a", None, None), ("t", 4, 159, "ask", "b", None, None),
        ("t", 5, 160, "ask", "b", None, None), ("t", 6, 170, "fail", "a", None, 5), ("t", 7, 180, "fail", "b", None, 40), ("t", 8, 190, "ask", "a", None, None),
        ("t", 9, 200, "ask", "a", "t#1", None), ("t", 10, 219, "ask", "a", "t#2", None), ("t", 11, 220, "ask", "a", "t#1", None), ("t", 12, 230, "fail", "a", None, 0),
        ("t", 13, 240, "ask", "b", "t#1", None), ("t", 14, 250, "ask", "b", "t#2", None), ("t", 15, 260, "done", "b", None, None), ("t", 16, 270, "ask", "a", None, None),
        ("t", 17, 280, "beat", "b", None, None),
    ]
    assert leased(spark, rows) == [
        ("granted", "a", None), ("busy", "a", None), ("heartbeat", "a", None), ("busy", "a", None),
        ("granted", "b", None), ("lost", "b", None), ("ticket", None, "t#1"), ("waiting", None, "t#1"),
        ("early", None, "t#1"), ("bad ticket", None, "t#1"), ("continued", "a", None), ("ticket", None, "t#2"),
        ("bad ticket", None, "t#2"), ("continued", "b", None), ("completed", None, None), ("cached", None, None),
        ("lost", None, None),
    ]
    # A consumed ticket, and one that was never out.
    assert leased(spark, [("u", 1, 0, "ask", "a", "u#1", None)]) == [("bad ticket", None, None)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, was) if was else spark.conf.unset(key)


def test_only_the_clock_frees_a_lease(spark, rocks, tmp_path):
    """One ask, and no other event: the timer says that the lease has run out, and a second topic's holder keeps it."""
    rows = [("t", 1, 0, "ask", "a", None, None), ("done", 2, 0, "ask", "a", None, None), ("done", 3, 0, "done", "a", None, None)]
    spark.createDataFrame(rows, LEASE).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LEASE).parquet(str(tmp_path / "in"))
    out = S.lease_stream(stream, 1500).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    query = out.trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not (found := spark.table("leases").where("result = 'expired'").collect()):
            time.sleep(0.3)
        assert [(r["topic"], r["holder"]) for r in found] == [("t", None)]
        assert sorted(r["result"] for r in spark.table("leases").collect()) == ["completed", "expired", "granted", "granted"]
        # Nothing but the clock has passed: the topic is free for another.
        spark.createDataFrame([("t", 4, 0, "ask", "b", None, None)], LEASE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        while time.time() < until and spark.table("leases").where("place = 4").isEmpty():
            time.sleep(0.3)
        assert [(r["result"], r["holder"]) for r in spark.table("leases").where("place = 4").collect()] == [("granted", "b")]
    finally:
        query.stop()


def test_leases_on_a_stream_as_on_a_table(spark, rocks, tmp_path):
    rnd, rows = random.Random(3), []
    for k in range(240):
        topic = f"t{rnd.randrange(5)}"
        kind = rnd.choices(["ask", "beat", "fail", "done"], [6, 2, 2, 0.1])[0]
        rows.append((topic, k, 1_700_000_000_000 + 60_000 * k, kind, rnd.choice("ab"), rnd.choice([None, f"{topic}#{rnd.randrange(1, 4)}"]) if kind == "ask" else None, rnd.choice([0, 900_000])))
    timed = lambda df: df.withColumn("time", F.timestamp_millis("at"))
    stream = timed(in_files(spark, rows, LEASE, str(tmp_path / "in"), 4)).withWatermark("time", "0 seconds")
    L.collect(S.lease_stream(stream, 400_000, by_clock=False), str(tmp_path / "out"), str(tmp_path / "c"))
    found = spark.read.parquet(str(tmp_path / "out"))
    expected = S.leases(spark.createDataFrame(rows, LEASE), 400_000)
    assert {r["result"] for r in expected.collect()} >= {"granted", "busy", "heartbeat", "ticket", "continued", "bad ticket", "waiting", "lost"}
    assert found.where("place IS NOT NULL").select(*expected.columns).exceptAll(expected).isEmpty() and found.where("place IS NOT NULL").count() == 240
    assert found.where("result = 'expired'").count() > 0


ROUND = "run string, place long, at long, kind string, task string, survey boolean, round int, nuggets array<string>, needs array<string>, facets array<string>"
LIMITS = dict(max_tasks=3, max_concurrent=2, max_calls=4, calls_per_task=2, no_progress_rounds=2, soft=100, hard=200)


def event(place, kind, at=0, task=None, survey=False, round=None, n=(), d=(), f=()):
    return ("r", place, at, kind, task, survey, round, list(n), list(d), list(f))


def coded(spark, rows, **limits):
    found = S.research_rounds(spark.createDataFrame(rows, ROUND), **{**LIMITS, **limits}).orderBy("place").collect()
    return [(r["code"], r["stop"], r["streak"]) for r in found]


def test_two_rounds_without_growth_stop_a_run(spark):
    rows = [
        event(1, "round", round=1, n="ab"), event(2, "round", round=2, n="ab", d="x"), event(3, "round", round=3, n="ac", d="x"), event(4, "round", round=3, n="abcd"),
        event(5, "round", round=5), event(6, "round", round=4, n="ac", d="y"), event(7, "task", task="t"), event(8, "round", round=5, n="acz"),
    ]
    assert coded(spark, rows) == [
        ("OK", None, 0), ("OK", None, 0), ("OK", None, 1), ("OK", None, 1),
        ("ROUND_SEQUENCE", None, 1), ("NO_PROGRESS", "NO_PROGRESS", 2), ("NO_PROGRESS", "NO_PROGRESS", 2), ("OK", "NO_PROGRESS", 0),
    ]


def test_the_deadline_overrides_the_total(spark):
    rows = [event(1, "task", task="a")] + [event(2 + k, "call", task="a") for k in range(3)] + [event(5, "task", task="b"), event(6, "call", task="b"), event(7, "call", 50, task="b"), event(8, "call", 60, task="b"), event(9, "call", 200, task="b"), event(10, "call", 10, task="b")]
    assert [r[:2] for r in coded(spark, rows)] == [
        ("OK", None), ("OK", None), ("OK", None), ("TASK_CALLS", None), ("OK", None), ("OK", None),
        ("OK", "CALL_BUDGET"), ("CALL_BUDGET", "CALL_BUDGET"), ("HARD_DEADLINE", "HARD_DEADLINE"), ("HARD_DEADLINE", "HARD_DEADLINE"),
    ]


def test_tasks_and_soft_deadline(spark):
    rows = [
        event(1, "task", task="a"), event(2, "task", task="a"), event(3, "task", task="b"), event(4, "task", task="c"), event(5, "finish", task="a"), event(6, "task", 100, task="c", survey=True),
        event(7, "task", 100, task="c"), event(8, "finish", task="b"), event(9, "task", task="d"), event(10, "model"), event(11, "call", task="x"),
    ]
    assert [r[:2] for r in coded(spark, rows)] == [
        ("OK", None), ("CONCURRENCY", None), ("OK", None), ("CONCURRENCY", None), ("OK", None), ("SOFT_DEADLINE", None),
        ("SOFT_DEADLINE", None), ("OK", None), ("TASK_BUDGET", "TASK_BUDGET"), ("MODEL_BUDGET", "MODEL_BUDGET"), ("MODEL_BUDGET", "MODEL_BUDGET"),
    ]


def test_rounds_on_a_stream_as_on_a_table(spark, tmp_path):
    rnd, rows = random.Random(8), []
    for k in range(160):
        kind = rnd.choice(["task", "call", "call", "finish", "round"])
        some = lambda: [c for c in "abcdef" if rnd.random() < 0.6]
        rows.append((f"r{k % 4}", k, k, kind, rnd.choice("xyz"), False, k // 20 + rnd.randrange(2), some(), some(), some()))
    limits = {**LIMITS, "max_calls": 30, "max_tasks": 20, "calls_per_task": 9, "hard": 150}
    stream = in_files(spark, rows, ROUND, str(tmp_path / "in"), 3)
    L.collect(L.folded_stream(stream, "run", ["place"], S.round_step(**limits), S.ROUND_CODES), str(tmp_path / "out"), str(tmp_path / "c"))
    expected = S.research_rounds(spark.createDataFrame(rows, ROUND), **limits)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 160 and found.select(*expected.columns).exceptAll(expected).isEmpty()


@pytest.mark.parametrize("total", [40, 10**6])
def test_ledger_over_all_users(spark, tmp_path, total):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, "abcde")), (F.col("event_id") % 5 + 1).cast("int"))
    rows = [tuple(r) for r in df.withColumn("event_type", kind).select(*L.EVENTS.names).orderBy("ts", "event_id").collect()]
    stream = in_files(spark, rows, L.EVENTS, str(tmp_path / "in"), 4)
    for _ in range(2):  # a second start finds nothing new
        S.ledger_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), "a", "b", "c", 3, total)
    found = S.read_ledger(spark, str(tmp_path / "out"), "b", 3, total)
    expected = L.ledger_state(spark.createDataFrame(rows, L.EVENTS), "a", "b", "c", 3, total)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.select(*found.columns).collect()), key=repr)
    if total == 40:
        assert {r["code"] for r in found.collect()} == {"ADMITTED", "USER_LIMIT", "TOTAL_LIMIT"}


def test_clocks_repaired_on_a_stream(spark, tmp_path):
    rnd, lines = random.Random(4), []
    for k in range(120):
        at = 1_700_000_000 + 10 * k - rnd.choice([0, 0, 500])
        stamp = rnd.choice([None, None, at, at * 1000, at * 10**6, at * 10**9, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(at))])
        lines.append(json.dumps({"run": k % 4, "seq": k, "type": f"e{k % 3}", "timestamp": stamp}))
    lines[50:50] = ["", "[1]", '{"run": 1}', "not json"]
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"part{k}.jsonl").write_text("\n".join(lines[k * 31 : (k + 1) * 31]) + "\n")
        time.sleep(1.05)
    whole = S.agent_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r["fault"] for r in whole.where("fault IS NOT NULL").collect()) == ["[1]", "not json", '{"run": 1}']
    good = whole.where("fault IS NULL")
    ts = good.select(F.col("run").alias("user_id"), F.col("seq").alias("event_id"), F.timestamp_seconds("at").alias("ts"))
    expected = {(r["user_id"], r["event_id"], r["filled"], r["repaired"]) for r in L.repaired_times(ts, F.col("ts").isNotNull()).collect()}
    stream = S.read_agent_events(spark, str(tmp_path / "in")).where("fault IS NULL")
    out = S.repaired_stream(stream, idle_ms=2000).writeStream.format("memory").queryName("repaired").option("checkpointLocation", str(tmp_path / "c"))
    query = out.trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("repaired").count() < 120:
            time.sleep(0.5)
        rows = spark.table("repaired").collect()
    finally:
        query.stop()
    assert {(r["run"], r["seq"], r["filled"], r["repaired"]) for r in rows} == expected and len(rows) == 120
    for run in range(4):
        assert [r["seq"] for r in rows if r["run"] == run] == sorted(r["seq"] for r in rows if r["run"] == run)
