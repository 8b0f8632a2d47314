"""Stateful streams: leases with tickets and timers, rounds of research, one ledger over all users, repaired clocks.

Each rule is written once, as a step over one key's rows in order, and runs on tables by
``folds.folded`` and on streams with its state in the state store.  Batches of a stream
must come in the order of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from orrery.operators.folds import folded
from orrery.operators.ranking import ordinals

# --- Leases and continuation tickets -------------------------------------------------

LEASED = "result string, holder string, open_ticket string"


def _expire(state: dict, now: int) -> bool:
    """Frees a lease that has run out."""
    if state.get("phase") == "leased" and state["until"] <= now:
        state.update(phase="open", holder=None)
        return True
    return False


def lease_step(lease_ms: int) -> Callable[[dict, dict], tuple]:
    """The rule of ``leases``, for tables and streams alike."""

    def grant(state: dict, row: dict, result: str) -> str:
        state.update(phase="leased", holder=row["owner"], until=row["at"] + lease_ms)
        return result

    def asked(state: dict, row: dict) -> str:
        phase = state.get("phase", "open")
        if phase == "completed":
            return "cached"
        if phase == "leased":
            return grant(state, row, "heartbeat") if state["holder"] == row["owner"] else "busy"
        if phase == "waiting":
            if row["ticket"] is None:
                return "waiting"
            if row["ticket"] != state["ticket"]:
                return "bad ticket"
            if row["at"] < state["not_before"]:
                return "early"
            state["ticket"] = None
            return grant(state, row, "continued")
        return "bad ticket" if row["ticket"] is not None else grant(state, row, "granted")

    def step(state: dict, row: dict) -> tuple:
        _expire(state, row["at"])
        own = state.get("phase") == "leased" and state["holder"] == row["owner"]
        if row["kind"] == "ask":
            result = asked(state, row)
        elif not own:
            result = "lost"
        elif row["kind"] == "beat":
            result = grant(state, row, "heartbeat")
        elif row["kind"] == "done":
            state.update(phase="completed", holder=None)
            result = "completed"
        else:
            state["failures"] = state.get("failures", 0) + 1
            state.update(phase="waiting", holder=None, ticket=f"{row['topic']}#{state['failures']}", not_before=row["at"] + (row["retry_ms"] or 0))
            result = "ticket"
        return result, state.get("holder"), state.get("ticket")

    return step


def leases(events: DataFrame, lease_ms: int) -> DataFrame:
    """What each event on a topic comes to: ``result``, the ``holder`` after it, and the ``open_ticket`` that is out.

    ``events``: topic, place, at (milliseconds), kind ("ask", "beat", "done", "fail"), owner,
    ticket, retry_ms.  A free topic is granted to who asks; the holder's asks and beats extend
    the lease, others are busy until it has run out.  A failure leaves a ticket: only an ask
    that shows it, and not before the time it names, goes on, and a ticket serves once.
    Once completed, a topic's asks are cached.
    """
    return folded(events, ["topic"], ["at", "place"], dict, lease_step(lease_ms), LEASED)


class _Leases(StatefulProcessor):
    """``lease_step`` with a timer for each lease, so that it runs out without any event."""

    def __init__(self, lease_ms: int, by_clock: bool, names: list[str]):
        self.step, self.by_clock, self.names = lease_step(lease_ms), by_clock, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("lease", T.StructType([T.StructField("state", T.StringType())]))

    def _state(self) -> dict:
        return json.loads(self.kept.get()[0]) if self.kept.exists() else {}

    def _keep(self, state: dict) -> None:
        due = state["until"] if state.get("phase") == "leased" else None
        if due != state.get("timer"):
            if state.get("timer") is not None:
                self.handle.deleteTimer(state["timer"])
            if due is not None:
                self.handle.registerTimer(due)
            state["timer"] = due
        self.kept.update((json.dumps(state),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, own = self._state(), pd.concat(list(rows)).sort_values(["at", "place"]).astype(object)
        own = own.where(own.notna(), None)
        made = []
        for row in own.to_dict("records"):
            if self.by_clock:
                row["at"] = timerValues.getCurrentProcessingTimeInMs()
            made.append((*(row[c] for c in self.names), *self.step(state, row)))
        self._keep(state)
        yield pd.DataFrame(made, columns=[*self.names, "result", "holder", "open_ticket"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        # A timer that was set for an earlier end of the lease changes nothing.
        if not _expire(state, expiredTimerInfo.getExpiryTimeInMs()):
            return
        state["timer"] = None
        self.kept.update((json.dumps(state),))
        row = dict.fromkeys((*self.names, "result", "holder", "open_ticket")) | {"topic": key[0], "at": expiredTimerInfo.getExpiryTimeInMs(), "result": "expired"}
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, lease_ms: int, by_clock: bool = True) -> DataFrame:
    """``leases`` on a stream, and a row "expired" for each lease that runs out by itself.

    ``by_clock``: the clock of the cluster is the time of every event, and timers run on
    it; else events bring their own time in ``at`` and a watermark on a column ``time``
    drives the timers.  The session needs the RocksDB state store.
    """
    names = events.columns if by_clock else [c for c in events.columns if c != "time"]
    schema = T.StructType([*(events.schema[c] for c in names), *T.StructType.fromDDL(LEASED).fields])
    return events.groupBy("topic").transformWithStateInPandas(
        statefulProcessor=_Leases(lease_ms, by_clock, names), outputStructType=schema, outputMode="append", timeMode="ProcessingTime" if by_clock else "EventTime"
    )


# --- Rounds of research under budgets --------------------------------------------------

#: Of several true reasons to stop, the highest counts.
STOPS = {"TASK_BUDGET": 20, "CALL_BUDGET": 30, "MODEL_BUDGET": 40, "NO_PROGRESS": 90, "HARD_DEADLINE": 100}
FAMILIES = ("nuggets", "needs", "facets")
ROUND_CODES = "code string, stop string, streak int"


def round_step(max_tasks: int, max_concurrent: int, max_calls: int, calls_per_task: int, no_progress_rounds: int, soft: int | None = None, hard: int | None = None) -> Callable[[dict, dict], tuple]:
    """The rule of ``research_rounds``, for tables and streams alike."""

    def latch(state: dict, code: str) -> str:
        if STOPS[code] > STOPS.get(state.get("stop"), -1):
            state["stop"] = code
        return code

    def admitted(row: dict) -> str:
        return "SOFT_DEADLINE" if soft is not None and row["at"] >= soft else "OK"

    def task(state: dict, row: dict) -> str:
        active = state.setdefault("active", [])
        if row["task"] in active:
            return "CONCURRENCY"
        if row["survey"] and admitted(row) != "OK":
            return "SOFT_DEADLINE"
        if state.get("tasks", 0) >= max_tasks:
            return latch(state, "TASK_BUDGET")
        if len(active) >= max_concurrent:
            return "CONCURRENCY"
        state["tasks"] = state.get("tasks", 0) + 1
        active.append(row["task"])
        return admitted(row)

    def call(state: dict, row: dict) -> str:
        if row["task"] not in state.get("active", ()):
            return "NO_TASK"
        if state.get("calls", 0) >= max_calls:
            return latch(state, "CALL_BUDGET")
        used = state.setdefault("used", {})
        if used.get(row["task"], 0) >= calls_per_task:
            return "TASK_CALLS"
        used[row["task"]] = used.get(row["task"], 0) + 1
        state["calls"] = state.get("calls", 0) + 1
        if state["calls"] >= max_calls:
            latch(state, "CALL_BUDGET")
        return admitted(row)

    def closed(state: dict, row: dict) -> str:
        decided = state.setdefault("decided", [])
        if row["round"] is not None and 1 <= row["round"] <= len(decided):
            return decided[row["round"] - 1]
        if row["round"] != len(decided) + 1:
            return "ROUND_SEQUENCE"
        now = {f: sorted(set(row[f] if row[f] is not None else ())) for f in FAMILIES}
        grew = any(set(now[f]) > set(state.get(f, ())) for f in FAMILIES)
        state.update(now, streak=0 if grew else state.get("streak", 0) + 1)
        decided.append(latch(state, "NO_PROGRESS") if state["streak"] >= no_progress_rounds else admitted(row))
        return decided[-1]

    def step(state: dict, row: dict) -> tuple:
        if hard is not None and row["at"] >= hard:
            latch(state, "HARD_DEADLINE")
        if row["kind"] == "round":
            code = closed(state, row)
        elif row["kind"] == "finish":
            state["active"] = [t for t in state.get("active", ()) if t != row["task"]]
            code = "OK"
        elif row["kind"] == "model":
            code = latch(state, "MODEL_BUDGET")
        elif state.get("stop"):
            code = state["stop"]
        else:
            code = (task if row["kind"] == "task" else call)(state, row)
        return code, state.get("stop"), state.get("streak", 0)

    return step


def research_rounds(rows: DataFrame, **limits) -> DataFrame:
    """The code of each event of a run, the stop that has latched, and the rounds in a row without progress.

    ``rows``: run, place, at, kind ("task", "call", "finish", "model", "round"), task, survey,
    round, and the round's report: nuggets, needs (addressed), facets (no longer open), each
    an array of ids.  A round makes progress where one of its sets properly contains that of
    the round before.  Rounds close in sequence, whether or not the run has stopped, and a
    round that is closed again keeps its code.  A stop gives way only to a higher one.
    """
    return folded(rows, ["run"], ["place"], dict, round_step(**limits), ROUND_CODES)


# --- One ledger over all users ----------------------------------------------------------

_LEDGER = "kind string, event_id long, user_id long, ts timestamp, nth long, outcome string"


def ledger_stream(events: DataFrame, path: str, checkpoint: str, reserve: str, success: str, failure: str, per_user: int, total: int) -> None:
    """``ledger.ledger_state`` on a stream, with the limit over all users and with outcomes, below ``path``.

    Each user's state counts reservations and holds those without an outcome.  The order
    over all users is that of each batch, counted on from what the batches before have
    admitted: a batch adds its prefix counts to one carried number.  A batch that is run
    again writes its files over.  ``read_ledger`` puts both together.
    """
    spark = events.sparkSession

    def user(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if row.event_type == reserve:
                seen += 1
                waiting.append(row.event_id)
                out.append(("asked", row.event_id, key[0], row.ts, seen, None))
            elif row.event_type in (success, failure):
                out += [("ended", i, key[0], row.ts, None, row.event_type) for i in waiting]
                waiting = []
        state.update((seen, json.dumps(waiting)))
        made = pd.DataFrame(out, columns=["kind", "event_id", "user_id", "ts", "nth", "outcome"])
        yield made.astype({"nth": "Int64"})

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            carried = spark.read.parquet(f"{path}/admitted/{number - 1}").first()[0] if number else 0
            asked = rows.where("kind = 'asked'")
            within = ordinals(asked.where(F.col("nth") <= per_user), F.floor(F.unix_timestamp("ts") / 600), "ts", "event_id")
            placed = asked.join(within.select("event_id", (F.col("ordinal") + carried).alias("ordinal")), "event_id", "left")
            placed.select("event_id", "user_id", "nth", "ordinal").write.mode("overwrite").parquet(f"{path}/asked/{number}")
            rows.where("kind = 'ended'").select("event_id", "outcome").write.mode("overwrite").parquet(f"{path}/ended/{number}")
            asked.where(F.col("nth") <= per_user).agg((F.count(F.lit(1)) + carried).alias("n")).write.mode("overwrite").parquet(f"{path}/admitted/{number}")
        finally:
            rows.unpersist()

    held = events.groupBy("user_id").applyInPandasWithState(user, _LEDGER, "seen long, waiting string", "append", GroupStateTimeout.NoTimeout)
    held.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ledger(spark: SparkSession, path: str, success: str, per_user: int, total: int) -> DataFrame:
    """The ledger as it stands: the columns of ``ledger.ledger_state``."""
    read = lambda part, schema: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/{part}")
    asked, ended = read("asked", "event_id long, user_id long, nth long, ordinal long"), read("ended", "event_id long, outcome string")
    code = F.when(F.col("nth") > per_user, "USER_LIMIT").when(F.col("ordinal") > total, "TOTAL_LIMIT").otherwise("ADMITTED")
    state = F.when(F.col("code") != "ADMITTED", "refused").when(F.col("outcome").isNull(), "pending").when(F.col("outcome") == success, "success").otherwise("failure")
    both = asked.join(ended, "event_id", "left").withColumn("code", code)
    return both.select("event_id", "user_id", "nth", F.when(F.col("code") == "ADMITTED", F.col("ordinal")).alias("ordinal"), "code", state.alias("state"))


# --- Native events whose clocks are missing -----------------------------------------------

AGENT_EVENT = "run long, seq long, type string, timestamp string"
REPAIRED = "run long, seq long, type string, filled long, repaired long"


def agent_events(lines: DataFrame) -> DataFrame:
    """run, seq, type, at (seconds, null where there is no clock) and fault of native event lines (column ``value``).

    Times are ISO texts (UTC unless they say otherwise) or epoch numbers in seconds, milli-, micro-
    or nanoseconds, told apart by size.  A line that is no object, or without run or seq, keeps its fault; blank lines go.
    """
    own = lines.where(F.trim("value") != "").select("value", F.from_json("value", AGENT_EVENT).alias("e"))
    stamp = F.col("e.timestamp")
    number = F.when(stamp.rlike(r"^-?\d+(\.\d+)?$"), stamp.cast("double"))
    size = F.abs(number)
    seconds = F.when(size >= 1e17, number / 1e9).when(size >= 1e14, number / 1e6).when(size >= 1e11, number / 1e3).otherwise(number)
    iso = F.try_to_timestamp(stamp).cast("long")
    whole = F.startswith(F.trim("value"), F.lit("{")) & F.col("e.run").isNotNull() & F.col("e.seq").isNotNull()
    return own.select("e.run", "e.seq", "e.type", F.coalesce(F.floor(seconds).cast("long"), iso).alias("at"), F.when(~F.coalesce(whole, F.lit(False)), F.col("value")).alias("fault"))


def read_agent_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """``agent_events`` of a growing folder of JSON lines, a bounded number of files at a time."""
    return agent_events(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def _filled(place: int, before: tuple[int, int] | None, after: tuple[int, int] | None) -> int:
    """Seconds of the row at ``place``, between two (place, seconds), behind one, or before one."""
    if before is None:
        return after[1] - (after[0] - place)
    if after is None:
        return before[1] + place - before[0]
    return before[1] + (after[1] - before[1]) * (place - before[0]) // (after[0] - before[0])


def repaired_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``ledger.repaired_times`` on a stream of run, seq, type, at: REPAIRED, each run's rows in order of seq.

    A row without a clock waits in its run's state for the next row with one; both then
    leave with what lies between.  Rows behind the last clock leave ``idle_ms`` after their
    run's last row, counted on from that clock, if ``idle_ms`` is given; a run without any
    clock waits on.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"place": 0, "anchor": None, "rise": None, "waiting": []}
        out = []

        def release(rows: list, after: tuple[int, int] | None) -> None:
            for place, seq, kind in rows:
                filled = _filled(place, kept["anchor"] and tuple(kept["anchor"]), after)
                kept["rise"] = filled - place if kept["rise"] is None else max(kept["rise"], filled - place)
                out.append((key[0], seq, kind, filled, kept["rise"] + place))

        if state.hasTimedOut:
            if kept["anchor"] is not None:
                release(kept["waiting"], None)
                kept["waiting"] = []
        else:
            for row in pd.concat(list(batches)).sort_values("seq").itertuples():
                kept["place"] += 1
                kept["waiting"].append((kept["place"], int(row.seq), row.type))
                if not pd.isna(row.at):
                    after = (kept["place"], int(row.at))
                    release(kept["waiting"], after)
                    kept["anchor"], kept["waiting"] = after, []
        state.update((json.dumps(kept),))
        if idle_ms is not None and kept["waiting"] and kept["anchor"] is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["run", "seq", "type", "filled", "repaired"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.select("run", "seq", "type", "at").groupBy("run").applyInPandasWithState(run, REPAIRED, "state string", "append", timeout)


