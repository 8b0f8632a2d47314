"""Responses, caches and budgets: what a run may read, keep and spend."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.numbers import finite
from orrery.functions.text import word_count
from orrery.operators.checks import first_fault
from orrery.operators.folds import folded
from orrery.session import keep

#: Fields that hold a document's text, the first that does counts; and fields that hold the hits.
TEXT_FIELDS, HIT_FIELDS = ("contents", "text", "body", "passage", "abstract"), ("candidates", "hits", "results")
_HIT = pa.schema([("response", pa.int64()), ("rank", pa.int64()), ("doc", pa.string()), ("score", pa.float64()), ("text", pa.string())])


def text_within(value: object) -> str:
    """The words of a nested value: a text field's if it has one, else of all its parts; text that is JSON is opened."""
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return " ".join(value.split())
        return text_within(inner)
    if isinstance(value, dict):
        named = (value[f] for f in TEXT_FIELDS if isinstance(value.get(f), str) and value[f].strip())
        found = next(named, None)
        return " ".join(found.split()) if found else text_within(list(value.values()))
    if isinstance(value, list):
        return " ".join(filter(None, map(text_within, value)))
    return ""


def _number(value: object, kind: type) -> tuple[float | int | None, bool]:
    """(number, whether it is well formed): numbers and texts of numbers, whole and finite where asked."""
    if value is None or value == "":
        return None, True
    try:
        made = float(value) if not isinstance(value, bool) else float("nan")
    except (TypeError, ValueError):
        made = float("nan")
    if not math.isfinite(made) or kind is int and made != int(made):
        return None, False
    return kind(made), True


def hits_of(body: str | None) -> tuple[list[dict], str | None]:
    """(hits, fault) of one response: a body that is no JSON object, hits that are no list, a hit that is no object, or a rank or score that is no number."""
    if not body:
        return [], None
    try:
        whole = json.loads(body)
    except (ValueError, RecursionError):
        return [], "not json"
    if not isinstance(whole, dict):
        return [], "not an object"
    found = next((whole[f] for f in HIT_FIELDS if whole.get(f)), [])
    if not isinstance(found, list):
        return [], "hits"
    rows, fault = [], None
    for place, hit in enumerate(found, 1):
        if not isinstance(hit, dict):
            fault = fault or "hit"
            continue
        rank, whole_rank = _number(hit.get("rank"), int)
        score, good_score = _number(hit.get("score"), float)
        fault = fault or (None if whole_rank else "rank") or (None if good_score else "score")
        doc = next((hit[f] for f in ("docid", "id", "_id") if hit.get(f)), None)
        rows.append({"rank": rank or place, "doc": None if doc is None else str(doc), "score": score, "text": text_within(hit.get("doc") or hit.get("contents") or hit)})
    return rows, fault


def normalised(responses: DataFrame) -> DataFrame:
    """Hits of JSON responses (response, body): response, rank, doc, score, text; ranks default to places.

    What is malformed stops no other response: a body without hits gives none, a hit that is
    no object is left out, a score that is no number is null.  ``body_faults`` names it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"response": k, **hit} for k, body in zip(batch.column("response").to_pylist(), batch.column("body").to_pylist()) for hit in hits_of(body)[0]]
            yield pa.RecordBatch.from_pylist(rows, schema=_HIT)

    return responses.select(F.col("response").cast("long").alias("response"), "body").mapInArrow(run, "response long, rank long, doc string, score double, text string")


#: The fields of a strict response, of its query, and of a candidate; no others, none left out.
STRICT = {"response": ("api", "candidates", "index", "query"), "query": ("text",), "candidate": ("doc", "docid", "rank", "score")}


def strict_fault(body: str | None) -> str | None:
    """The first rule of the strict form that a response breaks: exact fields, plain texts, whole ranks once, finite scores, one body for a document."""
    exact = lambda value, kind: isinstance(value, dict) and sorted(value) == list(STRICT[kind])
    named = lambda value: isinstance(value, str) and value.strip() != ""
    try:
        whole = json.loads(body or "")
    except (ValueError, RecursionError):
        return "not json"
    if not exact(whole, "response"):
        return "response fields"
    if whole["api"] != "v1" or not named(whole["index"]):
        return "api or index"
    if not exact(whole["query"], "query") or not isinstance(whole["query"]["text"], str):
        return "query fields"
    if not isinstance(whole["candidates"], list):
        return "candidates"
    ranks, bodies = set(), {}
    for row in whole["candidates"]:
        if not exact(row, "candidate"):
            return "candidate fields"
        rank, score = row["rank"], row["score"]
        if type(rank) is not int or rank < 1:
            return "rank"
        if rank in ranks:
            return "repeated rank"
        if type(score) not in (int, float) or not math.isfinite(score):
            return "score"
        if not named(row["docid"]):
            return "document"
        if not isinstance(row["doc"], str):
            return "text"
        if bodies.setdefault(row["docid"], row["doc"]) != row["doc"]:
            return "two bodies"
        ranks.add(rank)
    return None


def body_faults(responses: DataFrame, strict: bool = False) -> DataFrame:
    """(response, fault) of the responses that are malformed, or, strictly, that depart from the exact form."""

    @F.arrow_udf("string")
    def fault(bodies: pa.Array) -> pa.Array:
        return pa.array([strict_fault(b) if strict else hits_of(b)[1] for b in bodies.to_pylist()], pa.string())

    return responses.select("response", fault(F.col("body")).alias("fault")).where("fault IS NOT NULL")


def hit_faults(hits: DataFrame) -> DataFrame:
    """(response, rank, fault): ids and plain texts, positive ranks once, finite scores, one body for a document."""
    odd = F.col("score").isNotNull() & ~finite(F.col("score"))
    kept = keep(hits.select("response", "rank", "doc", "text", odd.alias("odd")))  # what was parsed is read twice
    torn = kept.groupBy("doc").agg((F.min("text") != F.max("text")).alias("torn")).where("torn")
    w = Window.partitionBy("response", "rank").orderBy("doc")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    own = kept.select("response", "rank", "doc", "odd", blank.alias("blank")).withColumn("copy", F.row_number().over(w)).join(torn, "doc", "left")
    fault = first_fault(
        ("document", F.coalesce("doc", F.lit("")) == ""), ("text", F.col("blank")), ("rank", F.col("rank") < 1), ("repeated rank", F.col("copy") > 1),
        ("score", F.col("odd")), ("two bodies", F.col("torn")),
    )
    return own.select("response", "rank", "doc", fault.alias("fault")).where("fault IS NOT NULL")


def committed(store: DataFrame, entries: DataFrame) -> DataFrame:
    """The store after entries came: (key, sha256, action); an entry with a known key must have its digest.

    Both: key, sha256.  "inserted", "kept", "equal" (came again), or "conflict" (the store's stays; of new ones that
    differ none enters).
    """
    came = entries.groupBy("key").agg(F.min("sha256").alias("new"), (F.min("sha256") != F.max("sha256")).alias("torn"))
    both = store.select("key", F.col("sha256").alias("old")).join(came, "key", "full")
    conflict = F.coalesce("torn", F.lit(False)) | F.coalesce(F.col("old") != F.col("new"), F.lit(False))
    action = F.when(conflict, "conflict").when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").otherwise("equal")
    return both.select("key", F.when(action == "inserted", F.col("new")).otherwise(F.col("old")).alias("sha256"), action.alias("action"))


def recovered(staged: DataFrame, store: DataFrame) -> DataFrame:
    """What becomes of staged payloads after a break: published if whole and not there yet, dropped otherwise.

    ``staged``: key, attempt, sha256, payload (text).  Of several whole attempts the first counts.
    """
    whole = F.sha2("payload", 256) == F.col("sha256")
    w = Window.partitionBy("key").orderBy(F.desc(F.coalesce(whole, F.lit(False))), "attempt")
    own = staged.withColumn("nth", F.row_number().over(w)).join(store.select("key", F.lit(True).alias("there")), "key", "left")
    state = F.when(~F.coalesce(whole, F.lit(False)), "torn").when(F.col("there").isNotNull(), "published before").when(F.col("nth") > 1, "superseded").otherwise("published")
    return own.select("key", "attempt", state.alias("state"))


def continued(tickets: DataFrame, answers: DataFrame) -> DataFrame:
    """State of each topic's continuation: done, retry after a failure, or open; attempts beyond ``most`` are given up.

    ``tickets``: topic, most.  ``answers``: topic, attempt, ok (null while it runs).
    """
    per = answers.groupBy("topic").agg(F.count(F.lit(1)).alias("attempts"), F.max(F.coalesce("ok", F.lit(False))).alias("done"), F.max_by(F.col("ok").isNull(), "attempt").alias("running"))
    both = tickets.join(per, "topic", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    state = F.when(F.col("done"), "done").when(F.col("running"), "running").when(F.col("attempts") >= F.col("most"), "given up").when(F.col("attempts") > 0, "retry").otherwise("open")
    return both.select("topic", "attempts", state.alias("state"))


ADMITTED = "code string, used long"


def budget_step(total: int, per_task: int, per_tool: dict[str, int], deadline: int | None = None) -> Callable[[dict, dict], tuple]:
    """The rule of ``budget``, for tables and streams alike."""

    def step(state: dict, row: dict) -> tuple:
        used, task = state.setdefault("used", {}), f"task {row['task']}"
        own = f"{task}, {row['tool']}"
        stop = state.get("stop")
        if stop is None and deadline is not None and row["at"] >= deadline:
            stop = state["stop"] = "DEADLINE"
        if stop is not None:
            return stop, used.get("", 0)
        if used.get(task, 0) >= per_task or used.get(own, 0) >= per_tool.get(row["tool"], per_task):
            return "TASK_BUDGET", used.get("", 0)
        for key in ("", task, own):
            used[key] = used.get(key, 0) + 1
        if used[""] >= total:
            state["stop"] = "TOTAL_BUDGET"
        return "ADMITTED", used[""]

    return step


def budget(calls: DataFrame, total: int, per_task: int, per_tool: dict[str, int], deadline: int | None = None) -> DataFrame:
    """Admission of a run's calls in order: the first failing check gives the code; a run's stop is for good.

    ``calls``: run, place, at (seconds since its start), task, tool.  The call that uses up the total is
    admitted and stops the run; tasks and tools that are used up refuse only themselves.
    """
    return folded(calls, ["run"], ["place"], dict, budget_step(total, per_task, per_tool, deadline), ADMITTED)


def splice_faults(sentences: DataFrame, operations: DataFrame, most: int = 6, insertions: int = 4, touched: int = 8, words: int = 1024) -> DataFrame:
    """(topic, fault) of each topic with operations: null where all of them may be applied together.

    ``sentences``: topic, idx, text.  ``operations``: topic, start, count (0 inserts before start), text.
    At most ``most`` operations with starts of their own, within the answer, ``insertions`` inserting,
    ``touched`` sentences replaced, ranges apart, no insertion in or at one, ``words`` words in the end.
    """
    length = sentences.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(word_count(F.col("text"))).alias("words"))
    own = operations.join(length.select("topic", "n"), "topic")
    w = Window.partitionBy("topic").orderBy("start", F.desc("count"))
    end = F.col("start") + F.col("count")
    reach = F.max(F.when(F.col("count") > 0, end)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("clash", F.coalesce(reach > F.col("start"), F.lit(False))).withColumn("copy", F.row_number().over(w.partitionBy("topic", "start").orderBy("count")))
    outside = F.when(F.col("count") == 0, (F.col("start") < 0) | (F.col("start") > F.col("n"))).otherwise((F.col("start") < 0) | (F.col("count") < 0) | (F.col("start") >= F.col("n")) | (end > F.col("n")))
    gone = operations.select("topic", "start", "count").join(sentences, (operations["topic"] == sentences["topic"]) & (F.col("idx") >= F.col("start")) & (F.col("idx") < end)).groupBy(operations["topic"]).agg(F.sum(word_count(F.col("text"))).alias("gone"))
    any_ = lambda c: F.max(c.cast("int")) == 1
    per = own.groupBy("topic").agg(
        F.count(F.lit(1)).alias("many"), any_(F.col("copy") > 1).alias("again"), F.sum((F.col("count") == 0).cast("bigint")).alias("inserted"), F.sum("count").alias("touched"),
        any_(outside).alias("outside"), any_(F.col("clash")).alias("clash"), F.sum(word_count(F.col("text"))).alias("new"),
    )
    both = per.join(length, "topic").join(gone, "topic", "left").withColumn("total", F.col("words") - F.coalesce("gone", F.lit(0)) + F.col("new"))
    fault = first_fault(
        ("operations", F.col("many") > most), ("repeated start", F.col("again")), ("insertions", F.col("inserted") > insertions), ("touched", F.col("touched") > touched),
        ("range", F.col("outside")), ("overlap", F.col("clash")), ("words", F.col("total") > words),
    )
    return both.select("topic", fault.alias("fault"), F.when(fault.isNull(), F.col("total")).alias("words"))


def supported_order(supported: DataFrame, audit: DataFrame) -> DataFrame:
    """Supported documents by their best audited passage: highest score, then rank, then lane, then id; without one is a fault.

    ``supported``: topic, doc.  ``audit``: topic, lane (in order), doc, rank, score (null: not scored).
    """
    best = audit.where("score IS NOT NULL").groupBy("topic", "doc").agg(F.min(F.struct((-F.col("score")).alias("neg"), "rank", "lane")).alias("best"))
    own = supported.join(best, ["topic", "doc"], "left")
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("best").asc_nulls_last(), "doc"))
    return own.select("topic", "doc", (-F.col("best.neg")).alias("score"), F.col("best.lane").alias("lane"), place.alias("place"), first_fault(("no scored passage", F.col("best").isNull())).alias("fault"))


def projected_seconds(checkpoints: DataFrame, ceiling: float) -> DataFrame:
    """Whole time by each checkpoint, and whether it stays below the ceiling.

    ``checkpoints``: elapsed, done, total, finalize (seconds that come at the end whatever the rate).
    """
    valid = (F.col("elapsed") > 0) & (F.col("done") > 0) & (F.col("total") >= F.col("done")) & (F.col("finalize") >= 0)
    whole = F.when(valid, F.col("elapsed") * F.col("total") / F.nullif(F.col("done"), F.lit(0)) + F.col("finalize"))
    return checkpoints.withColumn("projected", whole).withColumn("go_on", F.coalesce(whole <= ceiling, F.lit(False)))
