"""State machines over one key's rows in order, where windows cannot say the rule.

Rows are dealt by key and sorted; a pass over each partition carries one key's state at
a time, so memory holds a batch and one state, however many rows a key has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def folded(df: DataFrame, by: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], tuple], added: str) -> DataFrame:
    """``df`` with the columns ``added`` (DDL) that ``step(state, row)`` makes of each row of a key in turn."""
    fields = T.StructType.fromDDL(added).fields
    kinds, names = [to_arrow_type(f.dataType) for f in fields], df.columns
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in by)
                if state is None or own != key:
                    key, state = own, start()
                made.append(step(state, row))
            columns = list(zip(*made)) if made else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*names, *(f.name for f in fields)])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


CLAIMED = "result string, holder string"


def claim_step(lease_seconds: int = 3600) -> Callable[[dict, dict], tuple]:
    """The rule of ``claims``, for tables and streams alike."""

    def step(state: dict, row: dict) -> tuple:
        holder = state.get("holder")
        if state.get("scored"):
            return "cached", None
        if row["done"]:
            if holder != row["worker"]:
                return "lost", holder
            state.update(scored=True, holder=None)
            return "scored", None
        result = "claimed" if holder is None else "heartbeat" if holder == row["worker"] else "reclaimed" if state["until"] <= row["at"] else "busy"
        if result != "busy":
            state.update(holder=row["worker"], until=row["at"] + lease_seconds)
        return result, state["holder"]

    return step


def claims(attempts: DataFrame, lease_seconds: int = 3600) -> DataFrame:
    """What each attempt on a key comes to: ``result`` and the ``holder`` after it.

    ``attempts``: key, at (seconds), place, worker, done.  A free key is claimed; its holder's
    attempts are heartbeats, and only they extend the lease; others are busy until it has run
    out, and then reclaim.  The holder's done scores the key once and for all; from then on
    attempts are cached.  Done by anyone else is lost.
    """
    return folded(attempts, ["key"], ["at", "place"], dict, claim_step(lease_seconds), CLAIMED)


def paragraphs(sentences: DataFrame, most: int = 3500) -> DataFrame:
    """Sentences with their paragraph's number: a blank line behind a complete sentence begins a new one,
    and so does a sentence with which the paragraph would be longer than ``most``.

    ``sentences``: doc, start, end, complete, blank_before.
    """

    def step(state: dict, row: dict) -> tuple:
        fresh = state and (bool(row["blank_before"] and state["complete"]) or row["end"] - state["start"] > most)
        number = state.get("number", 0) + bool(fresh)
        if fresh or not state:
            state["start"] = row["start"]
        state.update(complete=row["complete"], number=number)
        return (number,)

    own = folded(sentences, ["doc"], ["start"], dict, step, "paragraph long")
    return own.groupBy("doc", "paragraph").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("sentences"))


#: Sections of an evidence delta, in the order in which they apply; reads come before.
SECTIONS = ("read", "need", "facet", "nugget", "evidence", "facet_status", "need_status", "supersede", "abandon")
#: Statuses, and drafts that a need may select.
FACET_STATUSES, NEED_STATUSES, MOST_DRAFTS = ("open", "covered", "dropped"), ("unaddressed", "partial", "answerable", "conflicted"), 8


class Ledger:
    """Evidence of one run: what is known, and rules that say why a row may not enter."""

    def __init__(self):
        self.snippets: dict[str, str | None] = {}  # snippet: document
        self.needs: set[str] = set()
        self.facets: dict[str, set[str]] = {}
        self.nuggets: dict[str, dict] = {}
        self.version, self.digest = 0, ""

    def _unread(self, row: dict) -> str | None:
        return "UNKNOWN_SNIPPET" if any(s not in self.snippets for s in row["snippets"]) else None

    def _grounded(self, row: dict) -> bool:
        own = [self.nuggets.get(n) for n in row["nuggets"]]
        return all(n and row["id"] in n["needs"] and n["snippets"] and not n["gone"] for n in own)

    def _linked(self, ids: list[str]) -> bool:
        return any(b in self.nuggets[a]["against"] for a in ids if a in self.nuggets for b in ids if a != b)

    def fault(self, row: dict) -> str | None:
        """The code of the first rule that the row breaks."""
        section, id, ids = row["section"], row["id"], {"need": self.needs, "facet": self.facets, "nugget": self.nuggets}
        unknown = lambda what, asked: f"UNKNOWN_{what.upper()}" if any(x not in ids[what] for x in asked) else None
        if section not in SECTIONS:
            return "UNKNOWN_SECTION"
        if section == "read":
            return None if id else "INVALID_READ"
        if section in ids:
            if not id or (section != "need" and not row["needs"] and section == "facet"):
                return f"INVALID_{section.upper()}"
            if id in ids[section]:
                return "DUPLICATE_ID"
        if section == "need":
            return None if row["grounded"] else "UNGROUNDED_NARRATIVE_SPAN"
        if section == "facet":
            return unknown("need", row["needs"])
        if section == "nugget":
            lost = None if row["needs"] else "UNKNOWN_NEED"
            return lost or unknown("need", row["needs"]) or unknown("facet", row["facets"]) or unknown("nugget", row["nuggets"]) or self._unread(row)
        if section == "evidence":
            known = unknown("nugget", [id]) or self._unread(row)
            return known or ("DUPLICATE_EVIDENCE" if set(row["snippets"]) <= self.nuggets[id]["snippets"] else None)
        if section == "facet_status":
            if id not in self.facets:
                return "UNKNOWN_FACET"
            if row["status"] not in FACET_STATUSES:
                return "INVALID_FACET_STATUS"
            support = [self.nuggets.get(n) for n in row["nuggets"]]
            if row["status"] == "covered" and not (support and all(n and id in n["facets"] and n["snippets"] for n in support)):
                return "MISSING_GROUNDED_NUGGET"
            return "MISSING_STATUS_REASON" if row["status"] == "dropped" and not row["reason"] else None
        if section == "need_status":
            if id not in self.needs:
                return "UNKNOWN_NEED"
            if row["status"] not in NEED_STATUSES:
                return "INVALID_NEED_STATUS"
            if len(row["nuggets"]) > MOST_DRAFTS:
                return "TOO_MANY_DRAFT_NUGGETS"
            grounded = self._grounded(row)
            if not grounded or (row["status"] == "answerable" and not (row["reason"] and row["nuggets"])):
                return "MISSING_GROUNDED_DRAFT"
            return "MISSING_CONTRADICTION_LINK" if row["status"] == "conflicted" and not self._linked(row["nuggets"]) else None
        if section == "supersede":
            return unknown("nugget", [id, row["other"]]) or ("INVALID_SUPERSESSION" if id == row["other"] else None)
        if not id or not row["reason"]:
            return "INVALID_ABANDONMENT"
        return None if id in self.snippets.values() else "UNKNOWN_DOCUMENT"

    def enter(self, row: dict) -> None:
        section, id = row["section"], row["id"]
        if section == "read":
            self.snippets[id] = row["other"]
        elif section == "need":
            self.needs.add(id)
        elif section == "facet":
            self.facets[id] = set(row["needs"])
        elif section == "nugget":
            self.nuggets[id] = {"needs": set(row["needs"]), "facets": set(row["facets"]), "snippets": set(row["snippets"]), "against": set(row["nuggets"]), "gone": False}
            for other in row["nuggets"]:
                self.nuggets[other]["against"].add(id)
        elif section == "evidence":
            self.nuggets[id]["snippets"] |= set(row["snippets"])
        elif section == "supersede":
            self.nuggets[id]["gone"] = True
        self.version += 1
        self.digest = hashlib.sha256(f"{self.digest}|{section}:{id}".encode()).hexdigest()


def evidence_ledger(rows: DataFrame) -> DataFrame:
    """Rows of evidence deltas with ``code``, and the ledger's version and digest behind each.

    ``rows``: ledger, seq (of the delta), place, section, id, needs, facets, nuggets, snippets
    (arrays), status, reason, other, grounded.  Sections of a delta apply in their fixed order.
    Rejected rows change nothing: their ids may come again.  A digest chains what was accepted.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int"), F.lit(0))
    empty = F.array().cast("array<string>")
    own = rows.withColumn("step", order).withColumns({c: F.coalesce(c, empty) for c in ("needs", "facets", "nuggets", "snippets")})

    def step(state: dict, row: dict) -> tuple:
        ledger = state.setdefault("ledger", Ledger())
        code = ledger.fault(row)
        if code is None:
            ledger.enter(row)
        return code or "ACCEPTED", ledger.version, ledger.digest

    return folded(own, ["ledger"], ["seq", "step", "place"], dict, step, "code string, version long, state_sha256 string").drop("step")
