"""Selections whose every step depends on the last.

FACET is lazy: what a candidate gains never grows from step to step (coverage rises), so a
heap of values, each computed when its candidate last came up, shows which few must be
computed again.  A topic's steps follow one another in one task, whose time and memory grow
with its candidates; topics run side by side.  DUAL has orders over all tasks (``dual``).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import dual as D
from orrery.operators.copies import linked
from orrery.operators.dual import DUAL
from orrery.operators.folds import folded
from orrery.session import keep


def _by_doc(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values("doc", kind="stable").reset_index(drop=True)


def _facet_matrix(rows: pd.DataFrame) -> np.ndarray:
    values = np.array([np.asarray(x, float) for x in rows["facets"]])
    return values if values.ndim == 2 else np.zeros((len(rows), 0))


def _order(arrays: list[np.ndarray]) -> np.ndarray:
    """Place of each row under the keys, the first counting most."""
    place = np.empty(len(arrays[0]), int)
    place[np.lexsort(arrays[::-1])] = np.arange(len(arrays[0]))
    return place


#: Terms that are put in order at a time.
_BLOCK = 1 << 22


class _Terms:
    """Term sets, for the redundancy of all others with one of them at a time.

    Sets are redundant from a Jaccard similarity of 0.8 on.  Two such sets share one of
    their n - ceil(0.8 n) + 1 rarest terms, so only postings of those are searched.
    """

    def __init__(self, terms):
        vocabulary: dict[str, int] = {}
        ids = array("i", (vocabulary.setdefault(t, len(vocabulary)) for row in terms for t in row))
        sizes = np.array([len(row) for row in terms], int)
        many = len(vocabulary)
        self.ids = np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)
        ends = np.cumsum(sizes)
        often = np.zeros(many, int)
        for a in range(0, len(self.ids), _BLOCK):
            often += np.bincount(self.ids[a : a + _BLOCK], minlength=many)
        rank = np.empty(many, np.int32)
        rank[np.lexsort((np.arange(many), often))] = np.arange(many)
        least, held, by = sizes + (-8 * sizes) // 10 + 1, [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        first = 0
        while first < len(sizes):  # some rows at a time, in place
            begin = int(ends[first] - sizes[first])
            last = max(int(np.searchsorted(ends, begin + _BLOCK)), first + 1)
            owner = np.repeat(np.arange(first, last), sizes[first:last])
            own = rank[self.ids[begin : begin + len(owner)]]
            own = own[np.lexsort((own, owner))]
            self.ids[begin : begin + len(owner)] = own
            rare = np.arange(begin, begin + len(owner)) - (ends - sizes)[owner] < least[owner]
            held.append(own[rare])
            by.append(owner[rare].astype(np.int32))
            first = last
        self.sizes, self.begins = sizes, ends - sizes
        self.rare = np.minimum(sizes, least)
        held, by = np.concatenate(held), np.concatenate(by)
        self.postings = by[np.argsort(held, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=many))])
        self.mark = np.zeros(many, bool)

    def redundant(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, penalties): all others with a penalty above 0 beside row ``k``."""
        parts = [self.postings[self.ends[t] : self.ends[t + 1]] for t in self.ids[self.begins[k] : self.begins[k] + self.rare[k]]]
        near = np.unique(np.concatenate(parts)) if parts else np.empty(0, int)
        small, large = np.minimum(self.sizes[near], self.sizes[k]), np.maximum(self.sizes[near], self.sizes[k])
        near = near[small >= 0.8 * large]
        if not len(near):
            return near, np.empty(0)
        own = self.ids[self.begins[k] : self.begins[k] + self.sizes[k]]
        self.mark[own] = True
        size = self.sizes[near]
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(self.begins[near], size)
        shared = np.add.reduceat(self.mark[self.ids[within]].astype(int), first)
        self.mark[own] = False
        similarity = shared / np.maximum(size + self.sizes[k] - shared, 1)
        penalty = np.where(similarity < 0.8, 0.0, np.where(similarity == 1.0, 1.0, (similarity - 0.8) / 0.2))
        return near[penalty > 0], penalty[penalty > 0]


class _Coverage:
    """What of each facet is covered, and what a row would add."""

    def __init__(self, rows: pd.DataFrame):
        self.facets = _facet_matrix(rows)
        self.left = np.ones(self.facets.shape[1])
        n, many = self.facets.shape
        self.local = self.facets.max(axis=1) if many else np.zeros(n)
        self.first = self.facets.argmax(axis=1) if many else np.zeros(n, int)
        self.version = 0

    def bonus(self, k: int) -> tuple[float, int]:
        """(best gain, its facet)."""
        if not len(self.left):
            return 0.0, int(self.first[k])
        gains = self.facets[k] * self.left
        at = int(gains.argmax())
        return float(gains[at]), at

    def cover(self, k: int) -> None:
        if len(self.left):
            left = np.minimum(self.left, 1 - self.facets[k])
            self.version += int((left < self.left).any())
            self.left = left


def _lazily(n: int, coverage: _Coverage, value, key, chosen_too=None, replay=()) -> list[tuple[int, float, float]]:
    """(row, value, bonus) of all ``n`` rows in greedy order; those of ``replay`` come first, as given.

    ``value(k, bonus)`` must not grow as coverage does, nor ``key(k, value, facet)`` fall: then
    a row whose key is new and the least in the heap is the next.  ``chosen_too(k)`` gives rows
    whose value has fallen for another reason.
    """
    seen = np.full(n, -1)
    out: list[tuple[int, float, float]] = []

    def fresh(k: int) -> tuple[float, float, int]:
        bonus, at = coverage.bonus(k)
        seen[k] = coverage.version
        return value(k, bonus), bonus, at

    def take(k: int, worth: float, bonus: float) -> None:
        out.append((k, worth, bonus))
        coverage.cover(k)
        if chosen_too is not None:
            seen[chosen_too(k)] = -1

    for k in replay:
        take(int(k), *fresh(int(k))[:2])
    done = {int(k) for k in replay}
    heap = []
    for k in range(n):
        if k not in done:
            worth, bonus, at = fresh(k)
            heap.append((key(k, worth, at), k, worth, bonus))
    heapify(heap)
    while heap:
        _, k, worth, bonus = heappop(heap)
        if seen[k] == coverage.version:
            take(k, worth, bonus)
        else:
            worth, bonus, at = fresh(k)
            heappush(heap, (key(k, worth, at), k, worth, bonus))
    return out


def facet_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Coverage-greedy order: .70 best facet + .30 best gain over what is covered."""
    rows = _by_doc(rows)
    coverage = _Coverage(rows)
    r, best, original = (rows[c].to_numpy() for c in ("r", "best_facet_rank", "original_rank"))
    local, first = coverage.local, coverage.first
    value = lambda k, bonus: float(0.70 * local[k] + 0.30 * bonus)
    # A gain's facet only moves on while the gain stays the same, so keys do not fall.
    key = lambda k, worth, at: (-worth, -r[k], first[k], at, original[k], best[k])
    return _result(rows, _lazily(len(rows), coverage, value, key))


def dual_order(rows: pd.DataFrame, use_redundancy: bool = True, prefix: int = 0) -> pd.DataFrame:
    """Two-sided greedy order of one topic's rows; the first ``prefix`` by original rank are replayed, then it goes on.

    The plain form of the DUAL arms, for rows in memory and for tests; ``arm`` and ``arms`` take the orders of ``dual``.
    """
    rows = _by_doc(rows)
    coverage = _Coverage(rows)
    n, local = len(rows), coverage.local
    g, narrative, r = (rows[c].to_numpy(float) for c in ("g", "n", "r"))
    tie = _order([-r, -local, rows["original_rank"].to_numpy(), rows["best_facet_rank"].to_numpy(), np.arange(n)])
    fixed = DUAL["g"] * g + DUAL["n"] * narrative + DUAL["r"] * r
    terms, penalty = _Terms(rows["terms"]) if use_redundancy else None, np.zeros(n)
    replay = np.argsort(rows["original_rank"].to_numpy(), kind="stable")[:prefix]

    def value(k: int, bonus: float) -> float:
        return float(fixed[k] + DUAL["local"] * local[k] + DUAL["bonus"] * bonus - (DUAL["redundancy"] * penalty[k] if terms else 0.0))

    def repeated(k: int) -> np.ndarray:
        near, own = terms.redundant(k)
        grown = near[own > penalty[near]]
        penalty[near] = np.maximum(penalty[near], own)
        return grown

    chosen = _lazily(n, coverage, value, lambda k, worth, at: (-worth, tie[k]), repeated if terms else None, replay)
    return _result(rows, chosen)


def _result(rows: pd.DataFrame, chosen: list[tuple[int, float, float]]) -> pd.DataFrame:
    k = [c[0] for c in chosen]
    return pd.DataFrame(
        {"topic": rows["topic"].iloc[k].to_numpy(), "doc": rows["doc"].iloc[k].to_numpy(), "final_rank": np.arange(1, len(k) + 1), "objective": [c[1] for c in chosen], "bonus": [c[2] for c in chosen]}
    )


ORDER = "topic string, doc long, final_rank long, objective double, bonus double"


def arm(features: DataFrame, name: str, prefix: int = 0) -> DataFrame:
    """One ranking arm: FACET, DUAL or DUAL-NR; with ``prefix``, replayed and continued.

    ``features``: topic, doc, facets (array of scores), g, n, r, original_rank,
    best_facet_rank, and, for DUAL, terms: an array, or a text with blanks between them.
    """
    if name == "FACET":
        return _by_topic(features.drop("terms"), lambda rows: [facet_order(rows)], ORDER)
    if name not in ("DUAL", "DUAL-NR"):
        raise ValueError(f"unknown arm: {name}")
    own = D.Arm(name, name == "DUAL", prefix)
    return D.orders(linked(features) if own.redundancy else keep(features.drop("terms")), [own]).drop("arm")


def arms(features: DataFrame, fused: DataFrame, prefixes: tuple[int, ...] = (100, 500)) -> DataFrame:
    """The six-arm table: the fused order, and DUAL with and without redundancy, static and replayed.

    Features and near copies are found once for all arms.
    """
    own = [D.Arm(f"{name}-{p}" if p else name, redundancy, p) for name, redundancy in (("DUAL", True), ("DUAL-NR", False)) for p in (0, *prefixes)]
    first = fused.select("topic", "doc", F.col("rank").alias("final_rank"), F.lit("RRF").alias("arm"))
    return first.unionByName(D.orders(linked(features), own).select("topic", "doc", "final_rank", "arm"))


def _by_topic(features: DataFrame, run: Callable[[pd.DataFrame], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """``run`` over each topic's rows by document.

    Rows stream into the topic's task unsorted.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def all_topics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics: dict = {}
        for batch in batches:
            for topic in pc.unique(batch.column("topic")):
                own = pc.is_null(batch.column("topic")) if not topic.is_valid else pc.equal(batch.column("topic"), topic)
                topics.setdefault(topic.as_py(), []).append(batch.filter(own))
        for topic in list(topics):
            rows = pa.Table.from_batches(topics.pop(topic)).to_pandas()
            for found in run(_by_doc(rows)):
                yield pa.RecordBatch.from_pandas(found[names], preserve_index=False)

    return features.repartition("topic").mapInArrow(all_topics, schema)


def round_robin(lanes: DataFrame, limit: int = 100) -> DataFrame:
    """Lanes take turns in order, each giving its next document that nobody gave before.

    ``lanes``: topic, lane, doc, rank (dense).  Returns topic, doc, lane, lane_rank, final_rank.
    A lane gives at most ``limit`` and passes over no more than all that are given, so
    ranks beyond twice the limit stay where they are.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        queues = [list(zip(g["doc"], g["rank"])) for _, g in rows.sort_values(["lane", "rank", "doc"]).groupby("lane")]
        names = sorted(rows["lane"].unique())
        at, taken, out = [0] * len(queues), set(), []
        while len(out) < limit:
            before = len(out)
            for k, queue in enumerate(queues):
                while at[k] < len(queue) and queue[at[k]][0] in taken:
                    at[k] += 1
                if at[k] < len(queue) and len(out) < limit:
                    doc, rank = queue[at[k]]
                    taken.add(doc)
                    out.append((rows["topic"].iloc[0], doc, names[k], rank, len(out) + 1))
                    at[k] += 1
            if len(out) == before:
                break
        return pd.DataFrame(out, columns=["topic", "doc", "lane", "lane_rank", "final_rank"])

    near = lanes.where(F.col("rank") <= 2 * limit)
    return near.groupBy("topic").applyInPandas(run, "topic string, doc long, lane string, lane_rank long, final_rank long")


def lane_status(lanes: DataFrame, selected: DataFrame) -> DataFrame:
    """Per lane: available, selected, and duplicates passed over before its last selection."""
    own = lanes.groupBy("topic", "lane").agg(F.count(F.lit(1)).alias("available"))
    got = selected.groupBy("topic", "lane").agg(F.count(F.lit(1)).alias("selected"), F.max("lane_rank").alias("reached"))
    return own.join(got, ["topic", "lane"], "left").select(
        "topic", "lane", "available", F.coalesce("selected", F.lit(0)).cast("bigint").alias("selected"),
        (F.coalesce("reached", F.lit(0)) - F.coalesce("selected", F.lit(0))).cast("bigint").alias("skipped"),
    )


def leader_clusters(items: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Each item joins the first cluster whose first member has its signature and is similar enough.

    ``items``: topic, id, signature, vector; in the order of ids.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        vectors = np.array([np.asarray(v, float) for v in rows["vector"]])
        norms = np.sqrt((vectors**2).sum(axis=1))
        vectors = vectors / np.where(norms == 0, 1, norms)[:, None]
        leaders, cluster = [], []
        signature = rows["signature"].to_numpy()
        for k in range(len(rows)):
            found = next((c for c, j in enumerate(leaders) if signature[j] == signature[k] and vectors[j] @ vectors[k] >= threshold), None)
            if found is None:
                found = len(leaders)
                leaders.append(k)
            cluster.append(found)
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"topic": rows["topic"].to_numpy(), "id": ids, "leader": [ids[leaders[c]] for c in cluster]})

    return items.groupBy("topic").applyInPandas(run, "topic string, id long, leader long")


def mmr(items: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: weight * relevance - (1 - weight) * greatest similarity to the chosen.

    ``items``: topic, id, relevance, vector.  Ties go to the smaller id.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        ids, relevance = rows["id"].to_numpy(), rows["relevance"].to_numpy(float)
        vectors = np.array([np.asarray(v, float) for v in rows["vector"]])
        norms = np.sqrt((vectors**2).sum(axis=1))
        vectors = vectors / np.where(norms == 0, 1, norms)[:, None]
        near, left, out = np.full(len(rows), -np.inf), np.ones(len(rows), bool), []
        for place in range(min(k, len(rows))):
            value = weight * relevance - (1 - weight) * (near if place else 0.0)
            value = np.where(left, np.round(value, 9), -np.inf)
            j = int(np.argmax(value))
            left[j] = False
            near = np.maximum(near, vectors @ vectors[j])
            out.append((rows["topic"].iloc[0], ids[j], place + 1, float(value[j])))
        return pd.DataFrame(out, columns=["topic", "id", "place", "value"])

    return items.groupBy("topic").applyInPandas(run, "topic string, id long, place long, value double")


def distinct_snippets(items: DataFrame, most: float = 0.8) -> DataFrame:
    """Drops a snippet whose text was kept before, or whose span overlaps a kept one of its document.

    ``items``: doc, id, start, end, text, score; better scores first.
    """

    def step(state: dict, row: dict) -> tuple:
        kept, seen = state.setdefault("kept", []), state.setdefault("seen", set())
        start, end, normal = row["start"], row["end"], " ".join((row["text"] or "").lower().split())
        clash = any(max(0, min(end, b) - max(start, a)) >= most * min(end - start, b - a) for a, b in kept)
        if normal in seen or clash:
            return (False,)
        seen.add(normal)
        kept.append((start, end))
        return (True,)

    own = items.select("doc", "id", "start", "end", "text", (-F.col("score")).alias("neg"))
    return folded(own, ["doc"], ["neg", "id"], dict, step, "fresh boolean").where("fresh").select("doc", "id")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Greedy matching: best scores first, every left and right at most once.

    ``pairs``: topic, a, b, score; ties by a, then b.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, out = set(), set(), []
        for r in rows.sort_values(["score", "a", "b"], ascending=[False, True, True], kind="stable").itertuples():
            if r.a not in left and r.b not in right:
                left.add(r.a)
                right.add(r.b)
                out.append((r.topic, r.a, r.b, r.score))
        return pd.DataFrame(out, columns=["topic", "a", "b", "score"])

    return pairs.groupBy("topic").applyInPandas(run, "topic string, a long, b long, score double")
