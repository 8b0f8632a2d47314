"""Near copies by sets of terms, within topics, as joins over all tasks.

Rows of equal sets are one set.  Two sets with a Jaccard similarity above 0.8 share one of the
n - floor(0.8 n) rarest terms of each: those are posted.  What meets is sifted by parities of counts
of terms (sets differ in as many terms at least as their parities differ), and what is left is compared
as whole sets; both in cells, to which a set is sent once and not for each of its pairs.  Sets that are
linked through others are one component.  Terms are compared by 64-bit hashes, and sets are named by
such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.members import among
from orrery.session import drop, keep

#: Counters of the sketch that tells rare terms from frequent ones; it decides speed only.
_COUNTERS = 1 << 20
#: Pairs of a cell that are sifted at once, about.
CELL_PAIRS = 500_000
#: Terms of the sets of a component in one cell, about; and sets of a task of comparison on average.
CELL_TERMS, BIN_SETS = 2_000_000, 2_000


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, the identity of topic and set (null without terms), and ``ids``, the hashes of its terms within the topic."""
    text = dict(rows.dtypes)["terms"] == "string"
    terms: Column = F.split("terms", " ", -1) if text else F.col("terms")
    rows = rows.withColumn("terms", F.array_sort(F.array_distinct(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t != ""))))
    topic = F.coalesce(F.concat(F.lit("t"), F.col("topic").cast("string")), F.lit(""))
    key = F.when(F.size("terms") > 0, F.substring(F.sha2(F.concat(topic, F.lit("\u0002"), F.array_join("terms", "\u0001")).cast("binary"), 256), 1, 32))
    return rows.withColumn("key", key).withColumn("ids", F.transform("terms", lambda t: F.xxhash64("topic", t))).drop("terms")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets, sizes of sets)."""
    return pc.list_flatten(batch.column("ids")).to_numpy(zero_copy_only=False), pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(int)


def _often(sets: DataFrame) -> np.ndarray:
    """How many sets hold the terms of each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            many += np.bincount(_flat(batch)[0] & (_COUNTERS - 1), minlength=_COUNTERS)
        at = np.flatnonzero(many)
        for a in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + (1 << 16)]), pa.array(many[at[a : a + (1 << 16)]])], ["counter", "many"])

    counted = sets.select("ids").mapInArrow(run, "counter long, many long").groupBy("counter").agg(F.sum("many").alias("many")).toArrow()
    often = np.zeros(_COUNTERS, np.int32)
    often[counted.column("counter").to_numpy()] = np.minimum(counted.column("many").to_numpy(), 2**31 - 1)
    return often


def _postings(sets: DataFrame) -> DataFrame:
    """head, size, term (32 bits), place: the rarest terms of each set, in order."""
    often = sets.sparkSession.sparkContext.broadcast(_often(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                flat, sizes = _flat(part)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((flat, often.value[flat & (_COUNTERS - 1)], owner))
                place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]
                rare = place < (sizes - 4 * sizes // 5)[owner]
                by = owner[rare]
                made = (sizes[by].astype(np.int32), flat[order][rare].astype(np.int32), place[rare].astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("head").take(pa.array(by)), *map(pa.array, made)], ["head", "size", "term", "place"])

    return sets.select("head", "ids").mapInArrow(run, "head long, size int, term int, place int")


def _parities(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set, bits that tell whether an odd number of its terms falls to each: as many bits as terms, at least 128, a power of two."""
    bits = 1 << np.ceil(np.log2(np.maximum(sizes, 128))).astype(int)
    begin = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(begin[owner] + (flat >> 20 & bits[owner] - 1), minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[a : a + n] for a, n in zip((begin // 8).tolist(), (bits // 8).tolist())]


def _sifted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Those pairs (``right``) whose parities (``left``) differ in no more places than near copies do."""
    order = np.argsort(left.column("head").to_numpy(), kind="stable")
    heads, held = left.column("head").to_numpy()[order], left.column("bits").take(pa.array(order)).combine_chunks()
    bits = 8 * pc.binary_length(held).to_numpy(zero_copy_only=False).astype(int) if len(held) else np.empty(0, int)
    rows, at = {}, np.zeros(len(bits), int)  # parities of each width, and the place of each set among them
    for w in np.unique(bits).tolist():
        own = np.flatnonzero(bits == w)
        at[own] = np.arange(len(own))
        rows[w] = np.frombuffer(b"".join(held.take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), -1)
    a, b = (np.searchsorted(heads, right.column(c).to_numpy()) for c in "ab")
    most, good = right.column("both").to_numpy(), np.zeros(len(a), bool)

    def of(k: np.ndarray, w: int, narrow: int) -> np.ndarray:
        own = rows[w][at[k]]
        while own.shape[1] * 64 > narrow:
            own = own[:, : own.shape[1] // 2] ^ own[:, own.shape[1] // 2 :]
        return own

    for x, y in set(zip(bits[a].tolist(), bits[b].tolist())):
        some = np.flatnonzero((bits[a] == x) & (bits[b] == y))
        for part in np.array_split(some, -(-len(some) * max(x, y) // (1 << 26))):
            apart = np.bitwise_count(of(a[part], x, min(x, y)) ^ of(b[part], y, min(x, y))).sum(axis=1, dtype=np.int64)
            good[part] = 9 * apart < most[part]
    return right.select(["a", "b", "both"]).filter(pa.array(good))


def _may_be_alike(sets: DataFrame, met: DataFrame) -> DataFrame:
    """a, b of ``met`` without most pairs that only share a term; each set's parities go to a cell for each block of sets."""
    blocks = max(2, int(np.ceil(np.sqrt(met.count() / CELL_PAIRS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([part.column("head"), pa.array(_parities(*_flat(part)), pa.binary())], ["head", "bits"])

    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cell = lambda x, y: (F.least(x, y) * blocks + F.greatest(x, y)).alias("cell")
    sent = sets.select("head", "ids").mapInArrow(run, "head long, bits binary").select("head", "bits", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = sent.select("head", "bits", cell(block("head"), F.col("other")))
    dealt = met.select("a", "b", "both", cell(block("a"), block("b")))
    deal = lambda df: df.repartitionById(blocks * blocks, F.col("cell")).groupBy("cell")
    return deal(sent).cogroup(deal(dealt)).applyInArrow(_sifted, "a long, b long, both int")


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """a, b, p of pairs (``right``) whose sets (``left``) are redundant beside one another."""
    heads = left.column("head").to_numpy()
    flat = left.column("ids").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(flat).to_numpy(zero_copy_only=False))]).astype(int)
    flat = flat.flatten().to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, np.int64)
    order = np.argsort(heads, kind="stable")
    pairs = np.stack([right.column(c).to_numpy() for c in "ab"], axis=1).reshape(-1, 2)
    sets: dict[int, np.ndarray] = {}

    def of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = np.sort(flat[ends[k] : ends[k + 1]])
        return sets[k]

    alike = np.zeros(len(pairs))
    for at, (k, j) in enumerate(order[np.searchsorted(heads[order], pairs)].tolist() if len(pairs) else ()):
        a, b = of(k), of(j)
        if len(a) > len(b):
            a, b = b, a
        found = np.searchsorted(b, a)
        found[found == len(b)] = 0
        shared = int((b[found] == a).sum())
        alike[at] = shared / (len(a) + len(b) - shared)
    p = np.where(alike == 1.0, 1.0, (alike - 0.8) / 0.2)
    good = (alike > 0.8) & (p > 0)
    return pa.table({"a": pairs[good, 0], "b": pairs[good, 1], "p": p[good]})


def _pairs(sets: DataFrame) -> DataFrame:
    """a, b, p: sets that are redundant beside one another, a before b, and how much."""
    posted = _postings(sets)
    a, b = (posted.select("term", *(F.col(c).alias(f"{c}_{x}") for c in ("head", "size", "place"))) for x in "ab")
    most = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))  # terms that they may share from here on
    both = F.col("size_a") + F.col("size_b")
    near = (F.col("head_a") < F.col("head_b")) & (5 * F.least("size_a", "size_b") > 4 * F.greatest("size_a", "size_b")) & (9 * most > 4 * both)
    every = keep(a.join(b, "term").where(near).select(F.col("head_a").alias("a"), F.col("head_b").alias("b"), both.alias("both")).distinct())
    met = keep(_may_be_alike(sets, every))
    drop(every)
    # A component of what may be alike is compared in cells, each with the sets of its pairs.
    known = keep(_components(met.select("a", "b").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))))
    total = met.join(known, met["a"] == known["head"]).groupBy("component").agg(F.sum("both").alias("terms"))  # of its pairs, at least of its sets
    sides = F.ceil(F.col("terms") / F.lit(CELL_TERMS))
    side = lambda c: F.pmod(F.xxhash64(c), sides)
    bins = max(1, -(-known.count() // BIN_SETS))
    cell = F.pmod(F.xxhash64("component", F.least(side("a"), side("b")), F.greatest(side("a"), side("b"))), F.lit(bins)).cast("int")
    dealt = keep(met.select("a", "b").join(known.withColumnRenamed("head", "a"), "a").join(total, "component").select("a", "b", cell.alias("bin")))
    visits = keep(dealt.select("bin", F.col("a").alias("head")).union(dealt.select("bin", "b")).distinct())
    asked = sets.where(among(known, "head")(F.col("head"))).join(visits, "head")
    deal = lambda df: df.repartitionById(bins, F.col("bin")).groupBy("bin")
    found = keep(deal(asked.select("bin", "head", "ids")).cogroup(deal(dealt)).applyInArrow(_compared, "a long, b long, p double"))
    for table in (met, known, dealt, visits):
        drop(table)
    return found


def _components(edges: DataFrame) -> DataFrame:
    """head, component: the least head reachable; ``edges`` (a, b) go both ways.  Labels go to neighbours and from labels to theirs until none falls."""
    labels = keep(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "head"))
    while True:
        told = edges.join(labels, edges["b"] == labels["head"]).groupBy("a").agg(F.min("label").alias("told"))
        least = labels.join(told, labels["head"] == told["a"]).select("head", F.col("label").alias("before"), F.least("label", "told").alias("least"))
        jump = labels.select(F.col("head").alias("least"), F.col("label").alias("further"))
        fallen = keep(least.join(jump, "least").select("head", "before", F.least("least", "further").alias("label")))
        drop(labels)
        labels = fallen.select("head", "label")
        if fallen.where("label < before").isEmpty():
            return labels.withColumnRenamed("label", "component")


def linked(features: DataFrame) -> DataFrame:
    """``features`` with their ``terms`` replaced by ``head``, the number of their set (null without terms), ``component`` (null without copies) and ``links``.

    ``links``: heads of other sets and how redundant they are, beside one row of each set.
    """
    rows = keep(_hashed(features).withColumn("head", F.when(F.col("key").isNotNull(), F.xxhash64("key"))))
    many = keep(rows.where("head IS NOT NULL").groupBy("head").agg(F.count(F.lit(1)).alias("many"), F.min("doc").alias("first")))
    # Smaller sets are equal or no copies.  Rows whose set is theirs alone stay where they lie.
    large, again = rows.where(F.size("ids") >= 5).select("head", "doc", "ids"), many.where("many > 1")
    shared = among(again, "head")(F.col("head"))
    marked = large.withColumn("shared", shared)
    first = marked.where("shared").join(many.select("head", F.col("first").alias("doc")), ["head", "doc"])
    sets = marked.where("NOT shared").select("head", "ids").unionByName(first.select("head", "ids"))
    pairs = _pairs(sets)
    edges = keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")))
    links = edges.groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("head"), "p")).alias("links")).withColumnRenamed("a", "head")
    known = many.join(_components(edges).join(links, "head"), "head", "left")
    own = rows.drop("ids", "key").join(known, "head", "left")
    out = keep(own.withColumns({"component": F.coalesce("component", F.when(F.col("many") > 1, F.col("head"))), "links": F.when(F.col("doc") == F.col("first"), F.col("links"))}).drop("many", "first"))
    for table in (rows, many, pairs, edges):
        drop(table)
    return out
