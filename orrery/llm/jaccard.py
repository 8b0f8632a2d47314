"""Documents that share most of their word n-grams, linked and joined into components.

Two documents link when the Jaccard similarity of their sets of distinct five-word
shingles is ``PERCENT`` / 100 or more.  Documents with equal sets form one class, and
everything below works on classes, for which one text stands.

* Shingles are hashed into groups, more of them for larger sets; a class's count of each
  is a point.  The sum of coordinate minima of two points bounds the overlap of their
  sets from above.  Groups nest, so that points of neighbouring sizes can be compared.
* Points meet in an R-tree (packed by sorting, boxes with greatest coordinates): a box
  is entered only if the minima with its upper corner still allow the overlap that the
  sizes demand; points that pass are candidates, and their sets are compared exactly.
* Which points can meet at all follows from the prefix rule: in any fixed order of all
  shingles, two sets that link share one of their first n - ceil(0.75 n) + 1.  The order
  puts frequent shingles last (by a counting sketch of fixed size over all documents),
  so that common passages draw no crowd; it only affects speed, never the result.

Each text is cut into shingles where it lies, and only a draft of it moves: a longer
prefix (by n / LONGER) and its point.  Buckets of drafts announce prefix shingles and
their counts to shards; shards answer which occur again.  Shingles that occur once are in
no overlap: a class with h that occur again, of a prefix longer by l, links with none if
h < l, and else meets all its links at the first h - l + 1 of them (the prefix rule on what
is left).  Only these carry its point to their shards.  Of a shingle
that more than ``CROWD`` classes share, buckets send one class each and hang the others
on it: a shard's rows follow the buckets then, not the crowd.  Candidate pairs join into
blocks; a block's texts are compared exactly, large blocks in parts, every part with
every other.  Components of the verified links are found by star steps on DataFrames.

Shingles are 64-bit hashes and classes 128-bit ones; texts are compared by these.  Drafts
hold 48 bits of a shingle and messages 32 beside the shard, which may let more pairs meet, not fewer.
``CROWD``, ``BROADCAST_ROWS`` and the sizes of buckets, shards, parts and bins change
the work's order, not the result.

Input rules: A-Z are lower-cased, words are cut at blanks and the five controls of
white space; fewer than five words make one shingle; without words (null, empty) a
document has an empty set and links with nothing, not even its like; repeated rows,
repeated ids and null ids are rows of their own and link as their sets do; a component
without ids has none; an empty table gives no rows; other columns, whatever their
names, are ignored; texts are taken whole (a text must fit a task).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.arrow import lean, pieces, texts_of, trim, unzipped, zipped
from orrery.llm.graph import components, nodes
from orrery.llm.words import BASE, MUL, hashes, mix
from orrery.members import among
from orrery.session import drop, keep

WORDS, PERCENT = 5, 75
#: Fewest groups of a point, and groups for each shingle of a larger set.
GROUPS, GROUPS_EACH = 128, 1 / 6
#: Bytes of a bucket, prefix shingles of a shard on average, shingles of a block's part.
BUCKET_BYTES, SHARD_SHINGLES, PART_SHINGLES = 8 << 20, 1_000_000, 1_000_000
#: A prefix is longer than the rule asks by one shingle in so many of its set.
LONGER = 16
#: Classes that share a shingle, above which they are not searched for pairs in a tree but
#: compared exactly as one block.  The result is the same on either side.
CROWD = 128
#: Tasks' counts that are summed in one step.
FAN = 64
#: Placed texts that one task of verification gets on average.
BIN_ROWS = 500
#: Bytes of text whose shingles are made at once; counters of the sketch, and points of an R-tree's leaf.
PIECE_BYTES, COUNTERS, LEAF = 2 << 20, 1 << 21, 32
#: Postings that verification reads at once.
POSTINGS = 1 << 20
#: Rows of an id, a key of 16 bytes and eight numbers that may be broadcast; above, rows of texts that a
#: bitmap lets pass are shuffled.
BROADCAST_ROWS = 200_000
#: Classes that a task remembers, so that it drafts the copies of a text once.
REMEMBERED = 200_000
#: Shards that meet in one part, so that a point goes there once, where there are more parts than these; and
#: parts whose blocks are joined in one task before the graph is built.
COMBINED = 8
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, as ascending hashes."""
    lowered = [t.translate(_LOWER) for t in texts]
    words = hashes(b" ".join(lowered))
    ends = np.cumsum(np.fromiter((len(t.split()) for t in lowered), np.int64, len(lowered)))
    n = max(0, len(words) - WORDS + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(WORDS):
        whole += words[k : k + n] * np.uint64(pow(MUL, 2 * k + 1, 1 << 64))
    whole = mix(whole)
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            own = np.uint64(b - a)
            for w in words[a:b]:
                own = mix(np.array([(int(own) * BASE + int(w)) & (1 << 64) - 1], np.uint64))[0]
            out.append(np.array([own], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        a = b
    return out


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two sums over its shingles: equal sets, equal classes."""
    if not len(shingles):
        return 0, 0
    n, out = np.array([len(shingles)], np.uint64), []
    for salt in (1, BASE):
        total = mix(shingles + np.uint64(salt)).sum(keepdims=True) + n * np.uint64(MUL)
        out.append(int(mix(total).view(np.int64)[0]))
    return out[0], out[1]


def numbered(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each distinct row's first occurrence, every row's number) of rows of two numbers."""
    order = np.lexsort((classes[:, 1], classes[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (classes[order][1:] != classes[order][:-1]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _class_column(classes) -> pa.StructArray:
    own = np.array(classes, np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["a", "b"])


def _classes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, 2)


def needed(a, b):
    """Least overlap of two sets of these sizes that link: 100 o >= 75 (a + b - o)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending arrays of distinct shingles link."""
    need = needed(len(a), len(b))
    if min(len(a), len(b)) < need:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= need


def groups_of(n):
    """How many groups the point of a set of ``n`` shingles has: a power of two."""
    wanted = np.maximum(np.asarray(n) * GROUPS_EACH, GROUPS)
    return (1 << np.ceil(np.log2(wanted)).astype(np.int64)).astype(np.int64)


def point_of(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) over fewer groups."""
    return points.reshape(len(points), -1, groups).sum(axis=1, dtype=np.int32) if points.shape[1] > groups else points


class Points:
    """Points of several classes, in one matrix for each number of groups."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, keep: np.ndarray):
        """``flat``: all points end to end; ``sizes``: shingles of each; ``keep``: which to hold."""
        groups = groups_of(sizes) if len(sizes) else np.empty(0, np.int64)
        begin = np.cumsum(groups) - groups
        self.n, self.groups = sizes[keep], groups[keep]
        self.row, self.bands = np.empty(len(keep), np.int64), {}
        for g in np.unique(self.groups).tolist():
            own = np.flatnonzero(self.groups == g)
            self.row[own] = np.arange(len(own))
            self.bands[g] = flat[begin[keep[own]][:, None] + np.arange(g)]

    def of(self, members: np.ndarray, groups: int) -> np.ndarray:
        """Points of members that all have one number of groups, over ``groups``."""
        return folded(self.bands[int(self.groups[members[0]])][self.row[members]], groups)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs the bound lets pass."""
        need = needed(self.n[a], self.n[b])
        ok = np.minimum(self.n[a], self.n[b]) >= need
        for ga, gb in set(zip(self.groups[a[ok]].tolist(), self.groups[b[ok]].tolist())):
            some = np.flatnonzero(ok & (self.groups[a] == ga) & (self.groups[b] == gb))
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                g = min(ga, gb)
                bound = np.minimum(self.of(a[part], g), self.of(b[part], g)).sum(axis=1, dtype=np.int64)
                ok[part] = bound >= need[part]
        return ok

    def pairs(self, members: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of members that the bound lets pass, found in R-trees: one for each number of groups."""
        trees = {}
        for g in np.unique(self.groups[members]).tolist():
            own = members[self.groups[members] == g]
            trees[g] = own, CountTree(self.of(own, g), self.n[own])
        for g, (own, tree) in trees.items():
            lower, below = trees.get(g // 2, (None, None))
            points, small = self.of(own, g), self.of(own, g // 2) if below else None
            for k, m in enumerate(own.tolist()):
                near = tree.search(points[k], int(self.n[m]))
                near = own[near[near > k]]
                if below:
                    near = np.concatenate([near, lower[below.search(small[k], int(self.n[m]))]])
                if len(near):
                    yield np.stack([np.full(len(near), m), near], axis=1)


class CountTree:
    """R-tree over points of group counts, searched by the bound on overlap."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Packed by size, then by the groups that vary most: near points share leaves.
        spread = np.argsort(-points.var(axis=0), kind="stable")[:2] if len(points) > LEAF else [0]
        keys = [points[:, g] for g in spread][::-1] + [np.log1p(sizes) // 0.15]
        self.order = np.lexsort(keys)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        corner, low, high = self.points, self.sizes, self.sizes
        while len(corner) > LEAF:
            cuts = np.arange(0, len(corner), LEAF)
            corner = np.maximum.reduceat(corner, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((corner, low, high))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose sets may link with one of this point and size."""
        some = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for corner, low, high in reversed(self.levels):
            bound = np.minimum(np.minimum(corner[some], point).sum(axis=1, dtype=np.int64), np.minimum(high[some], size))
            some = some[bound >= needed(size, low[some])]
            below = len(self.points) if corner is self.levels[0][0] else len(self.levels[self._index(corner) - 1][0])
            some = (some[:, None] * LEAF + np.arange(LEAF)).ravel()
            some = some[some < below]
        bound = np.minimum(self.points[some], point).sum(axis=1, dtype=np.int64)
        return self.order[some[bound >= needed(size, self.sizes[some])]]

    def _index(self, corner: np.ndarray) -> int:
        return next(k for k, level in enumerate(self.levels) if level[0] is corner)


def longer(n):
    """By how many shingles the prefix of a set of ``n`` is longer than the places that the rule names, less one."""
    return np.maximum(1, n // LONGER)


class Order:
    """The fixed order of shingles: frequent ones last, by levels of the sketch."""

    def __init__(self, counts: bytes):
        counts = np.frombuffer(counts, np.uint32)
        mean = counts.mean()
        self.limit = mean + 6 * np.sqrt(mean) + 24
        hot = np.maximum(counts / self.limit, 0.5)
        self.level = np.where(counts > self.limit, 1 + np.floor(2 * np.log2(hot)), 0).astype(np.uint8)

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        keep = n - -(-PERCENT * n // 100) + longer(n)
        level = self.level[(shingles >> np.uint64(20)) % np.uint64(COUNTERS)]
        if not level.any():
            return shingles[:keep]
        return shingles[np.lexsort((shingles, level))[:keep]]


SURVEYED = "id long, key binary, class struct<a:bigint,b:bigint>, n long, bytes long, part int, task int, counts binary"


def survey(df: DataFrame) -> DataFrame:
    """One pass over all rows (id, key, text): each row's class, size and bytes, and each task's counts.

    Two kinds of rows: rows (id, key, class, n, bytes), and (part, task, counts).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = [f.split()[0] for f in SURVEYED.split(", ")]
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                texts = texts_of(part, "text")
                sets = shingle_sets(texts)
                every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                counts += np.bincount((every >> np.uint64(20)) % np.uint64(COUNTERS), minlength=COUNTERS).astype(np.uint32)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("key"), _class_column([class_of(s) for s in sets]),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                        pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    ],
                    names,
                )
        if counts.any():
            blocks, task = [_narrow(x) for x in np.split(counts, 32)], TaskContext.get().partitionId()
            none = pa.nulls(32, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, pa.nulls(32, pa.binary()), pa.nulls(32, _class_column([(0, 0)]).type), none, none, pa.array(range(32), pa.int32()), pa.array([task] * 32, pa.int32()), pa.array(blocks, pa.binary())],
                names,
            )
        trim()

    return df.select("id", "key", "text").mapInArrow(run, SURVEYED)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each, the first byte telling how many."""
    width = next(w for w in (1, 2, 4) if int(counts.max()) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def sketch(surveyed: DataFrame) -> bytes:
    """All tasks' counts summed, FAN at a time: a table of fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // 32, np.uint32)
        for x in table.column("counts").to_pylist():
            total += _wide(x)
        first = lambda c: table.column(c).combine_chunks().slice(0, 1)
        return pa.table({"part": first("part"), "task": first("to"), "counts": [_narrow(total)]})

    held = surveyed.where("part IS NOT NULL").select("part", "task", "counts")
    tasks, before = 1 + (held.agg(F.max("task")).first()[0] or 0), None
    while True:
        summed = held.withColumn("to", F.floor(F.col("task") / FAN).cast("int")).groupBy("part", "to").applyInArrow(add, "part int, task int, counts binary")
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
        summed = keep(summed)
        if before is not None:
            drop(before)
        held = before = summed
    blocks = {r["part"]: _wide(bytes(r["counts"])).astype(np.uint32).tobytes() for r in summed.collect()}  # 32 rows of fixed size
    if before is not None:
        drop(before)
    return b"".join(blocks.get(k, bytes(COUNTERS // 8)) for k in range(32))


DRAFT = "a long, b long, n long, prefix binary, point binary"


def drafts(docs: DataFrame, counts) -> DataFrame:
    """Of each text with words, where it lies: its class, size, prefix (48 bits of each shingle) and point."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(counts.value), set()
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                rows = []
                for s in shingle_sets(texts_of(part, "text")):
                    if len(s) and (own := class_of(s)) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(own)
                        rows.append((*own, len(s), _six(order.prefix(s)), zipped(_narrow(point_of(s, int(groups_of(len(s))))))))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "n", "prefix", "point"])
        trim()

    return docs.select("text").mapInArrow(run, DRAFT)


def _six(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each."""
    return shingles.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


MESSAGE = "bucket int, shard int, kind string, tokens binary, sizes binary, classes binary, n binary, points binary"
_FIELDS = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("kind", pa.string())] + [(c, pa.binary()) for c in ("tokens", "sizes", "classes", "n", "points")])


class Bucket:
    """Drafts of a bucket, one of each class, by class; their prefix shingles end to end, each in its order, with its shard and 32 bits."""

    def __init__(self, table: pa.Table, shards: int):
        ends = np.stack([table.column(c).to_numpy() for c in ("a", "b")], axis=1)
        first = numbered(ends)[0]
        own = table.take(pa.array(first))
        self.classes, self.n, self.points = ends[first], own.column("n").to_numpy(), own.column("point")
        held = own.column("prefix").to_pylist()
        self.many = np.array([len(x) // 6 for x in held], np.int64)
        wide = np.zeros((int(self.many.sum()), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 6)
        tokens = wide.view(np.uint64).ravel()
        self.owner = np.repeat(np.arange(len(first)), self.many)
        self.shard = (tokens % np.uint64(shards)).astype(np.int64)
        self.tokens = (tokens // np.uint64(shards)).astype(np.uint32)
        self.by = np.argsort(self.shard, kind="stable")

    def shards(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, places of its shingles, distinct ones, number of each), always the same."""
        for at in np.split(self.by, np.flatnonzero(np.diff(self.shard[self.by])) + 1):
            if len(at):
                words, number = np.unique(self.tokens[at], return_inverse=True)
                yield int(self.shard[at[0]]), at, words, number

    def chosen(self, again: np.ndarray) -> np.ndarray:
        """Of prefix shingles that occur again, those at which a class meets all its links."""
        many = np.bincount(self.owner[again], minlength=len(self.n))
        most = many - longer(self.n) + 1
        count = np.cumsum(again)
        before = np.concatenate([[0], count])[np.cumsum(self.many) - self.many]
        return again & (count - before[self.owner] <= most[self.owner])


def _rising(words: np.ndarray) -> bytes:
    """Ascending 32-bit numbers, by their steps."""
    return zipped(np.diff(words, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes())


def _risen(data: bytes) -> np.ndarray:
    steps = np.frombuffer(unzipped(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint32).ravel(), dtype=np.uint32)


def _announce(shards: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, out = table.column("bucket")[0].as_py(), []
        for shard, _, words, number in Bucket(table, shards).shards():
            times = np.minimum(np.bincount(number), 255).astype(np.uint8)
            out.append({"bucket": bucket, "shard": shard, "kind": "tokens", "tokens": _rising(words), "sizes": zipped(times.tobytes())})
        return lean(pa.Table.from_pylist(out, schema=_FIELDS))

    return run


def _answer(crowd: int):
    """Which announced shingles of each bucket occur more than once in the shard, and which in a crowd."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "shard", "tokens", "sizes"]).to_pylist()
        held = [_risen(r["tokens"]) for r in rows]
        tokens = np.concatenate(held)
        times = np.concatenate([np.frombuffer(unzipped(r["sizes"]), np.uint8) for r in rows])
        order = np.argsort(tokens, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]]))
        total = np.add.reduceat(times[order].astype(np.int64), cuts)
        own = np.empty(len(tokens), np.int64)
        own[order] = np.repeat(total, np.diff(np.append(cuts, len(tokens))))
        out, at = [], 0
        for r, words in zip(rows, held):
            mine = own[at : at + len(words)]
            at += len(words)
            if (mine > 1).any():
                out.append({"bucket": r["bucket"], "shard": r["shard"], "kind": "again", "tokens": zipped(np.packbits(mine > 1).tobytes()), "sizes": zipped(np.packbits(mine > crowd).tobytes())})
        return lean(pa.Table.from_pylist(out, schema=_FIELDS))

    return run


def _send(shards: int, parts: int):
    """Points of the classes that may link, to the parts (of several shards) of the shingles at which they meet their links.

    Where a crowd shares the shingle, the bucket hangs its classes on one of them and
    sends that one only: a part gets a row for each bucket, however large the crowd.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers = {r["shard"]: r for r in right.select(["shard", "tokens", "sizes"]).to_pylist()}
        if answers and left.num_rows:
            bucket, own, hung = left.column("bucket")[0].as_py(), Bucket(left, shards), []
            again, crowded = (np.zeros(len(own.tokens), bool) for _ in range(2))
            for shard, at, words, number in own.shards():
                if shard in answers:
                    for flags, c in ((again, "tokens"), (crowded, "sizes")):
                        flags[at] = np.unpackbits(np.frombuffer(unzipped(answers[shard][c]), np.uint8), count=len(words)).astype(bool)[number]
            sent = np.flatnonzero(own.chosen(again))
            classes, points, to = own.classes, {}, own.shard[sent] % parts
            for part in np.unique(to).tolist():
                at = sent[to == part]
                if (crowd := crowded[at]).any():
                    tokens, who = own.tokens[at][crowd], own.owner[at][crowd]
                    order = np.lexsort((who, tokens))
                    tokens, who = tokens[order], who[order]
                    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
                    least = who[first]
                    hung.append(np.stack([np.repeat(least, np.diff(np.append(np.flatnonzero(first), len(who)))), who], axis=1))
                    out.append({"bucket": bucket, "shard": part, "kind": "crowd", "tokens": tokens[first].tobytes(), "classes": classes[least].tobytes()})
                at = at[~crowd]
                if not len(at):
                    continue
                by = np.argsort(own.owner[at], kind="stable")
                members, sizes = np.unique(own.owner[at], return_counts=True)
                for m in members.tolist():
                    if m not in points:
                        points[m] = _wide(unzipped(own.points[m].as_py()))
                out.append(
                    {
                        "bucket": bucket, "shard": part, "kind": "points", "tokens": own.tokens[at][by].tobytes(), "sizes": sizes.astype(np.uint32).tobytes(),
                        "classes": classes[members].tobytes(), "n": own.n[members].tobytes(), "points": zipped(_narrow(np.concatenate([points[m] for m in members.tolist()]))),
                    }
                )
            if hung and len(pairs := spanning(np.concatenate(hung), len(classes))):
                out.append({"bucket": bucket, "shard": bucket % parts, "kind": "hung", "classes": classes[pairs.ravel()].tobytes()})
        return lean(pa.Table.from_pylist(out, schema=_FIELDS))

    return run


def spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs that join the same members as ``pairs`` do, one less than members in each block."""
    root = np.arange(n)
    while len(pairs):
        ends = root[pairs]
        pairs = pairs[ends[:, 0] != ends[:, 1]]
        ends = np.sort(root[pairs], axis=1)
        if not len(ends):
            break
        np.minimum.at(root, ends[:, 1], ends[:, 0])
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(n))
    return np.stack([root[hung], hung], axis=1)


def _meet(table: pa.Table) -> pa.Table:
    """Blocks of candidates: classes that share a shingle here and pass the bound, joined.

    Only what joins a block leaves the part, not all its pairs.  Members of a crowd are
    hung on the least of them, and so into one block; there every pair is compared.
    """
    found = [np.empty((0, 2, 2), np.int64)]
    shard, of = table.column("shard")[0].as_py(), {}
    for batch in table.to_batches():
        for r in batch.to_pylist():
            of.setdefault(r["kind"], []).append(r)
    del table
    if rows := of.pop("points", None):
        classes = np.concatenate([_classes(r["classes"]) for r in rows])
        n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in rows])
        tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint32) for r in rows])
        flat = np.concatenate([_wide(unzipped(r["points"])) for r in rows])
        del rows
        first, number = numbered(classes)
        classes, points = classes[first], Points(flat, n, first)
        del flat
        for pairs in _candidates(points, np.repeat(number, sizes), tokens):
            found.append(classes[pairs])
    if rows := of.pop("crowd", None):
        tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint32) for r in rows])
        classes = np.concatenate([_classes(r["classes"]) for r in rows])
        order = np.argsort(tokens, kind="stable")
        tokens, classes = tokens[order], classes[order]
        cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        head = np.repeat(cuts, np.diff(np.append(cuts, len(tokens))))
        found.append(np.stack([classes[head], classes], axis=1))
    found += [_classes(r["classes"]).reshape(-1, 2, 2) for r in of.pop("hung", [])]
    return lean(pa.Table.from_pylist([{"shard": shard, **_joining(np.concatenate(found))}], schema=_BLOCKS))


def _candidates(points: Points, owner: np.ndarray, tokens: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs that join what shares a shingle and passes the bound."""
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
    tokens, owner = tokens[new], owner[new]
    cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(np.append(cuts, len(tokens)))
    # Groups of two, all at once; then larger ones, each distinct set of members once.
    two, total = cuts[counts == 2], len(points.n)
    pairs = np.unique(owner[two] * total + owner[two + 1])
    a, b = pairs // total, pairs % total
    ok = points.may_link(a, b)
    yield np.stack([a[ok], b[ok]], axis=1)
    seen, found = set(), [np.empty((0, 2), np.int64)]
    for at, size in zip(cuts[counts > 2].tolist(), counts[counts > 2].tolist()):
        own = owner[at : at + size]
        if (key := own.tobytes()) not in seen:
            seen.add(key)
            found += points.pairs(own)
    yield spanning(np.concatenate(found), total)


def _joining(pairs: np.ndarray) -> dict[str, bytes]:
    """What joins the classes that pairs (n, 2, 2) join, as bytes."""
    if not len(pairs):
        return {"a": b"", "b": b""}
    ends = pairs.reshape(-1, 2)
    first, number = numbered(ends)
    joined = spanning(number.reshape(-1, 2), len(first))
    classes = ends[first]
    return {"a": classes[joined[:, 0]].tobytes(), "b": classes[joined[:, 1]].tobytes()}


_BLOCKS = pa.schema([("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
EDGES = "a struct<a:bigint,b:bigint>, b struct<a:bigint,b:bigint>"


def _combine(table: pa.Table) -> pa.Table:
    """What joins the blocks of several parts."""
    a, b = (np.concatenate([_classes(x) for x in table.column(c).to_pylist()]) for c in ("a", "b"))
    made = _joining(np.stack([a, b], axis=1))
    return lean(pa.table({c: _class_column(_classes(made[c])) for c in ("a", "b")}))


def verify(sets: list[np.ndarray], copies: np.ndarray, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All links of a block: (pairs that join its sets as the links do, rows that each set links to).

    Overlaps are counted in postings of the sets' shingles, for every pair whose sizes
    allow a link.  ``copies``: rows of each set.  With ``sides`` (of two values), pairs of one side are
    someone else's.
    """
    n = np.array([len(s) for s in sets], np.int64)
    by = np.argsort(n, kind="stable")
    held, asking = (by, by) if sides is None else (by[sides[by] == sides.max()], by[sides[by] != sides.max()])
    root, joined, linked = np.arange(len(sets)), [], np.zeros(len(sets), np.int64)
    members: dict[int, list[int]] = {k: [k] for k in range(len(sets))}
    if not len(held) or not len(asking):
        return np.empty((0, 2), np.int64), linked

    def unite(k: int, j: int) -> None:
        a, b = int(root[k]), int(root[j])
        joined.append((j, k))
        if len(members[a]) < len(members[b]):
            a, b = b, a
        members[a] += members[b]
        root[members.pop(b)] = a

    # Postings: sets by size under each distinct shingle, as ascending numbers shingle * sets + place.
    words, post = np.unique(np.concatenate([sets[k] for k in held]), return_inverse=True)
    post = post.reshape(-1).astype(np.int64) * len(held)
    post += np.repeat(np.arange(len(held)), n[held])
    post.sort()
    sizes = n[held]
    for at, k in enumerate(asking.tolist()):
        low = int(np.searchsorted(sizes, -(-PERCENT * n[k] // 100)))
        high = at if sides is None else int(np.searchsorted(sizes, 100 * n[k] // PERCENT, side="right"))
        if low >= high:
            continue
        own = np.searchsorted(words, sets[k])
        own[own == len(words)] = 0
        own = own[words[own] == sets[k]] * len(held)
        begin, end = np.searchsorted(post, own + low), np.searchsorted(post, own + high)
        overlap = np.zeros(high - low, np.int64)
        reach = np.cumsum(end - begin)
        first = 0
        while first < len(own):
            done = reach[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(reach, done + POSTINGS, side="right")))
            length = end[first:last] - begin[first:last]
            shift = np.repeat(begin[first:last] - (np.cumsum(length) - length), length)
            found = post[np.arange(len(shift)) + shift] - np.repeat(own[first:last] + low, length)
            overlap += np.bincount(found, minlength=high - low)
            first = last
        near = held[low:high][overlap >= needed(sizes[low:high], n[k])]
        linked[k] += copies[near].sum()
        linked[near] += copies[k]
        near = near[root[near] != root[k]]
        while len(near):
            unite(k, int(near[0]))
            near = near[root[near] != root[k]]
    return np.array(joined, np.int64).reshape(-1, 2), linked


def _verify(table: pa.Table) -> pa.Table:
    """Exact comparison of the blocks that a bin holds: rows (a, b) join them, rows (a, links) count links."""
    blocks: dict[tuple, dict[tuple[int, int], tuple[np.ndarray, int, int]]] = {}
    at, fields = 0, ("ca", "cb", "ra", "rb", "low", "high", "side", "copies")
    columns = [table.column(c).to_pylist() for c in fields]
    for batch in table.select(["text"]).to_batches():
        for part in pieces(batch, "text", PIECE_BYTES):
            for s in shingle_sets(texts_of(part, "text")):
                ca, cb, ra, rb, low, high, side, copies = (c[at] for c in columns)
                blocks.setdefault((ra, rb, low, high), {})[ca, cb] = (s, side, copies)
                at += 1
    a, b, links_ = [], [], []  # chunks
    nothing = _class_column([(0, 0)]).type
    for (_, _, low, high), own in blocks.items():
        keys = sorted(own)
        classes = np.array(keys, np.int64).reshape(-1, 2)
        sets, sides, copies = zip(*(own[c] for c in keys))
        pairs, linked = verify(list(sets), np.array(copies, np.int64), None if low == high else np.array(sides))
        some = np.flatnonzero(linked)
        a += [_class_column(classes[pairs[:, 0]]), _class_column(classes[some])]
        b += [_class_column(classes[pairs[:, 1]]), pa.nulls(len(some), nothing)]
        links_ += [pa.nulls(len(pairs), pa.int64()), pa.array(linked[some])]
    return lean(pa.table({"a": pa.chunked_array(a, nothing), "b": pa.chunked_array(b, nothing), "links": pa.chunked_array(links_, pa.int64())}))


def text_key(text: Column) -> Column:
    """A text's key: with its id, what names a row (rows equal in both are the same row repeated)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def join(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, key, n_shingles, class, n_links, component_id and first.

    ``n_links`` counts the rows that a row links to (rows of one class link with each
    other; a row is not its own link).  ``component_id`` is the least id that links
    reach, and ``first`` the (unnamed, id, key) of the row that stands for the component:
    the least, rows without an id last; null where a set is empty.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), text_key(F.col(text)).alias("key"))
    surveyed = keep(survey(docs))
    rows = surveyed.where("part IS NULL").select("id", "key", "class", "n", "bytes")
    counts = spark.sparkContext.broadcast(sketch(surveyed))  # of a fixed size
    sums = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    buckets = max(1, -(-sums["size"] // BUCKET_BYTES))
    shards = max(1, -(-sums["total"] // (4 * SHARD_SHINGLES)))
    parts = max(min(shards, COMBINED), -(-shards // COMBINED))
    # One text stands for its class from here on.
    one = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first")
    reps = keep(rows.where("n > 0").groupBy("class").agg(one, F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    bucket = F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).cast("int")
    dealt = drafts(docs, counts).withColumn("bucket", bucket).repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    to_shard = lambda m: m.repartitionById(shards, F.col("shard")).groupBy("shard")
    announced = dealt.applyInArrow(_announce(shards), MESSAGE)
    answered = to_shard(announced).applyInArrow(_answer(CROWD), MESSAGE)
    sent = dealt.cogroup(answered.repartitionById(buckets, F.col("bucket")).groupBy("bucket")).applyInArrow(_send(shards, parts), MESSAGE)
    met = sent.repartitionById(parts, F.col("shard")).groupBy("shard").applyInArrow(_meet, "shard int, a binary, b binary")
    few = -(-parts // COMBINED)
    met = met.withColumn("part", F.pmod("shard", F.lit(few)).cast("int")).repartitionById(few, F.col("part")).groupBy("part")
    joined = keep(met.applyInArrow(_combine, EDGES).distinct())
    # What one task has combined hangs on the least classes already.
    blocks = nodes(joined, "b", "a") if few == 1 else components(joined)
    verified = _verified(docs, reps, blocks)
    linked = components(verified.where("b IS NOT NULL")).withColumnRenamed("node", "class")
    others = verified.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("others"))
    about = reps.join(linked, "class", "left").join(others, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = about.groupBy("root").agg(F.min("first").alias("least"))
    about = about.join(least, "root").select(
        "class", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least").alias("first")
    )
    out = rows.where("n > 0").join(about, "class").unionByName(rows.where("n = 0").withColumn("n_links", F.lit(0).cast("long")), allowMissingColumns=True)
    return out.select("id", "key", F.col("n").alias("n_shingles"), "class", "n_links", F.coalesce("first.id", "id").alias("component_id"), "first")


def _verified(docs: DataFrame, reps: DataFrame, blocks: DataFrame) -> DataFrame:
    """True links of the blocks, joined and counted; a large block is dealt into parts and its parts compared in pairs."""
    one = reps.join(blocks.withColumnRenamed("node", "class"), "class")
    sizes = one.groupBy("root").agg(F.sum("n").alias("total"))
    placed = (
        one.join(sizes, "root")
        .withColumn("parts", F.ceil(F.col("total") / PART_SHINGLES).cast("int"))
        .withColumn("side", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        .select("first", "class", "copies", "root", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select(
            F.col("first.id").alias("rep_id"), F.col("first.key").alias("rep_key"), F.col("class.a").alias("ca"), F.col("class.b").alias("cb"),
            F.col("root.a").alias("ra"), F.col("root.b").alias("rb"), "copies", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"),
        )
    )
    placed = keep(placed)
    amount = placed.count()
    bins = max(1, -(-amount // BIN_ROWS))
    # Few enough rows go to every executor, so that texts need not move to meet them; else only texts that may meet one move.
    side, own = (F.broadcast(placed), docs) if amount <= BROADCAST_ROWS else (placed, docs.where(among(placed, "rep_id", "rep_key")(F.col("id"), F.col("key"))))
    texts = own.join(side, docs["id"].eqNullSafe(placed["rep_id"]) & (docs["key"] == placed["rep_key"])).select(
        "text", "ca", "cb", "ra", "rb", "copies", "low", "high", "side", F.pmod(F.xxhash64("ra", "rb", "low", "high"), F.lit(bins)).cast("int").alias("bin")
    )
    found = texts.repartitionById(bins, F.col("bin")).groupBy("bin").applyInArrow(_verify, EDGES + ", links long")
    verified = keep(found.hint("rebalance"))  # few files, however many bins
    drop(placed)
    return verified
