"""Exact removal of repeated byte strings, by threshold-bounded interval expansion.

A byte goes if it is covered by a ``LEAST``-byte string (a window) that also starts
earlier, in a smaller document or before in the same one.  All windows are judged on
the input.  Which windows are equal is decided on a Burrows-Wheeler transform: intervals
of suffixes are extended backwards, breadth first, so that common prefixes appear in
increasing length; expansion stops at ``LEAST``.  Neighbouring suffixes that no interval
has parted by then share ``LEAST`` bytes or more (Beller, Gog, Ohlebusch and Schnattinger
2013, stopped early).

No machine sees the whole text.  Every window has an anchor, the ``ANCHOR``-byte string
in it with the least hash (leftmost on ties); equal windows have equal anchors at equal
places.  Neighbouring windows with one anchor make a segment.

1. Documents are dealt into buckets by id and text.  A bucket makes its segments, keeps
   one of each content, and sends hashes and a place for each to a shard by anchor.
2. A shard drops anchors that occur once.  Of segments with equal content (95 bits of two
   hashes, one of them modulo a prime), all but the first are covered whole.  Where one
   anchor has several contents, it asks the buckets of the first of each for the text.
3. Buckets send those texts, again by anchor; the transform finds equal windows among
   them, and all but the earliest of each class are covered.  An anchor with more than
   ``HOT`` contents (the edges of a passage with that many contexts) would bring too much
   text to one shard: its windows are dealt by their own 128-bit hashes over all shards.
4. Buckets merge what is covered into spans.

Equal contents thus travel as hashes, once per bucket; a passage in a third of all rows
costs a shard one row per bucket, and 25 bytes for each different context at its edges.
Buckets are shuffled once and read three times.  ``HOT`` and the sizes of buckets and
shards change the work's order, not the result.

Input rules: null and empty texts have nothing to remove; rows with equal ids (or none)
are ordered by a hash of id and text; equal rows follow each other, and the first stays;
a null id comes before all others; an empty table gives no rows; other columns are
ignored, whatever their names; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.arrow import lean

LEAST, ANCHOR = 100, 40
#: Bytes of text in a bucket, and segments that a shard gets on average.
BUCKET_BYTES, SHARD_SEGMENTS = 6 << 20, 400_000
#: Contents of one anchor, above which windows are dealt by themselves.
HOT = 2_048
#: Windows whose hashes are made at once.
STEP = 1 << 17
_PLACE = np.uint64((1 << 18) - 1)  # low bits that hold a place within a step

_random = np.random.default_rng(20)
_BYTE_A, _BYTE_B = (_random.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2))
_MUL = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(_BASE, STEP + 2 * LEAST), _powers(pow(_BASE, -1, 1 << 64), STEP + 2 * LEAST)
# A second hash, modulo a prime: powers of two alone have weak strings.
_PRIME = (1 << 31) - 1
_PRIME_BASE = 1_664_525_119 % _PRIME
_BYTE_P = _random.integers(1, _PRIME, 256, dtype=np.uint64)


def _prime_powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for k in range(n):
        out[k] = x
        x = x * base % _PRIME
    return out


_POWER_P, _BACK_P = _prime_powers(_PRIME_BASE, STEP + 2 * LEAST), _prime_powers(pow(_PRIME_BASE, -1, _PRIME), STEP + 2 * LEAST)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on, by doubling."""
    width, h = 1, _BYTE_A[data]
    total, at = None, 0
    need = ANCHOR
    while need:
        if need & 1:
            own = h[at:]
            if total is None:
                total = own
            else:
                n = min(len(total), len(own))
                total = total[:n] * np.uint64(pow(_MUL, width, 1 << 64)) + own[:n]
            at += width
        need >>= 1
        if need:
            h = h[:-width] * np.uint64(pow(_MUL, width, 1 << 64)) + h[width:]
            width *= 2
    return mix(total)


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, content hash, another one, first window's place, number of windows) of all segments.

    ``data``: texts laid end to end; ``ends``: where each ends.  In order of place.
    """
    found = []
    span = LEAST - ANCHOR + 1
    for a in range(0, len(data) - LEAST + 1, STEP):
        part = data[a : a + STEP + LEAST - 1]
        n = len(part) - LEAST + 1
        h = _anchor_hashes(part)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width : span - width + n])
        at = (low & _PLACE).astype(np.int64)
        # A window must lie within one text.
        first = np.searchsorted(ends, a, side="right")
        last = np.searchsorted(ends, a + n, side="left")
        inside = np.ones(n, bool)
        for e in ends[first : last + 1].tolist():
            inside[max(0, e - LEAST + 1 - a) : max(0, e - a)] = False
        starts = inside.copy()
        starts[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        begin = np.flatnonzero(starts)
        if not len(begin):
            continue
        stops = inside.copy()
        stops[:-1] &= starts[1:] | ~inside[1:]
        count = np.flatnonzero(stops) - begin + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_B[part] * _POWER[: len(part)], out=total[1:])
        content = (total[begin + count + LEAST - 1] - total[begin]) * _BACK[begin]
        anchor = at[begin]
        content = mix(content + (count * 1_000_003 + (anchor - begin)).astype(np.uint64) * np.uint64(_MUL))
        np.cumsum(_BYTE_P[part] * _POWER_P[: len(part)] % _PRIME, out=total[1:])
        other = (total[begin + count + LEAST - 1] - total[begin]) % _PRIME * _BACK_P[begin] % _PRIME
        found.append((h[anchor], content, other.astype(np.uint32), begin + a, count))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint32, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def pack(values: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each; ``unpack`` reverses it."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in ("u1", "u2", "u4", "u8") if top < 1 << (8 * int(k[1])))
    return kind[1].encode() + values.astype("<" + kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1)


def pack_rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.int64))


#: What goes from place to place: numbers packed as bytes, rows few.
MESSAGE = "bucket int, shard int, kind string, a binary, b binary, at binary, n binary, doc binary, text binary"
_FIELDS = pa.schema(
    [("bucket", pa.int32()), ("shard", pa.int32()), ("kind", pa.string())] + [(c, pa.binary()) for c in ("a", "b", "at", "n", "doc", "text")]
)


def _message(bucket: int, shard: int, kind: str, at=b"", n=b"", a=b"", b=b"", doc=b"", text=b"") -> dict:
    return {"bucket": bucket, "shard": shard, "kind": kind, "a": a, "b": b, "at": at, "n": n, "doc": doc, "text": text}


def _covered(bucket: int, shard: int, at: np.ndarray, n: np.ndarray) -> dict:
    """The windows ``at .. at + n`` of a bucket are repeats."""
    order = np.argsort(at, kind="stable")
    return _message(bucket, shard, "covered", pack_rising(at[order]), pack(n[order]))


def _laid_out(table: pa.Table) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows in order: (source row, text), ids, their bytes end to end, starts and ends."""
    ids, texts = table.column("id").to_pylist(), [t or b"" for t in table.column("text").to_pylist()]
    places = table.column("place").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, places[k], texts[k]))
    texts = [texts[k] for k in order]
    doc = np.array([-(1 << 63) if ids[k] is None else ids[k] for k in order], np.int64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return order, texts, doc, np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(shard[own[0]]), own


def _announce(shards: int):
    """Step 1: a bucket's segments, as hashes, to shards by anchor."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        _, _, doc, data, _, ends = _laid_out(table)
        h, c, e, at, n = segments(data, ends)
        out = []
        if len(h):
            order = np.lexsort((at, e, c, h))
            again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1]) & (e[order][1:] == e[order][:-1])])
            repeats = order[again]
            if len(repeats):
                out.append(_covered(bucket, bucket % shards, at[repeats], n[repeats]))
            first = np.sort(order[~again])
            h, c, e, at, n = h[first], c[first], e[first], at[first], n[first]
            owner = doc[np.searchsorted(ends, at, side="right")]
            for shard, own in _by_shard((h % np.uint64(shards)).astype(np.int64)):
                ids = owner[own]
                low = int(ids[0])
                rising = np.concatenate([[0], np.diff(ids)]).astype(np.uint64)
                out.append(
                    _message(bucket, shard, "segments", pack_rising(at[own]), pack(n[own]), h[own].tobytes(), c[own].tobytes(), low.to_bytes(8, "little", signed=True) + pack(rising), e[own].tobytes())
                )
        return lean(pa.Table.from_pylist(out, schema=_FIELDS))

    return run


def _ids(data: bytes) -> np.ndarray:
    low = int.from_bytes(data[:8], "little", signed=True)
    return (np.cumsum(unpack(data[8:]).astype(np.uint64)) + np.uint64(low & _MASK64)).astype(np.int64)


def _compare(hot: int):
    """Step 2: a shard finds repeated contents, and asks for texts where contents differ."""
    return lambda table: lean(_compared(table, hot))


def _compared(table: pa.Table, hot: int) -> pa.Table:
    rows = table.to_pylist()
    out = [r for r in rows if r["kind"] == "covered"]
    rows = [r for r in rows if r["kind"] == "segments"]
    if rows:
        shard = rows[0]["shard"]
        h = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        own = order[shared]
        del order
        if len(own):
            c = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in rows])[own]
            e = np.concatenate([np.frombuffer(r["text"], np.uint32) for r in rows])[own]
            at = np.concatenate([unpack_rising(r["at"]) for r in rows])[own]
            n = np.concatenate([unpack(r["n"]) for r in rows])[own].astype(np.int64)
            doc = np.concatenate([_ids(r["doc"]) for r in rows])[own]
            sizes = [len(r["a"]) // 8 for r in rows]
            bucket = np.repeat([r["bucket"] for r in rows], sizes)[own]
            h = h[own]
            order = np.lexsort((at, bucket, doc, e, c, h))
            h, c, e, at, n, doc, bucket = (x[order] for x in (h, c, e, at, n, doc, bucket))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (e[1:] != e[:-1])])
            for b, k in _by_shard(bucket[~new]):
                out.append(_covered(b, shard, at[~new][k], n[~new][k]))
            # First of each content, where its anchor has more than one.
            first = np.flatnonzero(new)
            head = np.flatnonzero(np.concatenate([[True], h[first][1:] != h[first][:-1]]))
            contents = np.diff(np.append(head, len(first)))
            contents = np.repeat(contents, contents)
            for kind, several in (("wanted", first[(contents > 1) & (contents <= hot)]), ("hot", first[contents > max(hot, 1)])):
                for b, k in _by_shard(bucket[several]):
                    k = several[k]
                    k = k[np.argsort(at[k], kind="stable")]
                    out.append(_message(b, shard, kind, pack_rising(at[k]), pack(n[k])))
    return pa.Table.from_pylist(out, schema=_FIELDS)


def _send(shards: int):
    """Step 3, first half: a bucket sends the texts that shards have asked for."""
    return lambda left, right: lean(_sent(left, right, shards))


def _sent(left: pa.Table, right: pa.Table, shards: int) -> pa.Table:
    rows = right.to_pylist()
    out = [r for r in rows if r["kind"] == "covered"]
    wanted, hot = ([r for r in rows if r["kind"] == kind] for kind in ("wanted", "hot"))
    if wanted or hot:
        _, _, doc, data, starts, ends = _laid_out(left)
        for r in hot:
            at, n = unpack_rising(r["at"]), unpack(r["n"]).astype(np.int64)
            windows = np.unique(np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            named = [hashlib.blake2b(data[a : a + LEAST], digest_size=16).digest() for a in windows.tolist()]
            names = np.frombuffer(b"".join(named), np.uint64).reshape(-1, 2)
            owner = doc[np.searchsorted(ends, windows, side="right")]
            for shard, own in _by_shard((names[:, 0] % np.uint64(shards)).astype(np.int64)):
                out.append(_message(r["bucket"], shard, "windows", pack_rising(windows[own]), a=names[own].tobytes(), doc=owner[own].tobytes()))
        for r in wanted:
            at, n = unpack_rising(r["at"]), unpack(r["n"]).astype(np.int64)
            owner = np.searchsorted(ends, at, side="right")
            text = b"".join(data[a : a + k + LEAST - 1].tobytes() for a, k in zip(at.tolist(), n.tolist()))
            out.append(_message(r["bucket"], r["shard"], "texts", pack_rising(at), pack(n), doc=doc[owner].tobytes(), text=text))
    return pa.Table.from_pylist(out, schema=_FIELDS)


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Suffixes of byte values + 1 in order, by prefix doubling; a 0 ends comparison (ties by place)."""
    n = len(sequence)
    # Eight symbols at a time to begin with; behind a separator everything counts as 0.
    key, stop = np.zeros(n, np.uint64), np.zeros(n, bool)
    padded = np.concatenate([sequence, np.zeros(8, sequence.dtype)])
    for j in range(7):
        symbol = padded[j : j + n]
        stop |= symbol == 0
        key = key * np.uint64(257) + np.where(stop, 0, symbol).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # Whoever meets a separator within the seven is ordered by place already.
    till = next_zero(sequence)
    width = 7
    while True:
        counts = np.bincount(rank, minlength=n)
        shared = np.flatnonzero(counts[rank[order]] > 1)
        if not len(shared):
            return order
        own = order[shared]
        following = np.where(till[own] >= width, rank[np.minimum(own + width, n - 1)] + n, own)
        new = np.argsort(rank[own] * (2 * n) + following)
        own, following = own[new], following[new]
        order[shared] = own
        old = rank[own]
        first = np.concatenate([[True], (old[1:] != old[:-1]) | (following[1:] != following[:-1])])
        rank[own] = np.maximum.accumulate(np.where(first, shared, 0))
        width *= 2


def next_zero(sequence: np.ndarray) -> np.ndarray:
    """How far the next 0 is from each place (0 at one)."""
    n = len(sequence)
    zeros = np.flatnonzero(sequence == 0)
    at = np.searchsorted(zeros, np.arange(n), side="left")
    return np.append(zeros, n)[at] - np.arange(n)


def equal_windows(sequence: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, joined): ``joined[k]`` says that suffixes k - 1 and k share ``least`` symbols.

    ``sequence``: byte values + 1, with a 0 behind every text, which equals nothing.
    Intervals are extended backwards level by level.  At level l, an interval of a string
    of l symbols gives one child for each symbol that stands before it; a child whose
    right border was not yet known parts neighbours that share exactly l symbols.
    """
    n = len(sequence)
    order = suffix_array(sequence)
    before = sequence[order - 1].astype(np.int64)
    before[order == 0] = 0
    # Row of the suffix one symbol longer; rows of one symbol keep their order.
    rows = np.argsort(before, kind="stable")
    longer = np.empty(n, np.int64)
    longer[rows] = np.arange(n)
    symbols = before[rows]
    following, preceding = np.full(n, n), np.full(n, -1)
    alike = symbols[1:] == symbols[:-1]
    following[rows[:-1][alike]] = rows[1:][alike]
    preceding[rows[1:][alike]] = rows[:-1][alike]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    ends = np.arange((sequence == 0).sum())
    low, high = np.array([0]), np.array([n])
    for level in range(least):
        width = high - low
        if not len(width):
            break
        inside = np.arange(width.sum()) + np.repeat(low - (np.cumsum(width) - width), width)
        lows, highs = np.repeat(low, width), np.repeat(high, width)
        word = before[inside] != 0
        inside, lows, highs = inside[word], lows[word], highs[word]
        new_low = np.sort(longer[inside[preceding[inside] < lows]])
        new_high = np.sort(longer[inside[following[inside] >= highs]]) + 1
        if not level:  # every separator is a symbol of its own, and the first in order
            new_low, new_high = np.concatenate([ends, new_low]), np.concatenate([ends + 1, new_high])
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
    return order, ~known[:n]


def _expand(table: pa.Table) -> pa.Table:
    """Step 3, second half: equal windows among a shard's texts; all but the earliest are covered."""
    rows = table.to_pylist()
    out = [r for r in rows if r["kind"] == "covered"]
    if windows := [r for r in rows if r["kind"] == "windows"]:
        names = np.concatenate([np.frombuffer(r["a"], np.uint64).reshape(-1, 2) for r in windows])
        at = np.concatenate([unpack_rising(r["at"]) for r in windows])
        doc = np.concatenate([np.frombuffer(r["doc"], np.int64) for r in windows])
        bucket = np.repeat([r["bucket"] for r in windows], [len(r["doc"]) // 8 for r in windows])
        order = np.lexsort((at, bucket, doc, names[:, 1], names[:, 0]))
        names, at, bucket = names[order], at[order], bucket[order]
        later = np.concatenate([[False], (names[1:] == names[:-1]).all(axis=1)])
        for b, k in _by_shard(bucket[later]):
            out.append(_covered_windows(b, windows[0]["shard"], at[later][k]))
    rows = [r for r in rows if r["kind"] == "texts"]
    if rows:
        shard = rows[0]["shard"]
        at = np.concatenate([unpack_rising(r["at"]) for r in rows])
        n = np.concatenate([unpack(r["n"]) for r in rows]).astype(np.int64)
        doc = np.concatenate([np.frombuffer(r["doc"], np.int64) for r in rows])
        bucket = np.repeat([r["bucket"] for r in rows], [len(r["doc"]) // 8 for r in rows])
        sizes = n + LEAST - 1
        begin = np.cumsum(sizes + 1) - sizes - 1
        sequence = np.zeros(int((sizes + 1).sum()), np.uint16)
        to = np.arange(sizes.sum()) + np.repeat(np.arange(len(n)), sizes)
        sequence[to] = np.frombuffer(b"".join(r["text"] for r in rows), np.uint8).astype(np.uint16) + 1
        order, joined = equal_windows(sequence, LEAST)
        group = np.cumsum(~joined)
        member = joined | np.append(joined[1:], False)
        place, group = order[member], group[member]
        if len(place):
            owner = np.searchsorted(begin, place, side="right") - 1
            start = at[owner] + place - begin[owner]
            sort = np.lexsort((start, bucket[owner], doc[owner], group))
            group, owner, start = group[sort], owner[sort], start[sort]
            later = np.concatenate([[False], group[1:] == group[:-1]])
            for b, k in _by_shard(bucket[owner[later]]):
                out.append(_covered_windows(b, shard, start[later][k]))
    return lean(pa.Table.from_pylist(out, schema=_FIELDS))


def _covered_windows(bucket: int, shard: int, at: np.ndarray) -> dict:
    """Single windows of a bucket, as runs."""
    at = np.unique(at)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    return _covered(bucket, shard, at[heads], np.diff(np.append(heads, len(at))))


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_RESULT = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """Step 4: a bucket's spans, and digests of what stays."""
    order, texts, _, data, starts, ends = _laid_out(left)
    edge = np.zeros(len(data) + 1, np.int32)
    for r in right.to_pylist():
        if r["kind"] == "covered":
            at, n = unpack_rising(r["at"]), unpack(r["n"]).astype(np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n + LEAST - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    ids = left.column("id").to_pylist()
    out = []
    hit = np.concatenate([[0], np.cumsum(gone)])
    removed = hit[ends] - hit[starts]
    for k, (text, a, b, m) in enumerate(zip(texts, starts.tolist(), ends.tolist(), removed.tolist())):
        spans, kept = [], text
        if m:
            own = gone[a:b]
            spans = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).reshape(-1, 2).tolist()
            kept = data[a:b][~own].tobytes()
        out.append((ids[order[k]], len(text), m, len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
    columns = list(zip(*out)) if out else [[]] * 6
    return lean(pa.table([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT))


def repeated(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans (bytes)."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-size // BUCKET_BYTES))
    shards = max(1, -(-2 * size // (LEAST - ANCHOR + 2) // SHARD_SEGMENTS))
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # Buckets are ranges of a hash, so that rows of one id have the same order whatever their number.
    docs = docs.withColumn("place", F.shiftrightunsigned(F.xxhash64("id", "text"), 33))
    docs = docs.withColumn("bucket", F.shiftright(F.col("place") * buckets, 31).cast("int")).repartitionById(buckets, F.col("bucket"))
    to_shard = lambda m: m.repartitionById(shards, F.col("shard")).groupBy("shard")
    to_bucket = lambda m: m.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    announced = docs.groupBy("bucket").applyInArrow(_announce(shards), MESSAGE)
    compared = to_shard(announced).applyInArrow(_compare(HOT), MESSAGE)
    sent = docs.groupBy("bucket").cogroup(to_bucket(compared)).applyInArrow(_send(shards), MESSAGE)
    expanded = to_shard(sent).applyInArrow(_expand, MESSAGE)
    return docs.groupBy("bucket").cogroup(to_bucket(expanded)).applyInArrow(_finish, RESULT)
