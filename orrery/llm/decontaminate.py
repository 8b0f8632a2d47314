"""Benchmark decontamination with an FM-index over each training shard.

A shard is some documents' words, all of them, as numbers of the shard's own vocabulary,
with a separator between documents.  Its index holds the Burrows-Wheeler transform in a
wavelet matrix (bits packed 64 to a word; rank queries walk one level per bit and count
bits) and suffix positions sampled every ``SAMPLE`` words.  All windows of the benchmark
are searched backwards side by side: each step narrows every window's suffix interval
by two ranks, and windows whose interval is empty are let go.  Occurrences are located
by walking back to the nearest sampled position, and the covered words of each document
are merged into removal spans.

The benchmark is coded by the executors into blocks of words, as 64-bit hashes, each of a
bounded size and broadcast by itself; an index is built once and asked for every block.

Input rules: A-Z are lower-cased; words are maximal runs of digits, letters a-z and all
characters beyond ASCII; null texts have no words; an item of fewer than ``WINDOW``
words, but not none, is one window; items with equal windows all count, items with one
id are one item, and a null id is one too (null in ``hit_items``, before others);
repeated rows give repeated results; an empty benchmark hits nothing; an empty table
gives no rows; texts of any length are taken whole; further columns stay, but those
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.arrow import pieces, texts_of, trim
from orrery.llm.words import hashes
from orrery.session import drop, keep

WINDOW = 13
#: One in so many suffix positions is kept.
SAMPLE = 8
#: Bytes of text in a shard, bytes of a block of the benchmark's words, words of an item's piece.
SHARD_BYTES, BLOCK_BYTES, PIECE_WORDS = 4 << 20, 8 << 20, 1 << 16
#: Windows that are searched side by side.
TOGETHER = 1 << 18

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Byte table: lower-cases A-Z, keeps bytes of words, makes all others blanks.
FOLD = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD or 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    folded = [t.translate(FOLD) for t in texts]
    return hashes(b" ".join(folded)), np.fromiter((len(t.split()) for t in folded), np.int64, len(folded))


class Block:
    """Some of the benchmark's words, and its windows as (begin, length, item)."""

    def __init__(self, names: list[str | None], items: np.ndarray, lengths: np.ndarray, words: np.ndarray, window: int = WINDOW):
        self.names, self.words = names, words
        ends = np.cumsum(lengths)
        some = np.flatnonzero(lengths)
        each = np.maximum(lengths[some] - window + 1, 1)
        shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.begin = np.repeat((ends - lengths)[some], each) + shift
        self.length = np.repeat(np.minimum(lengths[some], window), each)
        self.item = np.repeat(items[some], each)


def block_of(rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> Block:
    """``rows``: an item's name and its words' hashes."""
    names = sorted({n for n, _ in rows}, key=lambda n: (n is not None, n or ""))
    place = {n: k for k, n in enumerate(names)}
    items = np.array([place[n] for n, _ in rows], np.int64)
    lengths = np.array([len(w) // 8 for _, w in rows], np.int64)
    return Block(names, items, lengths, np.frombuffer(b"".join(w for _, w in rows), np.uint64), window)


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, flags: np.ndarray):
        data = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(data)] = data
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.total = int(self.before[-1]) + int(np.bitwise_count(self.words[-1]))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, low = place >> 6, (place & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def __getitem__(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """FM-index of a sequence of word numbers; 0 separates texts."""

    def __init__(self, sequence: np.ndarray, size: int):
        n = len(sequence)
        self.n = n
        order = suffix_array(sequence)
        before = sequence[order - 1]  # what stands before each suffix; before the first, the closing separator
        self.bits = max(1, int(size).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=size + 1))])
        # Places behind a separator are kept too: a walk never has to cross one.
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = Bits(sampled)
        self.position = order[sampled].astype(np.int32 if n < 1 << 31 else np.int64)
        self._levels(before.astype(np.int32))

    def _levels(self, symbols: np.ndarray) -> None:
        """Wavelet matrix: per bit, from the highest, which symbols have it; zeros go before ones."""
        self.levels, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (symbols >> bit) & 1 == 1
            self.levels.append(Bits(one))
            self.zeros.append(len(symbols) - self.levels[-1].total)
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place in the transform."""
        begin, end = np.zeros_like(place), place
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            bits, zeros = self.levels[level], self.zeros[level]
            one = (symbol >> bit) & 1 == 1
            b, e = bits.rank(begin), bits.rank(end)
            begin = np.where(one, zeros + b, begin - b)
            end = np.where(one, zeros + e, end - e)
        return end - begin

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place of the transform, how often it stands before that place)."""
        symbol, begin, at = np.zeros_like(place), np.zeros_like(place), place
        for bits, zeros in zip(self.levels, self.zeros):
            one = bits[at]
            b, a = bits.rank(begin), bits.rank(at)
            symbol = symbol * 2 + one
            begin = np.where(one, zeros + b, begin - b)
            at = np.where(one, zeros + a, at - a)
        return symbol, at - begin

    def search(self, words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of ``words[begin : begin + length]``: (window, interval begin, interval end) of those found."""
        alive = np.arange(len(begin))
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.n, np.int64)
        found = [(alive[:0], low[:0], high[:0])]
        for step in range(1, int(length.max()) + 1 if len(length) else 1):
            symbol = words[begin[alive] + length[alive] - step]
            base = self.first[symbol]
            if step == 1:
                low, high = base, self.first[symbol + 1]
            else:
                low, high = base + self.rank(symbol, low), base + self.rank(symbol, high)
            live = low < high
            alive, low, high = alive[live], low[live], high[live]
            done = length[alive] == step
            found.append((alive[done], low[done], high[done]))
            alive, low, high = alive[~done], low[~done], high[~done]
            if not len(alive):
                break
        return tuple(np.concatenate(x) for x in zip(*found))

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes given by their order."""
        out, at = np.empty(len(places), np.int64), np.arange(len(places))
        steps = 0
        while len(places):
            hit = self.sampled[places]
            out[at[hit]] = self.position[self.sampled.rank(places[hit])] + steps
            at, places = at[~hit], places[~hit]
            symbol, before = self.access(places)
            places = self.first[symbol] + before
            steps += 1
        return out


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; a separator ends comparison (ties by place)."""
    n = len(sequence)
    top = int(sequence.max()) + 1 if n else 1
    # As many words as fit 62 bits to begin with; behind a separator everything counts as 0.
    width = max(1, min(4, 62 // max(1, top.bit_length())))
    key, stop = np.zeros(n, np.int64), np.zeros(n, bool)
    padded = np.concatenate([sequence, np.zeros(width, sequence.dtype)])
    for j in range(width):
        symbol = padded[j : j + n]
        stop = stop | (symbol == 0)
        key = key * top + np.where(stop, 0, symbol)
    order = np.argsort(key)
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    del key
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # How far the next separator is: who meets one within the compared words is parted by place.
    zeros = np.append(np.flatnonzero(sequence == 0), n)
    till = np.repeat(zeros, np.diff(zeros, prepend=-1))[:n] - np.arange(n)
    last = np.append(first[1:], True)
    shared = np.flatnonzero(~(first & last))
    while len(shared):
        # Places whose rank is shared are put in order by the rank ``width`` further on.
        own = order[shared]
        following = np.where(till[own] >= width, rank[np.minimum(own + width, n - 1)] + n, own)
        new = np.lexsort((following, rank[own])) if n > 1 << 30 else np.argsort(rank[own] * (2 * n) + following)
        own, following = own[new], following[new]
        order[shared] = own
        old = rank[own]
        head = np.ones(len(own), bool)
        head[1:] = (old[1:] != old[:-1]) | (following[1:] != following[:-1])
        # Ranks are the place of a group's first member in the order.
        rank[own] = np.maximum.accumulate(np.where(head, shared, 0))
        shared = shared[~(head & np.append(head[1:], True))]
        width *= 2
    return order


class Shard:
    """Some texts' words under an index."""

    def __init__(self, texts: list[bytes]):
        words, self.counts = coded(texts)
        self.ends = np.cumsum(self.counts)
        self.total = len(words)
        if not self.total:
            return
        self.vocabulary, number = np.unique(words, return_inverse=True)
        del words
        # A separator behind every text.
        text = np.repeat(np.arange(len(texts)), self.counts)
        sequence = np.zeros(self.total + len(texts), np.int64)
        sequence[np.arange(self.total) + text] = number.reshape(-1) + 1
        self.begin = np.cumsum(self.counts + 1) - self.counts - 1  # of each text, in the sequence
        self.index = FMIndex(sequence, len(self.vocabulary))

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the block's windows: (first word, its text, words, item)."""
        none = np.empty(0, np.int64)
        if not self.total or not len(block.begin):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, block.words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == block.words
        words, unknown = np.where(known, at + 1, 0), np.concatenate([[0], np.cumsum(~known)])
        may = np.flatnonzero(unknown[block.begin + block.length] == unknown[block.begin])
        out = [(none, none, none, none)]
        for a in range(0, len(may), TOGETHER):
            some = may[a : a + TOGETHER]
            which, low, high = self.index.search(words, block.begin[some], block.length[some])
            if not len(which):
                continue
            sizes = high - low
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = self.index.locate(np.repeat(low, sizes) + inside)
            text = np.searchsorted(self.begin, place, side="right") - 1
            window = some[np.repeat(which, sizes)]
            out.append((place - text, text, block.length[window], block.item[window]))
        return tuple(np.concatenate(x) for x in zip(*out))


def scan_shard(texts: list[bytes], blocks: Iterable[Block]) -> tuple[np.ndarray, np.ndarray, list[set[str | None]]]:
    """(words of each text, covered, items that hit each text): ``covered`` flags all words, text by text."""
    shard = Shard(texts)
    edge = np.zeros(shard.total + 1, np.int64)
    items: list[set[str | None]] = [set() for _ in texts]
    for block in blocks:
        start, text, length, item = shard.find(block)
        if len(start):
            edge += np.bincount(start, minlength=len(edge)) - np.bincount(start + length, minlength=len(edge))
            for k in np.unique(text * len(block.names) + item).tolist():
                items[k // len(block.names)].add(block.names[k % len(block.names)])
    return shard.counts, np.cumsum(edge[:-1]) > 0, items


def runs(flags: np.ndarray) -> np.ndarray:
    """Maximal runs of true values, as rows (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return edges.reshape(-1, 2)


ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


def _coded_items(items: DataFrame, window: int) -> DataFrame:
    """(item, piece, words): the items' word hashes in pieces that hold all their windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                names, at, found = [], [], []
                words, counts = coded(texts_of(part, "text"))
                ends = np.cumsum(counts).tolist()
                for name, end, n in zip(part.column("item").to_pylist(), ends, counts.tolist()):
                    for k, a in enumerate(range(0, max(n - window + 1, min(n, 1)), PIECE_WORDS)):
                        names.append(name)
                        at.append(k)
                        found.append(words[end - n + a : min(end, end - n + a + PIECE_WORDS + window - 1)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int32()), pa.array(found, pa.binary())], ["item", "piece", "words"])

    return items.mapInArrow(run, "item string, piece int, words binary").distinct()


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with n_words, hit_words (merged spans, in words) and hit_items (sorted ids as text).

    One pass over the documents.  The benchmark's size is measured first; its blocks of
    about ``BLOCK_BYTES`` pass through the driver one at a time.
    """
    spark = df.sparkSession
    items = keep(_coded_items(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")), window))
    size = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // BLOCK_BYTES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "piece", "words"), F.lit(max(1, blocks))))
    held = []  # broadcasts of a bounded size each; the driver's process keeps none of them
    for k in range(blocks):
        rows = [(r["item"], bytes(r["words"])) for r in dealt.where(F.col("block") == k).toLocalIterator()]
        held.append(spark.sparkContext.broadcast(rows))
    drop(items)
    left = [c for c in df.columns if c.lower() not in ADDED.names]
    schema = T.StructType([*[df.schema[c] for c in left], *ADDED])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=1)  # one block serves all shards of a task; several take turns
        def block(k: int) -> Block:
            made = block_of(held[k].value, window)
            held[k].__dict__.pop("_value", None)  # else the worker would keep every block it has read
            return made

        for batch in batches:
            for part in pieces(batch, text, SHARD_BYTES):
                counts, covered, hits = scan_shard(texts_of(part, text), map(block, range(len(held))))
                spans, ends = [], np.cumsum(counts)
                for a, b, hit in zip((ends - counts).tolist(), ends.tolist(), hits):
                    spans.append([{"start": s, "end": e} for s, e in runs(covered[a:b]).tolist()] if hit else [])
                made = [
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(h, key=lambda n: (n is not None, n or "")) for h in hits], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in left], *made], [*left, *ADDED.names])
        trim()

    return df.select(*left).mapInArrow(run, schema)


def n_hit(spans: str = "hit_words"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def contaminated(hit, words):
    """The contract's rule: some word is hit, and a twentieth of all words or more."""
    return (hit > 0) & (20 * hit >= words)
