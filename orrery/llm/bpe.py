"""Byte-level BPE encoding and decoding over a contiguous rank array.

A pre-token of n bytes starts as n parts.  Two parallel lists hold the parts'
token ids and the rank of joining each part to its right neighbour.  The lowest
rank (leftmost on ties) is found by scanning, that boundary is deleted, and only
the two ranks beside it are looked up again.  Pre-tokens longer than
``SCAN_LIMIT`` bytes use the same rule with a heap in place of the scan, since
scanning would be quadratic there.  Results of ordinary words are remembered in a
bounded table, so each distinct word is merged about once in a Python worker; the
new words of a batch are merged side by side, their rank arrays laid end to end in
one vector that is scanned for every word's minimum at once.

Input rules: null and empty texts encode to no tokens; texts of any length are
encoded whole; equal rows give equal results; an empty table gives no rows; other columns
are left alone, but those named like a result are replaced.  The
vocabulary's special tokens inside a text become their own ids, as the
``tokenizers`` library does with its default settings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm.arrow import pieces, trim

#: Longest pre-token, in bytes, that is merged by scanning the rank array.
SCAN_LIMIT = 256
#: Words remembered in a worker, and the longest that is remembered (characters).
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48
#: From so many new words on, they are merged side by side; so many at most at once.
TOGETHER, TOGETHER_MOST = 48, 25_000
#: Texts above so many characters are walked match by match instead of at once.
WALK_ABOVE = 1 << 20
#: Fixed value: the byte-level pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_RANK = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies spell their tokens."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in shown}
    names.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in names)})
    return names


@lru_cache(maxsize=1)
def char_kinds() -> np.ndarray:
    """Kind of every code point, as PATTERN sees it: 0 other, 1 letter, 2 number, 3 white space."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(name, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            kinds[a : b + 1] = kind
    return kinds


def pre_tokens(texts: list[str]) -> tuple[list[str], list[int]]:
    """What PATTERN finds in the texts, one after another, and where each text's words end.

    The pattern's branches become rules on neighbouring characters, so that numpy
    finds all starts at once: a word starts where the kind changes, the last white
    space before a word stands alone or, if a blank, joins the word, and a
    contraction cuts the letters behind its apostrophe.
    """
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    if not len(codes):
        return [], [0] * len(texts)
    kinds = char_kinds()[codes]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    between = ends[:-1]
    kinds[between] = 9
    start = np.empty(len(codes) + 1, bool)
    start[0] = start[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:-1])
    start[between + 1] = True
    after = np.flatnonzero(start[1:-1] & (kinds[:-1] == 3) & (kinds[1:] != 9)) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    quote = np.flatnonzero((codes == 39) & start[:-1])
    if len(quote):
        padded = np.append(codes, [0, 0]).astype(np.uint32)
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cut = quote[one | two]
        start[cut + 1] = False
        start[np.concatenate([quote[one] + 2, quote[two] + 3])] = True
    at = np.flatnonzero(start)
    begins, stops = at[:-1], at[1:]
    word = kinds[begins] != 9
    begins, stops = begins[word], stops[word]
    words = [joined[i:j] for i, j in zip(begins.tolist(), stops.tolist())]
    return words, np.searchsorted(begins, ends, side="left").tolist()


class _Words(dict):
    """Word to packed ids; computes what is missing and forgets all when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word.encode("utf-8"))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.byte_ids = [vocab[symbols[b]] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.join = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self._hash([((a << 32) | b, *v) for (a, b), v in self.join.items()])
        self.first = np.array(self.byte_ids, np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pattern = regex.compile(PATTERN)
        self.splitter = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.spelled: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.spelled[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        self.words = _Words(self.merge)

    def merge(self, word: bytes) -> bytes:
        """Packed ids of one pre-token."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > SCAN_LIMIT:
            ids = self._merge_long(ids)
        elif len(ids) > 1:
            join, none = self.join, (NO_RANK, -1)
            ranks = [join.get(p, none)[0] for p in zip(ids, ids[1:])]
            while ranks:
                low = min(ranks)
                if low == NO_RANK:
                    break
                k = ranks.index(low)
                ids[k] = join[ids[k], ids[k + 1]][1]
                del ids[k + 1], ranks[k]
                if k < len(ranks):
                    ranks[k] = join.get((ids[k], ids[k + 1]), none)[0]
                if k:
                    ranks[k - 1] = join.get((ids[k - 1], ids[k]), none)[0]
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of many new words, merged side by side."""
        for at in range(0, len(words), TOGETHER_MOST):
            some = words[at : at + TOGETHER_MOST]
            self.words.update(zip(some, self._merge_together([w.encode("utf-8") for w in some])))

    def _merge_together(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), sizes)
        ranks, _ = self._ranks(ids[:-1], ids[1:])
        ranks[of[:-1] != of[1:]] = NO_RANK
        ranks = np.append(ranks, NO_RANK)
        done_ids, done_of = [], []
        while len(ids):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            low = np.minimum.reduceat(ranks, starts)
            own = np.repeat(low, np.diff(starts, append=len(ids)))
            live = own < NO_RANK
            done_ids.append(ids[~live])
            done_of.append(of[~live])
            ids, of, ranks, own = ids[live], of[live], ranks[live], own[live]
            if not len(ids):
                break
            at = np.flatnonzero(ranks == own)
            at = at[np.diff(of[at], prepend=-1) != 0]  # the leftmost of each word
            ids[at] = self._ranks(ids[at], ids[at + 1])[1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            ids, of, ranks = ids[stay], of[stay], ranks[stay]
            ranks[at] = NO_RANK
            right = at[at < len(ids) - 1]
            right = right[of[right] == of[right + 1]]
            left = at[at > 0] - 1
            left = left[of[left] == of[left + 1]]
            touched = np.concatenate([left, right])
            ranks[touched] = self._ranks(ids[touched], ids[touched + 1])[0]
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        ids = ids[np.argsort(of, kind="stable")].astype("<u4")
        ends = np.cumsum(np.bincount(of, minlength=len(words))) * 4
        packed, begin, out = ids.tobytes(), 0, []
        for end in ends.tolist():
            out.append(packed[begin:end])
            begin = end
        return out

    def _hash(self, pairs: list[tuple[int, int, int]]) -> None:
        """(pair, rank, joined id) in an open-addressed table, four slots or more for each."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.key_ranks, self.key_ids = np.full(1 << bits, NO_RANK, np.int64), np.full(1 << bits, -1, np.int64)
        left = np.array(pairs, np.int64).reshape(-1, 3)
        slots = self._slots(left[:, 0])
        while len(left):
            # Of the pairs that want a free slot, one gets it; the others go on to the next slot.
            free = self.keys[slots] == -1
            self.keys[slots[free]] = left[free, 0]
            own = self.keys[slots] == left[:, 0]
            self.key_ranks[slots[own]], self.key_ids[slots[own]] = left[own, 1], left[own, 2]
            left, slots = left[~own], (slots[~own] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined id of each pair; NO_RANK where none is listed."""
        keys = (left << 32) | right
        slots = self._slots(keys)
        there = self.keys[slots]
        other = np.flatnonzero((there != keys) & (there != -1))
        while len(other):
            slots[other] = (slots[other] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[other]]
            own = keys[other]
            other = other[(there != own) & (there != -1)]
        # A search ends at its pair or at a free slot, which holds no rank.
        return self.key_ranks[slots], self.key_ids[slots]

    def _merge_long(self, ids: list[int]) -> list[int]:
        join, n = self.join, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(join[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in join]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue
            ids[k], ids[right] = join[a, b][1], -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left, other in ((before[k], k), (k, after[k])):
                if left >= 0 and other < n and (p := (ids[left], ids[other])) in join:
                    heapq.heappush(heap, (join[p][0], left, *p))
        return [i for i in ids if i >= 0]

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """Packed ids of ``text``, in parts of bounded size."""
        for piece in self.splitter.split(text) if self.splitter else [text]:
            if piece in self.special:
                yield np.array([self.special[piece]], dtype="<u4").tobytes()
            elif len(piece) <= WALK_ABOVE:
                yield self._joined(self.pattern.findall(piece))
            else:
                found = (m.group() for m in self.pattern.finditer(piece))
                while some := list(islice(found, 100_000)):
                    yield self._joined(some)

    def _joined(self, words: list[str]) -> bytes:
        known = self.words
        self._learn_new(set(words))
        return b"".join(map(known.__getitem__, words))

    def encode_each(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; ordinary texts are split and looked up together."""
        plain = [t if t and len(t) <= WALK_ABOVE and not (self.splitter and self.splitter.search(t)) else "" for t in texts]
        words, ends = pre_tokens(plain)
        self._learn_new(set(words))
        begin = 0
        for text, own, end in zip(texts, plain, ends):
            yield b"".join(map(self.words.__getitem__, words[begin:end])) if own or not text else self.encode(text)
            begin = end

    def _learn_new(self, words: set[str]) -> None:
        """Learns what is new; when the table is full, it starts again with these words."""
        known = self.words
        new = [w for w in words if w not in known and len(w) <= LONGEST_REMEMBERED]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = [w for w in words if len(w) <= LONGEST_REMEMBERED]
        if len(new) >= TOGETHER:
            self.learn(new)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_parts(text or ""))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _mapped(df: DataFrame, column: str, added: list[T.StructField], make, kind: pa.DataType) -> DataFrame:
    """``df`` with columns made from ``column`` by ``make(list) -> list of arrays``."""
    names = [f.name for f in added]
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    schema = T.StructType([*[df.schema[c] for c in keep], *added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, 2 << 20):
                arrays = make(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *arrays], [*keep, *names])
        trim()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", path: str | None = None, checked: str | None = None) -> DataFrame:
    """``df`` with each text's ids (binary, little-endian u32) and their number.

    With ``checked``, a column of that name says whether the ids decode to the text again;
    decoding follows in the same pass, so that no second worker is needed for it.
    """
    path = path or default_path()
    added = [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())]
    added += [T.StructField(checked, T.BooleanType())] if checked else []

    def make(values):
        own = codec(path)
        found = list(own.encode_each(values))
        made = [pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())]
        if checked:
            made.append(pa.array([own.decode(x) == (v or "") for x, v in zip(found, values)], pa.bool_()))
        return made

    return _mapped(df, text, added, make, pa.binary())


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text that each row's ids spell."""
    path = path or default_path()

    def make(values):
        return (pa.array([codec(path).decode(v or b"") for v in values], pa.string()),)

    return _mapped(df, ids, [T.StructField(text, T.StringType())], make, pa.string())


def digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Encode, decode again, and keep only counts and SHA-256 digests of both.

    One pass of Arrow batches: ids are hashed as they are made, part by part, so a
    very long text never holds its ids and their decoded form at once.
    """
    path = path or default_path()

    def make(values):
        own = codec(path)
        n, a, b = [], [], []
        for v, whole in zip(values, own.encode_each([v if v and len(v) <= WALK_ABOVE else None for v in values])):
            ids, spelled, total = hashlib.sha256(), hashlib.sha256(), 0
            for part in [whole] if whole or not v else own.encode_parts(v):
                ids.update(part)
                total += len(part) // 4
                out = own.decode_bytes(part)
                spelled.update(out if _is_utf8(out) else out.decode("utf-8", errors="replace").encode("utf-8"))
            n.append(total)
            a.append(ids.hexdigest())
            b.append(spelled.hexdigest())
        return pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, text, added, make, pa.string())
