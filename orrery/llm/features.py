"""Sparse n-gram indicators of whole texts, shared by the two text classifiers."""

from __future__ import annotations

from collections.abc import Iterable
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.arrow import pieces, texts_of

#: Hashed features; the model's size follows from it, whatever the corpus.
BITS = 18
#: Features that say which of three neighbouring word pairs repeat a word.
REPEATS = 8
SIZE = (1 << BITS) + REPEATS

#: Features that the rows of a training sample have together, at most: 256 MB of numbers.
SAMPLE_FEATURES = 1 << 26

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SHAPE = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b
    for b in range(256)
)


#: Bytes of a text whose features are made at once; neighbours overlap, so none is lost.
WINDOW_BYTES = 2 << 20


class Indicators:
    """Makes the distinct features of a text; holds one reusable table."""

    def __init__(self):
        self.last = np.empty(SIZE, np.int32)

    def __call__(self, text: bytes) -> np.ndarray:
        """Distinct feature numbers of one text, in no order.

        Features are byte 5-grams of the lower-cased text; 4-grams over its shape (letters,
        capitals, digits, marks); and which of three neighbouring word pairs are equal.
        """
        data, found = b" " + text + b" ", []
        for a in range(0, max(1, len(data) - 4), WINDOW_BYTES):
            found.append(self._distinct(data[a : a + WINDOW_BYTES + 4]))
        split = text.split()
        if len(split) > 3:
            same = np.fromiter(map(eq, split, split[1:]), np.uint8, len(split) - 1)
            codes = np.unique(same[:-2] * 4 + same[1:-1] * 2 + same[2:])
            found.append(codes.astype(np.int64) + (1 << BITS))
        every = np.concatenate(found)
        return every if len(data) <= WINDOW_BYTES else np.unique(every)

    def _distinct(self, data: bytes) -> np.ndarray:
        low = np.frombuffer(data.translate(_LOWER), np.uint8).astype(np.uint64)
        if len(low) < 5:
            return np.empty(0, np.int64)
        five = low[:-4] | low[1:-3] << 8 | low[2:-2] << 16 | low[3:-1] << 24 | low[4:] << 32
        shape = np.frombuffer(data.translate(_SHAPE), np.uint8).astype(np.uint64)
        four = shape[:-3] | shape[1:-2] << 8 | shape[2:-1] << 16 | shape[3:] << 24 | np.uint64(1 << 40)
        every = np.concatenate([five * np.uint64(0x9E3779B97F4A7C15), four * np.uint64(0xD6E8FEB86659FD93)])
        every = (every >> np.uint64(64 - BITS)).astype(np.int64)
        place = np.arange(len(every), dtype=np.int32)
        self.last[every] = place
        return every[self.last[every] == place]


class Trained(NamedTuple):
    """A row of a training sample."""

    label: int
    n_bytes: int
    features: np.ndarray


def sampled(documents: DataFrame, own: DataFrame, id: str, text: str) -> DataFrame:
    """(id, label, text) of the labelled rows ``own`` (id, label; a bounded number): one text for each.

    Of several documents with one id, the one whose text has the smallest hash counts.
    """
    texts = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    met = texts.join(F.broadcast(own), "id")
    return met.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))


def in_one_task(sample: DataFrame) -> DataFrame:
    """The bounded sample in the order of the hash of its ids."""
    return sample.select("id", "label", "text").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label")


def collected(batches: Iterable[pa.RecordBatch]) -> list[Trained]:
    """Labels and features of rows in order, up to SAMPLE_FEATURES features."""
    indicators, found, left = Indicators(), [], SAMPLE_FEATURES
    for batch in batches:
        for part in pieces(batch, "text"):
            for t, y in zip(texts_of(part, "text"), part.column("label").to_pylist()):
                if left > 0:
                    row = indicators(t).astype(np.int32)
                    left -= len(row)
                    if left >= 0:
                        found.append(Trained(y, len(t), row))
    return found
