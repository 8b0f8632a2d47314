"""Token ids as binary files: a concatenated id array per shard, and Elias-Fano lists for where documents end.

File, little-endian::

    magic "ORTOK001"
    ids of all documents, end id included, ``width`` bytes each (2 where the vocabulary allows, else 4)
    Elias-Fano list of document ends: counts of ids up to and with each document
    Elias-Fano list of document ids, less the smallest, nulls left out
    footer: ids, documents, null ids, smallest id, width, sizes of both lists (7 x i64), magic again

Documents lie in ascending order of id within a shard and across shards.  A shard is
written in one pass from Arrow batches, so memory holds a batch and one number per
document; readers take the footer, the two lists, and the ids block by block.  Where a
document begins in the whole corpus is its place in its shard plus the ids of the shards
before: a table with one row per shard.

Every attempt of a task writes a file of its own.  The manifest, a table that Spark
commits, names those that count, so lost executors and repeated tasks leave no trace.
Executors write through ``pyarrow.fs``, to whatever folder all of them share.

Input rules: null and empty texts hold the end id only; null ids come first; documents of
equal id are ordered by a hash of their text, and repeated rows stay repeated; texts of any
length are written whole; an empty table makes no files; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.arrow import pieces, trim
from orrery.llm.bpe import codec, default_path
from orrery.llm.eliasfano import EliasFano, encode
from orrery.session import ensure_checkpoints, keep

MAGIC = b"ORTOK001"
FOOTER = 7 * 8 + len(MAGIC)
#: Bytes of ids that a reader takes at once, unless one document is larger.
READ_BYTES = 4 << 20
#: Shards whose sums are taken together before sums over all.
GROUP = 4096
MANIFEST = "shard long, file string, n_docs long, n_ids long"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class ShardWriter:
    """Appends documents to one file."""

    def __init__(self, out, width: int, end_id: int):
        self.out, self.kind = out, np.dtype(f"<u{width}")
        self.width, self.end = width, np.array([end_id], self.kind).tobytes()
        self.ends: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.n_ids = self.n_docs = self.n_null = 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], packed: list[bytes]) -> None:
        """``packed``: each document's ids as u32, without the end id."""
        narrow = packed if self.width == 4 else [np.frombuffer(p, "<u4").astype(self.kind).tobytes() for p in packed]
        self.out.write(self.end.join([*narrow, b""]))
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4 + 1
        self.ends.append(self.n_ids + np.cumsum(counts))
        known = np.array([i for i in doc_ids if i is not None], np.int64)
        self.ids.append(known)
        self.n_ids += int(counts.sum())
        self.n_docs += len(packed)
        self.n_null += len(packed) - len(known)

    def close(self) -> None:
        ids = np.concatenate([*self.ids, np.empty(0, np.int64)])
        least = int(ids[0]) if len(ids) else 0
        ends = encode(np.concatenate([*self.ends, np.empty(0, np.int64)]))
        # Wraps round like the sum that restores them, so ids of either sign and any size fit.
        names = encode(ids.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))
        footer = np.array([self.n_ids, self.n_docs, self.n_null, least, self.width, len(ends), len(names)], "<i8")
        for part in (ends, names, footer.tobytes(), MAGIC):
            self.out.write(part)
        self.out.close()


class ShardReader:
    """Reads one file: its lists at once, its ids in blocks or by document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(FOOTER, size - FOOTER)
        if tail[-len(MAGIC) :] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token ids, or a broken one")
        self.n_ids, self.n_docs, self.n_null, self.least, self.width, n_ends, n_names = (int(x) for x in np.frombuffer(tail, "<i8", 7))
        self.ends = EliasFano(source.read_at(n_ends, size - FOOTER - n_names - n_ends))
        self.names = EliasFano(source.read_at(n_names, size - FOOTER - n_names))

    def span(self, k: int) -> tuple[int, int]:
        """Where document ``k`` of the shard begins and ends, in ids."""
        return self.ends.select(k - 1) if k else 0, self.ends.select(k)

    def tokens(self, k: int) -> np.ndarray:
        """Ids of document ``k``, end id included."""
        a, b = self.span(k)
        return np.frombuffer(self.source.read_at((b - a) * self.width, len(MAGIC) + a * self.width), f"<u{self.width}")

    def blocks(self) -> Iterator[tuple[list[int | None], np.ndarray, bytes]]:
        """(document ids, their begins and the last end, their ids as u32) of successive documents."""
        at, begin, most = 0, 0, max(1, READ_BYTES // self.width)
        while at < self.n_docs:
            ends = self.ends.slice(at, at + (1 << 15)).astype(np.int64)
            n = max(1, int(np.searchsorted(ends, begin + most, side="right")))
            bounds = np.append(begin, ends[:n])
            read = self.source.read_at(int(bounds[-1] - begin) * self.width, len(MAGIC) + begin * self.width)
            named = (self.names.slice(at - self.n_null, at + n - self.n_null) + np.uint64(self.least & (1 << 64) - 1)).astype(np.int64)
            yield [None] * (n - len(named)) + named.tolist(), bounds, np.frombuffer(read, f"<u{self.width}").astype("<u4").tobytes()
            at, begin = at + n, int(bounds[-1])


def write(df: DataFrame, folder: str | None = None, id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes and writes all documents; the manifest, one row per shard with ``start``, the ids before it.

    ``folder``: where files go, a new one below ``spark.checkpoint.dir`` unless given.
    """
    path = path or default_path()
    spark = df.sparkSession
    if folder is None:
        ensure_checkpoints(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid4()}"
    own = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    order = ["id", "tie", "any"]
    # Rows that are equal in both may lie in any order, and in several shards.
    tied = own.withColumns({"tie": F.xxhash64("text"), "any": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, files = None, opened(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid4()}.ids"
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                own = codec(path)
                if writer is None:
                    files[0].create_dir(files[1], recursive=True)
                    size = max([len(own.spelled) - 1, end_id])
                    writer = ShardWriter(files[0].open_output_stream(f"{files[1]}/{name}"), 2 if size < 1 << 16 else 4, end_id)
                writer.add(part.column("id").to_pylist(), list(own.encode_each(part.column("text").to_pylist())))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{folder}/{name}"], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})
        trim()

    return placed(keep(ranged.mapInArrow(run, MANIFEST)))


def placed(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``start``: sums within groups of shards, and of the groups."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = manifest.withColumn("part", F.floor(F.col("shard") / GROUP))
    inner = own.withColumn("inside", zero(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard")))))
    groups = own.groupBy("part").agg(F.sum("n_ids").alias("sum"))
    outer = groups.select("part", zero(F.sum("sum").over(before(Window.orderBy("part")))).alias("outside"))
    return inner.join(outer, "part").select(*manifest.columns, (F.col("inside") + F.col("outside")).alias("start"))


def _read(manifest: DataFrame, schema: str, make) -> DataFrame:
    """One pass over the files; ``make`` gives arrays for a block of documents."""
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                files, folder = opened(os.path.dirname(file))
                with files.open_input_file(f"{folder}/{os.path.basename(file)}") as source:
                    for ids, bounds, packed in ShardReader(source).blocks():
                        arrays = [pa.array(ids, pa.int64()), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds))]
                        yield pa.RecordBatch.from_arrays([*arrays, *make(packed, (bounds - bounds[0]) * 4)], names)
        trim()

    many = manifest.count()
    return manifest.select("file", "start").repartition(max(1, many)).mapInArrow(run, schema)


def read(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start, n_tokens and token_ids (binary, u32)."""

    def make(packed: bytes, at: np.ndarray) -> list[pa.Array]:
        return [pa.array([packed[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())]

    return _read(manifest, f"`{id}` long, start long, n_tokens long, token_ids binary", make)


def digests(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start, n_tokens and ids_crc32, without moving ids."""

    def make(packed: bytes, at: np.ndarray) -> list[pa.Array]:
        view = memoryview(packed)
        return [pa.array([zlib.crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())]

    return _read(manifest, f"`{id}` long, start long, n_tokens long, ids_crc32 long", make)
