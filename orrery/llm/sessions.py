"""Closing sessions out of order: a Structured Streaming query with columnar state by hash bucket.

A client's rows at most ``GAP`` apart share a session.  Rows come late and out of order;
the horizon W(b), the largest time through batch b less ``LATENESS``, says which rows of
the next batch are too late and which sessions can grow no more.

* Rows are first merged where they lie: each Arrow batch becomes fragments of sessions.
  Batches are cut by time, so a client with a third of all rows sends on about as many
  fragments as it has sessions, not rows.
* Clients are dealt to ``BUCKETS`` buckets.  A bucket's open sessions are one Arrow block
  in the state store; a batch's fragments and the block are merged in one pass for all
  its clients: lexsort by client and time, a running maximum of ends that shows the gaps,
  and reduceat for the sums.
* Each bucket keeps a timer, so that its sessions close even where a batch brings it
  nothing.

State holds what the horizon leaves open and no more.  The query is started anew for each
batch on one checkpoint: offsets, state and the file sink's log lie there, so a start or a
task that is lost is run again with the same result.

Input rules: of the copies of a click id the one that arrived first counts (then the
earliest, then the least client); rows without id, client or time are left out; a row
without arrival arrives at its own time; times of any range are exact to the microsecond,
with or without a zone; an empty table gives no sessions; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.llm.arrow import trim
from orrery.session import ensure_checkpoints, keep

MINUTE = 60_000_000
GAP, LATENESS = 30 * MINUTE, 48 * 60 * MINUTE
HOUR = 60 * MINUTE
#: Buckets of clients; fixed for the life of a checkpoint.
BUCKETS = 512
#: One in so many of (client, hour) pairs comes a batch late.
LATE_EVERY = 5

FIELDS = ("client_id", "first_us", "last_us", "n_clicks", "ids_crc32", "n_merges")
CLOSED = "client_id long, first_us long, last_us long, n_clicks long, ids_crc32 long, n_merges long, close_batch long"


@dataclass
class Block:
    """Sessions side by side: one array for each of FIELDS."""

    client: np.ndarray
    first: np.ndarray
    last: np.ndarray
    clicks: np.ndarray
    crc: np.ndarray
    merges: np.ndarray

    @classmethod
    def of(cls, columns: Iterable[np.ndarray]) -> Block:
        return cls(*(np.asarray(c, np.int64) for c in columns))

    @classmethod
    def empty(cls) -> Block:
        return cls.of([np.empty(0, np.int64)] * len(FIELDS))

    def columns(self) -> list[np.ndarray]:
        return [self.client, self.first, self.last, self.clicks, self.crc, self.merges]

    def __len__(self) -> int:
        return len(self.client)

    def where(self, chosen: np.ndarray) -> Block:
        return Block.of(c[chosen] for c in self.columns())

    def dump(self) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in self.columns()], list(FIELDS))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, data: bytes) -> Block:
        table = pa.ipc.open_stream(data).read_all()
        return cls.of(table.column(c).to_numpy() for c in FIELDS)


def merged(parts: list[Block], is_open: list[bool], gap: int = GAP) -> Block:
    """All sessions of ``parts`` with those at most ``gap`` apart joined; joining k open ones counts k - 1 merges."""
    columns = [np.concatenate(c) for c in zip(*(p.columns() for p in parts))]
    opened = np.repeat(np.array(is_open, np.int64), [len(p) for p in parts])
    if not len(opened):
        return Block.empty()
    order = np.lexsort((columns[1], columns[0]))
    client, first, last, clicks, crc, merges = (c[order] for c in columns)
    opened = opened[order]
    # The running maximum of ends within a client: ranks of ends, lifted by client, cannot overflow.
    ends, rank = np.unique(last, return_inverse=True)
    new_client = np.append(True, client[1:] != client[:-1])
    lift = (np.cumsum(new_client) - 1) * len(ends)
    reach = ends[np.maximum.accumulate(rank + lift) - lift]
    begins = new_client.copy()
    begins[1:] |= first[1:] - reach[:-1] > gap
    at = np.flatnonzero(begins)
    total = lambda x: np.add.reduceat(x, at)
    joined = np.maximum(total(opened) - 1, 0)
    return Block(client[at], first[at], np.maximum.reduceat(last, at), total(clicks), total(crc), total(merges) + joined)


def micros(df: DataFrame, column: str) -> Column:
    """A time as microseconds since 1970, whether or not it has a zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(column))
    return F.unix_micros(F.col(column).cast("timestamp"))


def hour(us: Column) -> Column:
    """Whole hours since 1970, rounded down."""
    return F.call_function("div", us - F.pmod(us, F.lit(HOUR)), F.lit(HOUR))


def rows_of(clicks: DataFrame) -> DataFrame:
    """(click_id, client_id, us, arrived) of each click id once, without nulls."""
    own = clicks.select(
        F.col("click_id").cast("long").alias("click_id"),
        F.struct(
            F.coalesce(micros(clicks, "arrived_at"), micros(clicks, "ts")).alias("arrived"),
            micros(clicks, "ts").alias("us"),
            F.col("client_id").cast("long").alias("client_id"),
        ).alias("row"),
    ).where("click_id IS NOT NULL AND row.client_id IS NOT NULL AND row.us IS NOT NULL")
    return own.groupBy("click_id").agg(F.min("row").alias("row")).select("click_id", "row.*")


def cut(rows: DataFrame, n: int) -> DataFrame:
    """(client_id, us, crc, batch): ``n`` batches by hour of arrival, some rows one batch late."""
    span = rows.agg(F.min(hour(F.col("arrived"))).alias("lo"), F.max(hour(F.col("arrived"))).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    text = lambda c: c.cast("string").cast("binary")
    slot = F.concat_ws(":", F.col("client_id").cast("string"), hour(F.col("us")).cast("string"))
    base = F.call_function("div", n * (hour(F.col("arrived")) - lo), F.lit(hi - lo + 1))
    late = (F.crc32(text(slot)) % LATE_EVERY == 0).cast("long")
    return rows.select("client_id", "us", F.crc32(text(F.col("click_id"))).alias("crc"), F.least(base + late, F.lit(n - 1)).cast("int").alias("batch"))


def fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, client_id, us, crc) merged to sessions within each Arrow batch."""
    for batch in batches:
        client, us, crc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("client_id", "us", "crc"))
        one, none = np.ones(len(us), np.int64), np.zeros(len(us), np.int64)
        found = merged([Block.of([client, us, us, one, crc, none])], [False])
        # A client has one bucket: it is found again by the client's first row.
        clients, where = np.unique(client, return_index=True)
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)[where][np.searchsorted(clients, found.client)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *map(pa.array, found.columns())], ["bucket", *FIELDS])
    trim()


def closing(horizons: list[tuple[int, int]], last_number: int | None, gap: int = GAP):
    """The step of one batch for one bucket.

    ``horizons``: (batch, W) of all batches through this one, ascending; a session closes as
    the first of them that lies more than ``gap`` behind its end.  With ``last_number``, what is
    then still open closes as that batch.
    """
    numbers, limits = (np.array(x, np.int64) for x in zip(*horizons))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [Block.load(state.get[0])] if state.exists else []
        opened = [True] * len(parts)
        if not state.hasTimedOut:
            for frame in frames:
                parts.append(Block.of(frame[c].to_numpy() for c in FIELDS))
                opened.append(False)
        found = merged(parts, opened, gap) if parts else Block.empty()
        at = np.searchsorted(limits - gap, found.last, side="right")
        done = at < len(limits)
        number = np.where(done, numbers[np.minimum(at, len(limits) - 1)], -1 if last_number is None else last_number)
        if last_number is not None:
            done[:] = True
        left = found.where(~done)
        if len(left):
            state.update((left.dump(),))
            # The bucket is called in the next batch, whether or not that brings rows.
            state.setTimeoutDuration(1)
        elif state.exists:
            state.remove()
        out = found.where(done)
        yield pd.DataFrame(dict(zip((*FIELDS, "close_batch"), [*out.columns(), number[done]])))

    return step


def advance(spark: SparkSession, base: str, before: int | None, horizons: list[tuple[int, int]], last_number: int | None, buckets: int = BUCKETS) -> None:
    """Starts the query on ``base``'s checkpoint, lets it take what is new in its folder, and waits for its end."""
    fed = spark.readStream.schema("client_id long, us long, crc long, batch int").parquet(f"{base}/in")
    if before is not None:
        fed = fed.where(F.col("us") >= before)
    dealt = fed.select(F.pmod(F.hash("client_id"), F.lit(buckets)).cast("int").alias("bucket"), "client_id", "us", "crc")
    held = dealt.mapInArrow(fragments, "bucket int, " + ", ".join(f"{c} long" for c in FIELDS))
    closed = held.groupBy("bucket").applyInPandasWithState(
        closing(horizons, last_number), CLOSED, "block binary", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    out = closed.writeStream.format("parquet").option("path", f"{base}/closed").option("checkpointLocation", f"{base}/checkpoint")
    query = out.outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def close_sessions(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """One row per session: CLOSED.

    The clicks are written in ``batches`` batches below a new folder of ``spark.checkpoint.dir``
    and fed to the query one after another.
    """
    spark = clicks.sparkSession
    ensure_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/sessions-{uuid4()}"
    dealt = cut(keep(rows_of(clicks)), batches)
    # By time, so that rows of one session lie together; rows of one microsecond may part.
    dealt.repartitionByRange("batch", "us", "crc").write.partitionBy("batch").parquet(f"{base}/cut")
    # One row per batch.
    found = spark.read.schema("client_id long, us long, crc long, batch int").parquet(f"{base}/cut").groupBy("batch").agg(F.max("us")).collect()
    most = dict(sorted(map(tuple, found)))
    if not most:
        return spark.createDataFrame([], CLOSED)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(f"{base}/in"))
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        horizons: list[tuple[int, int]] = []
        for number, largest in most.items():
            before = horizons[-1][1] if horizons else None
            horizons.append((number, max(largest - LATENESS, before if before is not None else largest - LATENESS)))
            if not fs.rename(path(f"{base}/cut/batch={number}"), path(f"{base}/in/batch={number}")):
                raise OSError(f"batch {number} of {base} cannot be moved")
            advance(spark, base, before, horizons, batches if number == max(most) else None)
    finally:
        spark.conf.set(setting, was)
    return spark.read.schema(CLOSED).parquet(f"{base}/closed")
