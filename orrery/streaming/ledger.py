"""Event-sourced ledgers: batch form, and some of their rules on a stream.

Events: event_id, ts, user_id, event_type, value.  A user is a request, and its events
are what happened to it.  The batch functions define the result.  Windows of time, deduplication and
collection also run on streams, with watermarks and checkpoints, and ``availableNow`` runs
end equal to them; so do rules of ``operators.folds`` by ``folded_stream`` (claims with leases, budgets).
Ledger states with a total limit, budget stops by type and sessions by boundary are batch only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.ranking import ordinals

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def collector_waves(events: DataFrame, hours: int = 1) -> DataFrame:
    """One receipt per wave of time: new requests, repeats, and how many are known after it."""
    wave = F.floor(F.unix_timestamp("ts") / (3600 * hours))
    first = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = events.withColumn("wave", wave).withColumn("new", F.row_number().over(first) == 1)
    per = own.groupBy("wave").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("new").cast("bigint")).alias("new"))
    known = F.sum("new").over(Window.orderBy("wave").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("known", known)


def ledger_state(events: DataFrame, reserve: str, success: str, failure: str, per_user: int, total: int) -> DataFrame:
    """What became of each reservation: admitted with its ordinal, or refused, and its outcome.

    A user's reservations beyond ``per_user`` are refused first; of the rest those beyond
    ``total`` in order of time are.  An outcome is the user's next success or failure.
    """
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    later = own.rowsBetween(1, Window.unboundedFollowing)
    ends = F.col("event_type").isin(success, failure)
    rows = events.withColumn("outcome", F.first(F.when(ends, F.col("event_type")), ignorenulls=True).over(later))
    asked = rows.where(F.col("event_type") == reserve).withColumn("nth", F.row_number().over(own))
    within = ordinals(asked.where(F.col("nth") <= per_user), F.floor(F.unix_timestamp("ts") / 600), "ts", "event_id")
    both = asked.select("event_id", "user_id", "nth", "outcome").join(within.select("event_id", "ordinal"), "event_id", "left")
    code = F.when(F.col("nth") > per_user, "USER_LIMIT").when(F.col("ordinal") > total, "TOTAL_LIMIT").otherwise("ADMITTED")
    state = F.when(code != "ADMITTED", "refused").when(F.col("outcome").isNull(), "pending").when(F.col("outcome") == success, "success").otherwise("failure")
    return both.select("event_id", "user_id", F.col("nth").cast("bigint").alias("nth"), F.when(code == "ADMITTED", F.col("ordinal")).cast("bigint").alias("ordinal"), code.alias("code"), state.alias("state"))


def budget_stops(events: DataFrame, limits: dict[str, int], no_yield: int = 5) -> DataFrame:
    """Admission of each event under per-type budgets, with the streak of events without yield.

    The first failing check gives the code; a stop, once reached, latches for the user.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    typed = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    gained = F.col("value") >= 50
    own = (
        events.withColumn("used", F.row_number().over(typed))
        .withColumn("limit", F.coalesce(table[F.col("event_type")], F.lit(1 << 30)))
        .withColumn("island", F.sum(gained.cast("int")).over(w))
    )
    streak = F.sum((~gained).cast("int")).over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    own = own.withColumn("streak", streak)
    code = F.when(F.col("used") > F.col("limit"), "TYPE_BUDGET").when(F.col("streak") >= no_yield, "NO_YIELD").otherwise("OK")
    own = own.withColumn("code", code)
    stopped = F.max((F.col("code") == "NO_YIELD").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return own.select("event_id", "user_id", F.col("used").cast("bigint").alias("used"), F.col("streak").cast("bigint").alias("streak"), "code", stopped.alias("stopped"))


def repaired_times(events: DataFrame, anchor) -> DataFrame:
    """Times of events whose clock is missing, between those of the ``anchor`` rows.

    Linear between two anchors in whole seconds, one second a step behind the last, and
    counted back before the first; then strictly rising.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = events.withColumn("place", F.row_number().over(w)).withColumn("known", F.when(anchor, F.unix_timestamp("ts")))
    at = F.when(F.col("known").isNotNull(), F.struct("place", "known"))
    own = own.withColumn("before", F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("after", F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    p, a, b = F.col("place"), F.col("before"), F.col("after")
    between = a["known"] + F.floor((b["known"] - a["known"]) * (p - a["place"]) / F.nullif(b["place"] - a["place"], F.lit(0)))
    filled = F.when(F.col("known").isNotNull(), F.col("known")).when(a.isNull(), b["known"] - (b["place"] - p)).when(b.isNull(), a["known"] + (p - a["place"])).otherwise(between)
    own = own.withColumn("filled", filled)
    # Strictly rising: v' = max(v, previous + 1), that is a running maximum of v - place.
    rising = F.max(F.col("filled") - p).over(w.rowsBetween(Window.unboundedPreceding, 0)) + p
    return own.select("event_id", "user_id", F.col("filled").cast("bigint").alias("filled"), rising.cast("bigint").alias("repaired"))


def sessions(events: DataFrame, boundary: str) -> DataFrame:
    """Spans of a user's events from one ``boundary`` event to the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = events.withColumn("session", F.sum((F.col("event_type") == boundary).cast("int")).over(w))
    return own.groupBy("user_id", F.col("session").cast("bigint").alias("session")).agg(
        F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.round(F.sum("value"), 4).alias("value")
    )


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events from a growing folder of Parquet files, a bounded number at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window of event time and type; works on streams and tables alike."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(
        F.col("w.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value")
    )


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once; on a stream, state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


LIMIT = "user_id long, event_id long, nth long, code string"


def reservations(events: DataFrame, reserve: str, per_user: int) -> DataFrame:
    """Streamed admission: each user's reservations in order, refused beyond the limit.

    It knows no total limit and no outcomes, so it admits rows that ``ledger_state`` refuses.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows = rows[rows["event_type"] == reserve]
        nth = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "nth": list(nth), "code": ["ADMITTED" if n <= per_user else "USER_LIMIT" for n in nth]})

    return events.groupBy("user_id").applyInPandasWithState(run, LIMIT, "seen long", "append", "NoTimeout")


def folded_stream(rows: DataFrame, by: str, order: list[str], step: Callable[[dict, dict], tuple], added: str) -> DataFrame:
    """``folds.folded`` on a stream: each key's state is carried from batch to batch, as JSON.

    Rows of a batch are taken in ``order``; batches must come in it too.  ``step`` is a rule
    such as ``folds.claim_step`` or ``stores.budget_step``, whose states are JSON values.
    """
    names = [f.name for f in T.StructType.fromDDL(added).fields]
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])

    def run(key, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else {}
        own = pd.concat(list(batches)).sort_values(order)
        made = [step(state, row) for row in own.to_dict("records")]
        kept.update((json.dumps(state),))
        yield own.assign(**{n: [m[k] for m in made] for k, n in enumerate(names)})

    return rows.groupBy(by).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def collect(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream's rows to a table until its source is read; a rerun adds only what is new."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Buckets of keys of ``collect_waves``.
KEY_BUCKETS = 256


def collect_waves(stream: DataFrame, key: list[str], path: str, checkpoint: str, buckets: int = KEY_BUCKETS) -> None:
    """Imports rows whose key is new, batch by batch, with a receipt for each.

    Known keys lie apart from rows, in folders by a hash of the key, and each wave writes
    its own; a wave reads the buckets of its own keys and no rows, so what it reads follows
    what it brings.  A batch that is run again writes the same files over, so receipts stay
    one per batch.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def wave(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("_bucket", bucket)
        new = own.dropDuplicates(key)
        if number:
            # At most ``buckets`` numbers.
            met = [r["_bucket"] for r in own.select("_bucket").distinct().collect()]
            schema = T.StructType([*(batch.schema[c] for c in key), T.StructField("_wave", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
            known = spark.read.schema(schema).parquet(f"{path}/keys").where((F.col("_wave") < number) & F.col("_bucket").isin(met))
            new = new.join(known.select(*key, "_bucket"), [*key, "_bucket"], "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/rows/{number}")
        took = spark.read.schema(batch.schema).parquet(f"{path}/rows/{number}")
        took.select(*key, bucket.alias("_bucket")).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/keys/_wave={number}")
        counts = batch.agg(F.lit(number).cast("bigint").alias("wave"), F.count(F.lit(1)).alias("events"))
        counts.crossJoin(took.agg(F.count(F.lit(1)).alias("new"))).write.mode("overwrite").parquet(f"{path}/receipts/{number}")

    stream.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
