"""Numeric, array, map, hash and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, least_ratio: float = 0.0) -> Column:
    """Of two distinct arrays; 0 where one is empty or the sizes differ too much."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    ok = (small > 0) & (small / F.nullif(large, F.lit(0)) >= least_ratio)
    return F.when(ok, F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))).otherwise(0.0)


def redundancy(similarity: Column, from_: float = 0.8) -> Column:
    """0 below ``from_``, then rising in a line to 1."""
    return F.when(similarity < from_, 0.0).otherwise((similarity - from_) / (1 - from_))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length, summed in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def half_up(value: Column, places: int) -> Column:
    """A fixed-point decimal; halves round away from zero."""
    return F.round(value.cast("decimal(38,12)"), places)


def half_up_ratio(a: Column, b: Column) -> Column:
    """a / b to the nearest integer, halves up; integers throughout."""
    return F.floor((2 * a + b) / (2 * b))


def single(value: Column) -> Column:
    """As single precision holds it."""
    return value.cast("float").cast("double")


def next_below(value: Column, steps: Column) -> Column:
    """The double that lies ``steps`` doubles below ``value``: bit patterns of one sign are in the order of values."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    least = F.lit(-(1 << 63)).cast("bigint")
    ordered = F.when(bits >= 0, bits).otherwise(least - bits) - steps.cast("bigint")
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.when(ordered >= 0, ordered).otherwise(least - ordered)).cast("double")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def epoch_ns(value: Column) -> Column:
    """An epoch number as nanoseconds; its magnitude tells the unit."""
    size = F.abs(value)
    return (
        F.when(size >= 10**17, value).when(size >= 10**14, value * 1_000).when(size >= 10**11, value * 1_000_000).otherwise(value * 1_000_000_000)
    ).cast("bigint")


def identity(*parts: Column) -> Column:
    """SHA-256 over parts framed by their length, so that no two lists run together."""
    framed = [F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    return F.sha2(F.concat_ws(",", *framed), 256)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as name=value pairs in the order of names, nulls marked."""
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) for c in sorted(df.columns)]), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One digest for a table that no order of rows or partitions changes.

    Row digests are counted and hashed again in 256 ranges, and the ranges' digests in one.
    """
    rows = df.select(row_digest(df).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    part = rows.groupBy(F.substring("d", 1, 2).alias("part")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "n"))), lambda x: F.concat_ws("*", x["d"], x["n"].cast("string"))), ","), 256).alias("p"),
        F.sum("n").alias("n"),
    )
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"]), ","), 256).alias("digest"), F.sum("n").alias("n"))


def merged_map(base: Column, update: Column) -> Column:
    """``base`` with the entries of ``update`` in place of its own."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two spans over the shorter one."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.nullif(F.least(a1 - a0, b1 - b0), F.lit(0))


def iso_seconds(text: Column) -> Column:
    """An ISO time in seconds and millionths since the epoch; without a zone it is UTC; null if it is no time."""
    own = F.trim(text)
    zoned = own.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    shape = own.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    return F.when(shape, F.unix_micros(F.when(zoned, own).when(F.length(own) == 10, F.concat(own, F.lit("T00:00:00Z"))).otherwise(F.concat(own, F.lit("Z"))).try_cast("timestamp"))) / 1_000_000


def retry_after(header: Column, now: Column, most: float = 300.0) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date in HTTP's form; at most ``most``, none if it is neither."""
    own = F.trim(header)
    date = F.try_to_timestamp(F.regexp_replace(own, r"^[A-Za-z]{3}, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(own.rlike(r"^[0-9]+([.][0-9]+)?$"), own.try_cast("double")).when(own.rlike(r"^[A-Za-z]{3}, .* GMT$"), F.unix_timestamp(date) - now)
    return F.greatest(F.lit(0.0), F.least(F.lit(most), wait.cast("double"))) if most else wait


def canonical_json(*fields: tuple[str, Column]) -> Column:
    """Compact JSON of an object whose names are in order; nulls are written, not left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]), {"ignoreNullFields": "false"})


def strict_json(text: Column, schema: str) -> tuple[Column, Column]:
    """(value, fault) of a flat JSON object: torn, a name twice, a number that is none, or a field beyond the schema."""
    names = [f.split()[0] for f in schema.split(", ")]
    keys = F.json_object_keys(text)
    # Names as written: strings that stand before a colon, with all other strings' insides blanked.
    written = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    odd = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""').rlike(r"\b(NaN|-?Infinity)\b")
    value = F.from_json(text, schema)
    fault = (
        F.when(odd, "number").when(keys.isNull(), "torn").when(F.size(F.array_distinct(written)) < F.size(written), "name twice")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0, "unknown field").when(F.size(F.array_except(F.array(*map(F.lit, names)), keys)) > 0, "missing field")
    )
    return F.when(fault.isNull(), value), fault


def span_id(kind: str, *parts: Column) -> Column:
    """A readable prefix and 24 hexadecimal digits of the parts' identity."""
    return F.concat(F.lit(f"{kind}_"), F.substring(identity(F.lit(kind), *parts), 1, 24))
