"""WARC records: reading, writing, and resolving not-modified revisits.

A revisit says that a page had not changed since an earlier capture.  It is resolved by
an as-of join on the canonical URL: the latest full response captured before it.  The
revisit's validators are then checked against that response (the entity tag where both
have one, else the modification date, else the payload digest), and the headers that a
not-modified answer may update replace the response's own.

The join is one window over a URL's history, without any join.  The history of a URL with
more than ``SPAN_ROWS`` captures is cut into spans at quantiles of its times, so that no task
gathers it whole; what a span inherits then comes from one row per (URL, span).  Bodies do
not move: the result names the response they stand in.

Input rules: a revisit with a null URL or time stays unresolved ("no_response"), and rows
without a URL meet no window; responses at the revisit's own time do not count as
earlier; of responses at one time the one with the largest id counts, and a null id
before all others; revisits at one time are resolved alike, repeated rows too; headers
may be null, and values whose names differ in case only are joined by a comma; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified answer may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Captures of a URL that a span of time holds on average, and most spans of a URL.
SPAN_ROWS, CUTS = 4096, 1024


def canonical(url: Column) -> Column:
    """A URL without scheme, "www.", fragment, tracking parameters and closing slash; host in lower case.

    Only whole parameters behind the first "?" are tracking: "pref=1" and a path's "ref=" stay.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[Hh][Tt][Tt][Pp][Ss]?://", "")
    u = F.concat(
        F.regexp_extract(u, r"^[^?]*\??", 0),
        F.array_join(F.filter(F.split(F.regexp_extract(u, r"^[^?]*\?(.*)$", 1), "&", -1), lambda p: ~p.rlike("^(utm_[a-z]+|ref)=")), "&"),
    )
    u = F.regexp_replace(u, "[?&]+$", "")
    u = F.regexp_replace(u, "/+$", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    rest = F.regexp_extract(u, "^[^/?]*(.*)$", 1)
    return F.concat(F.regexp_replace(host, "^www[.]", ""), rest)


def spanned(own: DataFrame) -> DataFrame:
    """``own`` with the span of time that each row belongs to: 0 but for URLs with more than ``SPAN_ROWS`` captures.

    Those are cut at quantiles of their own times, so a burst is cut as well; captures of one URL at
    one time stay together.  The table of cuts has an entry for each ``SPAN_ROWS`` rows or so;
    whether it is broadcast is left to the optimiser.
    """
    cuts = F.percentile_approx("at", [k / CUTS for k in range(1, CUTS)], F.lit(10 * CUTS))
    hot = own.groupBy("url_key").agg(F.count("at").alias("n"), cuts.alias("cuts")).where(F.col("n") > SPAN_ROWS)
    every = F.greatest(F.lit(1), F.floor(F.lit(CUTS * SPAN_ROWS) / F.col("n")))
    hot = hot.select("url_key", F.array_distinct(F.filter("cuts", lambda c, k: (k + 1) % every == 0)).alias("cuts"))
    passed = F.size(F.filter("cuts", lambda c: c <= F.col("at")))
    return own.join(hot, "url_key", "left").withColumn("span", F.when(F.col("cuts").isNull() | F.col("at").isNull(), 0).otherwise(passed)).drop("cuts")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, base_id, outcome and merged headers.

    ``records``: record_id long, url, captured_at long, kind ("response" or "revisit"),
    etag, last_modified, digest, headers map.  ``outcome`` is "resolved", "mismatch" (the
    validators differ), "unverified" (none to compare) or "no_response".
    """
    own = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical(F.col("url")).alias("url_key"),
        F.col("captured_at").cast("long").alias("at"),
        "kind", "etag", "last_modified", "digest", "headers",
    )
    lost = own.where((F.col("kind") == "revisit") & F.col("url_key").isNull())
    own = own.where(F.col("url_key").isNotNull())
    keys = ["url_key"]
    most = own.groupBy("url_key").count().agg(F.max("count")).first()[0] or 0
    if most > SPAN_ROWS:
        own = spanned(own)
        keys.append("span")
    known = (F.col("kind") == "response") & F.col("at").isNotNull()
    when = F.when(known, F.struct("at", "record_id"))
    base = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    # The latest response before the revisit within its own span, else what the span inherits.
    earlier = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    joined = own.withColumn("base", F.max_by(F.when(known, base), when).over(earlier)).where(F.col("kind") == "revisit")
    if len(keys) > 1:
        newest = own.groupBy(*keys).agg(F.max(when).alias("newest"), F.max_by(F.when(known, base), when).alias("last"))
        before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        handed = newest.withColumn("inherited", F.max_by("last", "newest").over(before)).select(*keys, "inherited")
        joined = joined.join(handed, keys, "left").withColumn("base", F.coalesce("base", "inherited"))
    joined = joined.withColumn("base_id", F.col("base.record_id"))
    same = (
        F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("base.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(), F.col("last_modified") == F.col("base.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("base.digest").isNotNull(), F.col("digest") == F.col("base.digest"))
    )
    outcome = (
        F.when(F.col("base_id").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    )
    found = joined.withColumn("outcome", outcome).select(
        "record_id", "url_key", "base_id", "outcome",
        F.when(F.col("outcome") == "resolved", merged(F.col("base.headers"), F.col("headers"))).alias("headers"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    return found.unionByName(
        lost.select("record_id", "url_key", none("long").alias("base_id"), F.lit("no_response").alias("outcome"), none("map<string,string>").alias("headers"))
    )


def weak(tag: Column) -> Column:
    """An entity tag without its weakness mark, for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def merged(base: Column, update: Column) -> Column:
    """The response's headers, with those that a not-modified answer may update taken from it."""
    none = F.create_map().cast("map<string,string>")
    base, update = F.coalesce(base, none), F.coalesce(update, none)
    base, update = lowered(base), F.map_filter(lowered(update), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return F.map_concat(kept, update)


def lowered(headers: Column) -> Column:
    """Headers under lower-case names; values whose names are alike then are joined, in the order of the names as written."""
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))

    def value(name: Column) -> Column:
        own = F.filter(F.array_sort(F.map_entries(headers)), lambda e: F.lower(e["key"]) == name)
        return F.when(F.size(own) == 1, own[0]["value"]).otherwise(F.array_join(F.transform(own, lambda e: e["value"]), ", "))

    return F.map_from_arrays(names, F.transform(names, value))


def header_text(headers: Column) -> Column:
    """Headers as "name: value" lines in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def _inflated(data: bytes) -> Iterator[bytes]:
    """The file's bytes: as they are, or member by member where it is compressed; a cut member gives what it has."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        yield member.decompress(data) + member.flush()
        data = member.unused_data


def parse(data: bytes) -> Iterator[dict]:
    """Records of one WARC file, plain or compressed member by member; a record cut off at the end is left out."""
    rest = b""
    for part in _inflated(data):
        rest, at = rest + part if rest else part, 0
        while (begin := rest.find(b"WARC/1.", at)) >= 0:
            end = rest.find(b"\r\n\r\n", begin)
            fields = joined_fields(rest[begin:end]) if end >= 0 else {}
            length = fields.get("content-length", "0")
            stop = end + 4 + (int(length) if length.isdigit() else 0)
            if end < 0 or stop > len(rest):
                break
            yield {"fields": fields, "block": rest[end + 4 : stop]}
            at = stop
        rest = rest[begin:] if begin >= 0 else b""


def joined_fields(head: bytes) -> dict[str, str]:
    """Fields under lower-case names; repeated ones are joined by a comma."""
    out: dict[str, str] = {}
    for name, value in _fields(head):
        out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _fields(head: bytes) -> Iterator[tuple[str, str]]:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            yield name.strip().lower(), value.strip()


def render(fields: dict[str, str], block: bytes) -> bytes:
    """One uncompressed WARC record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if k.lower() != "content-length"), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORDS = "path string, offset int, record_id string, kind string, url string, captured_at timestamp, etag string, last_modified string, digest string, headers map<string,string>, body binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: one row each, with the HTTP headers and body of its block."""
    from datetime import datetime

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                for k, r in enumerate(parse(data)):
                    f = r["fields"]
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    http = joined_fields(head) if head.startswith(b"HTTP/") else {}
                    when = f.get("warc-date")
                    rows.append(
                        {
                            "path": name, "offset": k, "record_id": f.get("warc-record-id"), "kind": f.get("warc-type"),
                            "url": f.get("warc-target-uri"),
                            "captured_at": datetime.fromisoformat(when.replace("Z", "+00:00")) if when else None,
                            "etag": http.get("etag"), "last_modified": http.get("last-modified"), "digest": f.get("warc-payload-digest"),
                            "headers": list(http.items()), "body": body if http else r["block"],
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.mapInArrow(run, RECORDS)


_ARROW = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int32()), ("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()),
        ("captured_at", pa.timestamp("us", tz="UTC")), ("etag", pa.string()), ("last_modified", pa.string()), ("digest", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()),
    ]
)
