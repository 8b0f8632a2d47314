"""Revisits against a plain loop; records written and read again."""

import gzip
import random

from pyspark.sql import functions as F

from orrery.llm import warc

SCHEMA = "record_id long, url string, captured_at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, body string"


def plain(records):
    out = {}
    for r in records:
        if r[3] != "revisit":
            continue
        earlier = [x for x in records if x[3] == "response" and x[1] == r[1] and r[1] is not None and None not in (x[2], r[2]) and x[2] < r[2]]
        if not earlier:
            out[r[0]] = (None, "no_response")
            continue
        base = max(earlier, key=lambda x: (x[2], x[0]))
        for k in (4, 5, 6):
            if r[k] is not None and base[k] is not None:
                strip = lambda t: t.removeprefix("W/") if k == 4 else t  # noqa: B023, E731
                out[r[0]] = (base[0], "resolved" if strip(r[k]) == strip(base[k]) else "mismatch")
                break
        else:
            out[r[0]] = (base[0], "unverified")
    return out


def records(seed):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice([None, *v])
    return [
        (k, rnd.choice(["a.org/x", "b.org/y", "c.org", None] if k % 9 == 0 else ["a.org/x", "b.org/y"]), rnd.randrange(60) if k % 11 else None, rnd.choice(["response", "revisit"]), pick("t1", "W/t1", "t2"), pick("mon", "tue"), pick("d1", "d2"), pick({"ETag": "1", "X": "2"}, {"Date": "now"}), "body")
        for k in range(200)
    ]


def test_against_a_loop(spark, monkeypatch):
    for span_rows in (4096, 7):
        monkeypatch.setattr(warc, "SPAN_ROWS", span_rows)
        rows = records(span_rows)
        found = {r["record_id"]: (r["base_id"], r["outcome"]) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert found == plain(rows)
    assert warc.resolve(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_canonical_urls(spark):
    cases = {
        "https://WWW.Example.org/A/?utm_source=x&id=3#top": "example.org/A/?id=3", "http://example.org/a/": "example.org/a", "example.org": "example.org",
        "https://m.example.org/p?page=2&ref=x": "m.example.org/p?page=2", None: None, "": "",
        "http://e.org/p?pref=1": "e.org/p?pref=1", "http://e.org/p?pref=2&utm_a=1": "e.org/p?pref=2", "http://e.org/xref=1/p": "e.org/xref=1/p", "e.org/a&ref=1": "e.org/a&ref=1",
        "e.org/?ref=a&utm_b=c&x=1&ref=2&y=?ref=3": "e.org/?x=1&y=?ref=3", "e.org/a?utm_source=b": "e.org/a", "e.org/a?ref": "e.org/a?ref",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == cases


def test_headers_merge(spark):
    df = spark.createDataFrame([({"Content-Type": "t", "ETag": "1", "Date": "old"}, {"date": "new", "X-Cache": "HIT", "Vary": "v"}), (None, None)], "a map<string,string>, b map<string,string>")
    twice = spark.createDataFrame([({"Set-Cookie": "a", "set-cookie": "b", "X": None}, {"DATE": "1", "date": "2"})], "a map<string,string>, b map<string,string>")
    assert twice.select(warc.merged(F.col("a"), F.col("b")).alias("m")).first()["m"] == {"set-cookie": "a, b", "x": None, "date": "1, 2"}
    rows = df.select(warc.header_text(warc.merged(F.col("a"), F.col("b"))).alias("h")).collect()
    assert [r["h"] for r in rows] == ["content-type: t\ndate: new\netag: 1\nvary: v", ""]


def test_nulls_repeated_rows_and_other_columns(spark):
    rows = [(k, None, k, "revisit" if k % 2 else "response", "t", None, None, None, "x") for k in range(40)]
    rows += [(100, "e.org", 1, "response", "t", None, None, {"A": "1"}, "x"), (101, "e.org", None, "revisit", "t", None, None, None, "x")] + [(102, "e.org", 5, "revisit", "t", None, None, None, "x")] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in ("at", "base", "url_key", "span", "outcome")})
    found = sorted((r["record_id"], r["base_id"], r["outcome"]) for r in warc.resolve(df).collect() if r["record_id"] >= 100)
    assert found == [(101, None, "no_response")] + [(102, 100, "resolved")] * 3
    assert warc.resolve(df).where("outcome = 'no_response'").count() == 21


def test_cut_files_and_repeated_headers():
    one = warc.render({"WARC-Type": "response", "WARC-Record-ID": "<1>"}, b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nset-cookie: b\r\n\r\nbody")
    for data in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 2) + gzip.compress(one)):
        assert [r["block"][-4:] for r in warc.parse(data)] == [b"body"] * 3
        for cut in (3, 20, len(data) - 5, len(data) - 30):
            assert all(r["block"].endswith(b"body") for r in warc.parse(data[:cut]))
    assert warc.joined_fields(b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nset-cookie: b") == {"set-cookie": "a, b"}


def test_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\nContent-Type: text/html\r\n\r\n<p>h\r\n\r\ni</p>"
    one = warc.render({"WARC-Type": "response", "WARC-Record-ID": "<1>", "WARC-Target-URI": "http://a.org/", "WARC-Date": "2024-01-02T03:04:05Z"}, block)
    two = warc.render({"WARC-Type": "revisit", "WARC-Record-ID": "<2>", "WARC-Target-URI": "http://a.org/", "WARC-Date": "2024-02-02T03:04:05Z"}, b"HTTP/1.1 304 Not Modified\r\nETag: \"x\"\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    rows = warc.read(spark, str(tmp_path)).orderBy("path", "offset").collect()
    assert [(r["record_id"], r["kind"], r["etag"]) for r in rows] == [("<1>", "response", '"x"'), ("<2>", "revisit", '"x"')] * 2
    assert bytes(rows[0]["body"]) == b"<p>h\r\n\r\ni</p>" and rows[0]["headers"]["content-type"] == "text/html"


def test_hot_urls_without_times_and_with_bursts(spark, monkeypatch):
    """Captures that are all without a time; and a burst within a long history, cut at its own quantiles."""
    monkeypatch.setattr(warc, "SPAN_ROWS", 7)
    nothing = [(k, "e.org", None, "revisit" if k % 2 else "response", "t", None, None, None) for k in range(40)]
    found = warc.resolve(spark.createDataFrame([(*r, None) for r in nothing], SCHEMA)).collect()
    assert len(found) == 20 and {r["outcome"] for r in found} == {"no_response"}
    burst = [(k, "e.org", 10**9 + k, "revisit" if k % 3 else "response", "t", None, None, {"X": "y" * 5000}) for k in range(300)]
    rows = [(1000, "e.org", 0, "response", "t", None, None, None), (1001, "e.org", 1, "revisit", "t", None, None, None), (1002, "e.org", 10**12, "revisit", "t", None, None, None), *burst]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    base = {r["record_id"]: r["base_id"] for r in warc.resolve(df).collect()}
    assert base == {1001: 1000, 1002: 297} | {k: k - k % 3 for k in range(300) if k % 3}
    own = df.select("record_id", F.col("url").alias("url_key"), F.col("captured_at").alias("at"))
    sizes = [r["count"] for r in warc.spanned(own).groupBy("span").count().collect()]
    assert max(sizes) <= 14 and sum(sizes) == 303
