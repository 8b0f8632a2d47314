"""Fill-in-middle against a plain version, row by row."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from orrery.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def found(df, **options):
    made = fim.transform(df, **options).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    return Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made.collect())


def test_equals_plain_version(spark, corpus):
    edges = ["<P", "<P<P", "a <S", "M> <", "<P>", "x <M> y", " a", "a ", "  a b", "\x0b\x0c", "\x1fa\x1f b", "<S <M <P"]
    rows = corpus + [(1000 + k, t) for k, t in enumerate(edges * 9)] + [(5000 + k, "hot text of many rows") for k in range(300)] + [(7, corpus[7][1])] * 2
    expected = Counter((i, *plain(i, t)) for i, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == expected
    assert {f for _, _, f, *_ in expected} == {"plain", "psm", "spm"}
    assert all(r[-1] == (t or "") for r, t in ((plain(i, t), t) for i, t in rows))


def test_keys_that_two_texts_share(spark, corpus, monkeypatch):
    """Where keys collide, no list of another text is used."""
    real = F.xxhash64
    monkeypatch.setattr(fim.F, "xxhash64", lambda c: real(c) % 3)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert found(df) == Counter((i, *plain(i, t)) for i, t in corpus)


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "x"), (2, None, None, None), (2, None, None, None)], "doc_id long, text string, N int, output string")
    made = fim.transform(df)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((r["doc_id"], r["text"] or "", r["n"]) for r in made.collect()) == [(1, "a b c", 3), (2, "", 0), (2, "", 0)]
    assert fim.transform(df.limit(0)).count() == 0
    assert fim.transform(df, carry=["doc_id"]).columns[0] == "doc_id"


def test_documents_are_shuffled_once(spark):
    rows = [(k, f"text number {k}") for k in range(3000)]
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"])
    made.collect()
    plan = made._jdf.queryExecution().toString()
    assert "ReusedExchange" in plan or plan.count("REPARTITION_BY_COL") == 1, plan
