"""Secret scans against the patterns in Python, and the Markov test on held-out samples."""

import base64
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from orrery.llm import native, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RULES = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def expected(text):
    spans = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(RULES) for m in p.finditer(text or "") if ok(m))
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)


CASES = [
    None, "", "password=token: abcdefgh", "password=abc", "secret==abcdef", "API_KEY: 'abcdef' apikey=\"ZZZZZZ", "é😀 token = 0123456789abcdef0123456789abcdef",
    "AKIA" + "B" * 15, "AKIA" + "B" * 16 + "-AKIAAKIA" + "C" * 14, "0" * 23 + " " + "0" * 24, "g" + "a" * 30 + "g", "PassWD:x.y=z_1", "toKen\n=abcdef", "token =\tabcdefg",
    "password=" + "x" * 70_000, " ".join(f"token=value{k:06}" for k in range(300)),
]


def model(spark):
    words = "the quick Brown fox jumps over lazy dog while many people read about interesting history and nature writing long sentences".split()
    texts = [(" ".join(words[k:] + words[:k]),) for k in range(len(words))]
    return secrets.train(secrets.labelled_samples(spark, spark.createDataFrame(texts, "text string"), random_rows=1024))


def test_patterns_and_redaction(spark):
    table = model(spark)
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(CASES)], "doc_id int, text string, spans int")
    out = secrets.scan(df, table)
    shown = out.select("doc_id", "text", secrets.joined(F.col("base_spans")).alias("base"), secrets.joined(F.col("spans")).alias("all"), "spans", secrets.redact(F.col("text"), F.col("spans")).alias("clean"))
    for r in shown.collect():
        assert r["base"] == expected(CASES[r["doc_id"]]), r["doc_id"]
        assert set(filter(None, r["base"].split(","))) <= set(r["all"].split(","))
        text, covered = r["text"] or "", set()
        for s in r["spans"]:
            covered.update(range(s["start"], s["stop"]))
        clean, inside = "", False
        for k, c in enumerate(text):
            clean += "" if k in covered and inside else "[SECRET]" if k in covered else c
            inside = k in covered
        if not any(a["stop"] == b["start"] for a in r["spans"] for b in r["spans"]):
            assert (r["clean"] or "") == clean
    assert secrets.scan(df.limit(0), table).count() == 0


def test_random_strings_are_told_from_identifiers(spark):
    table = model(spark)
    noise = [base64.b64encode(hashlib.sha256(b"held out %d" % k).digest()).decode()[:32] for k in range(200)]
    names = ["interestingHistoryOfPeople", "jumps_over_the_lazy_dog", "writing-long-sentences", "people/read/about/nature", "THE_QUICK_BROWN_FOX_JUMPS"]
    df = spark.createDataFrame([(v, True) for v in noise] + [(v, False) for v in names], "text string, random boolean")
    rows = secrets.scan(df, table).select("random", F.exists("spans", lambda s: s["kind"] == 3).alias("found")).collect()
    assert sum(r["found"] for r in rows if r["random"]) >= 195
    assert not any(r["found"] for r in rows if not r["random"])


def test_running_sums(spark):
    rows = [([],), ([5],), (list(range(-40, 60)),), ([1] * 1000,), (list(range(513)),)]
    for stride in (256, 7):
        native.STRIDE, before = stride, native.STRIDE
        try:
            df = spark.createDataFrame(rows, "a array<int>").select("a", native.running(F.col("a"), 3).alias("r"))
            for r in df.collect():
                assert r["r"] == [3 + sum(r["a"][:k]) for k in range(len(r["a"]))]
        finally:
            native.STRIDE = before


def plain_ratio(token, samples):
    """The log-likelihood ratio of a token, by a plain count of the samples' character pairs."""
    letters, logs = secrets.ALPHABET, {}
    for label in (True, False):
        counts = {(a, b): 1 for a in letters for b in letters}
        for value, random in samples:
            for pair in zip(value, value[1:]):
                if random is label and pair in counts:
                    counts[pair] += 1
        sums = {a: sum(counts[a, b] for b in letters) for a in letters}
        logs[label] = {(a, b): math.log(n / sums[a]) for (a, b), n in counts.items()}
    return sum(logs[True][p] - logs[False][p] for p in zip(token, token[1:]))


def test_random_spans_equal_a_plain_markov_test(spark):
    ordinary = spark.createDataFrame([("the quick brown fox jumps over the lazy dog again and again",)] * 3, "text string")
    samples = secrets.labelled_samples(spark, ordinary, random_rows=40)
    pairs = [tuple(r) for r in samples.collect()]
    table = secrets.train(samples)
    rnd = random.Random(11)
    letters = secrets.ALPHABET
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(15, 40))) for _ in range(60)]
    words += ["quickBrownFoxJumpsOverLazy", "the_quick_brown_fox_jumps", "again-and-again-and-again", "password=hunter2hunter2hunter2", "0" * 30, "x" * 25]
    texts = [" ".join(rnd.sample(words, 20)) + rnd.choice(["", "\n", "é"]) for _ in range(20)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    token = re.compile(secrets.TOKEN)
    found = 0
    for r in secrets.scan(df, table).collect():
        base = [(s["start"], s["stop"]) for s in r["base_spans"]]
        expected = [
            m.span() for m in token.finditer(r["text"] or "")
            if plain_ratio(m.group(), pairs) > secrets.MARGIN and not any(a < m.end() and m.start() < b for a, b in base)
        ]
        assert [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == 3] == expected
        found += len(expected)
    assert found > 3


def test_redaction_of_many_spans(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(40):
        text = "".join(rnd.choice("abcé😀 ") for _ in range(rnd.randrange(1, 900)))
        spans = []
        for _ in range(rnd.randrange(200)):
            a = rnd.randrange(len(text))
            spans.append((a, 0, min(len(text), a + rnd.randrange(1, 6))))
        rows.append((text, sorted(spans)))
    rows.append(("abc", []))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,kind:int,stop:int>>")
    for r in df.withColumn("out", secrets.redact(F.col("text"), F.col("spans"), "#")).collect():
        gone = set()
        for s in r["spans"]:
            gone |= set(range(s["start"], s["stop"]))
        expected = "".join("#" if k in gone and k - 1 not in gone else "" if k in gone else c for k, c in enumerate(r["text"]))
        assert r["out"] == expected


def test_repeated_rows_and_columns_of_the_same_name(spark):
    rows = [(1, "token=abcdef99 and more", "old", "old")] * 3 + [(None, None, "old", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base_spans string, spans string")
    found = secrets.scan(df, [0.0] * len(secrets.ALPHABET) ** 2).collect()
    assert [[(s["start"], s["stop"]) for s in r["base_spans"]] for r in found] == [[(0, 14)]] * 3 + [[]]
    assert secrets.scan(df.limit(0), [0.0] * len(secrets.ALPHABET) ** 2).count() == 0
