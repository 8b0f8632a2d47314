"""Repeated byte strings against brute force, and the interval expansion by itself."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import substrings as S


def brute(rows, place=lambda row: 0):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place(r), (r[1] or "").encode())):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - 99):
            if data[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            else:
                seen.add(data[a : a + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_expansion_stops_at_the_threshold():
    rnd = random.Random(3)
    for _ in range(150):
        seq = []
        for _ in range(rnd.randint(1, 6)):
            seq += [rnd.choice([1, 2, 3][: rnd.randint(1, 3)]) for _ in range(rnd.randint(1, 40))] + [0]
        least = rnd.randint(1, 12)
        order, joined = S.equal_windows(np.array(seq, np.uint16), least)
        assert sorted(order.tolist()) == list(range(len(seq)))
        for k in range(1, len(seq)):
            a, b, n = int(order[k - 1]), int(order[k]), 0
            while n < least and max(a, b) + n < len(seq) and seq[a + n] == seq[b + n] != 0:
                n += 1
            assert joined[k] == (n >= least)


def test_segments_hold_every_window_once(monkeypatch):
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"ab \xc3") for _ in range(rnd.randrange(400))) for _ in range(30)] + [b"a" * 500]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for step in (1 << 17, 61, 150):
        monkeypatch.setattr(S, "STEP", step)
        *_, at, n = S.segments(data, ends)
        found = sorted(p for a, k in zip(at, n) for p in range(a, a + k))
        assert found == [p for t, e in zip(texts, ends) for p in range(e - len(t), e - 99)]


def test_two_hashes_part_weak_strings():
    word = "ab"
    for _ in range(8):  # Thue-Morse strings and their complements
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    texts = [word[:160].encode(), other[:160].encode()]
    h, c, e, *_ = S.segments(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([160, 160]))
    assert len(set(zip(h.tolist(), c.tolist(), e.tolist()))) == len(h)


@pytest.mark.parametrize("hot", [0, 2, 2048])
def test_hot_anchors_and_rows_that_share_an_id(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "BUCKET_BYTES", 4_000)
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 60)
    monkeypatch.setattr(S, "HOT", hot)
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage = make(130)
    rows = [(rnd.choice([None, 5, k]), make(rnd.randrange(60)) + passage[rnd.randrange(10) :] + make(rnd.randrange(60))) for k in range(120)]
    rows += rows[:15] + [(7, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit("")).cast("binary"))
    places = {(r["doc_id"], r["text"]): r["p"] for r in df.withColumn("p", F.shiftrightunsigned(own, 33)).collect()}
    found = sorted((tuple(r)[:5] for r in S.repeated(df).collect()), key=repr)
    assert found == brute(rows, places.__getitem__)


def test_against_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 2_000)
    df = spark.createDataFrame([(*r, b"x") for r in corpus], "doc_id long, text string, bucket binary")
    found = S.repeated(df)
    rows = sorted((tuple(r)[:5] for r in found.collect()), key=repr)
    assert rows == brute(corpus)
    for r in found.where("id = 96").collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert S.repeated(df.limit(0)).count() == 0
