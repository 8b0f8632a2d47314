"""Sessions closed by the streaming query against a plain version that goes batch by batch."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import sessions

DAY = datetime(2024, 1, 1)
HOUR, GAP, LATE = 3_600_000_000, 1_800_000_000, 172_800_000_000


def us(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def plain(rows, n=10):
    """Sessions of (click_id, ts, arrived_at, client_id) rows, by the rule alone."""
    first = {}
    for i, t, a, c in rows:
        if None not in (i, t, c):
            own = (us(a or t), us(t), c)
            first[i] = min(first.get(i, own), own)
    batches, opened, out, top, horizon = defaultdict(list), defaultdict(list), [], None, None
    hours = [a // HOUR for a, _, _ in first.values()] or [0]
    lo, hi = min(hours), max(hours)
    for i, (a, t, c) in first.items():
        late = zlib.crc32(f"{c}:{t // HOUR}".encode()) % 5 == 0
        batches[min(n - 1, n * (a // HOUR - lo) // (hi - lo + 1) + late)].append((c, t, zlib.crc32(str(i).encode())))
    for b in range(n):
        fresh = defaultdict(list)
        for c, t, crc in batches[b]:
            if horizon is None or t >= horizon:
                fresh[c].append([t, t, 1, crc, 0, 0])
        if batches[b]:
            top = max([t for _, t, _ in batches[b]] + ([top] if top is not None else []))
            horizon = top - LATE
        for c, new in fresh.items():
            joined = []
            for s in sorted([s + [1] for s in opened[c]] + new):
                if joined and s[0] - joined[-1][1] <= GAP:
                    at = joined[-1]
                    at[1] = max(at[1], s[1])
                    at[2:] = [x + y for x, y in zip(at[2:], s[2:])]
                else:
                    joined.append(list(s))
            opened[c] = [[*s[:4], s[4] + max(0, s[5] - 1)] for s in joined]
        for c in opened if horizon is not None else []:
            out += [(c, *s, b) for s in opened[c] if s[1] < horizon - GAP]
            opened[c] = [s for s in opened[c] if s[1] >= horizon - GAP]
    return sorted(out + [(c, *s, n) for c in opened for s in opened[c]])


def made(n_clients=30, rows=1500, seed=3):
    rnd, out = random.Random(seed), []
    for k in range(rows):
        at = DAY + timedelta(minutes=rnd.randrange(0, 60 * 24 * 12), microseconds=rnd.choice([0, 1, 999_999]))
        lag = timedelta(hours=rnd.choice([0, 0, 0, 1, 30, 47, 49, 90]), seconds=rnd.randrange(60))
        out.append((k, at, at + lag, rnd.choice([0, 0, 0, rnd.randrange(n_clients)])))
    # Exactly 30 minutes apart, and a microsecond more.
    for k, gap in ((9000, timedelta(minutes=30)), (9010, timedelta(minutes=30, microseconds=1))):
        out += [(k, DAY, DAY, k), (k + 1, DAY + gap, DAY + gap, k)]
    # Two sessions that a late row joins, in a batch after both.
    out += [(9100, DAY + timedelta(hours=50), DAY + timedelta(hours=50), -5), (9101, DAY + timedelta(hours=51), DAY + timedelta(hours=51), -5)]
    out += [(9102, DAY + timedelta(hours=50, minutes=30), DAY + timedelta(hours=84), -5)]
    # Copies, and rows with holes.
    out += out[:40] + [(1, DAY, DAY + timedelta(days=20), 3), (None, DAY, DAY, 1), (9200, None, DAY, 1), (9201, DAY, DAY, None), (9202, DAY, None, 1)]
    return out


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long"


def found(df, **options):
    return sorted(tuple(r) for r in sessions.close_sessions(df, **options).collect())


def test_equals_plain_version(spark):
    rows = made()
    expected = plain(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", batch string").repartition(5)
    assert found(df) == expected
    assert sum(s[5] for s in expected) > 0 and {s[6] for s in expected} >= {2, 5, 10}
    assert [s[3] for s in expected if s[0] in (9000, 9010)] == [2, 1, 1]
    assert any(s[0] == -5 and s[5] == 1 for s in expected)


def test_zones_and_few_batches(spark):
    rows = [(k, DAY + timedelta(minutes=20 * k), DAY + timedelta(minutes=20 * k), k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    zoned = df.withColumns({c: F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {c}))") for c in ("ts", "arrived_at")})
    assert found(zoned, batches=3) == found(df, batches=3) == plain(rows, 3)


def test_empty_tables(spark):
    df = spark.createDataFrame([(None, DAY, DAY, 1)], SCHEMA)
    assert found(df) == [] and found(df.limit(0)) == []


def test_blocks_of_many_clients():
    rng = np.random.default_rng(5)
    n = 4000
    client, first = rng.integers(0, 300, n), rng.integers(-(1 << 62), 1 << 62, n)
    first[: n // 2] = rng.integers(0, 40 * GAP, n // 2)
    last = first + rng.integers(0, GAP, n)
    one, is_open = np.ones(n, np.int64), np.arange(n) < 1500
    block = sessions.Block.of([client, first, last, one, one * 3, one * 0])
    got = sessions.merged([block.where(is_open), block.where(~is_open)], [True, False])
    expected = []
    for c, f, t, o in sorted(zip(client.tolist(), first.tolist(), last.tolist(), is_open.tolist())):
        if expected and expected[-1][0] == c and f - expected[-1][2] <= GAP:
            own = expected[-1]
            own[2], own[3], own[4] = max(own[2], t), own[3] + 1, own[4] + o
        else:
            expected.append([c, f, t, 1, int(o)])
    assert list(zip(*(c.tolist() for c in got.columns()))) == [(c, f, t, m, 3 * m, max(0, o - 1)) for c, f, t, m, o in expected]
    again = sessions.Block.load(got.dump())
    assert all((a == b).all() for a, b in zip(again.columns(), got.columns()))
