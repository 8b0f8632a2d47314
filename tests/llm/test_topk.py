"""MaxScore against brute force."""

from collections import Counter

import numpy as np
import pytest

from orrery.llm import topk


def brute(rows, asked, k):
    """``rows``: (id, integers); ``asked``: numbers of rows.  All answers, in any order."""
    out = Counter()
    for q in asked:
        query, v = rows[q]
        clip = lambda s: min(max(s, -topk.BEYOND), topk.BEYOND)
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for n, (i, w) in enumerate(rows) if n != q and len(w) == len(v))[:k]
        out.update((query, n + 1, i, min(max(-s, -topk.MOST), topk.MOST)) for n, (s, i) in enumerate(scored))
    return out


def test_search_prunes_nothing_that_counts():
    rnd = np.random.default_rng(3)
    for scale in (3, 1000):
        m = rnd.integers(-scale, scale + 1, (9000, 24)).astype(float)
        m[:, :4] *= 30  # a few terms dominate, so that others become non-essential
        ids, lists, times = np.arange(9000), np.ascontiguousarray(m.T), np.ones(9000, int)
        times[::7] = 0
        for q in range(0, 9000, 1500):
            found, score = topk.search_shard(ids, lists, m[q], 10, times)
            expected = sorted((-int(m[q] @ m[r]), r) for r in range(9000) if times[r])[:10]
            assert [(-s, r) for s, r in zip(score, found.tolist())] == expected


@pytest.mark.parametrize("size", [2.0**30, 2.0**45, 2.0**400])
def test_large_components_are_exact(size):
    rnd = np.random.default_rng(4)
    m = np.floor(rnd.normal(size=(500, 6)) * size)
    m[100:200] = m[:100] + rnd.integers(0, 2, (100, 6))  # neighbours that doubles cannot tell apart
    lists = np.ascontiguousarray(m.T)
    for q in (0, 5, 99):
        found, score = topk.search_shard(np.arange(500), lists, m[q], 10)
        clip = lambda s: min(max(s, -topk.BEYOND), topk.BEYOND)
        exact = sorted((-clip(sum(int(a) * int(b) for a, b in zip(m[q], m[r]))), r) for r in range(500))[:10]
        assert [(-s, r) for s, r in zip(score, found.tolist())] == exact


def test_frame(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rnd = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rnd.normal(size=8)]) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(20)]  # ties
    rows += [(0, [1.0] * 8), (0, [-1.0] * 8), (100, rows[100][1]), (100, rows[100][1]), (7, rows[7][1])]  # ids and rows repeated
    rows += [(1100, [3.0e6, -3.0e6] * 4), (1101, [3.0e6] * 8), (1200, [1e300] * 8), (1201, [9.1e15, 1e-3] * 4)]
    odd = [(400, None), (500, [1.0, None]), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8), (1300, [1e306] * 8)]
    short = [(800, [1.0, 2.0]), (900, []), (901, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd + short], "vec_id long, embedding array<double>, score string")
    got = Counter(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=10).collect())
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows + short]
    expected = brute(whole, [n for n, (i, _) in enumerate(whole) if i % 100 == 0], 10)
    assert not got - expected and not expected - got
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
