"""The Jaccard join against brute force, and its parts."""

import random
import re

import numpy as np
import pytest

from orrery.llm import graph
from orrery.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def link_rows(rows):
    """Of every row, the number of its component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], link_rows(rows)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None] if sets[k] else []
        out.append((i, len(sets[k]), min(ids) if ids else i))
    return sorted(out, key=repr)


def test_sets_and_links_equal_brute_force():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["a", "B", "cé", "dd", "e f", "g\x85"]) + rnd.choice(["", " ", "\n", "\x0b"]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    texts += ["", "  ", "x" * 200_000 + " y z"]
    sets, plain = J.shingle_sets([t.encode() for t in texts]), [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for _ in range(5000):
        i, j = rnd.randrange(200), rnd.randrange(200)
        if plain[i] and plain[j]:
            assert J.links(sets[i], sets[j]) == (100 * len(plain[i] & plain[j]) >= 75 * len(plain[i] | plain[j]))


def test_tree_finds_all_within_the_bound():
    rnd = np.random.default_rng(1)
    points = rnd.integers(0, 6, (3000, 64)).astype(np.int32)
    points[1500:] = points[:1500] + rnd.integers(0, 2, (1500, 64))
    sizes = points.sum(axis=1)
    tree = J.CountTree(points, sizes)
    for q in range(0, 3000, 311):
        expected = np.flatnonzero(np.minimum(points, points[q]).sum(axis=1) >= J.needed(sizes[q], sizes))
        assert sorted(tree.search(points[q], int(sizes[q]))) == expected.tolist()


def test_points_lose_no_link():
    rnd = np.random.default_rng(6)
    sets = []
    for n in (5, 40, 700, 760, 800, 3000, 3100, 20_000):
        base = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [base, np.sort(base[: int(len(base) * 0.8)]), np.sort(rnd.permutation(base)[: int(len(base) * 0.76)]), np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([J.point_of(s, int(J.groups_of(len(s)))) for s in sets])
    points = J.Points(flat, sizes, np.arange(len(sets)))
    every = np.arange(len(sets))
    found = {tuple(sorted(p)) for part in points.pairs(every) for p in part.tolist()}
    a, b = np.triu_indices(len(sets), 1)
    passed = {(i, j) for i, j, ok in zip(a.tolist(), b.tolist(), points.may_link(a, b)) if ok}
    linked = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if J.links(sets[i], sets[j])}
    assert linked <= found == passed
    assert len(found) < 3 * len(linked)


def test_spanning_joins_the_same():
    rnd = random.Random(2)
    for _ in range(100):
        n = rnd.randint(2, 30)
        pairs = np.array([rnd.sample(range(n), 2) for _ in range(rnd.randrange(30))]).reshape(-1, 2)

        def roots(p):
            r = list(range(n))
            for _ in range(n):
                for a, b in p:
                    r[a] = r[b] = min(r[a], r[b])
            return r

        assert roots(pairs.tolist()) == roots(J.spanning(pairs, n).tolist())


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(J, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(J, "SHARD_SHINGLES", 3_000)
    if hot:  # everything frequent, every group a crowd, every block dealt into parts
        monkeypatch.setattr(J, "PART_SHINGLES", 300)
        monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(J, "CROWD", 2)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(400)}" for _ in range(200)]
    rows = list(corpus)
    for k in range(40):  # a chain of near copies
        own = list(base)
        for _ in range(k // 2):
            own[rnd.randrange(200)] = "changed"
        rows.append((200 + k, " ".join(own)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string")
    found = J.join(df)
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == brute(rows)
    assert J.join(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 7), (5, 5), (3, 2)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        if a != b:
            assert found[a] == found[b]
    assert all(found[k] == k // 10 * 10 for k in range(40)) and found[100] == 0


def link_counts(rows):
    sets = [shingles(t) for _, t in rows]
    return [sum(i != j and bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_verify_counts_every_link(monkeypatch):
    monkeypatch.setattr(J, "POSTINGS", 50)
    rnd = np.random.default_rng(3)
    sets = []
    for n in (1, 4, 30, 200, 240):
        base = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [np.sort(rnd.permutation(base)[: max(1, int(len(base) * x))]) for x in (1, 0.95, 0.9, 0.85, 0.8, 0.76, 0.7)]
    sets = [sets[k] for k in rnd.permutation(len(sets))]
    copies = rnd.integers(1, 4, len(sets))
    true = np.array([[i != j and J.links(a, b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    pairs, linked = J.verify(sets, copies)
    assert linked.tolist() == (true @ copies).tolist() and all(true[i, j] for i, j in pairs.tolist())
    sides = rnd.integers(0, 2, len(sets))
    across = true & (sides[:, None] != sides)
    pairs, linked = J.verify(sets, copies, sides)
    assert linked.tolist() == (across @ copies).tolist() and all(across[i, j] for i, j in pairs.tolist())


@pytest.mark.parametrize("hot", [False, True])
def test_every_document_knows_all_its_links(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(J, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(J, "SHARD_SHINGLES", 3_000)
    if hot:
        monkeypatch.setattr(J, "PART_SHINGLES", 300)
        monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(J, "CROWD", 2)
    rnd = random.Random(4)
    rows = [(i, t) for i, t in corpus]
    for family in range(2):  # near copies that mostly link with each other, some of them twice
        base = [f"v{rnd.randrange(300)}" for _ in range(120)]
        for k in range(25):
            own = list(base)
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(120)] = "other"
            rows += [(1000 + 100 * family + k, " ".join(own))] * (1 + (k % 5 == 0))
    # An id that names two texts, and texts without an id.
    rows += [(1000, rows[-1][1] + " and more"), (1000, "one two three four five six"), (None, rows[-1][1]), (None, "one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = J.join(df).collect()
    expected = sorted(((i, len(shingles(t)), n) for (i, t), n in zip(rows, link_counts(rows))), key=repr)
    assert sorted(((r["id"], r["n_shingles"], r["n_links"]) for r in found), key=repr) == expected
    assert max(n for _, _, n in expected) > 20


def test_long_words_have_hashes_of_their_own():
    word = "ab"
    for _ in range(11):  # Thue-Morse words: polynomials modulo powers of two hash them like their complements
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    for n in (1024, 4096):
        a, b = J.shingle_sets([f"one {word[:n]} two three four".encode(), f"one {other[:n]} two three four".encode()])
        assert not J.links(a, b) and J.class_of(a) != J.class_of(b)


@pytest.mark.parametrize("hot", [False, True])
def test_rows_without_ids_and_with_the_same_id(spark, monkeypatch, hot):
    monkeypatch.setattr(J, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(J, "FAN", 2)
    if hot:
        monkeypatch.setattr(J, "PART_SHINGLES", 300)
        monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(J, "CROWD", 2)
    rnd = random.Random(8)
    base = [f"u{rnd.randrange(500)}" for _ in range(60)]
    rows = []
    for k in range(300):  # a quarter near copies, some repeated; no ids, or one id for many texts
        own = list(base) if k % 4 == 0 else [f"u{rnd.randrange(500)}" for _ in range(rnd.randrange(40))]
        if k % 8 == 0:
            own[rnd.randrange(60)] = "changed"
        rows.append((None if k % 3 else 7 if k % 2 else k, " ".join(own)))
    rows += rows[:40]
    found = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    assert sorted(((r["id"], r["n_shingles"], r["n_links"]) for r in found), key=repr) == sorted(((i, len(shingles(t)), n) for (i, t), n in zip(rows, link_counts(rows))), key=repr)
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == brute(rows)
    assert all((r["first"] is None) == (r["n_shingles"] == 0) for r in found)


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_what_moves_is_less_than_the_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_BYTES", 1_500_000)
    monkeypatch.setattr(J, "SHARD_SHINGLES", 8_000)
    rnd = random.Random(12)
    word = lambda k: "".join(rnd.choice("etaoinshrdlucm") for _ in range(7)) if k else ""
    words, lines = [word(1) for _ in range(20_000)], [" ".join(word(1) for _ in range(12)) for _ in range(150)]
    rows = []
    for k in range(1_500):  # documents of their own that share lines with a few others, and some near copies
        own = [rnd.choice(words) for _ in range(400)]
        for _ in range(4):
            own.insert(rnd.randrange(len(own)), rnd.choice(lines))
        rows.append((k, " ".join(own)))
        if k % 30 == 0:
            rows.append((10_000 + k, rows[-1][1] + " more"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    size, before = sum(len(t) for _, t in rows), shuffled(spark) if df.count() else 0
    found = J.join(df).select("id", "n_links").collect()
    moved = shuffled(spark) - before
    assert sorted(r["id"] for r in found if r["n_links"]) == sorted([*range(0, 1_500, 30), *range(10_000, 11_500, 30)])
    assert moved < 1.5 * size, (moved, size)  # sketches of a fixed size among them
