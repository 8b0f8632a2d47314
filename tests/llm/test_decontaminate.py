"""The FM-index against brute force."""

import re

import numpy as np

from orrery.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(None if i is None else str(i))
    out = []
    for d, text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in windows:
                    found |= windows[key]
                    hit[a : a + n] = [True] * n
        out.append((d, len(w), sum(hit), sorted(found, key=lambda n: (n is not None, n or ""))))
    return sorted(out, key=repr)


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        s = rnd.integers(0, 4, 60)
        s[0] = s[-1] = 0
        def key(i):
            stretch = []
            while i < len(s) and s[i]:
                stretch.append(int(s[i]) + 100)
                i += 1
            return stretch + [i - 100]
        assert D.suffix_array(s).tolist() == sorted(range(len(s)), key=key)


def test_index_counts_and_locates():
    rnd = np.random.default_rng(2)
    for size in (1, 3, 40):
        s = rnd.integers(0, size + 1, 700)
        s[-1] = 0
        index = D.FMIndex(s, size)
        for n in (1, 2, 5):
            words = rnd.integers(1, size + 1, 200 + n)
            which, low, high = index.search(words, np.arange(200), np.full(200, n))
            found = {k: sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which.tolist(), low.tolist(), high.tolist())}
            for k in range(200):
                assert found.get(k, []) == [a for a in range(700 - n) if (s[a : a + n] == words[k : k + n]).all()]


def test_against_brute_force(spark, corpus, monkeypatch):
    docs = corpus
    passage = words(docs[5][1]) + words(docs[20][1])
    items = [(1, " ".join(passage[:40])), (2, docs[72][1]), (3, "the"), (4, "STONE tree"), (5, ""), (6, None), (7, docs[72][1]), (8, "Straße! señor; x1"), (9, "nowhere to be found"), (10, "a" * 5000), (None, "stone"), (None, docs[71][1]), (11, docs[72][1]), (11, docs[72][1])]
    df = spark.createDataFrame([(*r, 3) for r in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def rows(found):
        return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["hit_words"]), r["hit_items"]) for r in found.collect()), key=repr)

    assert rows(D.scan(df, bench)) == brute(docs, items)
    monkeypatch.setattr(D, "BLOCK_BYTES", 900)  # several blocks, and items in pieces, give the same
    monkeypatch.setattr(D, "PIECE_WORDS", 5)
    assert rows(D.scan(df, bench)) == brute(docs, items)
    assert D.scan(df.limit(0), bench).count() == 0
    assert all(not r["hit_words"] for r in D.scan(df, bench.limit(0)).collect())
