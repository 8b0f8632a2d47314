"""Queries that take all rows of their tables, against brute force."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery import catalog
from orrery.functions.text import guard_signature
from orrery.operators import stats
from orrery.operators.evidence import select_evidence

SF = "/root/testdata/sf0.001"
#: On the smallest tables both runs of a topic hold the same documents.
LARGER = "/root/testdata/sf0.01"


def test_all_pairs_of_documents_and_units(spark):
    docs, units = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    words = {u: re.findall("[a-z0-9]+", t.lower()) for u, t in zip(units["item_id"], units["text"])}
    expected = sorted((u, d, sum(w in t.lower() for w in ws)) for d, t in zip(docs["doc_id"], docs["text"].fillna("")) for u, ws in words.items())
    found = sorted(tuple(r) for r in catalog.QUERIES["unit_cross_product_all"](spark, SF).select("topic", "doc", "hits").collect())
    assert len(found) == len(docs) * len(units) and found == expected


def test_unit_hits_by_parts(spark, monkeypatch):
    from orrery.operators import lexical

    monkeypatch.setattr(lexical, "UNITS", 2)
    docs = spark.createDataFrame([(1, "Foobar-baz 12"), (2, None), (3, "")], "doc long, text string")
    units = spark.createDataFrame([(1, ["oba", "oba", "arb"]), (2, []), (3, None), (4, ["2", "baz"])], "topic long, words array<string>")
    found = {(r["topic"], r["doc"]): r["hits"] for r in lexical.unit_hits(docs, units).collect()}
    assert found == {(t, d): None if t == 3 else 2 if d == 1 and t in (1, 4) else 0 for t in (1, 2, 3, 4) for d in (1, 2, 3)}
    assert lexical.unit_hits(docs, units.limit(0)).count() == 0


def test_every_claim_meets_all_evidence(spark):
    found = catalog.QUERIES["claim_support_all"](spark, SF)
    n = len(pd.read_parquet(f"{SF}/benchmark.parquet"))
    assert found.select("topic", "other").distinct().count() == found.count() == n * n


def test_sign_flip_takes_every_topic(spark):
    deltas = [r["delta"] for r in catalog.QUERIES["metric_comparison"](spark, LARGER).collect()]
    own = [abs(x) for x in deltas if x]
    sums = np.zeros(1)
    for x in own:
        sums = np.concatenate([sums - x, sums + x])
    r = catalog.QUERIES["sign_flip_all_topics"](spark, LARGER).first()
    assert (r["patterns"], r["reached"]) == (2 ** len(own), int((sums >= sum(deltas) - 1e-9).sum()))


def test_evidence_keeps_texts_apart_beyond_their_beginnings(spark, tmp_path):
    head = "the same beginning of a text, longer than any prefix that stood for the whole " * 2
    texts = [head + "ends one way", head + "ends in 42 other ways", head + "never ends", head + "ends one way"]
    docs = pd.DataFrame({"doc_id": range(4), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t) for t in texts]})
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"vec_id": range(4), "embedding": [[1.0, 0.0]] * 4}).to_parquet(tmp_path / "embeddings.parquet")
    found = catalog.QUERIES["evidence_selection"](spark, str(tmp_path)).collect()
    # Exact copies are one group; numbers and negation at the ends keep the others apart.
    assert sorted((r["id"], r["groups"]) for r in found) == [(0, 1), (1, 1), (2, 1)]


def test_white_space_is_squeezed_to_the_end(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    found = {r["doc"]: (r["squeezed"], r["words"]) for r in catalog.QUERIES["whitespace_of_whole_texts"](spark, SF).collect()}
    assert found == {d: (" ".join(t.split()), len(t.split())) for d, t in zip(docs["doc_id"], docs["text"])}
    assert any(len(s) > 300 for s, _ in found.values())


def test_selection_of_evidence_as_a_whole(spark):
    """Pool, groups, clusters, diverse order and budgets, against one plain walk over each topic."""
    rnd = np.random.default_rng(12)
    names = ["Rome", "Paris", "Oslo"]
    rows = []
    for topic in ("a", "b"):
        base = rnd.normal(size=(6, 4))
        for k in range(70):
            c = int(rnd.integers(0, 6))
            text = f"claim {c} of {names[int(rnd.integers(0, 3))]} " + ("not " if rnd.random() < 0.3 else "") + f"{int(rnd.integers(0, 3))}"
            rows.append((topic, k, k // 2, "sentence", text, float(rnd.integers(0, 20)), (base[c] + rnd.normal(scale=0.05, size=4)).tolist()))
    df = spark.createDataFrame(rows, "topic string, id long, doc long, kind string, text string, score double, vector array<double>")
    signature = {(r["topic"], r["id"]): r["s"] for r in df.select("topic", "id", guard_signature(F.col("text")).alias("s")).collect()}
    budgets, threshold, weight = (3, 7), 0.92, 0.7
    expected = []
    for topic in ("a", "b"):
        own = [r for r in rows if r[0] == topic]
        groups = {}
        for r in own:
            groups.setdefault((r[3], r[4]), []).append(r)
        heads = sorted((min(g, key=lambda r: (-r[5], r[1])) for g in groups.values()), key=lambda r: (-r[5], r[1]))[: 10 * max(budgets)]
        cos = lambda u, v: float(np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)))
        clusters = []
        for rank, r in enumerate(heads, 1):
            found = next((c for c in clusters if signature[topic, c[0][1]] == signature[topic, r[1]] and cos(c[0][6], r[6]) >= threshold), None)
            if found:
                found[2].append(r)
            else:
                clusters.append((r, rank, [r]))
        chosen = []
        while clusters and len(chosen) < max(budgets):
            worth = lambda c: weight / c[1] - (1 - weight) * max([cos(c[0][6], s[0][6]) for s in chosen], default=0.0)  # noqa: B023, E731
            best = max(clusters, key=lambda c: (round(worth(c), 12), -c[1]))
            clusters.remove(best)
            chosen.append(best)
        expected += [(topic, c[0][1], k, len(c[2]), min(b for b in budgets if k <= b)) for k, c in enumerate(chosen, 1)]
    found = select_evidence(df, budgets, threshold, weight).select("topic", "id", "place", "groups", "budget").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_bootstrap_equals_numpy_on_the_same_draws(spark):
    x = np.sort(np.random.default_rng(1).normal(size=37).round(3))
    draws, means = np.random.default_rng(5), []
    for _ in range(2):
        means.append([np.mean([x[k] for k in row]) for row in draws.integers(0, 37, (5000, 37))])
    low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(2).permutation(x)] + [(None,)], "delta double").repartition(5)
    r = stats.bootstrap(df, samples=10_000, seed=5).first()
    assert abs(r["mean"] - x.mean()) < 1e-12 and abs(r["low"] - low) < 1e-12 and abs(r["high"] - high) < 1e-12 and r["n"] == 37
