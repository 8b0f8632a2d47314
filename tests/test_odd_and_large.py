"""Words beside other scripts, and steps whose tasks must stay small as tables grow."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery import catalog
from orrery.functions import text as X
from orrery.operators import extensions as E
from orrery.operators import greedy as G
from orrery.operators import ranking as R

SF = "/root/testdata/sf0.001"


def test_word_ends_are_those_of_sql(spark):
    """A letter of another script ends a word of A-Z, as it does in the SQL twins."""
    texts = ["it is noé", "én not", "neveŕ", "note", "a_no", "no.", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    got = df.select("k", X.guard_signature(t).alias("g"), X.depends(F.concat(F.lit("but"), t)).alias("d"), X.clean_query(F.concat(F.lit("é"), F.upper(t))).alias("c")).orderBy("k").collect()
    assert [r["g"] for r in got] == ["|neg|", "|neg|", "|neg|", "||", "||", "|neg|", None]
    assert [r["d"] for r in got] == [False, True, False, False, False, False, None]
    assert [r["c"] for r in got] == [True, False, True, True, True, True, None]


def test_best_sentences_are_those_of_all_pairs(spark):
    """Also where a document comes twice, has no sentence, or meets a query without text; and pairs never are rows."""
    docs = spark.createDataFrame([(1, 5, ["The cat sat. A dog ran!\nA dog ran!", None, "cats and dogs."]), (1, 6, [" \n "]), (2, 7, ["x y."])], "topic long, doc long, texts array<string>")
    subs = spark.createDataFrame([(1, 1, "dog cat"), (1, 2, "the"), (1, 3, None), (2, 4, "zebra")], "topic long, sub long, query string")
    found = sorted(map(tuple, E.best_sentences(docs, subs).collect()))
    assert found == [(1, 5, 1, 4, 0.5), (1, 5, 2, 4, 0.0), (1, 5, 3, 4, None), (2, 7, 4, 1, 0.0)]
    plan = catalog.QUERIES["sentence_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_hold_no_group_in_a_task(spark):
    rnd = np.random.default_rng(5)
    rows = [(None if k % 7 == 0 else k % 3, k, None if k % 11 == 0 else float(rnd.integers(0, 20))) for k in range(400)]
    df = spark.createDataFrame(rows, "topic long, doc long, score double")
    order = (F.desc("score"), "doc")
    made, plain = R.numbered(df, *order), R.ranked(df, *order)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, plain.select(made.columns).collect()))
    w = Window.partitionBy("topic")
    n, ties = F.count(F.lit(1)).over(w), F.count(F.lit(1)).over(Window.partitionBy("topic", "score"))
    plain = df.withColumn("p", (n - (F.rank().over(w.orderBy(F.desc("score"))) - 1) - ties + (ties - 1) / 2) / (n - 1))
    assert sorted(map(repr, R.percentile_midrank(df, "score", name="p").collect())) == sorted(map(repr, plain.collect()))
    assert "row_number" not in plan_of(catalog.QUERIES["three_orders"](spark, SF))
    assert "rank(" not in plan_of(catalog.QUERIES["percentile_midrank"](spark, SF))


def test_responses_are_parsed_once(spark):
    assert "MapInArrow" not in plan_of(catalog.QUERIES["response_faults"](spark, SF))


def test_terms_of_a_topic_are_numbers(spark, monkeypatch):
    """In arrays or texts, in whatever order rows come, and put in order some at a time."""
    rnd, n = np.random.default_rng(9), 60
    words = [f"w{k}" for k in range(12)]
    terms = [[w for w in words if rnd.random() < 0.85] if k % 9 else [] for k in range(n)]
    rows = [("a" if k % 3 else "b", k, terms[k], float(rnd.random()), float(rnd.random()), float(rnd.random()), [float(rnd.random())] * 2, k, n - k) for k in rnd.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "topic string, doc long, terms array<string>, g double, n double, r double, facets array<double>, original_rank long, best_facet_rank long")
    expected = pd.concat([G.dual_order(own) for _, own in df.toPandas().groupby("topic")])
    for made in (df, df.withColumn("terms", F.array_join("terms", " "))):
        found = G.arm(made, "DUAL")
        assert "InPandas" not in plan_of(found)
        assert sorted(map(tuple, found.collect())) == sorted(expected.itertuples(index=False, name=None))
    whole = G._Terms(terms)
    monkeypatch.setattr(G, "_BLOCK", 30)
    parts = G._Terms(terms)
    for k in range(n):
        assert all(np.array_equal(a, b) for a, b in zip(whole.redundant(k), parts.redundant(k)))


def greedy_rows(n, seed, levels):
    """Two topics with ties everywhere, or none, and many near copies."""
    rnd = np.random.default_rng(seed)
    many = lambda *s: rnd.integers(0, levels, s) / levels if levels else rnd.random(s)
    words = np.array([f"w{k}" for k in range(12)])
    return pd.DataFrame({
        "topic": np.where(np.arange(n) % 3, "a", "b"), "doc": np.arange(n), "facets": [x.tolist() for x in many(n, 3)], "g": many(n), "n": many(n), "r": many(n), "original_rank": rnd.permutation(n) // 2,
        "best_facet_rank": rnd.integers(0, 3, n), "terms": [words[rnd.random(12) < 0.8].tolist() if k % 9 else [] for k in range(n)],
    })


GREEDY = "topic string, doc long, facets array<double>, g double, n double, r double, original_rank long, best_facet_rank long, terms array<string>"


def test_orders_without_redundancy_hold_no_topic_in_a_task(spark):
    for seed, levels, prefix in ((1, 4, 0), (2, 0, 7)):
        rows = greedy_rows(300, seed, levels)
        made = G.arm(spark.createDataFrame(rows, GREEDY).repartition(5), "DUAL-NR", prefix)
        assert "MapInArrow" not in plan_of(made)
        expected = pd.concat([G.dual_order(own, False, prefix) for _, own in rows.groupby("topic")])
        assert sorted(map(tuple, made.collect())) == sorted(expected.itertuples(index=False, name=None))


def test_orders_with_redundancy_hold_no_topic_in_a_task(spark):
    """Also with copies and empty sets among replayed rows, terms as texts, and a topic that is replayed whole."""
    rows = greedy_rows(300, 3, 4)
    rows["topic"] = np.where(np.arange(300) < 5, "c", rows["topic"])
    df = spark.createDataFrame(rows, GREEDY).repartition(5)
    first = df.select("topic", "doc", F.lit(1).alias("rank"))
    made = G.arms(df.withColumn("terms", F.array_join("terms", " ")), first, (7, 40)).where("arm <> 'RRF'")
    assert "MapInArrow" not in plan_of(made)
    expected = []
    for name, use in (("DUAL", True), ("DUAL-NR", False)):
        for prefix in (0, 7, 40):
            for _, own in rows.groupby("topic"):
                found = G.dual_order(own, use, prefix)[["topic", "doc", "final_rank"]]
                expected += found.assign(arm=f"{name}-{prefix}" if prefix else name).itertuples(index=False, name=None)
    assert sorted(map(tuple, made.collect())) == sorted(expected)
    found = G.arm(df, "DUAL", 7).collect()
    expected = pd.concat([G.dual_order(own, True, 7) for _, own in rows.groupby("topic")])
    assert sorted(map(tuple, found)) == sorted(expected.itertuples(index=False, name=None))


def test_sets_that_only_share_terms_do_not_move_with_each_pair(spark):
    from orrery.operators import copies
    from tests.llm.test_jaccard import shuffled

    rnd = random.Random(6)
    words = [f"w{k}" for k in range(4_000)]
    sets = [rnd.sample(words, rnd.randrange(950, 1_050)) for _ in range(200)]
    sets += [own[:-1] for own in sets[:20]] + [own[:-40] + ["new"] for own in sets[:10]] + [sets[30], sets[31][:30], sets[31][:29]]
    rows = [(1, k, " ".join(own)) for k, own in enumerate(sets)] + [(2, 5_000, " ".join(sets[0])), (2, 5_001, ""), (1, 5_002, None)]
    df = spark.createDataFrame(rows, "topic long, doc long, terms string").repartition(4).cache()
    before = shuffled(spark) if df.count() else 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are large
    try:
        made = copies.linked(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    found = {r["doc"]: r for r in made.collect()}
    heads = {r["head"]: r["doc"] for r in found.values() if r["head"] is not None}
    expected, distinct = {}, [set(own) for own in sets]
    for i, a in enumerate(distinct):
        for j, b in enumerate(distinct):
            if a != b and (x := len(a & b) / len(a | b)) > 0.8:
                expected.setdefault(i, {})[frozenset(b)] = (x - 0.8) / 0.2
    for k in range(len(sets)):
        near = {frozenset(distinct[heads[x["head"]]]): x["p"] for x in found[k]["links"] or ()}
        assert near == expected.get(k, {}) or (k in (30, 230) and not near), k
        assert (found[k]["component"] is not None) == (k in expected or k in (30, 230))
    assert found[5_000]["component"] is None and found[5_001]["head"] is None and found[5_002]["head"] is None
    size = sum(8 * len(own) for own in sets)
    assert moved < 20 * size, (moved, size)
