"""Operators that SQL cannot express, guards, and small goldens."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.functions import numbers as N
from orrery.functions import text as X
from orrery.operators import admission as A
from orrery.operators import bundles as B
from orrery.operators import folds
from orrery.operators import answers as AN
from orrery.operators import greedy as G
from orrery.operators import stores as ST
from orrery.operators import joins as J
from orrery.operators import passages as P
from orrery.operators import ranking as R
from orrery.operators import stats as S


def test_fusion_rejects_bad_parameters(spark):
    hits = spark.createDataFrame([("t", "a", 1, 1, 1.0)], "topic string, stream string, doc long, rank long, score double")
    for k in (0, math.inf, math.nan):
        with pytest.raises(ValueError):
            R.rrf(hits, k)
    with pytest.raises(ValueError):
        R.rrf(hits, 60, {"a": -1.0})
    with pytest.raises(Exception, match="no weight for stream a"):
        R.rrf(hits, 60, {"b": 1.0}).collect()


def test_percentiles_share_ties(spark):
    df = spark.createDataFrame([("t", k, v) for k, v in enumerate([1.0, 2.0, 2.0, 4.0])] + [("u", 9, 5.0)], "topic string, doc long, score double")
    values = lambda f: [r["percentile"] for r in f(df, "score").orderBy("topic", "doc").collect()]
    assert values(R.percentile_midrank) == [0.0, 0.5, 0.5, 1.0, 1.0]
    assert values(R.percentile_average_rank) == [0.0, 0.5, 0.5, 1.0, 1.0]
    assert values(R.percentile_best_one) == [0.25, 0.625, 0.625, 1.0, 1.0]


def test_admission_golden(spark):
    rows = [("t", lane, f"d{k}", float(v)) for lane, vs in {"original": [0, 1, 2, 3, 20], "facet": [30, 3, 2, 1, 0]}.items() for k, v in enumerate(vs)]
    lanes = spark.createDataFrame(rows, "topic string, lane string, doc string, score double")
    limits = A.thresholds(lanes).collect()
    assert {(r["median"], r["mad"]) for r in limits} == {(2.0, 1.0)} and all(abs(r["threshold"] - (2 + 2.5 * 1.4826)) < 1e-12 for r in limits)
    core = A.core(lanes)
    assert sorted((r["doc"], r["lanes"]) for r in core.collect()) == [("d0", 1), ("d4", 1)]
    assert [tuple(r) for r in A.multiplicity(core).collect()] == [("t", 1, 2)]
    flat = spark.createDataFrame([("t", "a", "x", 1.0), ("t", "a", "y", 1.0)], "topic string, lane string, doc string, score double")
    assert [tuple(r) for r in A.core(flat).collect()] == [("t", "x", 0)]


def test_weighted_scores(spark):
    df = spark.createDataFrame([("t", 1, 0, 0, 100, 4.0), ("t", 1, 1, 50, 150, 3.0), ("t", 1, 2, 100, 200, 2.0)], "topic string, doc long, chunk long, start long, end long, score double")
    r = P.suppressed_top4(df).first()
    assert r["n_kept"] == 2 and abs(r["score"] - 3.375) < 1e-12


def greedy_rows(n, rnd):
    return pd.DataFrame(
        {
            "topic": "t", "doc": np.arange(n), "facets": [list(rnd.random(3)) for _ in range(n)], "g": rnd.random(n), "n": rnd.random(n),
            "r": rnd.random(n), "original_rank": rnd.permutation(n) + 1, "best_facet_rank": rnd.permutation(n) + 1,
            "terms": [sorted({f"w{x}" for x in rnd.integers(0, 6, 5)}) for _ in range(n)],
        }
    )


def slow_dual(rows, use_redundancy, prefix, slack=1e-12):
    """One document at a time, by the objective's definition."""
    docs, order = rows.set_index("doc").to_dict("index"), []
    replay = sorted(docs, key=lambda d: docs[d]["original_rank"])[:prefix]

    def redundancy(d):
        best = 0.0
        for s in order:
            a, b = set(docs[d]["terms"]), set(docs[s]["terms"])
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                j = len(a & b) / len(a | b)
                best = max(best, 0.0 if j < 0.8 else 1.0 if j == 1 else (j - 0.8) / 0.2)
        return best

    def value(d):
        f = docs[d]["facets"]
        cover = [max([docs[s]["facets"][k] for s in order], default=0.0) for k in range(3)]
        bonus = max(x * (1 - c) for x, c in zip(f, cover))
        v = 0.35 * docs[d]["g"] + 0.15 * docs[d]["n"] + 0.15 * docs[d]["r"] + 0.25 * max(f) + 0.10 * bonus
        return v - 0.15 * redundancy(d) if use_redundancy else v

    while len(order) < len(docs):
        if len(order) < prefix:
            order.append(replay[len(order)])
            continue
        left = [d for d in docs if d not in order]
        best = max(value(d) for d in left)
        ties = [d for d in left if abs(value(d) - best) <= slack]
        order.append(min(ties, key=lambda d: (-docs[d]["r"], -max(docs[d]["facets"]), docs[d]["original_rank"], docs[d]["best_facet_rank"], d)))
    return order


def test_dual_equals_its_definition():
    rnd = np.random.default_rng(4)
    for prefix in (0, 5):
        for use in (True, False):
            rows = greedy_rows(25, rnd)
            found = G.dual_order(rows.sample(frac=1, random_state=1), use, prefix)
            expected = slow_dual(rows, use, prefix)
            assert list(found["doc"]) == expected and list(found["final_rank"]) == list(range(1, 26))


def test_facet_order_covers_first():
    rows = greedy_rows(4, np.random.default_rng(1))
    rows["facets"] = [[1.0, 0.0, 0.0], [0.9, 0.0, 0.0], [0.0, 0.9, 0.0], [0.0, 0.0, 0.8]]
    rows["r"] = 0.5
    assert list(G.facet_order(rows)["doc"]) == [0, 2, 3, 1]


def slow_facet(rows):
    """Every step computes every row anew."""
    m, left, out = np.array(rows["facets"].tolist()), list(range(len(rows))), []
    covered = np.zeros(m.shape[1])
    while left:
        gain = {k: m[k] * (1 - covered) for k in left}
        key = {k: (-(0.70 * m[k].max() + 0.30 * gain[k].max()), -rows["r"][k], m[k].argmax(), gain[k].argmax(), rows["original_rank"][k], rows["best_facet_rank"][k], k) for k in left}
        best = min(left, key=key.get)
        left.remove(best)
        covered = np.maximum(covered, m[best])
        out.append(best)
    return out


def test_lazy_orders_equal_stepwise_ones():
    """Few distinct values, so that ties are everywhere, and many near copies."""
    rnd = np.random.default_rng(9)
    for n in (1, 40, 120):
        words = np.array([f"w{k}" for k in range(12)])
        rows = pd.DataFrame({
            "topic": "t", "doc": np.arange(n), "facets": list(rnd.integers(0, 4, (n, 3)) / 4), "g": rnd.integers(0, 3, n) / 2, "n": rnd.integers(0, 2, n) / 1.0, "r": rnd.integers(0, 3, n) / 2,
            "original_rank": rnd.permutation(n) // 2, "best_facet_rank": rnd.integers(0, 3, n), "terms": [words[rnd.random(12) < 0.8].tolist() for _ in range(n)],
        })
        assert list(G.facet_order(rows)["doc"]) == slow_facet(rows)
        for prefix in (0, 7):
            for use in (True, False):
                assert list(G.dual_order(rows, use, prefix)["doc"]) == slow_dual(rows, use, prefix, 0.0)


def test_many_candidates_of_one_topic():
    """More than a topic could once have; each step computes few of them anew."""
    rnd, n = np.random.default_rng(3), 30_000
    words = np.array([f"w{k}" for k in range(4000)])
    rows = pd.DataFrame({
        "topic": "t", "doc": np.arange(n), "facets": list(rnd.random((n, 5))), "g": rnd.random(n), "n": rnd.random(n), "r": rnd.random(n), "original_rank": rnd.permutation(n),
        "best_facet_rank": rnd.permutation(n), "terms": [words[rnd.integers(0, 4000, 10)].tolist() for _ in range(n)],
    })
    made = G.dual_order(rows)
    assert sorted(made["doc"]) == list(range(n)) and (np.diff(made["objective"]) <= 1e-12).all()


def test_splices_rejected_for_their_range_reject_no_other(spark):
    sentences = spark.createDataFrame([("t", k, f"s{k}") for k in range(5)], "topic string, idx long, text string")
    ops = spark.createDataFrame([("t", 1, 0, 99, "x"), ("t", 2, 1, 1, "y"), ("t", 3, 1, 2, "z"), ("t", 4, 2, 2, "w"), ("t", 5, -1, 0, "v")], "topic string, op long, first long, last long, text string")
    answers, rejected = AN.splice_operations(sentences, ops)
    assert [r["text"] for r in answers.orderBy("idx").collect()] == ["s0", "y", "w", "s3", "s4"]
    assert sorted((r["op"], r["reason"]) for r in rejected.collect()) == [(1, "range"), (3, "overlap"), (5, "range")]


def test_malformed_responses_stop_no_other(spark):
    bodies = ["not json", "[1]", '{"hits": {"a": 1}}', '{"hits": [1, {"id": "a", "rank": "x", "text": "t"}]}', '{"hits": [{"id": "b", "rank": "2", "score": "high", "text": "t"}]}', '{"hits": [{"id": "c", "score": "1.5"}]}', None, "{}", '{"hits": [{"id": "d", "rank": 1.5, "score": NaN}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "response long, body string")
    hits = {(r["response"], r["doc"], r["rank"], r["score"]) for r in ST.normalised(df).collect()}
    assert hits == {(3, "a", 2, None), (4, "b", 2, None), (5, "c", 1, 1.5), (8, "d", 1, None)}
    assert {r["response"]: r["fault"] for r in ST.body_faults(df).collect()} == {0: "not json", 1: "not an object", 2: "hits", 3: "hit", 4: "score", 8: "rank"}


def test_strict_responses_have_exact_fields(spark):
    import json

    hit = lambda **x: {"doc": "body", "docid": "a", "rank": 1, "score": 0.5} | x
    whole = lambda *hits, **x: {"api": "v1", "candidates": list(hits), "index": "i", "query": {"text": "q"}} | x
    less = hit()
    del less["score"]
    cases = [
        (whole(hit(), hit(rank=2, docid="b")), None), (whole(), None), (whole(more=1), "response fields"), (whole(api="v2"), "api or index"), (whole(index=" "), "api or index"),
        (whole(query={"text": "q", "k": 1}), "query fields"), (whole(query={"text": None}), "query fields"), (whole(candidates={}), "candidates"), (whole(less), "candidate fields"),
        (whole(hit(extra=1)), "candidate fields"), (whole(hit(rank=True)), "rank"), (whole(hit(rank=0)), "rank"), (whole(hit(), hit()), "repeated rank"), (whole(hit(score=float("nan"))), "score"),
        (whole(hit(score="1")), "score"), (whole(hit(docid=" ")), "document"), (whole(hit(doc={"text": "x"})), "text"), (whole(hit(), hit(rank=2, doc="other")), "two bodies"),
    ]
    rows = [(k, json.dumps(w)) for k, (w, _) in enumerate(cases)] + [(99, "{"), (98, None)]
    found = {r["response"]: r["fault"] for r in ST.body_faults(spark.createDataFrame(rows, "response long, body string"), strict=True).collect()}
    assert found == {k: f for k, (_, f) in enumerate(cases) if f} | {99: "not json", 98: "not json"}


def test_round_robin(spark):
    rows = [("t", "a", 1, 1), ("t", "a", 2, 2), ("t", "a", 3, 3), ("t", "b", 1, 1), ("t", "b", 2, 2), ("t", "c", 9, 1)]
    lanes = spark.createDataFrame(rows, "topic string, lane string, doc long, rank long")
    out = G.round_robin(lanes, 4)
    assert [(r["doc"], r["lane"], r["lane_rank"]) for r in out.orderBy("final_rank").collect()] == [(1, "a", 1), (2, "b", 2), (9, "c", 1), (3, "a", 3)]
    status = {r["lane"]: (r["available"], r["selected"], r["skipped"]) for r in G.lane_status(lanes, out).collect()}
    assert status == {"a": (3, 2, 1), "b": (2, 1, 1), "c": (1, 1, 0)}


def test_clusters_snippets_and_matching(spark):
    items = spark.createDataFrame([("t", 1, "s", [1.0, 0.0]), ("t", 2, "s", [0.99, 0.1]), ("t", 3, "x", [1.0, 0.0]), ("t", 4, "s", [0.0, 1.0])], "topic string, id long, signature string, vector array<double>")
    assert [(r["id"], r["leader"]) for r in G.leader_clusters(items).orderBy("id").collect()] == [(1, 1), (2, 1), (3, 3), (4, 4)]
    snippets = spark.createDataFrame([(1, 1, 0, 10, "One  a", 3.0), (1, 2, 50, 60, "one a", 2.0), (1, 3, 1, 10, "b", 1.0), (1, 4, 8, 20, "c", 0.5)], "doc long, id long, start long, end long, text string, score double")
    assert sorted(r["id"] for r in G.distinct_snippets(snippets).collect()) == [1, 4]
    pairs = spark.createDataFrame([("t", 1, 1, 0.9), ("t", 1, 2, 0.8), ("t", 2, 1, 0.7), ("t", 2, 2, 0.1)], "topic string, a long, b long, score double")
    assert sorted((r["a"], r["b"]) for r in G.one_to_one(pairs).collect()) == [(1, 1), (2, 2)]


def test_merge_conflicts(spark):
    target = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    source = spark.createDataFrame([(2, 2.5), (3, 3.0), (3, 3.0), (1, 1.0)], "k long, v double")
    merged, conflicts = J.merge(target, source, ["k"], "v")
    assert sorted(map(tuple, merged.collect())) == [(1, 1.0, "equal"), (2, 2.0, "conflict"), (3, 3.0, "inserted")]
    assert [tuple(r) for r in conflicts.collect()] == [(2, 2.0, 2.5)]
    kept, _ = J.merge(target, source, ["k"], "v", strict=False)
    assert {r["action"] for r in kept.collect()} == {"equal", "kept", "inserted"}


def test_guards(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="has no match"):
        J.strict_lookup(left, right, ["k"]).collect()
    with pytest.raises(ValueError):
        B.without_labels(spark.createDataFrame([(1, 2)], "doc long, grade long"))
    assert J.same_rows(left.union(left), left.unionAll(left)) and not J.same_rows(left, left.union(left))


def test_sign_flip_and_bootstrap(spark):
    deltas = [0.1, -0.2, 0.3, 0.05]
    df = spark.createDataFrame([(x,) for x in deltas], "delta double")
    sums = [sum(x if k >> i & 1 else -x for i, x in enumerate(map(abs, deltas))) for k in range(16)]
    r = S.sign_flip(df).first()
    assert (r["reached"], r["patterns"]) == (sum(s >= sum(deltas) - 1e-12 for s in sums), 16)
    b = S.bootstrap(df, samples=4000).first()
    assert b["low"] < b["mean"] < b["high"] and b["n"] == 4


def test_text_functions(spark):
    df = spark.createDataFrame([("The  organization's Relational models, 2.5 not running in Paris.\nNext one",)], "t string")
    r = df.select(X.terms(F.col("t")).alias("terms"), X.guard_signature(F.col("t")).alias("g"), X.sentences(F.col("t")).alias("s"), X.word_count(F.col("t")).alias("n"), X.inner_boundaries(F.lit("Dr. Smith came. He left. J. Doe")).alias("b")).first()
    assert r["terms"] == ["organize", "s", "relate", "model", "2", "5", "not", "runn", "pari", "next", "one"]
    assert r["g"] == "2.5|neg|paris,relational"
    assert [s["complete"] for s in r["s"]][-1] is False and r["n"] == 11 and r["b"] == 2


def test_table_digest_ignores_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") % 7)
    b = a.orderBy(F.desc("id")).repartition(5)
    assert N.table_digest(a).first() == N.table_digest(b).first() != N.table_digest(a.where("id > 0")).first()


def test_expected_paragraph_rules(spark):
    rows = [(1, 0, 10, True, False), (1, 11, 20, False, True), (1, 21, 30, True, True), (1, 31, 5000, True, True)]
    out = folds.paragraphs(spark.createDataFrame(rows, "doc long, start long, end long, complete boolean, blank_before boolean"))
    assert sorted((r["start"], r["end"], r["sentences"]) for r in out.collect()) == [(0, 10, 1), (11, 30, 2), (31, 5000, 1)]

    # Length is counted from the paragraph's own beginning.
    rows = [(2, 0, 2000, True, False), (2, 2001, 3600, True, False), (2, 3601, 6500, True, False), (2, 6501, 6600, True, False)]
    out = folds.paragraphs(spark.createDataFrame(rows, "doc long, start long, end long, complete boolean, blank_before boolean"))
    assert sorted((r["start"], r["end"]) for r in out.collect()) == [(0, 2000), (2001, 3600), (3601, 6600)]


def test_claims_extend_by_their_holder_only(spark):
    rows = [("k", 0, 0, "a", False), ("k", 3000, 1, "b", False), ("k", 5400, 2, "b", False), ("k", 5500, 3, "a", True), ("k", 5600, 4, "b", True), ("k", 9999, 5, "a", False)]
    out = folds.claims(spark.createDataFrame(rows, "key string, at long, place long, worker string, done boolean"))
    assert [r["result"] for r in out.orderBy("place").collect()] == ["claimed", "busy", "reclaimed", "lost", "scored", "cached"]


def test_rejected_rows_do_not_use_up_their_ids(spark):
    row = lambda seq, section, id, **x: dict(ledger=1, seq=seq, place=0, section=section, id=id, needs=[], facets=[], nuggets=[], snippets=[], status=None, reason=None, other=None, grounded=True) | x
    rows = [
        row(1, "nugget", "g", needs=["n"], snippets=["s"]), row(2, "need", "n"), row(2, "read", "s", other="d"), row(3, "nugget", "g", needs=["n"], snippets=["s"]), row(4, "nugget", "g", needs=["n"], snippets=["s"]),
        row(5, "nugget", "h", needs=["n"], snippets=["s"], nuggets=["g"]), row(6, "need_status", "n", status="conflicted", nuggets=["g", "h"]), row(7, "supersede", "g", other="h"),
        row(8, "need_status", "n", status="partial", nuggets=["g"]), row(9, "facet", "f", needs=["n"]), row(10, "facet_status", "f", status="covered", nuggets=["h"]), row(11, "facet_status", "f", status="dropped", reason="r"),
        row(12, "abandon", "d", reason="r"), row(13, "abandon", "x", reason="r"), row(14, "evidence", "h", snippets=["s"]), row(15, "oddity", "x"), row(16, "need_status", "n", status="partial", nuggets=["h"] * 9),
    ]
    schema = "ledger long, seq long, place long, section string, id string, needs array<string>, facets array<string>, nuggets array<string>, snippets array<string>, status string, reason string, other string, grounded boolean"
    out = folds.evidence_ledger(spark.createDataFrame(rows, schema)).orderBy("seq", "section").collect()
    assert [r["code"] for r in out] == [
        "UNKNOWN_NEED", "ACCEPTED", "ACCEPTED", "ACCEPTED", "DUPLICATE_ID", "ACCEPTED", "ACCEPTED", "ACCEPTED", "MISSING_GROUNDED_DRAFT", "ACCEPTED", "MISSING_GROUNDED_NUGGET", "ACCEPTED",
        "ACCEPTED", "UNKNOWN_DOCUMENT", "DUPLICATE_EVIDENCE", "UNKNOWN_SECTION", "TOO_MANY_DRAFT_NUGGETS",
    ]
    assert out[-1]["version"] == 9 and len({r["state_sha256"] for r in out}) == 10


def test_next_doubles_below(spark):
    values = [1.0, 0.0, -0.0, 2.5e-300, -7.25, 4.9e-324, 1e308]
    for steps in (1, 2, 1000):
        df = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.next_below(F.col("v"), F.lit(steps)).alias("b"))
        for r in df.collect():
            x = r["v"]
            for _ in range(steps):
                x = math.nextafter(x, -math.inf)
            assert r["b"] == x


def test_tail_scores_fall_below_the_head(spark):
    docs = spark.createDataFrame([("t", d, d, 10.0 - d) for d in range(1, 6)], "topic string, doc long, rank long, score double")
    w = spark.createDataFrame([("t", d, 0, 0, 900, 1.0) for d in (1, 2)], "topic string, doc long, chunk long, start long, end long, score double")
    out = P.coverage_aware(docs, w, 2).orderBy("final_rank").collect()
    scores = [r["final_score"] for r in out]
    assert [r["rank"] for r in out] == [1, 2, 3, 4, 5] and all(a > b for a, b in zip(scores, scores[1:])) and scores[1] - scores[4] < 1e-12


def test_streams_must_agree_on_texts(spark):
    hits = spark.createDataFrame([("t", "a", 1, 1, "x"), ("t", "b", 1, 2, "x"), ("t", "b", 2, 1, None), ("t", "a", 2, 3, "y")], "topic string, stream string, doc long, rank long, text string")
    rows = J.union_provenance(hits, "text").orderBy("doc").collect()
    assert [(r["doc"], r["streams"], r["text"]) for r in rows] == [(1, 2, "x"), (2, 2, "y")]
    with pytest.raises(Exception, match="different texts of 1"):
        J.union_provenance(hits.unionByName(spark.createDataFrame([("t", "c", 1, 1, "z")], hits.schema)), "text").collect()


def test_breadth_counts_passages_after_suppression(spark):
    base = [("t", "A", 100 + k, 0.0, 0, 100) for k in range(20)]
    rows = base + [("t", "A", 1, 9.0, 0, 100), ("t", "A", 1, 8.0, 40, 140), ("t", "A", 1, 7.0, 200, 300), ("t", "A", 1, 6.9, 301, 400), ("t", "A", 1, 6.8, 401, 500), ("t", "B", 1, 0.0, 0, 10)]
    df = spark.createDataFrame(rows, "topic string, lane string, doc long, score double, start long, end long")
    assert [tuple(r) for r in A.passage_breadth(df).where("doc = 1").collect()] == [("t", 1, 1, 3)]
    assert [r["n_hits"] for r in A.passage_breadth(df, per_document=9).where("doc = 1").collect()] == [4]


def test_stage_deltas_refuse_counters_that_fall(spark):
    df = spark.createDataFrame([("t", 1, "calls", 3), ("t", 2, "calls", 5), ("t", 1, "hits", 1)], "topic string, stage long, counter string, value long")
    assert sorted((r["stage"], r["counter"], r["delta"]) for r in B.stage_deltas(df).collect()) == [(1, "calls", 3), (1, "hits", 1), (2, "calls", 2)]
    with pytest.raises(Exception, match="counter fell: hits"):
        B.stage_deltas(df.unionByName(spark.createDataFrame([("t", 2, "hits", 0)], df.schema))).collect()
