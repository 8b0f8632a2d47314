"""Shared fixtures of small documents."""

import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, near copies, shared passages, and awkward values."""
    rnd = random.Random(4)
    words = ["the", "of", "And", "straße", "señor", "x1", "alpha", "beta", "gamma", "delta", "été", "run", "tree", "stone"]
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".", str(rnd.randrange(50))]) for _ in range(n))
    passage = make(40)
    rows = [(k, make(rnd.randrange(1, 90))) for k in range(40)]
    rows += [(40 + k, rows[k][1]) for k in range(8)]
    rows += [(50 + k, rows[k][1] + " " + make(2)) for k in range(12)]
    rows += [(70 + k, make(20) + " " + passage + " " + make(15)) for k in range(10)]
    long = make(30_000)
    rows += [(90, ""), (91, None), (92, " \n\t "), (93, "one"), (94, "one two"), (95, long), (96, long + " end"), (97, "a" * 5_000), (98, "ab " * 900), (99, None), (100, make(60)), (100, make(60))]
    return rows + [(None, rows[3][1]), (None, make(70))]
