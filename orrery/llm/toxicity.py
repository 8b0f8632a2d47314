"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity has ordered grades 0 .. ``len(CUTS) + 1``.  One weight vector is shared by all
thresholds: P(grade <= k) is logistic(threshold k - weights . features), thresholds
ascending.  Weights are not negative (severity is what a text has, never what it lacks,
so a text without such features gets the lowest grade) and carry an L1 penalty, so that
most features drop out and scoring sums the few that a text has.  A text's severity is its expected grade.

Labels say only whether a document is toxic.  Grades of toxic training rows follow from
how densely they use features that toxic rows have far more often than others: rows
above the quantiles ``CUTS`` of that density get the higher grades.

The model is fitted in one task on a bounded sample of labelled rows: of either class
the ``CLASS_ROWS`` with the smallest hash of their id, and of those, in that order, as many
as have ``features.SAMPLE_FEATURES`` features together.  The fit stops early by design,
after ``STEPS`` steps.  Scoring reads whole texts only.

Input rules: null and empty texts have no features and are scored by the thresholds
alone; rows without labels never train; of several documents with one id the text with
the smallest hash trains; with one class only, every severity is that
class's; repeated rows score alike; texts of any length are scored whole; an empty table
gives no rows; other columns stay, but those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import features
from orrery.llm.arrow import pieces, texts_of, trim

#: Labelled rows of either class that a model is fitted on.
CLASS_ROWS = 2_000
#: Features that enter the regression, and rows of a class that must have one.
CHOSEN, LEAST_ROWS = 3_000, 4
#: Quantiles of density that part the toxic grades.
CUTS = (0.5,)
PENALTY, STEPS = 1e-4, 300
#: A text is called toxic from this probability of a grade above 0 on.
CALLED = 0.3


def grades_of(rows: list[np.ndarray], lengths: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grade of each row, the features chosen for the regression)."""
    with_it = np.zeros((2, features.SIZE))
    for row, y in zip(rows, toxic):
        with_it[y][row] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    share = (with_it + 0.5) / (n[:, None] + 1)
    pooled = with_it.sum(axis=0) / n.sum()
    z = (share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n).sum() + 1e-9)
    z[with_it.max(axis=0) < LEAST_ROWS] = 0
    chosen = np.argsort(-z, kind="stable")[:CHOSEN]
    chosen = np.sort(chosen[z[chosen] > 0])
    marks = np.zeros(features.SIZE, bool)
    marks[(share[1] > 10 * share[0]) & (with_it[1] >= LEAST_ROWS)] = True
    density = np.array([marks[row].sum() for row in rows]) / np.sqrt(lengths + 100.0)
    grade = np.zeros(len(rows), int)
    bad = toxic == 1
    grade[bad] = 1 + np.searchsorted(np.quantile(density[bad], CUTS), density[bad], side="left")
    return grade, chosen


def fit(rows: list[np.ndarray], lengths: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of all features, then the thresholds."""
    size, cuts = features.SIZE, len(CUTS) + 1
    out = np.zeros(size + cuts, np.float32)
    share = toxic.mean() if len(toxic) else 0.0
    if share in (0.0, 1.0):
        out[size:] = np.arange(cuts) + (20.0 if share == 0 else -20.0 - cuts)
        return out
    grade, chosen = grades_of(rows, lengths, toxic)
    to = np.full(size, -1)
    to[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, row in enumerate(rows):
        own = to[row]
        x[k, own[own >= 0]] = 1
    weights, cut = np.zeros(len(chosen)), np.linspace(1.0, 2.0, cuts)
    # Accelerated proximal gradient; the step is the inverse of a bound on the curvature.
    v = np.ones(len(chosen), np.float32)
    for _ in range(8):
        v = (x @ v) @ x
        norm = np.linalg.norm(v)
        v /= norm
    step = 2 * len(rows) / norm
    ahead, momentum = weights, 1.0
    for _ in range(STEPS):
        f = (x @ ahead.astype(np.float32)).astype(float)
        slope, cut_slope = _gradient(f, grade, cut)
        new = ahead - step * (slope.astype(np.float32) @ x) / len(rows)
        new = np.maximum(new - step * PENALTY, 0)
        cut = cut - 1.0 * cut_slope / len(rows)
        for k in range(1, cuts):
            cut[k] = max(cut[k], cut[k - 1] + 1e-3)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weights, momentum = new + (momentum - 1) / next_momentum * (new - weights), new, next_momentum
    out[chosen], out[size:] = weights, cut
    return out


def _gradient(f: np.ndarray, grade: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log-likelihood, by each row's sum of weights and by each threshold."""
    logistic = 1 / (1 + np.exp(-np.clip(cut[None, :] - f[:, None], -30, 30)))
    padded = np.concatenate([np.zeros((len(f), 1)), logistic, np.ones((len(f), 1))], axis=1)
    at = np.arange(len(f))
    high, low = padded[at, grade + 1], padded[at, grade]
    mass = np.maximum(high - low, 1e-9)
    d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
    cut_slope = np.array([(d_low[grade == k + 1]).sum() - (d_high[grade == k]).sum() for k in range(len(cut))])
    return d_high - d_low, cut_slope


class Scorer:
    def __init__(self, model: bytes):
        m = np.frombuffer(model, np.float32)
        self.weights, self.cut = m[: features.SIZE], m[features.SIZE :].astype(float)
        self.indicators = features.Indicators()

    def __call__(self, text: bytes) -> tuple[float, float]:
        """(expected severity, probability of a grade above 0)."""
        row = self.indicators(text)
        f = float(self.weights[row].astype(float).sum())
        above = 1 / (1 + np.exp(np.clip(self.cut - f, -500, 500)))
        return float(above.sum()), float(above[0])


@lru_cache(maxsize=2)
def _scorer(model: bytes) -> Scorer:
    return Scorer(model)


def training_rows(documents: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", rows: int = CLASS_ROWS, allowed: Column | None = None) -> DataFrame:
    """(id, label, text) of the bounded sample, of either class."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    own = (own if allowed is None else own.where(allowed)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    of = lambda y: own.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
    return features.sampled(documents, of(0).unionAll(of(1)), id, text)


def train(sample: DataFrame) -> bytes:
    """The fitted model; the sample goes to one task, the model comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = features.collected(batches)
        made = fit([r.features for r in found], np.array([r.n_bytes for r in found], float), np.array([r.label for r in found], int))
        yield pa.RecordBatch.from_pydict({"model": [made.astype(np.float32).tobytes()]})

    made = features.in_one_task(sample).mapInArrow(run, "model binary").first()
    # Over no rows at all, Spark runs no task.
    return bytes(made["model"]) if made else fit([], np.empty(0), np.empty(0, int)).astype(np.float32).tobytes()


def score(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``df`` with expected_severity and p_toxic of each whole text."""
    held = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    added = ["expected_severity", "p_toxic"]
    keep = [c for c in df.columns if c.lower() not in added]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in added]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(held.value)
        for batch in batches:
            for part in pieces(batch, text):
                made = np.array([own(t) for t in texts_of(part, text)]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(made[:, 0]), pa.array(made[:, 1])], [*keep, *added]
                )
        trim()

    return df.mapInArrow(run, schema)
