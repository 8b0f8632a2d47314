"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes.

Each indicator is scaled by the logarithm of its smoothed class ratio, the scaled rows
are brought to unit length, and a hinge-loss model is fitted by dual coordinate
descent.  A logistic curve over held-in margins turns margins into scores.

The model is fitted in one task on a bounded sample: of the labelled rows allowed for
training, the ``SAMPLE_ROWS`` with the smallest hash of their id, and of those, in that
order, as many as have ``features.SAMPLE_FEATURES`` features together.  The fit ends where
the duality gap is a hundredth of the primal objective.  Scoring reads every whole text
and nothing else; the model has a fixed size.

Input rules: null and empty texts are scored by the intercept alone; rows without
labels never train; a document labelled twice trains once per label, and of several
documents with one id the text with the smallest hash trains; if the sample has
fewer than two classes, every score is the share of positive labels (0.5 without any);
equal texts score alike, repeated rows too; texts of any length are scored whole; an empty
table gives no rows; other columns stay, but one named like the score is replaced.
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

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 3_000
PENALTY, SMOOTHING = 1.0, 1.0
#: The fit ends at this duality gap, as a share of the primal objective, or after so many passes.
GAP, PASSES = 0.01, 200


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of all features, then intercept, slope and offset of the scores.

    ``rows``: distinct feature numbers; ``labels``: 0 or 1.
    """
    size = features.SIZE
    out = np.zeros(size + 3, np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        out[size + 1 :] = 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))
        return out
    sign = np.where(labels == 1, 1.0, -1.0)
    counts = np.full((2, size), SMOOTHING)
    for row, y in zip(rows, labels.astype(int)):
        counts[y][row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for row in rows:
        v = ratio[row]
        norm = np.sqrt(v @ v)
        values.append(v / norm if norm else v)
    # Dual coordinate descent for the hinge loss; the intercept is a feature of value 1.
    cap = PENALTY * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    weights, intercept, dual = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in random.permutation(len(rows)):
            row, v = rows[i], values[i]
            gradient = sign[i] * (weights[row] @ v + intercept) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), cap[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weights[row] += step * v
                intercept += step
                dual[i] = new
        primal, gap = _objective(rows, values, sign, cap, weights, intercept, dual)
        if gap <= GAP * primal:
            break
    margin = np.array([weights[r] @ v + intercept for r, v in zip(rows, values)])
    out[:size] = ratio * weights
    out[size] = intercept
    out[size + 1 :] = _logistic(margin, labels)
    return np.concatenate([out, ratio.astype(np.float32)])


def _objective(rows, values, sign, cap, weights, intercept, dual) -> tuple[float, float]:
    """(primal objective, duality gap)."""
    slack = np.array([max(0.0, 1.0 - y * (weights[r] @ v + intercept)) for r, v, y in zip(rows, values, sign)])
    square = float(weights @ weights) + intercept**2
    primal = square / 2 + float(cap @ slack)
    return primal, primal - (float(dual.sum()) - square / 2)


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score curve; the margin's zero stays at one half."""
    slope = 1.0
    goal = np.where(labels == 1, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-slope * margin))
        slope -= ((p - goal) @ margin) / ((p * (1 - p)) @ margin**2 + 1e-6)
        slope = min(max(slope, 0.5), 20.0)
    return slope, 0.0


class Scorer:
    def __init__(self, model: bytes):
        m = np.frombuffer(model, np.float32)
        size = features.SIZE
        self.weights, (self.intercept, self.slope, self.offset) = m[:size], m[size : size + 3].astype(float)
        self.ratio = m[size + 3 :] if len(m) > size + 3 else None
        self.indicators = features.Indicators()

    def __call__(self, text: bytes) -> float:
        margin = self.intercept
        if self.ratio is not None:
            row = self.indicators(text)
            if len(row):
                v = self.ratio[row]
                norm = np.sqrt(float(v @ v))
                margin += float(self.weights[row].sum()) / norm if norm else 0.0
        return float(1 / (1 + np.exp(-(self.slope * margin + self.offset))))


@lru_cache(maxsize=2)
def _scorer(model: bytes) -> Scorer:
    return Scorer(model)


def held_out(id: Column) -> Column:
    """The fold that never trains: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(documents: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, allowed: Column | None = None) -> DataFrame:
    """(text, label) of the bounded sample."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    if allowed is not None:
        own = own.where(allowed)
    own = own.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    # Equal rows of labels count once.
    own = own.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    return features.sampled(documents, own, id, text)


def train(sample: DataFrame) -> bytes:
    """The fitted model; the sample goes to one task, the model comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = features.collected(batches)
        yield pa.RecordBatch.from_pydict({"model": [fit([r.features for r in found], np.array([r.label for r in found], int)).tobytes()]})

    made = features.in_one_task(sample).mapInArrow(run, "model binary").first()
    # Over no rows at all, Spark runs no task.
    return bytes(made["model"]) if made else fit([], np.empty(0, int)).tobytes()


def score(df: DataFrame, model: bytes, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with each whole text's score, 0 to 1."""
    held = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    keep = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(held.value)
        for batch in batches:
            for part in pieces(batch, text):
                made = pa.array([own(t) for t in texts_of(part, text)], pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], made], [*keep, out])
        trim()

    return df.mapInArrow(run, schema)
