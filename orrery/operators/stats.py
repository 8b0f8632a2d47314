"""Paired comparisons, significance, agreement and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.ranking import fractional_rank

#: Differences up to this count as ties; losses from this on are big.
TIE, BIG = 1e-12, 0.05


def compare(baseline: DataFrame, candidate: DataFrame, key: str = "topic", value: str = "value") -> DataFrame:
    """(key, baseline, candidate, delta, status) over both populations; a missing side stays null."""
    a = baseline.select(key, F.col(value).alias("baseline"))
    b = candidate.select(key, F.col(value).alias("candidate"))
    both = a.join(b, key, "full").withColumn("delta", F.col("candidate") - F.col("baseline"))
    return both.withColumn("status", status(F.col("delta")))


def status(delta: Column) -> Column:
    return F.when(delta.isNull(), "missing").when(delta > TIE, "improved").when(delta < -TIE, "degraded").otherwise("tied")


def summary(compared: DataFrame, key: str = "topic") -> DataFrame:
    """Wins, ties, losses, big losses, mean change, relative lift, and the worst key."""
    count = lambda c: F.sum(c.cast("bigint"))
    return compared.where(F.col("delta").isNotNull()).agg(
        count(F.col("status") == "improved").alias("wins"),
        count(F.col("status") == "tied").alias("ties"),
        count(F.col("status") == "degraded").alias("losses"),
        count(F.col("delta") <= -BIG).alias("big_losses"),
        F.avg("delta").alias("mean_delta"),
        (F.avg("delta") / F.nullif(F.avg("baseline"), F.lit(0.0))).alias("lift"),
        F.min_by(key, F.struct(F.round("delta", 9), F.col(key))).alias("worst"),
    )


def holm(tests: DataFrame, p: str = "p", id: str = "id") -> DataFrame:
    """Step-down adjusted p-values: the running maximum of min(1, (m - i) p)."""
    every = Window.partitionBy(F.lit(1)).orderBy(p, id)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(every) + 1) * F.col(p))
    return tests.withColumn("raw", raw).withColumn("adjusted", F.max("raw").over(every.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def sign_flip(deltas: DataFrame, value: str = "delta", most: int = 22, slack: float = 1e-15) -> DataFrame:
    """Exact one-sided test: the share of all sign patterns whose sum reaches the observed one.

    The patterns are dealt over the cluster; the differences are at most ``most``.  A sum
    reaches the observed one from ``slack`` below it on, as sums in other orders may differ.
    """
    rows = [abs(r[0]) for r in deltas.select(value).where(F.col(value) != 0).orderBy(F.abs(value)).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} non-zero differences")
    observed = deltas.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("observed"))
    total = F.lit(0.0)
    for k, x in enumerate(rows):
        total = total + F.when(F.shiftright(F.col("id"), k).bitwiseAND(1) == 1, F.lit(x)).otherwise(F.lit(-x))
    patterns = deltas.sparkSession.range(1 << len(rows)).select(total.alias("sum"))
    return patterns.crossJoin(F.broadcast(observed)).agg(
        F.sum((F.col("sum") >= F.col("observed") - slack).cast("bigint")).alias("reached"),
        F.count(F.lit(1)).alias("patterns"),
        (F.sum((F.col("sum") >= F.col("observed") - slack).cast("bigint")) / F.count(F.lit(1))).alias("p"),
    )


def pearson(df: DataFrame, x: str, y: str, by: tuple[str, ...], name: str = "r") -> DataFrame:
    """Correlation per group; null where a side does not vary."""
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return own.agg(F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))).alias(name), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...], name: str = "rho") -> DataFrame:
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(fractional_rank(fractional_rank(own, x, by, "rank_x"), y, by, "rank_y"), "rank_x", "rank_y", by, name)


def auc(df: DataFrame, score: str, positive: str, by: tuple[str, ...]) -> DataFrame:
    """Area under the ROC curve with half credit for ties, by rank sums; null with one class."""
    r = fractional_rank(df, score, by, "r")
    pos = F.sum(F.col(positive).cast("bigint"))
    neg = F.sum((~F.col(positive)).cast("bigint"))
    won = F.sum(F.when(F.col(positive), F.col("r")).otherwise(0.0)) - pos * (pos + 1) / 2
    return r.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), won / F.nullif(pos * neg, F.lit(0))).alias("auc"), pos.alias("positives"), neg.alias("negatives"))


def bootstrap(deltas: DataFrame, value: str = "delta", samples: int = 100_000, seed: int = 20260716, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean of paired differences; one per topic, so they fit a task."""

    def run(batches):
        import pyarrow as pa

        x = np.sort(np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches] or [np.empty(0)]))
        if len(x):
            random = np.random.default_rng(seed)
            means = np.concatenate([x[random.integers(0, len(x), (min(5000, samples - at), len(x)))].mean(axis=1) for at in range(0, samples, 5000)])
            low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
            yield pa.RecordBatch.from_pydict({"mean": [float(x.mean())], "low": [float(low)], "high": [float(high)], "n": [len(x)]})

    own = deltas.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL").repartition(1)
    return own.mapInArrow(run, "mean double, low double, high double, n long")


def quantiles_nearest(df: DataFrame, value: str, qs: tuple[float, ...], by: tuple[str, ...]) -> DataFrame:
    """Nearest-rank quantiles with halves rounded up: the value at floor(q (n - 1) + 1/2)."""
    w = Window.partitionBy(*by).orderBy(value)
    rows = df.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    place = lambda q: F.floor(F.lit(q) * (F.col("n") - 1) + 0.5)
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("at") == place(q), F.col(value))).alias(f"q{round(q * 100)}") for q in qs])


def distribution(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("least"), F.median(value).alias("median"), F.max(value).alias("most"))


def calibration(df: DataFrame, components: tuple[str, ...], grade: str = "grade", by: tuple[str, ...] = ("topic",)) -> DataFrame:
    """Per group and component: Spearman with the grade, AUC of grade >= 2, and both means."""
    long = df.select(*by, grade, F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in components])))
    long = long.withColumn("positive", F.col(grade) >= 2)
    keys = (*by, "component")
    return (
        spearman(long, "value", grade, keys)
        .join(auc(long, "value", "positive", keys), list(keys))
        .join(long.groupBy(*keys).agg(F.avg(F.when(F.col("positive"), F.col("value"))).alias("mean_positive"), F.avg(F.when(~F.col("positive"), F.col("value"))).alias("mean_negative")), list(keys))
    )
