"""Secret scans in DataFrame expressions only: three patterns and a Markov test.

The patterns find what looks like a secret by its form.  The method adds strings
that look random: two first-order character Markov models, one of random strings and
one of ordinary identifiers, are trained from labelled samples, and a long token is
reported when the log-likelihood ratio of the two exceeds a margin.

Spans are (kind, start, end) in code points, end exclusive.  Matches of one kind are
leftmost and do not overlap; spans of different kinds may.  The Markov kind keeps
away from spans that the patterns have found.

Input rules: a null text counts as empty and has no spans; whole texts are scanned,
of any length; repeated rows give repeated results; an empty table gives no rows;
further columns stay as they are, but those named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.native import let, running

# The contract's patterns, in Java's spelling.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so demanding the length at once drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Tokens that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "random")
#: A token is reported when the ratio's logarithm exceeds this (prior odds of e**12 to 1).
MARGIN = 12.0
SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _spans(text: Column, pattern: str, kind: int, least: Column | None = None) -> Column:
    """Where ``pattern`` matches: the pieces between matches and the matches give the places."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = let(found, lambda all: F.zip_with(F.slice(between, 1, F.size(all)), all, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))))
    walked = let(
        sizes,
        lambda all: F.zip_with(
            running(F.transform(all, lambda x: x["b"] + x["m"])), all,
            lambda at, x: F.struct((at + x["b"]).alias("start"), F.lit(kind).alias("kind"), (at + x["b"] + x["m"]).alias("stop")),
        ),
    )
    if least is not None:
        walked = F.transform(
            F.filter(F.arrays_zip(walked.alias("s"), least.alias("l")), lambda z: z["l"]), lambda z: z["s"]
        )
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then by kind."""
    long_enough = F.transform(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST
    )
    return F.array_sort(
        F.concat(_spans(text, ASSIGN, 0, long_enough), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    )


def labelled_samples(spark: SparkSession, ordinary_text: DataFrame, text: str = "text", random_rows: int = 4096) -> DataFrame:
    """(value, random): random strings of several alphabets, and identifiers from words.

    ``ordinary_text`` should be a small table of prose; neighbouring words are joined
    as identifiers join them.  ``random_rows`` digests give the random half.
    """
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    encoded = F.base64(F.unhex(digest))
    noise = spark.range(random_rows).select(
        F.explode(F.array(encoded, F.substring(digest, 1, 40), F.upper(F.substring(F.regexp_replace(encoded, "[^A-Za-z0-9]", ""), 1, 32)))).alias("value"),
        F.lit(True).alias("random"),
    )
    words = F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+"), F.lit(0))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))
    pair = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.array(a, F.concat_ws("_", a, b), F.concat(F.lower(a), capital(b)), F.concat_ws("-", F.lower(a), F.lower(b)), F.concat(a, F.lower(b)), F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(a, F.lit("/"), b)))
    plain = (
        ordinary_text.where(F.size(words) > 1)
        .select(F.explode(F.flatten(pair(words))).alias("value"))
        .select("value", F.lit(False).alias("random"))
    )
    return noise.unionByName(plain)


def train(samples: DataFrame, value: str = "value", random: str = "random") -> list[float]:
    """Log-likelihood ratios of all character pairs, as a square table laid out by rows.

    Counts are summed on the executors; at most twice the square of the alphabet's size
    comes to the driver.  Add-one smoothing over the alphabet.
    """
    size = len(ALPHABET)
    pairs = (
        samples.where(F.length(value) > 1)
        .select(F.col(random).alias("random"), F.explode(F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(F.col(value), i, F.lit(2)))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    counts = {True: [1.0] * size * size, False: [1.0] * size * size}
    for row in pairs:
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b >= 0 and row["random"] is not None:
            counts[row["random"]][a * size + b] += row["count"]
    logs = {}
    for label, table in counts.items():
        sums = [sum(table[a * size : (a + 1) * size]) for a in range(size)]
        logs[label] = [math.log(x / sums[k // size]) for k, x in enumerate(table)]
    return [a - b for a, b in zip(logs[True], logs[False])]


def log_ratio(token: Column, table: list[float]) -> Column:
    """Summed log-likelihood ratio of a token's character pairs."""
    weights = F.lit([float(x) for x in table])
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.element_at(weights, (place(i) - 1) * len(ALPHABET) + place(i + 1)),
    )


def random_spans(text: Column, base: Column, table: list[float], margin: float = MARGIN) -> Column:
    """Spans of tokens that the models call random, away from ``base``."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    hit = F.transform(tokens, lambda t: log_ratio(t, table) > margin)
    found = _spans(text, TOKEN, 3, hit)
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))


def scan(df: DataFrame, table: list[float], text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``df`` with the patterns' spans and with all spans."""
    own = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(base, base_spans(own)).withColumn(
        spans, F.array_sort(F.concat(F.col(base), random_spans(own, F.col(base), table)))
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` for each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal run of covered characters replaced by ``mark``."""
    own = F.coalesce(text, F.lit(""))
    # Where spans open and close, openings first: runs lie between depths of none.
    edge = lambda place, step: F.struct(place.alias("at"), F.lit(step).alias("step"))
    edges = F.array_sort(F.flatten(F.transform(spans, lambda s: F.array(edge(s["start"], -1), edge(s["stop"], 1)))))

    def cuts(all: Column) -> Column:
        """Where each stretch that stays begins and ends, one after the other."""
        depth = running(F.transform(all, lambda e: e["step"]))
        outer = F.filter(F.arrays_zip(all.alias("e"), depth.alias("d")), lambda z: (z["d"] == 0) | (z["d"] + z["e"]["step"] == 0))
        return F.concat(F.array(F.lit(0)), F.transform(outer, lambda z: z["e"]["at"]), F.array(F.length(own)))

    def stays(c: Column) -> Column:
        at = lambda k: F.get(c, k)
        return F.transform(F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1), lambda k: F.substring(own, at(2 * k) + 1, at(2 * k + 1) - at(2 * k)))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(let(let(edges, cuts), stays), mark))
