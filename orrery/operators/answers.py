"""Answers: budgets, citations, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.folds import folded

from orrery.functions.text import word_count


def trim_to_budget(sentences: DataFrame, words: int = 1024) -> DataFrame:
    """Each answer's sentences while their running word count stays within the budget.

    ``sentences``: topic, idx, text.  What follows the first overflow goes too.
    """
    running = F.sum("words").over(Window.partitionBy("topic").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    own = sentences.withColumn("words", word_count(F.col("text"))).withColumn("running", running.cast("bigint"))
    return own.where(F.col("running") <= words)


def normalise_citations(citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations re-numbered by first use, references in that order).

    ``citations``: topic, sentence, place, doc.  Repeats within a sentence go, and
    documents that nobody cites have no number.
    """
    first = citations.groupBy("topic", "doc").agg(F.min(F.struct("sentence", "place")).alias("first"))
    order = Window.partitionBy("topic").orderBy("first", "doc")
    references = first.select("topic", "doc", (F.row_number().over(order) - 1).cast("bigint").alias("number"))
    own = citations.groupBy("topic", "sentence", "doc").agg(F.min("place").alias("place"))
    order = Window.partitionBy("topic", "sentence").orderBy("place", "doc")
    own = own.join(references, ["topic", "doc"]).withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
    return own.select("topic", "sentence", "place", "doc", "number"), references


def answer_faults(sentences: DataFrame, citations: DataFrame, references: DataFrame, words: int = 1024, most: int = 3) -> DataFrame:
    """Per topic: words, whether over the budget, sentences with too many or no citations, unused references."""
    cited = citations.groupBy("topic", F.col("sentence").alias("idx")).agg(F.countDistinct("doc").alias("n"))
    own = sentences.join(cited, ["topic", "idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    count = lambda c: F.sum(c.cast("bigint"))
    per = own.groupBy("topic").agg(F.sum(word_count(F.col("text"))).alias("words"), count(F.col("n") > most).alias("too_many"), count(F.col("n") == 0).alias("uncited"))
    unused = references.join(citations.select("topic", "doc").distinct(), ["topic", "doc"], "left_anti").groupBy("topic").agg(F.count(F.lit(1)).alias("unused"))
    return per.join(unused, "topic", "left").select("topic", "words", (F.col("words") > words).alias("over"), "too_many", "uncited", F.coalesce("unused", F.lit(0)).alias("unused"))


def grounded(ledger: DataFrame, citations: DataFrame) -> DataFrame:
    """Ledger documents that some sentence cites."""
    return ledger.join(citations.select("topic", "doc"), ["topic", "doc"], "left_semi")


def splice_operations(sentences: DataFrame, operations: DataFrame, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(answers with ranges replaced, rejected operations).

    ``operations``: topic, op, first, last, text: replace sentences first .. last by one.
    In order of their ranges, an operation is rejected when its range is wrong, touches an
    accepted one's, or comes beyond the ``most``-th.  Since accepted ranges are disjoint, all apply at once.
    """
    ends = sentences.groupBy("topic").agg(F.max("idx").alias("end"))

    def step(state: dict, row: dict) -> tuple:
        state["place"] = state.get("place", 0) + 1
        if not 0 <= row["first"] <= row["last"] <= row["end"]:
            return ("range",)
        if row["first"] <= state.get("last", -1):
            return ("overlap",)
        if state["place"] > most:
            return ("limit",)
        state["last"] = row["last"]
        return (None,)

    own = folded(operations.join(ends, "topic"), ["topic"], ["first", "last", "op"], dict, step, "reason string")
    good = own.where("reason IS NULL").select("topic", "first", "last", F.col("text").alias("new"))
    hit = sentences.join(good, (sentences["topic"] == good["topic"]) & F.col("idx").between(F.col("first"), F.col("last")), "left").select(
        sentences["topic"], "idx", "text", "first", "new"
    )
    kept = hit.where("first IS NULL OR idx = first").select("topic", "idx", F.coalesce("new", "text").alias("text"), F.col("first").isNotNull().alias("edited"))
    order = Window.partitionBy("topic").orderBy("idx")
    return kept.withColumn("new_idx", (F.row_number().over(order) - 1).cast("bigint")), own.where("reason IS NOT NULL").select("topic", "op", "reason")


def aliases(items: DataFrame, by: tuple[str, ...], prefix: str, *order) -> DataFrame:
    """Positional names such as c001, in order, for a bounded request."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return items.withColumn("alias", F.concat(F.lit(prefix), F.lpad(place.cast("string"), 3, "0")))
