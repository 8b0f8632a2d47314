"""Extension points: segmenters, chunkers and scorers by name, each with a deterministic default.

A segmenter or chunker is a function of one text that gives spans; it runs as a Python
UDTF beside each row, and its offsets are checked.  A scorer is made once per Python
worker (a model may be costly to load) and scores Arrow batches of (query, text) pairs.
Whoever brings another registers it by name; operators name it and stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import STOP_WORDS
from orrery.operators import spans

Segmenter = Callable[[str], list[tuple[int, int, bool]]]
Chunker = Callable[[str], list[tuple[int, int]]]
Scorer = Callable[[list[str], list[str]], list[float]]

SEGMENTERS: dict[str, Segmenter] = {"marks": spans.sentences}
CHUNKERS: dict[str, Chunker] = {"semantic": spans.chunks}
SCORERS: dict[str, Callable[[], Scorer]] = {}


def content_overlap() -> Scorer:
    """Share of a query's distinct content words that are words of the text; 0 without any."""
    word, stop = re.compile(r"[a-z][a-z'-]+"), frozenset(STOP_WORDS)

    known: dict[str, frozenset[str]] = {}

    def wanted(query: str) -> frozenset[str]:
        if len(known) >= 4096:
            known.clear()
        return known.setdefault(query, frozenset(word.findall(query.lower())) - stop)

    def score(queries: list[str], texts: list[str]) -> list[float]:
        out, last, words = [], None, frozenset()
        for q, t in zip(queries, texts):
            if t is not last:  # a text comes with its queries one after another
                last, words = t, frozenset(word.findall(t.lower()))
            own = known.get(q)
            own = wanted(q) if own is None else own
            out.append(0.0 if own.isdisjoint(words) else len(own & words) / len(own))
        return out

    return score


SCORERS["content_overlap"] = content_overlap


def registered(registry: dict, name: str):
    if name not in registry:
        raise KeyError(f"{name!r} is not registered; there are: {', '.join(sorted(registry))}")
    return registry[name]


def _checked(found: list[tuple], size: int, name: str) -> Iterator[tuple]:
    before = -1
    for k, row in enumerate(found):
        if not (0 <= row[0] < row[1] <= size and row[0] > before):
            raise ValueError(f"{name} gave span {row[:2]} of a text of {size} characters")
        before = row[0]
        yield (k, *row)


def segmented(df: DataFrame, text: str = "text", segmenter: str = "marks") -> DataFrame:
    """``df``'s columns but the text, with place, start, end and complete: a row for each sentence."""
    cut = registered(SEGMENTERS, segmenter)

    @F.udtf(returnType="place: int, start: int, end: int, complete: boolean")
    class Segments:
        def eval(self, value: str):
            yield from _checked(cut(value) if value else [], len(value or ""), segmenter)

    return _beside(df, Segments, text, ["place", "start", "end", "complete"])


def chunked(df: DataFrame, id: str, text: str = "text", chunker: str = "semantic") -> DataFrame:
    """``df``'s columns but the text, with chunk_id ("id:0000"), start, end and chunk: a row for each chunk."""
    cut = registered(CHUNKERS, chunker)

    @F.udtf(returnType="place: int, start: int, end: int, chunk: string")
    class Chunks:
        def eval(self, value: str):
            for k, a, b in _checked(cut(value) if value else [], len(value or ""), chunker):
                yield k, a, b, value[a:b]

    made = _beside(df, Chunks, text, ["place", "start", "end", "chunk"])
    return made.withColumn("chunk_id", F.format_string("%s:%04d", F.col(id).cast("string"), "place")).drop("place")


def _beside(df: DataFrame, table, text: str, added: list[str]) -> DataFrame:
    kept = [c for c in df.columns if c != text and c not in added]
    return df.lateralJoin(table(F.col(text).outer())).select(*kept, *added)


def scored(query: Column, text: Column, scorer: str = "content_overlap") -> Column:
    """The score of each (query, text) pair; null where either is."""
    make = registered(SCORERS, scorer)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = make()
        for queries, texts in batches:
            there = queries.notna() & texts.notna()
            out = pd.Series(float("nan"), index=queries.index, dtype="float64")
            if there.any():
                out[there] = own(queries[there].tolist(), texts[there].tolist())
            yield out.where(there, None)

    return score(query, text)


def sentence_pairs(sentences: DataFrame, subnarratives: DataFrame, scorer: str = "content_overlap") -> DataFrame:
    """Each sentence with each subnarrative of its topic, and their score.

    ``sentences``: topic, doc, place, text.  ``subnarratives``: topic, sub, query; a topic
    has a handful, so a sentence meets a handful.  The join is by topic, and sentences are
    dealt by document within it, so no task holds a topic.
    """
    asked = subnarratives.select("topic", F.struct("sub", "query").alias("s")).groupBy("topic").agg(F.sort_array(F.collect_list("s")).alias("subs"))
    met = sentences.join(asked, "topic").withColumn("s", F.explode("subs"))
    return met.select("topic", "doc", "place", F.col("s.sub").alias("sub"), scored(F.col("s.query"), F.col("text"), scorer).alias("score"))


def marked(text: str) -> list[str]:
    """Maximal stretches closed by end marks or a line end, but blank ones."""
    return [s for s in _MARKED.findall(text) if s.strip(" ")]


_MARKED = re.compile(r"[^.!?\n]+[.!?]*")


def best_sentences(documents: DataFrame, subnarratives: DataFrame, scorer: str = "content_overlap", cut: Callable[[str], list[str]] = marked) -> DataFrame:
    """Each document with each subnarrative of its topic: how many sentences it has, and the best one's score to 9 digits.

    ``documents``: topic, doc, texts (an array, each cut into sentences).  ``subnarratives``:
    topic, sub, query.  Pairs of sentences and subnarratives are made where they are scored,
    and never are rows.  A document without sentences has no row.
    """
    make = registered(SCORERS, scorer)

    asked = subnarratives.select("topic", F.struct("sub", "query").alias("s")).groupBy("topic").agg(F.sort_array(F.collect_list("s")).alias("subs"))
    met = documents.join(asked, "topic").select("topic", "doc", "texts", F.col("subs.sub").alias("sub"), F.col("subs.query").alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            many, best = [], []
            for texts, queries in zip(batch.column("texts"), batch.column("query")):
                sentences = [s for t in texts.as_py() or () if t for s in cut(t)]
                many.append(len(sentences))
                best += _best_of(own, sentences, queries.as_py())
            of = pc.list_parent_indices(batch.column("sub"))
            counts = pa.array(many, pa.int64()).take(of)
            columns = [batch.column("topic").take(of), batch.column("doc").take(of), batch.column("sub").flatten(), counts, pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["topic", "doc", "sub", "sentences", "best"]).filter(pc.greater(counts, 0))

    kinds = {f.name: f.dataType.simpleString() for f in documents.select("topic", "doc").schema} | {"sub": subnarratives.schema["sub"].dataType.simpleString()}
    rows = met.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", sentences long, best double")
    return rows.withColumn("best", F.round("best", 9))


def _best_of(score: Scorer, texts: list[str], queries: list[str | None]) -> list[float | None]:
    """The greatest score of each query with any of the texts; null where none has one.  Equal texts are scored once."""
    there, asked = list(dict.fromkeys(texts)), [q for q in queries if q is not None]
    if not there or not asked:
        return [None] * len(queries)
    made = np.array(score(asked * len(there), [t for t in there for _ in asked]), float).reshape(len(there), len(asked))
    found = iter([None if x != x else x for x in np.fmax.reduce(made, axis=0).tolist()])
    return [None if q is None else next(found) for q in queries]
