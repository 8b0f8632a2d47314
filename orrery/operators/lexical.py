"""First-stage retrieval: query variants and BM25 over tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import squeezed, tokens
from orrery.operators.ranking import top

K1, B = 0.9, 0.4
RUN = re.compile("[a-z0-9]+")


def variants(topics: DataFrame, facets: int = 2, words: int = 6) -> DataFrame:
    """The original query first, then one per group of ``words`` words."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    rows = [F.struct(F.lit("original").alias("variant"), squeezed(F.col("text")).alias("query"))]
    rows += [F.struct(F.lit(f"facet:{k}").alias("variant"), F.array_join(F.slice(w, (k - 1) * words + 1, words), " ").alias("query")) for k in range(1, facets + 1)]
    return topics.select("topic", F.posexplode(F.array(*rows)).alias("place", "v")).select("topic", F.col("place").cast("bigint").alias("place"), "v.variant", "v.query")


#: Topics scored at once, and documents whose scores are held at once.
TOPICS, DOCUMENTS = 256, 2_048


def bm25(docs: DataFrame, topics: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """topic, doc, score, rank of each topic's ``k`` best documents.

    Two passes over the texts and no posting leaves a task: the first sums document
    frequencies of the topics' terms, counts and lengths; the second multiplies a block
    of documents' term weights by a block of topics, and sends on the best ``k`` of each.
    The topics are a stated query set; their terms go to every task.
    """
    asked = topics.select("topic", F.array_distinct(tokens(F.col("query"))).alias("w")).collect()
    vocabulary = {t: n for n, t in enumerate(sorted({t for r in asked for t in r["w"] or ()}))}
    lowered = docs.select("doc", F.lower("text").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text is not None:
                    words = RUN.findall(text)
                    n, total = n + 1, total + len(words)
                    df[[vocabulary[w] for w in set(words) if w in vocabulary]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(some, [-1, -2]), "n": np.append(df[some], [n, total])}, schema=pa.schema([("term", pa.int64()), ("n", pa.int64())]))

    sums = {r["term"]: r["n"] for r in lowered.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(len(vocabulary))
    df[list(sums)] = list(sums.values())
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / n if n else 1.0
    blocks = [asked[at : at + TOPICS] for at in range(0, len(asked), TOPICS)]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x.slice(at, DOCUMENTS) for x in batches for at in range(0, x.num_rows, DOCUMENTS)):
            ids = np.array([-1 if d is None else d for d in part.column("doc").to_pylist()], np.int64)
            at, term, weight = [], [], []
            for row, text in enumerate(part.column("text").to_pylist()):
                words = RUN.findall(text or "")
                for t, tf in Counter(words).items():
                    if (number := vocabulary.get(t)) is not None:
                        at.append(row)
                        term.append(number)
                        weight.append(idf[number] * tf / (tf + k1 * (1 - b + b * len(words) / mean)))
            at, term, weight = np.array(at, np.int64), np.array(term, np.int64), np.array(weight)
            for block in blocks:
                yield _best(ids, at, term, weight, block, vocabulary, k)

    kind = topics.schema["topic"].dataType
    scored = lowered.mapInArrow(score, f"topic {kind.simpleString()}, doc long, score double") if asked else docs.sparkSession.createDataFrame([], f"topic {kind.simpleString()}, doc long, score double")
    return top(scored, k, F.desc("score"), "doc")


def _best(ids: np.ndarray, at: np.ndarray, term: np.ndarray, weight: np.ndarray, block: list, vocabulary: dict[str, int], k: int) -> pa.RecordBatch:
    """The ``k`` best of some documents for each topic of a block, from (document, term, weight) triples."""
    own = np.unique(np.array([vocabulary[t] for r in block for t in r["w"] or ()], np.int64))
    place = np.full(len(vocabulary), -1)
    place[own] = np.arange(len(own))
    asks = np.zeros((len(own), len(block)))
    for j, r in enumerate(block):
        asks[place[[vocabulary[t] for t in r["w"] or ()]], j] = 1.0
    used = place[term] >= 0
    weights = np.zeros((len(ids), len(own)))
    weights[at[used], place[term[used]]] = weight[used]
    scores = np.round(weights @ asks, 5)
    rows, topics = [], []
    for j in range(len(block)):
        some = np.flatnonzero(scores[:, j] > 0)
        if len(some) > k:
            some = some[np.lexsort((ids[some], -scores[some, j]))[:k]]
        rows.append(some)
        topics.append(np.full(len(some), j))
    rows, topics = np.concatenate(rows), np.concatenate(topics)
    names = pa.array([r["topic"] for r in block]).take(pa.array(topics))
    return pa.RecordBatch.from_arrays([names, pa.array(ids[rows]), pa.array(scores[rows, topics])], ["topic", "doc", "score"])


#: Units that one pass over the documents holds, (document, unit) rows made at once, and runs whose words a task remembers.
UNITS, ROWS, REMEMBERED = 4_096, 1 << 18, 100_000


def unit_hits(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(topic, doc, hits) of every document and every unit: the unit's words that the text contains as strings.

    ``docs``: doc, text.  ``units``: topic, words ([a-z0-9]+, counted as often as they
    stand).  Such a word lies in a text just where it lies in one of its runs of a-z and
    0-9, so each distinct run is looked up once, not each text for each word.
    """
    lowered = docs.select("doc", F.lower("text").alias("text"))
    schema = f"topic {units.schema['topic'].dataType.simpleString()}, doc {docs.schema['doc'].dataType.simpleString()}, hits long"
    rows = units.select("topic", "words").collect()
    passes = [lowered.mapInArrow(_hits(rows[at : at + UNITS]), schema) for at in range(0, len(rows), UNITS)]
    return reduce(DataFrame.unionAll, passes) if passes else docs.sparkSession.createDataFrame([], schema)


def _hits(units: list):
    """A pass over documents for some units, as ``mapInArrow`` wants it."""
    own = [u["words"] for u in units]
    number = {w: k for k, w in enumerate(sorted({w for ws in own for w in ws or ()}))}
    lengths = sorted({len(w) for w in number})
    flat = np.array([number[w] for ws in own for w in ws or ()], np.int64)
    cuts = np.concatenate([[0], np.cumsum([len(ws or ()) for ws in own])]).astype(np.int64)
    unknown = np.array([ws is None for ws in own], bool)

    def within(token: str) -> list[int]:
        parts = {token[at : at + n] for n in lengths for at in range(len(token) - n + 1)}
        return [number[p] for p in parts if p in number]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, known, step = pa.array([u["topic"] for u in units]), {}, max(1, ROWS // max(1, len(units)))
        for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            hits = np.zeros((part.num_rows, len(units)), np.int64)
            for i, text in enumerate(part.column("text").to_pylist()):
                has = np.zeros(len(number), bool)
                for token in set(RUN.findall(text or "")):
                    if (found := known.get(token)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[token] = within(token)
                    has[found] = True
                hits[i] = np.diff(np.concatenate([[0], np.cumsum(has[flat])])[cuts])
            at, unit = np.divmod(np.arange(hits.size), max(1, len(units)))
            found = pa.array(hits.ravel(), pa.int64(), mask=np.tile(unknown, part.num_rows))
            yield pa.RecordBatch.from_arrays([topics.take(pa.array(unit)), part.column("doc").take(pa.array(at)), found], ["topic", "doc", "hits"])

    return run


def facet_variants(plans: DataFrame) -> DataFrame:
    """(topic, place, variant, query): the original first, then each facet's queries in order, as "facet:<id>:q<n>".

    ``plans``: topic, text, facets (array of struct(id, queries)).
    """
    named = F.transform("facets", lambda f: F.transform(f["queries"], lambda q, k: F.struct(F.concat(F.lit("facet:"), f["id"], F.lit(":q"), (k + 1).cast("string")).alias("variant"), q.alias("query"))))
    first = F.array(F.struct(F.lit("original").alias("variant"), F.col("text").alias("query")))
    every = F.concat(first, F.coalesce(F.flatten(named), F.array().cast("array<struct<variant:string,query:string>>")))
    return plans.select("topic", F.posexplode(every).alias("place", "v")).select("topic", "place", "v.variant", "v.query")
