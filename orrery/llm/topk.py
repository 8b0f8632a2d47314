"""Exact top-k inner products by MaxScore over dimension-at-a-time lists.

A query's terms are its non-zero dimensions.  Within a shard, each dimension's list is
shifted so that contributions are never negative (by its minimum for a positive query
weight, by its maximum for a negative one), which gives each term a greatest possible
contribution.  Terms are ordered by that bound; the longest prefix whose bounds sum to
less than the room that the current k-th score leaves is non-essential.  Essential
lists are traversed first, block by block; the rest are probed only for rows whose
partial score plus the remaining bounds can still reach the k-th score.  Shards return
their k best and the lists are merged, ties going to the smaller id.

Sums that stay below 2**53 are exact in doubles.  A query that could pass that in a shard
is bounded in doubles with their greatest error, and what may reach the k-th score is
summed in integers of any length.  Scores beyond 64 bits are ranked as they are (alike
beyond 10**37) and given as the nearest 64-bit number.

Input rules: vectors that are null, or hold components that are null, not finite, or not
finite when scaled, take no part, neither do null ids; vectors of another length than a
query's are not compared.  Queries and candidates are rows, not ids: of rows with the
query's id and vector one is its own and no candidate, all others are; a query that
comes twice is answered twice.  Fewer than k candidates give what there is; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, queries of a block, and rows whose lists are traversed together.
SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS = 16_384, 4_096, 4_096
#: Scores are decimal, as 64 bits may not hold them.
RESULT = "query_id long, query_key long, vec_id long, times long, score decimal(38,0)"
#: Doubles hold all integers up to this.
EXACT = float(1 << 53)
MOST = (1 << 63) - 1
#: Greatest score that is ranked as it is: beyond, all count alike.
BEYOND = 10**37


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component: integers, held as doubles."""

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)  # no negative zero

    return F.transform(vector, whole)


def usable(vector: Column, scale: int = 1024) -> Column:
    infinite = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) == float("inf")
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | infinite(x))


def search_shard(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, times: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """The k best rows of one shard for one query: (row numbers, scores), best first, ties to the smaller id.

    ``vectors``: one row for each dimension; ``ids`` ascending; ``times``: how often each
    row counts (none: not at all).
    """
    low, high = (vectors.min(axis=1), vectors.max(axis=1)) if vectors.size else (np.zeros(len(vectors)), np.zeros(len(vectors)))
    with np.errstate(over="ignore", invalid="ignore"):
        most = float(np.abs(query) @ np.maximum(np.abs(low), np.abs(high))) if len(query) else 0.0
    rows = np.arange(len(ids)) if times is None else np.flatnonzero(times)
    # The shifted sums of the pruned search may be four times as large.
    if 4 * most < EXACT:
        found, score = _search(rows, vectors, low, high, query, k)
        return found, [int(x) for x in score.tolist()]
    return _exact(rows, vectors, query, most, k)


def _exact(rows: np.ndarray, lists: np.ndarray, query: np.ndarray, most: float, k: int) -> tuple[np.ndarray, list[int]]:
    """By integers of any length, for what the error of doubles leaves open."""
    error = most * (len(query) + 2) * 2.0**-52
    if len(rows) > k and np.isfinite(2 * most + 4 * error):
        about = query @ lists[:, rows]
        least = min(np.partition(about, len(rows) - k)[len(rows) - k], float(BEYOND)) - 2 * error
        rows = rows[about >= least] if least > -BEYOND else rows
    own = [int(x) for x in query.tolist()]
    clipped = lambda x: min(max(x, -BEYOND), BEYOND)
    scored = sorted((-clipped(sum(a * int(b) for a, b in zip(own, lists[:, r].tolist()))), r) for r in rows.tolist())[:k]
    return np.array([r for _, r in scored], np.int64), [-x for x, _ in scored]


def _search(candidates, lists, low, high, query, k):
    terms = np.flatnonzero(query)
    weights = query[terms]
    # Shifted contribution of a term: weight * x - its least value; the leasts sum to a constant.
    least = np.where(weights > 0, weights * low[terms], weights * high[terms])
    bound = np.abs(weights) * (high[terms] - low[terms])
    order = np.argsort(bound, kind="stable")
    terms, weights, bound, constant = terms[order], weights[order], bound[order], least.sum()
    reach = np.concatenate([[0.0], np.cumsum(bound)])  # what the first j terms can add at most
    best_rows, best = np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(candidates), BLOCK_ROWS):
        rows = candidates[at : at + BLOCK_ROWS]
        room = best[-1] - constant if len(best) == k else -np.inf
        split = min(int(np.searchsorted(reach, room, side="left")) - 1, len(terms)) if room > 0 else 0
        split = max(split, 0)
        dense = rows[-1] - rows[0] == len(rows) - 1
        partial = weights[split:] @ (lists[terms[split:], rows[0] : rows[-1] + 1] if dense else lists[np.ix_(terms[split:], rows)])
        partial = partial - np.where(weights[split:] > 0, weights[split:] * low[terms[split:]], weights[split:] * high[terms[split:]]).sum()
        while split:
            live = partial + reach[split] >= room
            rows, partial = rows[live], partial[live]
            if not len(rows):
                break
            step = min(split, 8)
            own = slice(split - step, split)
            partial = partial + weights[own] @ lists[np.ix_(terms[own], rows)]
            partial -= np.where(weights[own] > 0, weights[own] * low[terms[own]], weights[own] * high[terms[own]]).sum()
            split -= step
        if not len(rows):
            continue
        score = partial + constant
        if len(score) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= kth
            rows, score = rows[keep], score[keep]
        best_rows, best = np.concatenate([best_rows, rows]), np.concatenate([best, score])
        top = np.lexsort((best_rows, -best))[:k]
        best_rows, best = best_rows[top], best[top]
    return best_rows, best


def _matrix(column: pa.ChunkedArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows grouped by vector length: (length, row numbers, values)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((int(size), rows, flat[starts[rows][:, None] + np.arange(int(size))]))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Equal rows are counted, and searched once.  Rows go to shards of about SHARD_ROWS by
    the hash of id and vector, queries to blocks.  A shard meets each query block in a
    task of its own, so a task holds one of each, whatever the tables' sizes; all that
    leaves it is k rows per query.
    """
    clean = lambda df: df.where(F.col(id).isNotNull() & usable(F.col(vector), scale)).select(
        F.col(id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v")
    )
    counted = lambda df: clean(df).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("key", F.xxhash64("id", "v"))
    rows, asked = counted(vectors), counted(queries)
    shards = max(1, -(-clean(vectors).count() // SHARD_ROWS))
    blocks = max(1, -(-clean(queries).count() // QUERY_ROWS))
    deal = lambda n: F.pmod("key", F.lit(n)).cast("int")
    left = rows.withColumn("shard", deal(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", deal(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, Decimal]] = []
        if left.num_rows and right.num_rows:
            ids, times = left.column("id").to_numpy(), left.column("times").to_numpy()
            own = {}
            for size, rows, m in _matrix(left.column("v")):
                order = np.argsort(ids[rows], kind="stable")
                own[size] = ids[rows][order], times[rows][order], np.ascontiguousarray(m[order].T)
            asked, keys = right.column("id").to_numpy(), right.column("key").to_numpy()
            for size, at, values in _matrix(right.column("v")):
                if size not in own:
                    continue
                own_ids, often, lists = own[size]
                for q, key, query in zip(asked[at].tolist(), keys[at].tolist(), values):
                    a, b = np.searchsorted(own_ids, [q, q + 1])
                    mine = [r for r in range(a, b) if (lists[:, r] == query).all()]
                    left_over = often
                    if mine:
                        left_over = often.copy()
                        left_over[mine[0]] -= 1
                    found, score = search_shard(own_ids, lists, query, k, left_over if mine else None)
                    out += [(q, key, int(own_ids[r]), int(left_over[r]), Decimal(x)) for r, x in zip(found.tolist(), score)]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=[f.split()[0] for f in RESULT.split(", ")])

    pair = (F.col("shard") * blocks + F.col("block")).alias("pair")
    met = lambda df: df.select(pair, "id", "key", "v", "times").repartitionById(shards * blocks, F.col("pair")).groupBy("pair")
    partial = met(left).cogroup(met(right)).applyInArrow(meet, RESULT)
    # A candidate that counts several times takes as many ranks.
    order = [F.desc("score"), F.asc("vec_id")]
    each = Window.partitionBy("query_id", "query_key")
    ranked = (
        partial.withColumn("place", F.row_number().over(each.orderBy(*order)))
        .where(F.col("place") <= k)
        .withColumn("before", F.sum("times").over(each.orderBy("place")) - F.col("times"))
        .where(F.col("before") < k)
    )
    again = asked.where("times > 1").select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), F.col("times").alias("asked"))
    many = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k) - F.col("before"))))).withColumn("rank", (F.col("before") + F.col("copy")).cast("int"))
    many = many.join(again, ["query_id", "query_key"], "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.coalesce("asked", F.lit(1)))))
    nearest = F.greatest(F.least("score", F.lit(MOST).cast("decimal(38,0)")), F.lit(-MOST).cast("decimal(38,0)")).cast("long")
    return many.select("query_id", "rank", "vec_id", nearest.alias("score"))


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
