"""Exact top-k inner products by block-at-a-time pruning.

Candidates stand in an order that keeps similar vectors together and are cut into blocks.
A block keeps the largest and smallest value of every component, so that for a query the
sum of component maxima bounds every score in the block. A query visits blocks by falling
bound and scores them from the block's forward index until the next bound is below its
k-th score. Queries and ranges of blocks meet in tasks, every query with every range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .mixing import numbered

#: Vectors of a block, vectors of a range, queries of a batch.
BLOCK, RANGE, BATCH = 256, 4096, 2048
_LONG = (1 << 63) - 1


def coded(vectors: DataFrame, scale: float, key: str, vector: str) -> DataFrame:
    """``id``, ``v`` (floor of ``scale`` times each component, as doubles), ``near``: a
    locality key. Vectors that are null, empty or hold null or non-finite components
    take no part."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    v = F.transform("x", lambda c: _floor(c * F.lit(float(scale))))
    near = F.aggregate(F.slice("v", 1, 24), F.lit(0).cast("long"), lambda acc, c: acc * 2 + F.when(c > 0, 1).otherwise(0))
    whole = F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(F.forall("x", finite), F.lit(False))
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return named.where(whole).select("id", v.alias("v")).withColumn("near", near)


def _floor(c: Column) -> Column:
    """Floor as a double, also beyond the longs (where doubles are whole)."""
    return F.when(F.abs(c) < F.lit(float(1 << 53)), F.floor(c).cast("double")).otherwise(c)


def _matrix(table: pa.Table, width: int | None = None) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(lists.offsets.to_numpy())
    width = max(width or 0, int(n.max(initial=0)))
    if len(n) and n.min() == width:
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _dots(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(c).T), -_LONG, _LONG).astype(np.int64)


def search(q: np.ndarray, q_row: np.ndarray, floor: np.ndarray, c: np.ndarray, c_id: np.ndarray, c_row: np.ndarray, k: int, block: int = BLOCK):
    """(query index, candidate id, candidate row, score) of the best ``k`` candidates of
    each query with a score of at least ``floor``; a query's own row is none."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    limit = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    exact = limit * limit * width < float(1 << 53)
    starts = np.arange(0, len(c), block)
    high, low = np.maximum.reduceat(c, starts, axis=0), np.minimum.reduceat(c, starts, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = up @ high.T + down @ low.T if exact else np.full((len(q), len(starts)), np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    none = -_LONG - 1
    top = np.full((len(q), k), none, np.int64)
    top_at = np.full((len(q), k), -1, np.int64)
    ids = np.append(c_id, np.iinfo(np.int64).max)  # place -1: none
    rows = np.append(c_row, np.iinfo(np.int64).max)
    active = np.arange(len(q))
    for step in range(len(starts)):
        worst = np.maximum(top[active, k - 1], floor[active])
        active = active[bound[active, order[active, step]] >= worst]
        if not len(active):
            break
        turn = order[active, step]
        for b in np.unique(turn):
            who = active[turn == b]
            part = slice(starts[b], starts[b] + block)
            score = _dots(q[who], c[part], exact)
            score[q_row[who][:, None] == c_row[part][None, :]] = none
            score[score < floor[who][:, None]] = none
            at = np.broadcast_to(np.arange(starts[b], starts[b] + score.shape[1]), score.shape)
            at = np.where(score == none, -1, at)
            all_s, all_at = np.concatenate((top[who], score), axis=1), np.concatenate((top_at[who], at), axis=1)
            best = np.lexsort((rows[all_at], ids[all_at], ~all_s), axis=1)[:, :k]
            top[who], top_at[who] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_at, best, 1)
    i, j = np.nonzero(top_at >= 0)
    at = top_at[i, j]
    return i, c_id[at], c_row[at], top[i, j]


def _task(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = lambda t, n, null=0: t.column(n).fill_null(null).to_numpy() if t.num_rows else np.zeros(0, np.int64)
        if not left.num_rows or not right.num_rows:
            return _RESULT.empty_table()
        right = right.sort_by([("near", "ascending"), ("row", "ascending")])
        last = np.iinfo(np.int64).max  # null ids stand last among ties
        i, cid, crow, score = search(_matrix(left), number(left, "row"), number(left, "floor"), _matrix(right), number(right, "id", last), number(right, "row"), k)
        none = cid == last
        return pa.table([left.column("row").take(pa.array(i)), left.column("id").take(pa.array(i)), pa.array(cid, mask=none), pa.array(crow), pa.array(score)], schema=_RESULT)

    return run


_RESULT = pa.schema([(n, pa.int64()) for n in ("row", "query_id", "vec_id", "vec_row", "score")])
_DDL = "row long, query_id long, vec_id long, vec_row long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` largest inner
    products of each query row (test ``is_query`` on column ``id``) with every other row,
    of components ``floor(scale * x)``; ties go to the smaller id, null ids last.

    A vector of fewer components counts as 0 beyond them. Rows that repeat are rows of
    their own, as queries and as candidates; only a query's own row is left out. Scores
    beyond the longs are cut to them. No usable vectors: no rows."""
    base = settle(numbered(coded(vectors, scale, key, vector), [F.col("near").asc(), F.col("id").asc_nulls_last()], "row"))
    ranges = F.floor(F.col("row") / RANGE)
    cands = base.select(ranges.alias("range"), "row", "id", "v", "near")
    queries = settle(numbered(base.where(is_query).select("row", "id", "v"), [F.col("row").asc()], "n"))
    count, asked = base.count(), queries.count()

    # A query's own range first: its k-th score there is a floor for all other ranges.
    own = queries.select(ranges.alias("range"), "row", "id", "v", F.lit(-_LONG - 1).alias("floor"))
    near = own.groupBy("range").cogroup(cands.groupBy("range")).applyInArrow(_task(k), _DDL)
    floors = settle(near.groupBy("row").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= k).select("row", "floor"))

    n_ranges, n_batches = max(1, -(-count // RANGE)), max(1, -(-asked // BATCH))
    each = queries.join(floors, "row", "left").select(
        F.floor(F.col("n") / BATCH).alias("batch"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_ranges - 1).cast("long"))).alias("range"),
        "row", "id", "v", F.coalesce("floor", F.lit(-_LONG - 1)).alias("floor"),
    )
    every = cands.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_batches - 1).cast("long"))))
    found = each.groupBy("batch", "range").cogroup(every.groupBy("batch", "range")).applyInArrow(_task(k), _DDL)
    place = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("vec_row").asc())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
