"""Exact top-k search by no-random-access aggregation.

Each component of a block is a list of rows sorted by value. A query reads
all its lists to the same depth (from the top where its component is
positive, from the bottom where it is negative). A row's lower bound takes
the least value for lists it has not been met in, its upper bound the value
at the list's reading place. Only rows whose upper bound reaches the k-th
lower bound can be results. Reading stops when these are few, at the latest
where the lists end and the bounds are the scores; their final scores are
resolved and ranked. Bounds for many queries are matrix products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import search, vectors

#: Queries whose bounds are held at once.
QUERIES = 128
#: Shares of the lists that are read before the bounds are compared.
DEPTHS = (0.8, 0.9, 0.95, 1.0)
#: Reading stops at so many possible results, as a multiple of k.
RESOLVE = 4


def kernel(ids, own, x, query_own, q, k):
    """The k rows of highest integer inner product for each query: (query index, row index, score)."""
    n, dim = x.shape
    limit = float(np.abs(x).max()) * float(np.abs(q).max()) * dim
    kind = np.float32 if limit < 2 ** 24 else np.float64 if limit < 2 ** 53 else np.int64
    xi = x.astype(np.int64)
    order = np.argsort(xi, axis=0, kind="stable")
    rank = np.empty((n, dim), np.int64)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ranked = np.take_along_axis(xi, order, axis=0).astype(kind)
    xs = xi.astype(kind)
    out_q, out_r, out_s = [], [], []

    def resolve(i, rows):
        rows = rows[own[rows] != query_own[i]]
        scores = xi[rows] @ q[i].astype(np.int64)
        best = np.lexsort((ids[rows], -scores))[:k]
        out_q.append(np.full(len(best), i))
        out_r.append(rows[best])
        out_s.append(scores[best])

    for at in range(0, len(q), QUERIES):
        active = np.arange(at, min(at + QUERIES, len(q)))
        for share in DEPTHS:
            depth = min(n, max(1, int(np.ceil(n * share))))
            up, down = np.maximum(q[active], 0).astype(kind), np.minimum(q[active], 0).astype(kind)
            top, bottom = rank >= n - depth, rank < depth
            known = (top * xs) @ up.T + (bottom * xs) @ down.T
            lower = upper = known
            if depth < n:
                not_top, not_bottom = (~top).astype(kind), (~bottom).astype(kind)
                lower = known + not_top @ (up * ranked[0]).T + not_bottom @ (down * ranked[-1]).T
                upper = known + not_top @ (up * ranked[n - depth]).T + not_bottom @ (down * ranked[depth - 1]).T
            cut = min(n, k + 1)  # the query's own row may be among them
            floor = np.partition(lower, n - cut, axis=0)[n - cut]
            reach = upper >= floor
            ready = (reach.sum(axis=0) <= RESOLVE * (k + 1)) | (depth == n)
            for j in np.flatnonzero(ready):
                resolve(active[j], np.flatnonzero(reach[:, j]))
            active = active[~ready]
            if not len(active):
                break
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def top_k(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
          every: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x).

    Null, empty and non-finite vectors take no part, zero vectors do. Rows
    without id and rows that share one are candidates like all others; a
    query leaves out its own row only, and query rows that share an id are
    answered one by one. Ties go to the smaller id, null ids last. Empty input
    gives an empty result. Components above 2**53 / scale in size are not exact.
    """
    rows = vectors(table, id_col, vector_col, every)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    return search(rows, k, kernel, "long")


ORACLE = r"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS own, vec_id,
         list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.own, q.vec_id AS query_id, r.vec_id,
         list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole r ON q.vec_id % 20 = 0 AND q.own <> r.own AND len(q.v) = len(r.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
