"""Approximate nearest neighbours by collision counting over query-centred windows.

Rows of a block are projected on single random directions; each projection is
a sorted array, and a row's place in it (in 256ths of the block) is kept. A
query's windows are ranges of places around its own projections, found by
binary search in the sorted arrays; they grow by virtual rehashing, and each
row counts the windows it lies in. When enough rows reach the collision
threshold, the rows are verified on the original vectors in order of their
collisions, as far as the budget goes (rows of equal count together).

Inner products become distances by one added component: with M the largest
norm of the block, a row x gets sqrt(M^2 - |x|^2), and a query is scaled to
norm M with 0 added, so the nearest row has the largest inner product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .blocks import search, vectors

#: Projections (a count fits one byte), and the share of them in which a row must collide.
PROJECTIONS = 192
THRESHOLD = 0.72
#: Half a window's width at first, for distances between 0 and 2, and its growth from one rehashing to the next.
WIDTH, GROWTH = 1.3, 1.25
#: Rows that are verified: this share of a block, and at least so many times k.
BUDGET, LEAST = 0.2, 6
SEED = 42


def kernel(ids, own, x, query_own, q, k):
    """The k rows of largest inner product found for each query: (query index, row index, score)."""
    n, dim = x.shape
    top = np.sqrt((x * x).sum(axis=1)).max()
    unit = x / top
    lifted = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))[:, None]])
    asked = q / np.abs(q).max(axis=1, keepdims=True)
    asked /= np.sqrt((asked * asked).sum(axis=1, keepdims=True))
    directions = np.random.default_rng(SEED).standard_normal((dim + 1, PROJECTIONS))
    projected = np.ascontiguousarray((lifted @ directions).T)
    order = np.argsort(projected, axis=1, kind="stable")
    values = np.take_along_axis(projected, order, axis=1)  # the sorted arrays
    place = np.empty((PROJECTIONS, n), np.uint8)
    np.put_along_axis(place, order, (np.arange(n) * 256 // n).astype(np.uint8)[None, :], axis=1)
    centre = asked @ directions[:-1]
    need, budget = int(np.ceil(THRESHOLD * PROJECTIONS)), min(n, max(int(BUDGET * n), LEAST * k + 1))
    counts = np.zeros((len(q), n), np.uint8)
    waiting, width = np.arange(len(q)), WIDTH
    while len(waiting):
        # places of all windows of all waiting queries
        low, high = (np.stack([np.searchsorted(v, centre[waiting, j] + side * width, "left" if side < 0 else "right")
                               for j, v in enumerate(values)], axis=1) for side in (-1, 1))
        whole = ((low == 0) & (high == n)).all(axis=1)
        first = np.minimum(low * 256 // n, 255)
        span = np.minimum(np.maximum((high - 1) * 256 // n, first), 255) - first
        ready = whole.copy()
        for i, (f, s) in enumerate(zip(first.astype(np.uint8), span.astype(np.uint8))):
            inside = (place - f[:, None]) <= s[:, None]  # one-byte arithmetic wraps: both borders in one comparison
            count = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
            counts[waiting[i]] = count
            ready[i] |= np.count_nonzero(count >= need) >= budget
        waiting, width = waiting[~ready], width * GROWTH
    out_q, out_r, out_s = [], [], []
    for i in range(len(q)):
        least = np.partition(counts[i], n - budget)[n - budget]
        rows = np.flatnonzero(counts[i] >= least)
        rows = rows[own[rows] != query_own[i]]
        scores = (x[rows] * q[i]).sum(axis=1)
        best = np.lexsort((ids[rows], -scores))[:k]
        out_q.append(np.full(len(best), i))
        out_r.append(rows[best])
        out_s.append(scores[best])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product found.

    Every valid row is indexed in its block, rows without id and rows that
    share one too; a query leaves out its own row only, and query rows that
    share an id are answered one by one. Null, empty, zero and non-finite
    vectors take no part; a query without other rows gives none. Empty input
    gives an empty result.
    """
    rows = vectors(table, id_col, vector_col, every).where("exists(v, x -> x <> 0)")
    return search(rows, k, kernel, "double")
