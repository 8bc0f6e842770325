"""Vector searches against brute force, and their edge cases."""

import duckdb
import numpy as np
import pytest

from spineworks.llm import bounded_topk, collision_search, queries

SF = "/root/testdata/sf0.001"
BAD = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
       (6, [float("inf"), 1.0]), (20, [0.0, 0.0]), (40, [1.0, 2.0]), (41, [1.0, 2.0]), (41, [1.0, 2.0]),
       (None, [9.0, 9.0]), (60, [1.0, 0.0, 5.0]), (61, [-1.0, 0.0, 5.0]), (80, [1.0])]


def _brute(rows, k, score):
    out = {}
    for n, (q, v) in enumerate(rows):
        if q is not None and q % 20 == 0:
            found = sorted((-score(v, w), i is None, i or 0) for m, (i, w) in enumerate(rows) if m != n and len(v) == len(w))
            out[q] = [(None if none else i, -s) for s, none, i in found[:k]]
    return out


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def _embeddings():
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows]


@pytest.fixture(scope="module")
def bad(spark):
    return spark.createDataFrame([(*r, 1) for r in BAD], "vec_id long, embedding array<double>, dim int")


def test_op5(spark, bad):
    rows = [(i, np.floor(64 * v).astype(int)) for i, v in _embeddings()]
    assert _got(queries.QUERIES["op5_exact_top_k"](spark, SF)) == _brute(rows, 20, lambda a, b: int(a @ b))
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in BAD
            if v and all(x is not None and np.isfinite(x) for x in v)]
    want = {q: r for q, r in _brute(good, 20, lambda a, b: int(a @ b)).items() if r}
    assert _got(bounded_topk.top_k(bad)) == want
    assert bounded_topk.top_k(bad.limit(0)).count() == 0


def test_op4(spark, bad):
    want = _brute(_embeddings(), 20, lambda a, b: float((a * b).sum()))
    got = _got(queries.QUERIES["op4_nearest"](spark, SF))
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(len(r) == 20 for r in got.values())
    assert _got(collision_search.nearest(bad))[0] == [(None, 27.0), (40, 5.0), (41, 5.0), (41, 5.0), (1, 1.0)]
    assert collision_search.nearest(bad.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 300, 2000])
def test_kernels(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 16)) * rng.uniform(0.1, 3, (n, 1))
    x[n // 2:] = x[:n - n // 2]  # ties
    ids, q = np.arange(n) * 2, x[:n:7]
    asked = ids[::7]
    for kernel, a, b in ((collision_search.kernel, x, q), (bounded_topk.kernel, np.floor(x * 9), np.floor(q * 9))):
        qi, ri, s = kernel(ids, ids, a, asked, b, 5)
        hit = total = 0
        for i in range(len(asked)):
            full = (a * b[i]).sum(axis=1)
            rows = [r for r in np.lexsort((ids, -full)) if ids[r] != asked[i]][:5]
            mine = ri[qi == i].tolist()
            hit, total = hit + len(set(rows) & set(mine)), total + len(rows)
            if kernel is bounded_topk.kernel:
                assert mine == rows and s[qi == i].tolist() == full[rows].tolist()
        assert hit >= 0.9 * total


def test_every_row_is_a_candidate(spark):
    rows = [(20, [1.0, 0.0]), (20, [.5, .5]), (1, [1.0, 1.0]), (1, [5.0, 0.0]), (None, [9.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search, scale in ((collision_search.nearest, 1.0), (bounded_topk.top_k, 64.0 * 64)):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score / scale) for r in search(df).collect())
        assert got == sorted([(20, 1, None, 9.0), (20, 2, 1, 5.0), (20, 3, 1, 1.0), (20, 4, 20, .5),
                              (20, 1, None, 4.5), (20, 2, 1, 2.5), (20, 3, 1, 1.0), (20, 4, 20, .5)])


def test_recall_and_share_verified(monkeypatch):
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()
    x = np.array([v for _, v in rows], float)
    ids, n = np.arange(len(x)), len(x)
    asked = ids[::20]
    verified = []
    real = np.lexsort

    def counted(keys):
        verified.append(len(keys[0]))
        return real(keys)
    monkeypatch.setattr(collision_search.np, "lexsort", counted)
    q, r, _ = collision_search.kernel(ids, ids, x, asked, x[asked], 20)
    monkeypatch.undo()
    full = x[asked] @ x.T
    full[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-full, axis=1)[:, :20]
    recall = np.mean([len(set(want[i]) & set(r[q == i])) / 20 for i in range(len(asked))])
    assert recall >= 0.93, recall
    assert np.mean(verified) <= 0.22 * n, np.mean(verified)


def test_bounds_stop_the_reading():
    rows = duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchall()
    x = np.floor(64 * np.array([v for v, in rows], float))
    ids = np.arange(len(x))
    seen = []

    class Depths(tuple):
        def __iter__(self):
            for d in tuple.__iter__(self):
                seen.append(d)
                yield d
    kept, bounded_topk.DEPTHS = bounded_topk.DEPTHS, Depths(bounded_topk.DEPTHS)
    try:
        bounded_topk.kernel(ids, ids, x, ids[::20], x[::20], 20)
    finally:
        bounded_topk.DEPTHS = kept
    assert max(seen) < 1.0  # all queries are answered before the lists end
