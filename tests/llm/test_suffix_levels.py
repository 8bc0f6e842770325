"""Repeated byte strings against brute force: planted passages, hot grams, pieces of long texts, edge cases, SQL."""

import hashlib
import random

import numpy as np
import pytest

from spineworks.llm import queries, sparse_suffixes, suffix_levels
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def _brute(rows, length):
    """(doc_id, n_bytes, removed runs, kept) of documents in order."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append((doc_id, len(raw), edge[::2].tolist(), edge[1::2].tolist(),
                    bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def _sorted(rows):
    return sorted(rows, key=str)


def _got(df, length, batches=4):
    return _sorted((r.doc_id, r.n_bytes, list(r.starts), list(r.ends), bytes(r.kept))
                   for r in suffix_levels.remove_repeats(df, length, batches).collect())


def _texts(rnd, n=60):
    passages = ["".join(rnd.choice("abcd é") for _ in range(rnd.randint(90, 400))) for _ in range(6)]
    line = "".join(rnd.choice("xyz") for _ in range(140))
    out = []
    for i in range(n):
        parts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 150))) for _ in range(3)]
        if rnd.random() < .7:
            p = rnd.choice(passages)
            parts.insert(1, p[rnd.randint(0, 40):len(p) - rnd.randint(0, 40)])
        if rnd.random() < .5:
            parts.insert(2, line)
        out.append("".join(parts) if i % 9 else "ab" * rnd.randint(20, 200))
    return out + out[:5]


@pytest.mark.parametrize("length,batches,group", [(100, 4, 2_000), (100, 7, 3), (40, 1, 2)])
def test_against_brute_force(spark, monkeypatch, length, batches, group):
    monkeypatch.setattr(suffix_levels, "GROUP", group)
    rnd = random.Random(length + batches)
    ids = rnd.sample(range(-50, 500), 65)
    rows = list(zip(ids, _texts(rnd)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(df, length, batches) == _sorted(_brute(rows, length))


def test_entries_cover_every_window():
    rnd = np.random.default_rng(3)
    sizes = np.array([0, 99, 100, 101, 5_000, 30, 700])
    data = rnd.integers(97, 99, sizes.sum()).astype(np.uint8)
    _, _, row, start, size = sparse_suffixes.entries(data, np.concatenate([[0], np.cumsum(sizes)]), 100)
    found = sorted((r, s + i) for r, s, k in zip(row, start, size) for i in range(k))
    assert found == [(r, s) for r, n in enumerate(sizes) for s in range(n - 99)]
    assert size.max() <= 100 - sparse_suffixes.GRAM + 1


def test_edges(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh") for _ in range(1_200_000))  # more than one piece
    a, b = ("".join(rnd.choice("abc") for _ in range(300)) for _ in range(2))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, "x" + long[900_000:1_100_000] + "y"), (6, "z" * 1_000),
            (7, a), (None, a + b)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, d string, tie int")
    assert _got(df, 100) == _sorted(_brute(rows, 100))
    assert _got(df.limit(0), 100) == []
    # repeated ids and rows: one of the equal rows stays, the texts of one id and of null ids are told apart
    rows = [(1, a), (1, a), (1, a), (1, b), (None, a + "q"), (None, b + "r"), (None, b + "r"), (1, "few"), (1, "few")]
    got = suffix_levels.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(bytes(r.kept) for r in got if r.doc_id == 1)
    assert kept == sorted([a.encode(), b.encode(), b"", b"", b"few", b"few"])
    assert sum(r.n_removed for r in got if r.doc_id is None) == 300 + 300 + 301


def test_digests_are_those_of_the_kept_bytes(spark):
    rows = list(zip(range(65), _texts(random.Random(4))))
    got = suffix_levels.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, n, sum(e) - sum(s), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, e, k in _brute(rows, 100)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_op12_against_sql(spark):
    r = compare(spark, "op12_suffix_dedup", SF, queries.QUERIES, queries.ORACLE)
    assert r["ok"], r
