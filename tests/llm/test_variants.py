"""Spelling variants: the FM-index and the grouping against brute force, and edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from spineworks.llm import queries, variants
from spineworks.llm.fm_index import Block
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute(rows, ratio=10):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def _rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_fm_index_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 50))})
        asked = ["".join(rnd.choice("abéz") for _ in range(rnd.randint(1, 6))) for _ in range(15)]
        exact = [rnd.randint(0, len(q)) for q in asked]
        q, w = Block(words).one_edit(asked, exact)
        want = {(i, x) for i, (s, e) in enumerate(zip(asked, exact)) for x in words
                if e <= len(x) and x.endswith(s[len(s) - e:]) and _one_edit(s[:len(s) - e], x[:len(x) - e])}
        assert {(i, words[j]) for i, j in zip(q.tolist(), w.tolist())} == want


@pytest.mark.parametrize("split", [False, True])
def test_grouping_against_brute_force(spark, monkeypatch, split):
    if split:  # tiny shards, and halves of more than three words over several of them
        monkeypatch.setattr(variants, "HALF_WORDS", 3)
        monkeypatch.setattr(variants, "SHARD_LETTERS", 400)
    rnd = random.Random(2)
    stems = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(7, 9))) for _ in range(12)]

    def word():
        w = rnd.choice(stems[:3] if rnd.random() < .6 else stems)
        if rnd.random() < .3:
            i = rnd.randrange(len(w))
            w = w[:i] + rnd.choice(["", "x", w[i] + "y"]) + w[i + 1:]
        return w.upper() if rnd.random() < .1 else w
    rows = [(d, " ".join(word() for _ in range(40))) for d in range(60)]
    assert _rows(variants.group(spark.createDataFrame(rows, "doc_id long, text string"))) == _brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Streets streets; street_s 7streets"), (None, "streets strets"),
            (3, "strets x" + "streets " * 50), (3, "strets x" + "streets " * 50), (4, "x" * 70_000 + " " + "x" * 69_999),
            (5, "x" * 70_000 + " " + "x" * 69_999), (6, "été×÷été ete")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    assert _rows(variants.group(df)) == _brute(rows)
    assert _rows(variants.group(df.limit(0))) == []


def test_op13_against_sql(spark):
    r = compare(spark, "op13_spelling_variants", SF, queries.QUERIES, queries.ORACLE)
    assert r["ok"], r
