"""Prefix trie against brute force: deep conversations, cut ones, edge cases, SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spineworks.llm import prefix_trie, queries
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth long, member string"


def _brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
        key = hashlib.md5(b"").digest()
        nodes[0, key].append((c, None, 0))
        for d, (role, text) in enumerate(whole, 1):
            before, key = key, hashlib.md5(key + f"{len(role)}:{role}{text}".encode()).digest()
            nodes[d, key].append((c, before, len(text)))
        ends[len(whole), key].append(c)
    children, leaves, saved = (defaultdict(int) for _ in range(3))
    for (d, k), m in sorted(nodes.items(), reverse=True):
        leaves[d, k] += not children[d, k]
        saved[d, k] += (len(m) - 1) * m[0][2]
        if d:
            up = d - 1, m[0][1]
            children[up] += 1
            leaves[up] += leaves[d, k]
            saved[up] += saved[d, k]
    name = {n: min(c for c, *_ in m) for n, m in nodes.items()}
    return sorted((name[d, k], d, -1 if d == 0 else name[d - 1, m[0][1]], len(m), children[d, k], leaves[d, k], saved[d, k],
                   hashlib.sha256(",".join(map(str, sorted(ends[d, k]))).encode()).hexdigest())
                  for (d, k), m in nodes.items())


def _got(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie(df).collect())


@pytest.mark.parametrize("band,joined", [(8, 8192), (2, 3)])
def test_against_brute_force(spark, monkeypatch, band, joined):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "JOINED_IDS", joined)
    rnd = random.Random(band)
    rows = [(c, t, rnd.choice(["user", "bot"]), rnd.choice(["a", "bb", "é"]))
            for c in [*range(0, 130), 305, 317, -7, -130, 250] for t in range(rnd.randint(1, 9))]
    assert _got(spark, rows) == _brute(rows)


def test_deep_and_hot(spark):
    # three conversations share 300 turns; one holds most rows, so partition borders cut it; many are equal
    rows = [(c, t, "r", f"t{t % 7}") for c in (200, 201, 202) for t in range(300 + 10 * (c % 100))]
    rows += [(400, t, "r", "same") for t in range(2_000)]
    rows += [(c, t, "r", f"hot {t}") for c in range(500, 700) for t in range(3)]
    rnd = random.Random(5)
    rnd.shuffle(rows)
    assert _got(spark, rows) == _brute(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (1, 0, "a", "1"), (1, 0, "a", "1"), (2, 5, "u", "x" * 50_000),
            (None, 1, "u", "lost"), (103, 1, "u", "few"), (104, 1, "ab", "c"), (105, 1, "a", "bc"), (204, 0, "u", "é")]
    assert _got(spark, rows) == _brute(rows)
    assert _got(spark, []) == []
    assert _got(spark, [(None, 1, "u", "x")]) == []


def test_op11_against_sql(spark):
    r = compare(spark, "op11_prefix_trie", SF, queries.QUERIES, queries.ORACLE)
    assert r["ok"], r
