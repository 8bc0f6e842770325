"""The registered operators against brute force on the small tables, and their edge cases."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
import re

from spineworks.llm import mixing, packing, queries, simhash, token_files
from spineworks.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EDGES = [(1, None, "a"), (2, "", "a"), (3, "  \n", None), (4, "Same words here now.", "b"),
         (4, "Same words here now.", "b"), (5, "same WORDS here now.", None), (6, "long " * 30_000, "c"),
         (None, "no id at all", "c"), (7, "<|endoftext|> été x", "a")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in EDGES], "doc_id long, text string, source string, size int, h string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def _docs(sf=SF):
    return duckdb.sql(f"select doc_id, text, source from '{sf}/documents.parquet'").fetchall()


def _simhash(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(low)
    sh = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _check_simhash(rows, got):
    fps = [(d, _simhash(t)) for d, t, *_ in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        low[find(i)].append(d)
    want = [(d, f"{f:016x}", min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(fps)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got)


def test_op1(spark, edges, empty):
    _check_simhash(_docs(), queries.QUERIES["op1_simhash_near_dedup"](spark, SF).collect())
    _check_simhash(EDGES, simhash.near_duplicates(edges).collect())
    assert simhash.near_duplicates(empty).count() == 0


def test_op3(spark, edges, empty):
    got = queries.QUERIES["op3_mix_sources"](spark, SF).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert r.taken <= 2 * r["size"]
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
        by[r.source][2] = r.source_size
    for taken, target, size in by.values():
        assert abs(taken - target) <= 1 and target <= 2 * size
    assert len(got) == len(_docs())
    assert mixing.mix(edges).count() == len(EDGES)
    assert mixing.mix(empty).count() == 0


def _tokens(path, end, rows):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path(path))
    return [(d, np.array([*lib.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t, *_ in rows]


def test_op7(spark, edges, empty):
    want, at = [], 0
    for d, ids in sorted(_tokens("byte_bpe_50k.json", 0, _docs()), key=lambda x: x[0]):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op7_token_files"](spark, SF).collect()) == want
    path = tokenizer_path("byte_bpe_50k.json")
    got = token_files.round_trip(edges, path, segment_ids=50).collect()
    brute = sorted((str(d), len(i), zlib.crc32(i.tobytes())) for d, i in _tokens("byte_bpe_50k.json", 0, EDGES))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == brute
    assert token_files.round_trip(empty, path).count() == 0


def _check_packing(rows, got):
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    for d, ids in _tokens("word_bpe_49k.json", 1, rows):
        if sum(x[0] == d for x in rows) > 1:
            continue
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)


def test_op10(spark, edges, empty):
    _check_packing(_docs(), queries.QUERIES["op10_pack"](spark, SF).collect())
    path = tokenizer_path("word_bpe_49k.json")
    _check_packing(EDGES, packing.pack(edges, path).collect())
    assert packing.pack(empty, path).count() == 0


def test_token_ids_equal_the_library(spark):
    from tokenizers import Tokenizer
    from spineworks.llm import tokens
    rnd = np.random.default_rng(5)
    texts = [t or "" for _, t, _ in _docs()] + ["", " ", "\n\n a  b\t\tc \n", "<|endoftext|> été x", "a\u00a0b\u2003c", "ÀÉ É e\u0301",
                                                 "x" * 5000 + " y", "don't we'll I'm 's 're ' s", "\x00 \x1c a\x1db", "日本語テキスト " * 30,
                                                 "1234 5,6.7!!", "ﬁ ① Å"]
    texts += ["".join(rnd.choice(list(" \n\tab'sTR.,1é <|>日"), rnd.integers(0, 40))) for _ in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        got = tokens.Encoder(tokenizer_path(name))
        want = Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)
        for turn in range(2):  # the second time all pieces are known
            for i in range(0, len(texts), 150):
                for t, w, g in zip(texts[i:i + 150], want[i:i + 150], got.encode([t.encode() for t in texts[i:i + 150]])):
                    assert np.frombuffer(g, "<u2").tolist() == w.ids, t


def test_token_files_spread_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i % 50} of some words") for i in range(6000)], "doc_id long, text string")
    manifest = token_files.write(docs, str(tmp_path), tokenizer_path("byte_bpe_50k.json"))
    rows = [r[0] for r in manifest.groupBy("part").sum("documents").select("sum(documents)").collect()]
    assert sum(rows) == 6000 and max(rows) <= 2 * 6000 / len(rows), rows


def test_op3_spreads_null_ids_over_the_queue(spark):
    rows = [(None if i % 3 else i, f"{i} " + "w " * (i % 40), "a") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    finish = sorted(r.finish for r in got if r.doc_id is None)
    # finish times of the rows without id run evenly through the queue
    middle = finish[len(finish) // 2] / max(r.finish for r in got)
    assert abs(middle - .5) < .1
