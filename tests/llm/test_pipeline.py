"""The corpus pipeline, each stage on all that its predecessor kept, against a brute-force version."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from spineworks.llm import cotraining
from spineworks.llm.common import tokenizer_path
from tests.llm.test_operators import WORD, _simhash
from tests.llm.test_text import SMALL, _repeats


def _near(docs):
    """One row of each SimHash class: that of the smallest id."""
    fp = [_simhash(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    best = {}
    for i, (d, *_) in enumerate(docs):
        k = find(i)
        best[k] = min(best.get(k, d), d)
    return sorted(r for r in docs if r[0] in set(best.values()))


def _mixed(docs):
    """Each source's queue, served round after round up to its target."""
    size = {d: len(WORD.findall((t or "").encode())) for d, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    have = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    low, high = 0.0, 1e9  # the water level by bisection
    for _ in range(200):
        level = (low + high) / 2
        total = sum(min(2 * have[s], weight[s] * level) for s in sources)
        low, high = (level, high) if total < 1.5 * sum(have.values()) else (low, level)
    out = []
    for s in sources:
        left = math.floor(min(2 * have[s], weight[s] * high) + 1e-6)
        queue = sorted((hashlib.md5(f"{d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), d, t)
                       for d, t, x in docs if x == s)
        for _ in range(2):
            for _, d, t in queue:
                words = WORD.findall((t or "").encode())[:left]
                if words:
                    out.append((d, t if len(words) == size[d] else b" ".join(words).decode()))
                left -= len(words)
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = cotraining.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    accepted = {r.doc_id for r in cotraining.score(docs, model).collect() if r.accepted}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in accepted)
    assert 0 < len(rows) < docs.count()
    want = [sorted((d, t) for d, t, _ in rows)]
    near = _near(rows)
    want.append(sorted((d, t) for d, t, _ in near))
    source = {d: s for d, _, s in near}
    kept = [(d, t) for d, t in _repeats([(d, t) for d, t, _ in near])
            if WORD.findall((t or "").encode()) or not WORD.findall(dict(want[1])[d].encode())]
    want.append(sorted(kept))
    want.append(sorted(_mixed([(d, t, source[d]) for d, t in kept])))
    for (name, step), right in zip(corpus_pipeline.STAGES, want):
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), "test")
        got = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        assert got == right, name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # packing: every id of every row lies in one piece, sequences are gapless
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = defaultdict(list)
    for d, t in want[-1]:
        ids[d].append(np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sum(p.length for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start:p.start + p.length].tobytes()) == p.ids_crc32
                   for x in ids[p.doc_id])
    whole = corpus_pipeline.run(spark, SMALL).collect()
    digest = lambda found: sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in found)
    assert sum(p.length for p in whole) == sum(p.length for p in pieces)
    assert {p[0] for p in digest(whole)} == {p[0] for p in digest(pieces)}
