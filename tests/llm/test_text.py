"""Substring dedup, license scan, scoring, classifier and pipeline against brute force and planted cases."""

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from spineworks.llm import chunks, cotraining, licenses, queries, scoring
from spineworks.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, "  \n", "en", "a", 3),
            (4, "one row twice", "en", "a", 13), (4, "one row twice", "en", "a", 13), (None, "no id", "en", "b", 5),
            (6, "long " * 40_000, "en", "c", 200_000), (7, "under the MIT license, CC-BY-NC", "en", "b", -1)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, key int, words int")


def test_gear_is_the_rolling_hash():
    data = np.frombuffer(b"some text that rolls on and on for more than thirty-two bytes", np.uint8)
    got, want, h = chunks.gear(data, np.array([0, 10, len(data)])), [], 0
    for i, b in enumerate(data):
        h = 0 if i == 10 else h
        h = (2 * h + int(chunks.GEAR[b])) % 2 ** 32
        want.append(h)
    assert got.tolist() == want


def test_op2_removes_planted_passages_only(spark):
    rng = random.Random(3)
    passage = _prose(rng, 60)
    rows = [(i, _prose(rng, 200)) for i in range(40)]
    planted = {5, 9, 17, 33}
    rows = [(i, t[:500] + " " + passage + " " + t[500:] if i in planted else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunks.dedup_substrings(docs).collect()}
    assert {i for i, r in got.items() if r.removed_words} == planted - {5}
    for i, t in rows:
        if i in planted - {5}:
            assert 25 <= got[i].removed_words <= 60
            assert len(got[i].text.split()) == len(t.split()) - got[i].removed_words
        else:
            assert got[i].text == t


def _words(raw):
    """Byte runs of words; long ones in short parts."""
    out = []
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        at, h = m.start(), _rolled(raw)
        if m.end() - m.start() <= chunks.LONG_WORD:
            out.append((m.start(), m.end()))
            continue
        for i in range(m.start(), m.end()):
            last = i + 1 == m.end()
            starts_char = last or raw[i + 1] & 0xC0 != 0x80
            if last or starts_char and h[i] >> 16 & 7 == 0:
                while i + 1 - at > chunks.LARGEST:
                    stop = at + chunks.LARGEST
                    while raw[stop] & 0xC0 == 0x80:
                        stop += 1
                    out.append((at, stop))
                    at = stop
                out.append((at, i + 1))
                at = i + 1
    return out


_rolls = {}


def _rolled(raw):
    if raw not in _rolls:
        _rolls.clear()
        h, out = 0, []
        for b in raw:
            h = (2 * h + int(chunks.GEAR[b])) % 2 ** 32
            out.append(h)
        _rolls[raw] = out
    return _rolls[raw]


def _repeats(rows, min_words=16):
    """Texts without the runs that stand earlier: each chunk's shortest run of ``min_words`` words, by bytes."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        words = _words(raw)
        h = _rolled(raw)
        ends = [i for i, (_, e) in enumerate(words) if h[e - 1] >> (32 - chunks.CUT_BITS) == 0 or i == len(words) - 1]
        gone, begin = np.zeros(len(raw), bool), 0
        for k, e in enumerate(ends):
            stop = next((x for x in ends[k:] if x - begin + 1 >= min_words), None)
            if stop is not None:
                a, b = words[begin][0], words[stop][1]
                gone[a:b] |= raw[a:b] in seen
                seen.add(raw[a:b])
            begin = e + 1
        out.append((d, None if t is None else bytes(c for c, g in zip(raw, gone) if not g).decode()))
    return out


def _kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_op2_against_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet' order by doc_id").fetchall()
    assert _kept(queries.QUERIES["op2_substring_dedup"](spark, SMALL)) == sorted(_repeats(docs), key=str)


def test_op2_texts_without_spaces(spark):
    rng = random.Random(8)
    letters = "一二三四五六七八九十abcdéö"
    passage = "".join(rng.choice(letters) for _ in range(600))
    rows = [(i, "".join(rng.choice(letters) for _ in range(700)) + passage * (i % 2) + rng.choice(letters) * 3_000)
            for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunks.dedup_substrings(docs).collect()}
    assert sorted(((i, r.text) for i, r in got.items()), key=str) == sorted(_repeats(rows), key=str)
    for i in (3, 5):  # most of the passage goes
        assert len(rows[i][1]) - len(got[i].text) > 350


def test_op2_keeps_runs_pieced_together_from_many_documents(spark):
    rng = random.Random(11)
    text = _prose(rng, 120)
    raw = text.encode()
    a, b, _, _ = chunks.cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    rows = []
    for i in range(len(a) - 3):  # four chunks of the text and a stranger: less than 16 words together
        if len(raw[a[i]:b[i + 3]].split()) < chunks.MIN_WORDS:
            rows.append((len(rows), _prose(rng, 30) + " " + raw[a[i]:b[i + 3]].decode() + " " + _prose(rng, 30)))
    rows.append((10_000, text))
    got = {r.doc_id: r for r in chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10_000].text == text


def test_op2_null_and_equal_ids_are_different_documents(spark):
    rng = random.Random(12)
    passage = _prose(rng, 60)
    rows = [(None, _prose(rng, 40) + " " + passage + " " + _prose(rng, 20)) for _ in range(3)]
    rows += [(5, _prose(rng, 40) + " " + passage) for _ in range(2)] + [(7, passage), (7, passage)]
    got = chunks.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.removed_words > 25 for r in got) == 6  # all but the first; equal rows count as one document


def test_op2_runs_reach_the_word_count():
    rng = np.random.default_rng(4)
    words, first = rng.integers(1, 9, 400), np.array([0, 3, 3, 60, 400])
    begin, end, row = chunks.runs(words, first, 16)
    for i, j, r in zip(begin, end, row):
        assert first[r] <= i <= j < first[r + 1]
        assert words[i:j + 1].sum() >= 16 > words[i:j].sum()
    starts = set(begin.tolist())
    for r in range(4):
        for i in range(first[r], first[r + 1]):
            assert (i in starts) == (words[i:first[r + 1]].sum() >= 16)


def test_op2_edges(spark, edges):
    got = chunks.dedup_substrings(edges, keep=("key", "words")).collect()
    assert len(got) == 8
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text is None and by_id[2].text == "" and by_id[3].words == 0
    assert by_id[None].carried == (1, 2) and by_id[4].removed_words == 0
    assert by_id[6].words == 40_000 and by_id[6].removed_words > 39_900
    assert chunks.dedup_substrings(edges.limit(0)).count() == 0


def test_op6(spark, edges):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    want = {}
    for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        w = word.findall((t or "").encode().translate(low))
        places = [(i, label) for label, p in licenses.BASE for i in range(len(w))
                  if w[i:i + len(p.split())] == p.encode().split()]
        want[d] = (len(w), len(places), min((p[0] for p in places), default=None),
                   max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places})))
    got = queries.QUERIES["op6_license_scan"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert any(r.n_base for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    out = {r.doc_id: r for r in licenses.scan(edges).collect()}
    assert out[7].base_labels == "cc-by-nc,mit" and out[1].n_words == 0 and out[1].labels == ""
    assert licenses.scan(edges.limit(0)).count() == 0


def test_template_markup():
    machine = licenses.compile_templates([("x", "a <<opt>>b c<</opt>> d <<var:2>> e")])
    yes = ["a d e", "a b c d e", "z a d q q e", "a d e e"]
    no = ["a b d e", "a d q q q e", "a c d e", "a d"]
    assert all(licenses.matches(t.encode().split(), machine) for t in yes)
    assert not any(licenses.matches(t.encode().split(), machine) for t in no)


def _notice(template, fill, options):
    """A text of the template: optional regions in or out, variable ones filled."""
    while (m := re.search(r"<<opt>>((?:(?!<<opt>>).)*?)<</opt>>", template)):
        template = template[:m.start()] + (m[1] if options else "") + template[m.end():]
    return re.sub(r"<<var:\d+>>", fill, template)


def test_op6_takes_whole_notices_only(spark):
    rows, want = [], []
    for label, template in licenses.NOTICES:
        for fill, options in (("X", True), ("", False)):
            text = _notice(template, fill, options)
            rows.append(f"Copyright 2020 Someone\n{text.upper()}. And more text")
            want.append(label)
            words = text.split()
            for i in (len(words) // 3, len(words) - 1):  # one mandatory word replaced, or left out
                if re.search(rf"\b{words[i]}\b", re.sub(r"<<opt>>.*?<</opt>>", "", template)):
                    rows.append(" ".join([*words[:i], "never", *words[i + 1:]]))
                    rows.append(" ".join([*words[:i], *words[i + 1:]]))
                    want += [None, None]
    rows += ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the "
             "software without restriction, provided that nobody uses it", "SPDX-License-Identifier: MIT", "all rights reserved"]
    want += [None, None, None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(docs, base=()).collect()}
    whole = {label for label, _ in licenses.NOTICES}
    for i, label in enumerate(want):
        assert got[i] & whole == ({label} if label else set()), rows[i]
    assert "mit-reference" in got[len(rows) - 2] and got[len(rows) - 1] == {""}


def test_op6_labels_against_regular_expressions(spark):
    patterns = []
    for label, template in licenses.TEMPLATES:
        p = re.sub(r"\s+", " ", re.sub(r"(<<[^>]*>>)", r" \1 ", template)).strip()
        p = p.replace("<<opt>> ", "(?:").replace(" <</opt>> ", " )?").replace(" <</opt>>", " )?")
        p = re.sub(r"<<var:(\d+)>> ?", r"(?:\\S+ ){0,\1}", p)
        patterns.append((label, re.compile("(?:^| )" + (p if p.endswith(("?", "}")) else p + " "))))
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in queries.QUERIES["op6_license_scan"](spark, SF).collect()}
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for d, t in docs:
        low = " ".join(w.decode("utf-8", "replace") for w in word.findall(
            "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())) + " "
        want = {label for label, p in patterns if p.search(low)}
        want |= {label for label, p in licenses.BASE if f" {p} " in " " + low}
        assert got[d] == want, d


def test_op8(spark, edges):
    got = {r.doc_id: r for r in queries.QUERIES["op8_lm_score"](spark, SF).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    good, bad = ([got[d].difference for d, q in labels if q == k and d in got] for k in (1, 0))
    assert np.mean(good) < np.mean(bad)
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    ids = {d: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 50256], "<u2") for d, t in docs}
    table = np.zeros(scoring.VOCABULARY + scoring.CELLS)
    for x in ids.values():
        np.add.at(table, x, 1)
        np.add.at(table, scoring.VOCABULARY + scoring._cells(x), 1)
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    for r in scoring.score(small, small.limit(0), path).collect():
        x = ids[r.doc_id]
        assert r.n_tokens == len(x)
        assert r.background_loss == pytest.approx(scoring.losses(x, table, 50_257).mean(), rel=1e-4)
        assert r.target_loss == pytest.approx(r.background_loss, rel=1e-9)
    assert scoring.score(edges, edges, path).count() == 8
    assert scoring.score(edges.limit(0), edges, path).count() == 0


def test_op8_counts_every_bigram_exactly(spark):
    from collections import Counter
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    docs.append((3_000_000, "one text <|endoftext|> and more of it"))
    ids = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 50256] for d, t in docs}

    def model(rows):
        return Counter(t for x in rows for t in x), Counter(p for x in rows for p in zip(x, x[1:]))

    def background(x, uni, pairs):
        single = [(uni[t] + 1) / (sum(uni.values()) + 50_257) for t in x]
        return single[:1] + [0.6 * pairs[a, b] / uni[a] + 0.4 * s if uni[a] else s for a, b, s in zip(x, x[1:], single[1:])]

    def adapted(x, uni, pairs, prior):
        first = (uni[x[0]] + scoring.PRIOR * prior[0]) / (sum(uni.values()) + scoring.PRIOR)
        return [first] + [(pairs[a, b] + scoring.PRIOR_AFTER * q) / (uni[a] + scoring.PRIOR_AFTER)
                          for a, b, q in zip(x, x[1:], prior[1:])]

    wide, near = model(ids.values()), model([x for d, x in ids.items() if d % 3 == 0])
    small = spark.createDataFrame(docs, "doc_id long, text string")
    part = small.where("doc_id % 3 = 0")
    for size, target in ((scoring.BLOCK_TOKENS, part), (20_000, part.select("doc_id"))):  # one block, many blocks
        got = scoring.score(small, target, path, block_tokens=size).collect()
        assert sorted(r.doc_id for r in got) == sorted(ids)
        for r in [x for x in got if x.doc_id % 4 == 0]:
            base = background(ids[r.doc_id], *wide)
            assert r.background_loss == pytest.approx(-np.mean(np.log(base)), rel=1e-9)
            assert r.target_loss == pytest.approx(-np.mean(np.log(adapted(ids[r.doc_id], *near, base))), rel=1e-9)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_op8_models_are_matched(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    half = docs.where("doc_id % 2 = 0")  # a target without a leaning, and documents outside it
    got = scoring.score(docs, half.select("doc_id"), tokenizer_path("byte_bpe_50k.json")).where("doc_id % 2 = 1").collect()
    assert abs(np.mean([r.difference for r in got])) < 0.15


def test_op9(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fit, held = labels.where("doc_id % 3 <> 1"), labels.where("doc_id % 3 = 1")
    model = cotraining.train(docs, fit)
    rows = cotraining.score(docs, model).join(held, "doc_id").collect()
    assert np.mean([r.accepted == (r.quality == 1) for r in rows]) >= 0.95
    assert np.mean([r.accepted for r in rows if r.quality == 1]) >= 0.97
    assert cotraining.score(edges, model).count() == 8
    assert {r.score for r in cotraining.score(edges, cotraining.train(edges, labels.limit(0))).collect()} == {0.5}
    assert cotraining.score(edges.limit(0), cotraining.train(edges.limit(0), labels)).count() == 0


def test_op9_learns_from_all_unlabelled_rows(spark):
    from pyspark.sql import functions as F
    rng = random.Random(9)
    good = lambda: _prose(rng, 40)
    bad = lambda: "$$ 0123 ## " * 12
    rows = [(i, good() if i % 2 else bad(), "a" if i % 2 else "b") for i in range(8_000)]
    ids = [r.id for r in spark.range(400, 8_000).orderBy(F.xxhash64("id").desc()).limit(60).collect()]
    for i in ids:  # rare sources among the last of the unlabelled rows
        rows[i] = (i, bad(), f"rare {i % 2}") if i % 2 == 0 else (i, good(), f"rare {i % 2}")
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(10 ** 6 + i, 0) for i in range(20_000)],
                                   "doc_id long, quality int")  # most labels are of documents that are not here
    model = cotraining.train(docs, labels)
    ask = spark.createDataFrame([(i, "", "en", s, 0) for i, s in enumerate(("rare 0", "rare 1", "unknown"))], docs.schema)
    got = {r.doc_id: r.metadata_score for r in cotraining.score(ask, model).collect()}
    assert got[0] + 0.05 < got[2] < got[1] - 0.05


def test_op9_source_weights_do_not_collide():
    n = 3_000
    sources = [f"s{i}" for i in range(n) for _ in range(10)]
    y = np.repeat(np.arange(n) % 2, 10)
    model = cotraining.fit_metadata([["en"] * len(y), sources, [5] * len(y)], y, np.ones(len(y)))
    assert np.array_equal(cotraining.metadata_z([["en"] * len(y), sources, [5] * len(y)], model) > 0, y == 1)


def test_pipeline(spark, edges):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SMALL)
        assert out.columns == docs.columns
        docs = corpus_pipeline.stage(out, "test")
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] > 0
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    for _, step in corpus_pipeline.STAGES:
        step(spark, edges, SMALL).collect()
        assert step(spark, edges.limit(0), SMALL).count() == 0
