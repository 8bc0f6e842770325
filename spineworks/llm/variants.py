"""Spelling variants: words at one edit, grouped under their far more frequent neighbours.

Search scheme: an edit lies in one half of a word, so the other half matches
exactly. A word goes to the shards of the halves by which a neighbour could
look for it (prefixes and suffixes of the two possible lengths); a query goes
to the shards of its own two halves. Each shard is an FM-index of at most
about ``SHARD_LETTERS`` letters over delimited words (reversed words where
the front half is exact): the exact half narrows a suffix-rank interval, the
other half extends it with one error. Queries stream past the index, so a
task holds one index, whatever the number of queries.

A half that more than ``HALF_WORDS`` words share is split by word hash over
several shards, and its queries visit each of them. The vocabulary never
reaches the driver or one task.

Defined results: null texts hold no words; a null ``doc_id`` reads as the
empty string in the hashed ``<doc_id>:<word>``; repeated rows count each
time; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, stage
from .fm_index import Block

#: Letters of one shard's index, and words of one half before it is split.
SHARD_LETTERS, HALF_WORDS = 100_000, 5_000
#: Distinct words that a task counts before it hands the counts on.
COUNT_WORDS = 200_000
#: Queries searched at once.
QUERY_ROWS = 8_192

_RUN = r"[a-zÀ-ÿ]"


def _counted(min_length: int, drop_one_in: int):
    """Words of texts after the planned deletions, counted batch by batch."""
    runs = re.compile(f"{_RUN}{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                  ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = Counter(runs.findall(text.encode("utf-8").lower().decode("utf-8")))  # bytes: A-Z only
                head = b"" if doc_id.as_py() is None else b"%d" % doc_id.as_py()
                start = zlib.crc32(head + b":")
                for word, n in found.items():
                    h = zlib.crc32(word.encode("utf-8"), start)
                    if h % drop_one_in == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1:]
                        if len(word) < min_length:
                            continue
                    total[word] += n
                if len(total) > COUNT_WORDS:
                    yield flush()
        if total:
            yield flush()
    return count


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_one_in: int = 31) -> DataFrame:
    """(word, n): words of at least ``min_length`` letters that occur ``min_count`` times or more overall."""
    words = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
                                  .alias("text")), _counted(min_length, drop_one_in), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _halves(word: F.Column, lengths) -> list:
    """(side, half) structs; ``lengths`` gives the front length for a word length."""
    n = F.char_length(word)
    return ([F.struct(F.lit(1).alias("side"), F.substring(word, F.lit(1), front).alias("half"))
             for front in lengths[0]]
            + [F.struct(F.lit(0).alias("side"), F.substring(word, n - back + 1, back).alias("half"))
               for back in lengths[1]])


def _routed(words: DataFrame, shards: int) -> DataFrame:
    """(shard, query, word, n): each word as index row and as query, in all shards it takes part in."""
    n = F.char_length("word")
    half = lambda x: F.floor(x / 2).cast("int")
    back = lambda x: (x - half(x)).cast("int")
    # a query of length m cuts at m // 2; a word of length n answers queries of lengths n - 1 to n + 1
    index = _halves(F.col("word"), ([half(n - 1), half(n + 1)], [back(n - 1), back(n + 1)]))
    query = _halves(F.col("word"), ([half(n)], [back(n)]))
    index = (words.select("word", "n", F.explode(F.array_distinct(F.array(*index))).alias("key"))
             .select("word", "n", "key.*"))
    hot = (index.groupBy("side", "half").agg(F.count("*").alias("words")).where(F.col("words") > HALF_WORDS)
           .select("side", "half", F.ceil(F.col("words") / HALF_WORDS).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    shard = lambda part: (F.pmod(F.xxhash64("side", "half", part), F.lit(shards)) * 2
                          + F.col("side")).alias("shard")
    index = (index.join(hot, ["side", "half"], "left")
             .select(shard(F.pmod(F.xxhash64("word"), parts).cast("int")), F.lit(False).alias("query"), "word", "n"))
    query = (words.select("word", "n", F.explode(F.array(*query)).alias("key")).select("word", "n", "key.*")
             .join(hot, ["side", "half"], "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
             .select(shard(F.col("part")), F.lit(True).alias("query"), "word", "n"))
    return index.unionByName(query)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, query, word, n) by shard, index rows first: (word, near, near_n)."""
    at, indexed, block = None, {}, None
    waiting: list[str] = []

    def answer():
        side = at % 2
        turned = [q[::-1] for q in waiting] if side else waiting
        exact = [len(q) // 2 if side else len(q) - len(q) // 2 for q in waiting]
        q, w = block.one_edit(turned, exact)
        words, near = [], []
        for i, j in zip(q.tolist(), w.tolist()):
            found = block.words[j][::-1] if side else block.words[j]
            # an edit at the cut is found from both sides; the front half's search reports it
            if side or not found.startswith(waiting[i][:len(waiting[i]) // 2]):
                words.append(waiting[i])
                near.append(found)
        waiting.clear()
        return pa.record_batch([pa.array(words, pa.string()), pa.array(near, pa.string()),
                                pa.array([indexed[x] for x in near], pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for shard, query, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if shard != at:
                if waiting:
                    yield answer()
                at, indexed, block = shard, {}, None
            if not query:
                indexed[word] = n
                continue
            if not indexed:
                continue
            if block is None:
                block = Block(sorted(w[::-1] for w in indexed) if at % 2 else sorted(indexed))
            waiting.append(word)
            if len(waiting) >= QUERY_ROWS:
                yield answer()
    if waiting:
        yield answer()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of distinct words (word, n) at exactly one edit."""
    letters = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    shards = max(1, -(-4 * letters // SHARD_LETTERS) // 2)
    routed = _routed(words, shards)
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = routed.repartition(max(partitions, -(-shards // 8)), "shard").sortWithinPartitions("shard", "query")
    # a split half's word can also stand in a shard by its other halves
    return (map_arrow(routed, _search, "word string, near string, near_n long")
            .repartition("word").dropDuplicates(["word", "near"]))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): pointers are doubled until each stands at its last word.

    Forms grow tenfold in count at each step, so five rounds reach any end.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "variant-links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(links.join(onward, "root", "left")
                      .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")),
                      "variant-links")
        open_ends = moved.where("on").limit(1).count()
        discard(links)
        links = moved.drop("on")
        if not open_ends:
            return links


def group(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, drop_one_in: int = 31
          ) -> DataFrame:
    """Each word with its neighbours' number, its form and its root.

    (word, form, root, n, n_near, form_n). The form is the neighbour of the
    largest count (ties: the smallest by code point) if it occurs at least
    ``ratio`` times as often; the root is the end of the chain of forms.
    """
    words = stage(vocabulary(docs, min_length, min_count, drop_one_in), "variant-words")
    best = (neighbours(words).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best")))
    far = -F.col("best.minus_n") >= F.lit(ratio) * F.col("n")
    found = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.minus_n")).alias("form_n")),
        "variant-forms")
    discard(words)
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(bytes)),
           lambda i: ('0x' || substr(hex(bytes), (2 * i + 1)::BIGINT, 2))::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) AS h
  FROM (SELECT run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS bytes FROM counted)),
spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END
         AS word, n
  FROM hashed),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
-- letter i left out (0: none): words at one edit share the rest at the same i, or one is the other's rest
cut AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS rest
        FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM vocabulary)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n
         FROM cut a JOIN cut b ON a.rest = b.rest AND a.word <> b.word
         WHERE a.i = b.i OR (a.i = 0) <> (b.i = 0)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n
         FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near,
                  CASE WHEN b.form_n >= 10 * v.n THEN b.form END AS form,
                  CASE WHEN b.form_n >= 10 * v.n THEN b.form_n END AS form_n
           FROM vocabulary v LEFT JOIN best b USING (word)),
chain AS (
  WITH RECURSIVE walk(word, stand) AS (
    SELECT word, word FROM formed
    UNION ALL
    SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.stand WHERE f.form IS NOT NULL)
  SELECT w.word, w.stand AS root FROM walk w JOIN formed f ON f.word = w.stand WHERE f.form IS NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word
"""
