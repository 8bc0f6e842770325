"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Documents come in batches, in ascending order. A batch's suffixes are sorted
into an array (a table bucketed by gram, sorted by gram and context in each
bucket), merge-scanned against the arrays of earlier batches (sort-merge joins
of co-bucketed tables: the levels are never shuffled), and what stands in none
of them becomes a new level; two levels of equal rank merge into one of the
next rank. So a suffix is rewritten once for each doubling of the index.

A full suffix array needs several bytes for each byte of text, more than the
disk that this operator may use. Only suffixes at content-chosen anchors are
kept (``sparse_suffixes``): each window of ``length`` bytes has one. They are
ordered by a 64-bit hash of the anchor's string and one of the whole context,
so equal contexts stand together. A context met again has only windows that
stand earlier. Contexts that share the anchor's string but differ elsewhere
can still share windows; these few (one in twenty on the test texts) fetch
their bytes and are compared window by window, byte for byte.

Defined results: null texts are empty. Documents are ordered by doc_id, null
ids last as one largest id, equal ids by a hash of the text; of repeated rows
(equal id and text) one counts as the first, all its windows stand earlier for
the others. Texts shorter than ``length`` lose nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sparse_suffixes
from .common import LAST, discard, document_order, map_arrow, shared_folder, stage, text_slices

#: Contexts of one gram that are compared by one task at once; more are dealt to several.
GROUP = 2_000
NO_BYTES = hashlib.sha256(b"").hexdigest()
_COPARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


class Levels:
    """Sorted suffix tables by rank, the newest last; equal ranks merge."""

    def __init__(self, spark):
        self.spark = spark
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                           int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        self.tables: list[tuple[int, str]] = []
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, *split: str) -> str:
        """Bucketed table of ``df`` in the shared folder; its name."""
        name = f"suffixes_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_folder(self.spark)}/stage-{name}"
        # rows with one gram meet in one bucket, joins compare (gram, context)
        before = self.spark.conf.get(_COPARTITION, "true")
        self.spark.conf.set(_COPARTITION, "false")
        try:
            w = df.write.bucketBy(self.buckets, "gram").sortBy("gram", "context").option("path", self.paths[name])
            (w.partitionBy(*split) if split else w).saveAsTable(name)
        finally:
            self.spark.conf.set(_COPARTITION, before)
        return name

    def rows(self, name: str) -> DataFrame:
        """The level's rows; a batch's table also holds those that other levels have."""
        table = self.spark.table(name)
        return table.where("novel").drop("novel") if "novel" in table.columns else table

    def drop(self, name: str) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        self.spark.sql(f"DROP TABLE {name}")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def scan(self, batch: DataFrame) -> DataFrame:
        """``batch`` with ``known``: some level holds its (gram, context)."""
        known = F.lit(False)
        for i, (_, name) in enumerate(self.tables):
            level = self.rows(name).select("gram", "context", F.lit(True).alias(f"in_{i}"))
            batch = batch.join(level, ["gram", "context"], "left")
            known = known | F.coalesce(f"in_{i}", F.lit(False))
        return batch.withColumn("known", known).drop(*[f"in_{i}" for i in range(len(self.tables))])

    def add(self, name: str) -> None:
        """New level of rank 0; levels of equal rank merge."""
        self.tables.append((0, name))
        self.merge()

    def merge(self, whole: bool = False) -> None:
        """Merge the newest levels while their ranks are equal, or all levels."""
        while len(self.tables) > 1 and (whole or self.tables[-1][0] == self.tables[-2][0]):
            (rank, new), (old_rank, old) = self.tables.pop(), self.tables.pop()
            keys, rest = ["gram", "context"], ["d", "tie", "start", "size"]
            a = self.rows(old).select(*keys, *[F.col(c).alias(f"old_{c}") for c in rest])
            b = self.rows(new).select(*keys, *rest)
            # levels are disjoint, so the merge of two sorted tables is their full outer sort-merge join
            both = a.join(b, keys, "full").select(*keys, *[F.coalesce(c, f"old_{c}").alias(c) for c in rest])
            merged = self.write(both)
            self.drop(old)
            self.drop(new)
            self.tables.append((max(rank, old_rank) + 1, merged))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, tie, text): ``d`` and ``tie`` order the documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *document_order(docs, "doc_id", text), text.alias("text"))


def _ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy("d", "tie", "start")))


def _indexed(base: DataFrame, length: int, batches: int) -> tuple[Levels, list[DataFrame]]:
    """Index of all first contexts, and (d, tie, start, size) of removed bytes by batch."""
    spark = base.sparkSession
    levels, removed = Levels(spark), []
    shares = [i / batches for i in range(1, batches)] or [0.5]
    cuts = base.agg(F.percentile_approx("d", shares, 1_000)).first()[0] if batches > 1 else None
    bounds = [None, *sorted(set(cuts or ()) - {LAST}), None]
    for low, high in zip(bounds, bounds[1:]):
        part = base if low is None else base.where(F.col("d") > low)
        part = part if high is None else part.where(F.col("d") <= high)
        found = stage(map_arrow(part.select("d", "tie", "text"), sparse_suffixes.sampled(length), sparse_suffixes.SCHEMA),
                      "suffix-batch", split="removed")
        spot = ["d", "tie", "start", "size"]
        batch = found.where("not removed").select("gram", "context", *spot).repartition(levels.buckets, "gram")
        in_order = Window.partitionBy("gram", "context").orderBy("d", "tie", "start")
        batch = (batch.withColumn("rank", F.rank().over(in_order)).withColumn("place", F.row_number().over(in_order))
                 .where("place = 1 or rank > 1"))  # a repeated row's entries are equal in all
        scanned = levels.scan(batch).select("gram", "context", *spot, ((F.col("rank") == 1) & ~F.col("known")).alias("novel"))
        name = levels.write(scanned, "novel")
        array = spark.table(name)
        removed.append(stage(found.where("removed").select(*spot).unionByName(
            array.where("not novel").select("d", "tie", "start", (F.col("size") + (length - 1)).alias("size"))),
            "suffix-removed"))
        discard(found)
        levels.add(name)
    levels.merge(whole=True)
    return levels, removed


def _contexts(length: int):
    """Rows (d, tie, text, spots) to the bytes of the spots."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "part", "split", "d", "tie", "start", "bytes"]
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                spots = rows.column(3)
                flat = spots.flatten()
                row = np.repeat(np.arange(rows.num_rows), np.diff(spots.offsets.to_numpy()))
                get = lambda c: flat.field(c).to_numpy(zero_copy_only=False)  # noqa: B023,E731
                raw, begin = data.tobytes(), (offsets[:-1][row] + get("start"))
                texts = [raw[i:j] for i, j in zip(begin.tolist(), (begin + get("size") + length - 1).tolist())]
                d, tie = (rows.column(i).to_numpy()[row] for i in (0, 1))
                yield pa.record_batch([pa.array(get("gram")), pa.array(get("part")), pa.array(get("split")), pa.array(d),
                                       pa.array(tie), pa.array(get("start")), pa.array(texts, pa.binary())], names)
    return cut


def _compared(length: int):
    """Contexts sorted by (gram, part, d, tie, start): bytes whose window stands in an earlier context of the group.

    Windows that do not, in a gram dealt to several groups, come with their
    digest, to be compared across the groups.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, last = None, set(), None
        for batch in batches:
            rows = []
            for gram, part, split, d, tie, start, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (gram, part) != group:
                    group, seen = (gram, part), set()
                elif last == (d, tie, start):
                    continue
                last = (d, tie, start)
                run = None
                for i in range(len(text) - length + 1):
                    window = text[i:i + length]
                    if window in seen:
                        run = i if run is None else run
                        continue
                    if run is not None:
                        rows.append((None, d, tie, start + run, i - run - 1 + length))
                        run = None
                    seen.add(window)
                    if split:
                        rows.append((hashlib.md5(window).digest(), d, tie, start + i, length))
                if run is not None:
                    rows.append((None, d, tie, start + run, len(text) - run))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["window", "d", "tie", "start", "size"])
    return compare


def _partly_equal(base: DataFrame, levels: Levels, length: int) -> DataFrame:
    """(d, tie, start, size) of removed bytes in contexts that share only a part with an earlier one."""
    spark = base.sparkSession
    if not levels.tables:
        return spark.createDataFrame([], "d long, tie long, start long, size long")
    name = levels.tables[0][1]
    index = levels.rows(name)
    shared = index.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1")
    groups = F.ceil(F.col("contexts") / GROUP).cast("int")
    spots = stage(index.join(shared, "gram").select(
        "d", "tie", F.struct("start", "size", "gram", F.pmod(F.xxhash64("d", "tie", "start"), groups).alias("part"),
                             (groups > 1).alias("split")).alias("spot")), "suffix-spots")
    levels.drop(name)
    by_doc = spots.groupBy("d", "tie").agg(F.collect_list("spot").alias("spots"))
    texts = base.select("d", "tie", "text").join(by_doc, ["d", "tie"])
    cut = map_arrow(texts, _contexts(length), "gram long, part long, split boolean, d long, tie long, start long, bytes binary")
    order = ["gram", "part", "d", "tie", "start"]
    grouped = cut.repartition(levels.buckets, "gram", "part").sortWithinPartitions(*order)
    found = stage(map_arrow(grouped, _compared(length), "window binary, d long, tie long, start long, size long"),
                  "suffix-compared")
    spot = ["d", "tie", "start", "size"]
    across = _ordered(found.where("window is not null"), "window").where("rank > 1")
    out = stage(found.where("window is null").select(*spot).unionByName(across.select(*spot)), "suffix-removed")
    discard(spots, found)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, tie, spots) to the maximal removed runs."""
    for batch in batches:
        spots = batch.column(2)
        flat, at = spots.flatten(), spots.offsets.to_numpy()
        start, size = (flat.field(c).to_numpy() for c in ("start", "size"))
        base = at[0]
        runs = [sparse_suffixes.union(start[i:j], start[i:j] + size[i:j]) for i, j in zip(at[:-1] - base, at[1:] - base)]
        n = np.array([len(a) for a, _ in runs], np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in runs]), pa.int64())) for k in (0, 1)]
        gone = [int((b - a).sum()) for a, b in runs]
        yield pa.record_batch([batch.column(0), batch.column(1), *lists, pa.array(gone, pa.int64())],
                              ["d", "tie", "starts", "ends", "n_removed"])


def repeats(base: DataFrame, length: int = 100, batches: int = 4) -> DataFrame:
    """(d, tie, starts, ends, n_removed): maximal runs of bytes in windows that also start earlier."""
    levels, removed = _indexed(base, length, batches)
    removed.append(_partly_equal(base, levels, length))
    every = removed[0]
    for part in removed[1:]:
        every = every.unionByName(part)
    lists = every.groupBy("d", "tie").agg(F.collect_list(F.struct("start", "size")).alias("spots"))
    out = stage(map_arrow(lists, _merged, "d long, tie long, starts array<long>, ends array<long>, n_removed long"),
                "suffix-runs")
    discard(*removed)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, tie, starts, ends, text) to the bytes that stay."""
    for batch in batches:
        at = 0
        for rows, data, offsets in text_slices(batch, "text"):
            raw, kept = data.tobytes(), []
            for i, (a, b) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())):
                text = raw[offsets[i]:offsets[i + 1]]
                kept.append(b"".join(text[x:y] for x, y in zip([0, *(b or [])], [*(a or []), len(text)])))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(kept, pa.binary())], ["d", "tie", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, batches: int = 4) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, n_removed, kept): every document with the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document before, or before it in the same document.
    """
    return _documents(_keyed(docs), length, batches, texts=True)


def _documents(base: DataFrame, length: int, batches: int, texts: bool) -> DataFrame:
    runs = repeats(base, length, batches)
    facts = base.select("doc_id", "d", "tie", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2("text", 256).alias("sha256"))
    # repeated rows become one with their number
    facts = facts.groupBy(*facts.columns).agg(F.count("*").alias("rows"))
    facts = stage(facts.join(runs, ["d", "tie"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long"))),
                  "suffix-documents")
    partly = facts.where("n_removed between 1 and n_bytes - 1").select("d", "tie", "starts", "ends")
    touched = base.select("d", "tie", "text").join(facts.select("d", "tie", "starts", "ends") if texts else partly,
                                                   ["d", "tie"]).select("d", "tie", "starts", "ends", "text")
    kept = map_arrow(touched, _kept, "d long, tie long, kept binary")
    if not texts:
        kept = kept.select("d", "tie", F.sha2("kept", 256).alias("kept_sha256"))
    kept = kept.dropDuplicates(["d", "tie"])
    every = facts.join(kept, ["d", "tie"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    # a repeated row's windows all stand in the first one
    again = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<long>")
    every = (every.withColumn("starts", F.when(again, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)))
             .withColumn("ends", F.when(again, F.array("n_bytes")).otherwise(F.coalesce("ends", none)))
             .withColumn("n_removed", F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed"))))
    if texts:
        return every.select("doc_id", "n_bytes", "starts", "ends", "n_removed",
                            F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    digest = (F.when(F.col("n_removed") == F.col("n_bytes"), F.lit(NO_BYTES)).when(F.col("n_removed") == 0, F.col("sha256"))
              .otherwise(F.col("kept_sha256")))
    return every.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
                        digest.alias("kept_sha256"))


def digests(docs: DataFrame, length: int = 100, batches: int = 4) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats``, moving only texts cut in part."""
    return _documents(_keyed(docs), length, batches, texts=False)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS doc, doc_id, hex(encode(coalesce(text, ''))) AS hx,
         octet_length(encode(coalesce(text, ''))) AS n
  FROM documents),
blocks AS (  -- short strings, so that taking a window out of one costs little
  SELECT doc, n, b, substr(hx, 2 * b + 1, 2 * (512 + 99)) AS hx
  FROM (SELECT doc, hx, n, unnest(range(0, n - 99, 512)) AS b FROM docs WHERE n >= 100)),
windows AS (
  SELECT doc, b + i AS s, md5(substr(hx, 2 * i + 1, 200)) AS w
  FROM (SELECT doc, b, hx, unnest(range(0, least(512, n - 99 - b))) AS i FROM blocks)),
again AS (SELECT doc, s FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc, s) > 1),
edges AS (SELECT doc, s, lag(s) OVER (PARTITION BY doc ORDER BY s) AS before FROM again),
runs AS (SELECT doc, s, count(*) FILTER (WHERE before IS NULL OR s > before + 100) OVER (PARTITION BY doc ORDER BY s) AS run
         FROM edges),
spans AS (SELECT doc, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc, run),
lists AS (SELECT doc, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts,
                 list(b ORDER BY a) AS ends FROM spans GROUP BY doc)
SELECT d.doc_id, d.n AS n_bytes, coalesce(l.n_removed, 0) AS n_removed, coalesce(l.n_spans, 0) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, coalesce(l.n_spans, 0) + 2), lambda i:
         substr(d.hx, 2 * coalesce(list_prepend(0, l.ends)[i], 0) + 1,
                2 * (coalesce(l.starts[i], d.n) - coalesce(list_prepend(0, l.ends)[i], 0)))), ''))) AS kept_sha256
FROM docs d LEFT JOIN lists l USING (doc)
"""
