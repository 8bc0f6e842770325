"""Token files: documents in ascending id order as rANS segments, written and read in parallel.

A file ``part-<partition>-<number>.rans`` holds one segment: a table of its
documents (id, null flag, token count), then the ids as :mod:`.rans` image.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import local_temp, map_arrow, shared_folder, stage
from .tokens import encoded_rows

#: A segment closes at this many ids (after a whole document).
SEGMENT_IDS = 1 << 20
MAGIC = b"SPWTOKS1"
_HEAD = struct.Struct("<8sQII")
_NAME = re.compile(r"part-(\d+)-(\d+)\.rans$")


def pack_segment(doc_ids: list, tokens: list[bytes]) -> bytes:
    """File image of documents and their uint16 ids."""
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    table = zlib.compress(ids.tobytes() + bytes(d is None for d in doc_ids)
                          + np.array([len(t) // 2 for t in tokens], "<u4").tobytes(), 6)
    raw = np.frombuffer(b"".join(tokens), "<u2")
    return _HEAD.pack(MAGIC, len(doc_ids), len(table), zlib.crc32(table)) + table + rans.encode(raw)


def read_segment(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, token counts, all ids) of a file image."""
    magic, n, size, crc = _HEAD.unpack_from(image)
    table = image[_HEAD.size:_HEAD.size + size]
    if magic != MAGIC or zlib.crc32(table) != crc:
        raise ValueError("not a token file")
    raw = zlib.decompress(table)
    ids = np.frombuffer(raw, "<i8", n).tolist()
    null = raw[8 * n:9 * n]
    counts = np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)
    return [None if z else d for d, z in zip(ids, null)], counts, rans.decode(image[_HEAD.size + size:])


def _save(folder: str, name: str, image: bytes) -> None:
    """Write under a scratch name, then move: a repeated attempt replaces the file by the same bytes."""
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    scratch = local_temp(f"{base}/.{name}")
    with store.open_output_stream(scratch) as out:
        out.write(image)
    store.move(scratch, f"{base}/{name}")


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the token files and return their manifest (part, number, documents, tokens, bytes).

    Rows are range-partitioned and sorted by id, nulls first, equal ids by a
    hash of the text and then by their place in the input. Each text's ids end with ``end_id``; null text: that id alone. A
    task holds one segment, which is one document or about ``segment_ids``
    ids. Empty input writes no file.
    """
    def run(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        ids, tokens, held = [], [], 0

        def close():
            image = pack_segment(ids, tokens)
            _save(folder, f"part-{part:07d}-{number:07d}.rans", image)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in
                                               (part, number, len(ids), held, len(image))],
                                              ["part", "number", "documents", "tokens", "bytes"])

        for new_ids, new_tokens in encoded_rows(batches, vocabulary, end_id):
            for d, t in zip(new_ids.to_pylist(), new_tokens):
                ids.append(d)
                tokens.append(t)
                held += len(t) // 2
                if held >= segment_ids:
                    yield close()
                    ids, tokens, held, number = [], [], 0, number + 1
        if ids:
            yield close()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the hash and the row's place in the input spread equal and null ids over tasks
    order = ["doc_id", "text_hash", "place"]
    src = src.withColumn("text_hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    src = src.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select("doc_id", "text")
    return stage(map_arrow(src, run, "part long, number long, documents long, tokens long, bytes long"), "manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, number, doc_id, local_start, n_tokens, ids_crc32) of each document in the files of a folder."""
    def run(batches):
        for batch in batches:
            for path, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, number = map(int, _NAME.search(path).groups())
                ids, counts, tokens = read_segment(image.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(tokens[i:j].astype("<u4").tobytes()) for i, j in zip(starts, ends)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(ids, pa.int64()),
                     pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["part", "number", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.rans").load(folder)
    return map_arrow(files.select("path", "content"), run, "part long, number long, doc_id long, "
                     "local_start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from files written to the shared folder.

    start counts the ids of all documents before it, over all files. The
    running total goes over one manifest row for each file.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write(docs, folder, vocabulary, end_id=end_id, **options)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    heads = stage(manifest.select("part", "number",
                                  F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("ahead")), "heads")
    if not heads.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read(spark, folder).join(heads, ["part", "number"])
    return rows.select("doc_id", (F.col("ahead") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
