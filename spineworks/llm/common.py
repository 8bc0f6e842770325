"""Staging in the shared folder and byte-level views of Arrow text columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels of one task.
SLICE_BYTES = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The word bytes of the pattern [^\x20\x09-\x0D]+.
WORD_BYTES = ~_SPACE
#: Byte table that lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session (tests, one machine)
    a temporary folder is made and remembered in the session; on a cluster
    its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spineworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, split: str | None = None, **options) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage: a lost executor costs only the tasks of the current step.
    ``split`` is a column with a folder for each value, ``options`` are the
    writer's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, partitionBy=split)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete the folders of staged tables that no later step reads."""
    for df in staged:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Largest document key; null ids stand for it.
LAST = (1 << 63) - 1


def document_order(docs: DataFrame, id_col: str, text: Column) -> tuple[Column, Column]:
    """(d, tie): longs that order documents by id, null ids last, equal ids by a hash of ``text``.

    ``tie`` is 0 where all ids differ, which one count of the ids finds out.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    repeated = ids.where("n > 1 or id is null").limit(1).count() > 0
    tie = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), tie.alias("tie")


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_spineworks_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spineworks-")) / "spineworks_modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._spineworks_shipped = True


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` whose function may use this package on any executor."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES
                ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row slices of about ``limit`` text bytes (one row at least)."""
    i = batch.schema.get_field_index(column)
    data, offsets = text_bytes(batch.column(i))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BYTES
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words; ``first[d]:first[d+1]`` are those of row d.

    A row's end also ends a word.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    row_starts = offsets[:-1]
    begin[row_starts] = inside[row_starts]
    starts = np.flatnonzero(begin[:-1])
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside[:-1] & ~inside[1:]
    row_ends = offsets[1:][offsets[1:] > offsets[:-1]]
    stop[row_ends] = inside[row_ends - 1]
    return starts, np.flatnonzero(stop), np.searchsorted(starts, offsets)


def local_temp(prefix: str) -> str:
    """A scratch name next to a final file; unique per attempt."""
    return f"{prefix}.{os.getpid()}-{uuid.uuid4().hex}.tmp"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)
