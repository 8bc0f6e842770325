"""Versioned folders: a write becomes visible at once, or not at all.

Layout of a published folder::

    target/_claims/v7      empty file: the version number is taken
    target/v7/...          the data of version 7, written in full
    target/_current        the name of the version that readers use

A writer claims the next number, writes ``v<N>`` and then replaces the pointer
file in one rename. A write that fails leaves the pointer, and so the version
before, as they were. Readers resolve the pointer once and keep that version
for as long as they hold the path; ``expire`` removes versions before the last
few published ones, and what failed writers have left.

The folder may be in any store with an atomic rename of one small file (HDFS,
local file systems).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
#: Published versions that stay readable after a newer one.
KEEP = 2
_VERSION = re.compile(r"v(\d+)$")


class StaleWrite(RuntimeError):
    """A newer version was published while this one was being written."""


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _read_text(spark: SparkSession, name: str) -> str | None:
    fs, path = _fs(spark, name), _path(spark, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Small file ``name``, replaced in one step if it exists."""
    draft = f"{name}.{uuid.uuid4().hex}"
    stream = _fs(spark, name).create(_path(spark, draft), False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, draft).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(_path(spark, draft), _path(spark, name), replace)


def read_text(spark: SparkSession, name: str) -> str | None:
    """Content of the small file ``name``; None if there is none."""
    return _read_text(spark, name)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, folder), _path(spark, folder)
    if not fs.exists(path):
        return []
    found = (_VERSION.match(s.getPath().getName()) for s in fs.listStatus(path))
    return sorted(int(m[1]) for m in found if m)


def current(spark: SparkSession, target: str) -> str | None:
    """Folder of the published version; None if nothing was published."""
    name = _read_text(spark, f"{target}/{POINTER}")
    return f"{target}/{name.strip()}" if name else None


def resolve(spark: SparkSession, target: str) -> str:
    """Folder to read: the published version, or ``target`` itself if it has no versions."""
    return current(spark, target) or target


def number(folder: str | None) -> int:
    """Version number of a version folder; 0 for none."""
    found = _VERSION.search(folder or "")
    return int(found[1]) if found else 0


def _claim(spark: SparkSession, target: str) -> int:
    n = max([0, *_numbers(spark, f"{target}/_claims"), *_numbers(spark, target)]) + 1
    fs = _fs(spark, target)
    fs.mkdirs(_path(spark, f"{target}/_claims"))
    while not fs.createNewFile(_path(spark, f"{target}/_claims/v{n}")):
        n += 1  # another writer was faster
    return n


def published(spark: SparkSession, target: str) -> list[str]:
    """Folders of all published versions that are still kept, oldest first."""
    now = number(current(spark, target))
    return [f"{target}/v{n}" for n in _numbers(spark, f"{target}/_claims")
            if n == now or n < now and _read_text(spark, f"{target}/_claims/v{n}")]


def publish(spark: SparkSession, target: str, write: Callable[[str], None], keep: int | None = KEEP) -> str:
    """Run ``write(folder)`` on a fresh version folder, then make it the current one.

    If ``write`` fails, the version before stays current. If a newer version
    was published meanwhile, raises ``StaleWrite`` and leaves it current.
    ``keep`` published versions stay, all of them if it is None. Returns the
    new version's folder.
    """
    n = _claim(spark, target)
    folder = f"{target}/v{n}"
    write(folder)
    newer = number(current(spark, target))
    if newer > n:
        raise StaleWrite(f"{target}: version {newer} was published before version {n} was complete")
    write_text(spark, f"{target}/{POINTER}", f"v{n}\n")
    write_text(spark, f"{target}/_claims/v{n}", "published\n")
    if keep is not None:
        expire(spark, target, keep)
    return folder


def expire(spark: SparkSession, target: str, keep: int = KEEP) -> list[str]:
    """Delete versions older than the last ``keep`` published ones; returns the deleted folders.

    Versions below the current one that were never published are leftovers of
    failed writers (they could not be published any more) and go too.
    """
    now = number(current(spark, target))
    below = [n for n in _numbers(spark, f"{target}/_claims") if n <= now]
    published = [n for n in below if _read_text(spark, f"{target}/_claims/v{n}")]
    stay = set(published[-max(keep, 1):]) | {now}
    fs, gone = _fs(spark, target), []
    for n in below:
        if n not in stay:
            if fs.delete(_path(spark, f"{target}/v{n}"), True):
                gone.append(f"{target}/v{n}")
            fs.delete(_path(spark, f"{target}/_claims/v{n}"), False)
    return gone


def read(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """The published version of a table written by ``sink.write_table``."""
    return spark.read.format(fmt).load(resolve(spark, target))
