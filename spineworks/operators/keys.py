"""Surrogate keys that stay the same over loads: a dictionary from row content to ids.

The dictionary maps the digest of a row's content to blocks of consecutive
ids, one block for the copies of that content which a load added. Each load
is one published delta (``sources.versions``); nothing written before is
rewritten, and ids start above the high-water mark. Copies of a row are
numbered, not told apart: a load with fewer copies than before uses the first
ones again.

A digest is one row, however many copies it stands for, so a group of copies
with a third of all rows costs the joins nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spineworks.session import ensure_checkpoint_dir
from spineworks.sources import versions

#: Copies in one block at most: a block's ids are one array.
BLOCK = 100_000
_SCHEMA = "digest string, copy_from long, copies long, first_id long"


class KeyDictionary:
    """Ids of rows by content. ``order`` names the content columns, which are all but the id."""

    def __init__(self, spark: SparkSession, folder: str, name: str, order: Sequence[str], start: int = 1):
        self.spark, self.folder, self.name, self.order, self.start = spark, folder, name, tuple(order), start

    def blocks(self) -> DataFrame:
        """All published (digest, copy_from, copies, first_id)."""
        folders = versions.published(self.spark, self.folder)
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*folders)

    def high_water(self) -> int:
        """The largest id given so far (``start`` - 1 if none)."""
        last = self.blocks().agg(F.max(F.col("first_id") + F.col("copies") - 1)).first()[0]
        return self.start - 1 if last is None else last

    def _counted(self, df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != self.name]
        if sorted(others) != sorted(self.order):
            raise ValueError(f"the columns {others} are not the content columns {list(self.order)}")
        # to_json leaves out nulls and names the rest, so the text is unambiguous
        digest = F.sha2(F.to_json(F.struct(*self.order)), 256)
        return df.groupBy(*self.order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_digest", digest)

    def update(self, df: DataFrame) -> int:
        """Give ids to the rows (or further copies) of ``df`` that have none; returns how many.

        New ids follow the content order (nulls first) from the high-water
        mark on: a first load gets the ids of ``quality.surrogate_key``.
        """
        counted = self._counted(df)
        if versions.current(self.spark, self.folder) is None:
            missing = counted.withColumn("_have", F.lit(0).cast("long")).withColumn("_new", F.col("_n"))
        else:
            have = self.blocks().groupBy("digest").agg(F.sum("copies").alias("_have"))
            missing = (counted.join(have, counted._digest == have.digest, "left")
                       .withColumn("_have", F.coalesce("_have", F.lit(0).cast("long")))
                       .withColumn("_new", F.col("_n") - F.col("_have")).where("_new > 0"))
        # ranked rows are written so that running sums and totals see the same partitions
        staging = f"{ensure_checkpoint_dir(self.spark)}/new-keys-{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [F.asc_nulls_first(c) for c in self.order]
        (missing.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .select(F.monotonically_increasing_id().alias("_at"), F.col("_digest").alias("digest"), "_have", "_new")
         .write.parquet(staging))
        ranked = self.spark.read.parquet(staging).withColumn("_part", F.shiftrightunsigned("_at", 33))
        totals = ranked.groupBy("_part").agg(F.sum("_new").alias("_total"))  # one row for each partition
        added = totals.agg(F.sum("_total")).first()[0] or 0
        if added:
            before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            totals = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
            inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
            first = (F.lit(self.high_water() + 1) + F.col("_before")
                     + F.coalesce(F.sum("_new").over(inside), F.lit(0)))
            blocks = ranked.join(F.broadcast(totals), "_part").withColumn("_first", first)
            cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_new") - 1, F.lit(BLOCK).cast("long")))
            blocks = blocks.withColumn("_cut", cut).select(
                "digest", (F.col("_have") + F.col("_cut")).alias("copy_from"),
                F.least(F.lit(BLOCK).cast("long"), F.col("_new") - F.col("_cut")).alias("copies"),
                (F.col("_first") + F.col("_cut")).alias("first_id"))
            versions.publish(self.spark, self.folder, lambda folder: blocks.write.parquet(folder), keep=None)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return int(added)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the dictionary's ids in column ``name``; runs no job.

        Rows without an id (not in any load so far) are left out: ``update``
        first.
        """
        counted, blocks = self._counted(df), self.blocks()
        used = F.least(F.col("copies"), F.col("_n") - F.col("copy_from"))
        ids = F.explode(F.sequence(F.col("first_id"), F.col("first_id") + used - 1)).alias(self.name)
        return (counted.join(blocks, counted._digest == blocks.digest).where("copy_from < _n")
                .select(ids, *self.order).select(*df.columns))
