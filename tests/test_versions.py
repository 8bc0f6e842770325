"""Versioned writes: all or nothing, also under failures, races and readers in between."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spineworks.plans.params import FIXTURE_PARAMS as P
from spineworks.plans.registry import QUERIES
from spineworks.plans.tables import Tables
from spineworks.plans.warehouse import WarehouseTables, materialize
from spineworks.sources import versions
from spineworks.sources.sink import read_table, table_folder, write_table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return os.path.join(tempfile.mkdtemp(prefix="spineworks-versions-"), "t")


def _ids(df):
    return sorted(r[0] for r in df.collect())


def _broken(spark):
    """Fails in its last task, after others have written files."""
    return spark.range(0, 40, 1, 4).select(F.when(F.col("id") < 35, F.col("id")).otherwise(
        F.raise_error(F.lit("disk full")).cast("long")).alias("id"))


def test_failed_write_leaves_the_old_version(spark, folder):
    write_table(spark.range(10), folder)
    with pytest.raises(Exception, match="disk full"):
        write_table(_broken(spark), folder)
    assert _ids(read_table(spark, folder)) == list(range(10))
    write_table(spark.range(3), folder)
    assert _ids(read_table(spark, folder)) == [0, 1, 2]
    # the failed version is gone, the published ones are numbered on
    assert versions.current(spark, folder).endswith("/v3")
    assert sorted(n for n in os.listdir(folder) if n.startswith("v")) == ["v1", "v3"]


def test_first_write_that_fails_publishes_nothing(spark, folder):
    with pytest.raises(Exception, match="disk full"):
        write_table(_broken(spark), folder)
    assert versions.current(spark, folder) is None


def test_table_may_be_rewritten_from_itself_and_read_meanwhile(spark, folder):
    write_table(spark.range(10), folder)
    reader = read_table(spark, folder)
    write_table(read_table(spark, folder).where("id % 2 = 0"), folder)
    assert _ids(reader) == list(range(10))  # an open reader keeps its version
    assert _ids(read_table(spark, folder)) == [0, 2, 4, 6, 8]


def test_expiry_keeps_the_last_versions(spark, folder):
    for n in range(1, 6):
        write_table(spark.range(n), folder, keep=2)
    assert sorted(n for n in os.listdir(folder) if n.startswith("v")) == ["v4", "v5"]
    assert sorted(n for n in os.listdir(f"{folder}/_claims") if not n.startswith(".")) == ["v4", "v5"]


def test_slower_writer_does_not_undo_a_newer_version(spark, folder):
    def slow(path):
        write_table(spark.range(7), folder)  # another writer starts later and is done first
        spark.range(2).write.parquet(path)
    with pytest.raises(versions.StaleWrite):
        versions.publish(spark, folder, slow)
    assert _ids(read_table(spark, folder)) == list(range(7))


def test_partitioned_folder(spark, folder):
    write_table(spark.range(6).withColumn("k", F.col("id") % 2), folder, partition_by=("k",))
    assert _ids(read_table(spark, folder).where("k = 1")) == [1, 3, 5]


def test_catalog_table_moves_to_the_new_version(spark):
    name = f"sink_{os.urandom(6).hex()}"
    write_table(spark.range(4), name, as_table=True)
    assert _ids(spark.table(name)) == [0, 1, 2, 3]
    write_table(spark.range(2), name, as_table=True)
    assert _ids(spark.table(name)) == [0, 1]
    with pytest.raises(Exception, match="disk full"):
        write_table(_broken(spark), name, as_table=True)
    assert _ids(spark.table(name)) == [0, 1]
    # another schema, then partitions
    write_table(spark.range(3).withColumn("k", F.lit("a")), name, as_table=True)
    assert spark.table(name).columns == ["id", "k"]
    write_table(spark.range(3).withColumn("k", F.col("id") % 2), name, as_table=True, partition_by=("k",))
    assert _ids(spark.table(name).where("k = 0")) == [0, 2]
    assert versions.current(spark, table_folder(spark, name)).endswith("/v5")
    spark.sql(f"DROP TABLE {name}")


def _bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_warehouse_stages_change_together(spark, folder):
    source = Tables(spark, SF)
    materialize(source, folder)
    first = WarehouseTables(spark, folder)
    before = _bag(QUERIES["recurring_revenue"](first, P))

    class Half(Tables):  # subscriptions load, usage does not
        def _load(self, name):
            df = super()._load(name)
            if name == "feature_usage":
                return df.withColumn("usage_count", F.raise_error(F.lit("lost file")).cast("long"))
            return df.limit(5)
    with pytest.raises(Exception, match="lost file"):
        materialize(Half(spark, SF), folder)
    again = WarehouseTables(spark, folder)
    assert again.source == first.source
    assert _bag(QUERIES["recurring_revenue"](again, P)) == before
    # a second run is a new version; the reader before keeps its own, reports agree
    materialize(source, folder)
    assert WarehouseTables(spark, folder).source.endswith("/v3")
    assert _bag(QUERIES["recurring_revenue"](first, P)) == before
    for name in ("null_profile", "empty_profile", "whitespace_profile"):
        assert _bag(QUERIES[name](WarehouseTables(spark, folder), P)) == _bag(QUERIES[name](source, P))


def test_unpublished_folder_is_an_error(spark, folder):
    with pytest.raises(FileNotFoundError):
        WarehouseTables(spark, folder)
