"""Clean once, report many times.

The cleaning stage (derive, de-duplicate, re-key, drop outliers) is a few
full shuffles of the entity tables. Reports only read the cleaned tables, so
a deployment runs ``materialize`` once -- writing every stage table as
Parquet to a shared folder -- and points ``WarehouseTables`` at it; each
report then starts from compact, already-cleaned columnar files instead of
repeating the cleaning shuffles.

All stage tables of one run are one version of the folder
(``sources.versions``): readers see the stages of one run, never a mixture,
and a run that fails leaves the version before. While the raw tables are
written, their null, empty and blank counts are observed; the profile reports
read these counts instead of scanning the tables again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spineworks.operators.quality import drop_where, observed_profile, profile_metrics
from spineworks.operators.keys import KeyDictionary
from spineworks.plans.tables import USAGE_ORDER, Tables, usage_outlier
from spineworks.sources import versions

RAW_TABLES = {"raw_subscription": "subscription", "raw_account": "account",
              "raw_usage": "feature_usage", "support_ticket": "support_ticket",
              "churn_event": "churn_event"}

# Raw tables written by default: all five. Two are joins and aggregates of
# the sources; the others are projections whose written copies are smaller
# than the source scans they replace. Pass a subset to derive some
# raw tables lazily from the sources instead.
DERIVED_RAW = tuple(RAW_TABLES)

#: Stage tables that reports join on the account; they are bucketed by it.
BY_ACCOUNT = ("dedup_subscription", "raw_account", "churn_event")
#: An account with more rows than this many average buckets makes the tables plain.
HOT_BUCKETS = 2
#: Stage tables written at the same time.
WRITERS = 4
MANIFEST, PROFILE = "_stages.json", "_profile"


def materialize(tables: Tables, target: str, written_raw=DERIVED_RAW, buckets: int | None = None) -> str:
    """Write the stage tables as a new version of ``target``; returns its folder.

    Written: the raw tables in ``written_raw`` (default: all five), the
    de-duplicated subscriptions and the re-keyed usage rows. Each stage is computed from
    the previous stage's written files, so no cleaning shuffle runs twice;
    tables that do not build on each other are written at the same time.
    Usage ids come from a key dictionary beside the versions
    (``operators.keys``): rows of earlier runs keep their ids.
    The remaining stages are row filters or column drops of these and are
    derived on read.

    The tables that reports join on the account are bucketed by it
    (``buckets``: the shuffle partitions by default; 0 for none), so those
    joins read co-located files and shuffle neither side. Spark reads a
    bucket in one task, so if one account holds more than ``HOT_BUCKETS``
    average buckets of any of them, all stay plain: the joins then shuffle,
    and AQE splits the hot account.
    """
    return versions.publish(tables.spark, target, lambda folder: _write_stages(
        tables, folder, f"{target}/_keys/usage", written_raw, buckets))


def _write_stages(tables: Tables, folder: str, keys_folder: str, written_raw, buckets: int | None) -> None:
    spark = tables.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    layout: dict[str, int] = {}
    profiles: dict[str, dict] = {}

    def raw(out: str) -> None:
        df = getattr(tables, out)
        watch = Observation(f"{out}-{folder}")
        _write(df.observe(watch, *profile_metrics(df)), folder, out, 0)
        profiles[out] = watch.get

    _at_once([lambda o=o: raw(o) for o in written_raw])
    plain = _stage_tables(spark, folder, tables, written_raw, {})
    if n and not _hot(plain, n):
        layout = {name: n for name in BY_ACCOUNT if name == "dedup_subscription" or name in written_raw}
    # row groups and pages prune on date bounds
    by_end = ("end_date", "start_date")

    def dedup() -> None:
        df = plain.dedup_subscription
        if layout:
            _write(df, folder, "dedup_subscription", n, by_end)
        else:
            _write(df.sortWithinPartitions(*by_end), folder, "dedup_subscription", 0)

    def rekeyed() -> None:
        keys = KeyDictionary(spark, keys_folder, "usage_id", USAGE_ORDER)
        keys.update(plain.raw_usage)
        _write(keys.apply(plain.raw_usage), folder, "rekeyed_usage", 0)

    jobs: list[Callable] = [dedup, rekeyed]
    jobs += [lambda o=o: _write(spark.read.parquet(f"{folder}/{o}"), folder, o, n, ("account_id",))
             for o in layout if o in written_raw]
    _at_once(jobs)
    for o in layout:
        if o in written_raw:
            _remove(spark, f"{folder}/{o}")
    names = {o: name for name, df in tables.raw_tables().items() for o in written_raw if getattr(tables, o) is df}
    rows = [r for o, label in names.items() for r in observed_profile(getattr(tables, o), label, profiles[o])]
    spark.createDataFrame(rows, "table_name string, column string, position int, null_count long, empty_count long, "
                                "whitespace_count long, rows long").coalesce(1).write.parquet(f"{folder}/{PROFILE}")
    versions.write_text(spark, f"{folder}/{MANIFEST}", json.dumps({"buckets": layout, "profiled": sorted(names.values())}))


def _at_once(jobs: list[Callable]) -> None:
    """Run Spark writes from a few threads; the first error stops the caller."""
    with ThreadPoolExecutor(WRITERS) as pool:
        for job in [pool.submit(j) for j in jobs]:
            job.result()


def _bucketed(name: str) -> str:
    return f"{name}_by_account"


def _write(df: DataFrame, folder: str, name: str, buckets: int, sort: tuple = ()) -> None:
    if not buckets:
        df.write.parquet(f"{folder}/{name}")
        return
    # one file for each bucket, whatever the number of tasks before
    table = _table_name(f"{folder}/{_bucketed(name)}")
    (df.repartition(buckets, "account_id").write.bucketBy(buckets, "account_id").sortBy(*sort)
     .option("path", f"{folder}/{_bucketed(name)}").saveAsTable(table))
    df.sparkSession.sql(f"DROP TABLE {table}")  # external: the files stay


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _hot(tables: Tables, buckets: int) -> bool:
    """Some account holds more rows of a joined table than a few average buckets."""
    def of(df: DataFrame) -> DataFrame:
        per_account = df.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
        return per_account.agg(F.max("n").alias("most"), F.sum("n").alias("rows"))
    sizes = of(tables.raw_subscription).unionByName(of(tables.raw_account)).unionByName(of(tables.churn_event))
    return any(r["rows"] and r["most"] > max(HOT_BUCKETS * r["rows"] / buckets, 1) for r in sizes.collect())


def _table_name(path: str) -> str:
    return "spineworks_" + hashlib.md5(path.encode()).hexdigest()


def _read_stage(spark: SparkSession, folder: str, name: str, layout: dict[str, int]) -> DataFrame:
    """A stage table of a version; a bucketed one as an external catalog table, so that joins know its buckets."""
    if name not in layout:
        return spark.read.parquet(f"{folder}/{name}")
    path = f"{folder}/{_bucketed(name)}"
    table = _table_name(path)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (account_id) "
                  f"INTO {layout[name]} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def _stage_tables(spark, folder, source: Tables, written_raw, layout) -> Tables:
    loaders = {}
    for out, name in RAW_TABLES.items():
        if out in written_raw:
            loaders[name] = (lambda s, src, o=out: _read_stage(s, folder, o, layout))
        else:
            loaders[name] = (lambda s, src, o=out: getattr(source, o))
    return Tables(spark, folder, loaders=loaders)


class WarehouseTables(Tables):
    """Stage tables read back from a folder written by ``materialize``.

    The published version is looked up once, here; a later ``materialize``
    does not change what this object reads. ``source`` supplies the raw
    tables that were not written (read lazily from the original files).
    """

    def __init__(self, spark: SparkSession, target: str, source: Tables | None = None,
                 written_raw=DERIVED_RAW):
        if source is None and set(written_raw) != set(RAW_TABLES):
            raise ValueError("pass the source tables for the raw tables that were not written")
        folder = versions.current(spark, target)
        if folder is None:
            raise FileNotFoundError(f"{target} holds no published stage tables")
        self.manifest = json.loads(versions.read_text(spark, f"{folder}/{MANIFEST}"))
        stages = _stage_tables(spark, folder, source, written_raw, self.manifest["buckets"])
        super().__init__(spark, folder, loaders=stages._loaders)
        self.colocated = set(BY_ACCOUNT) <= set(self.manifest["buckets"])

    def _read(self, name: str) -> DataFrame:
        return _read_stage(self.spark, self.source, name, self.manifest["buckets"])

    @cached_property
    def dedup_subscription(self) -> DataFrame:
        return self._read("dedup_subscription")

    def rekeyed_usage(self, staging: str | None = None) -> DataFrame:
        return self._read("rekeyed_usage")

    @cached_property
    def feature_usage(self) -> DataFrame:
        # Same rows as the clean usage table; key-level queries ignore usage_id.
        return self.clean_usage()

    def clean_usage(self) -> DataFrame:
        u = self.rekeyed_usage()
        return drop_where(u, usage_outlier(u))

    def profile(self, kinds=("null", "empty", "whitespace")) -> DataFrame:
        """Counts observed while the raw tables were written; the others are profiled by a scan."""
        stored = self.spark.read.parquet(f"{self.source}/{PROFILE}")
        stored = stored.select("table_name", "column", "position", *[f"{k}_count" for k in kinds], "rows")
        missing = {label: df for label, df in self.raw_tables().items() if label not in self.manifest["profiled"]}
        if not missing:
            return stored
        return stored.unionByName(self._scanned_profile(missing, kinds))
