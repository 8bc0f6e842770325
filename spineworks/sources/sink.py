"""Table sink: replace a table's contents (a versioned folder, or a catalog table over one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spineworks.sources import versions


def write_table(df: DataFrame, target: str, *, as_table: bool = False,
                partition_by: tuple = (), fmt: str = "parquet", keep: int = versions.KEEP) -> str:
    """Replace ``target`` with ``df`` (the ``if_exists='replace'`` export).

    The rows are written in full to a new version folder, then one pointer
    file moves (``versions``). Until then, and for good if the write fails,
    readers see the version before; the table may even be read while it is
    replaced. ``keep`` published versions stay on disk.

    With ``as_table``, ``target`` names a catalog table whose versions lie in
    the warehouse folder; its location moves to the new version. Returns the
    version's folder.
    """
    spark = df.sparkSession
    folder = table_folder(spark, target) if as_table else target

    def write(path: str) -> None:
        w = df.write.format(fmt)
        (w.partitionBy(*partition_by) if partition_by else w).save(path)

    path = versions.publish(spark, folder, write, keep=keep if not as_table else max(keep, 2))
    if as_table:
        _point(spark, target, path, df, fmt, partition_by)
    return path


def table_folder(spark: SparkSession, name: str) -> str:
    """Folder that holds the versions of a catalog table."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.replace('.', '/')}.versions"


def read_table(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """The published rows of a folder written by ``write_table``."""
    return versions.read(spark, target, fmt)


def _point(spark: SparkSession, name: str, path: str, df: DataFrame, fmt: str, partition_by: tuple) -> None:
    """Make the catalog table ``name`` read ``path``."""
    if spark.catalog.tableExists(name):
        old = spark.table(name)
        same = [(f.name, f.dataType) for f in old.schema] == [(f.name, f.dataType) for f in spark.read.format(fmt).load(path).schema]
        if same and not partition_by:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE {name}")  # external: its files stay
    spark.catalog.createTable(name, path=path, source=fmt)
    if partition_by:
        spark.catalog.recoverPartitions(name)
