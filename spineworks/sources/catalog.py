"""Catalog listings: tables and their columns, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CATALOG_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("ordinal_position", T.IntegerType()),
])


def list_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Names of the registered tables, sorted."""
    rows = [(n,) for n in sorted(tables)]
    return spark.createDataFrame(rows, "table_name string")


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, position) for every table, sorted by table and position.

    Built from the DataFrames' schemas (metadata only; no data is read).
    """
    rows = [(name, f.name, f.dataType.simpleString(), i + 1)
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, _CATALOG_SCHEMA).orderBy("table_name", "ordinal_position")


def id_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Text columns whose name ends in ``id``: the candidate join keys."""
    cat = column_catalog(spark, tables)
    return (cat.where((F.col("data_type") == "string") & F.col("column_name").like("%id"))
            .orderBy("table_name", "ordinal_position")
            .select("table_name", "column_name"))


def session_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the session catalog (e.g. after ``register_views``), sorted."""
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(
        rows, "table_name string, table_type string, is_temporary boolean").orderBy("table_name")


def session_columns(spark: SparkSession, names) -> DataFrame:
    """(table, column, type, position) for catalog tables or views, from the catalog."""
    rows = [(n, c.name, c.dataType, i + 1) for n in names
            for i, c in enumerate(spark.catalog.listColumns(n))]
    return spark.createDataFrame(rows, _CATALOG_SCHEMA).orderBy("table_name", "ordinal_position")
