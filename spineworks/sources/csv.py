"""CSV scan with a fixed schema and pandas-compatible missing-value tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spineworks.sources import versions
from spineworks.sources.schemas import SCHEMAS

# The strings a pandas CSV reader turns into missing values by
# default (besides the empty field, which Spark already reads as null).
NA_TOKENS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null")


FILE = "_metadata.file_path"


def _scan(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, file_as: str | None = None) -> DataFrame:
    """The schema's columns as text, found by their names in the header.

    Raises ValueError where the header lacks one of them, names one twice or
    has others. Files of a folder must share one header. ``file_as`` names an
    extra column with the row's file.
    """
    raw = (spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
           .option("escape", '"').option("multiLine", multi_line).csv(path))
    if sorted(raw.columns) != sorted(schema.names):
        raise ValueError(f"{path}: header {raw.columns}, expected the columns {schema.names} in any order")
    return raw.select(*schema.names, *([F.col(FILE).alias(file_as)] if file_as else []))


def _typed(f: T.StructField, tokens, timestamp_format: str | None, on_error: str):
    """Column of ``f``'s type from its text; tokens become null."""
    strict = on_error == "fail"
    c = F.col(f.name)
    c = F.when(c.isin(tokens), F.lit(None)).otherwise(c)
    if isinstance(f.dataType, T.StringType):
        return c
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and timestamp_format:
        return (F.to_timestamp_ntz(c, F.lit(timestamp_format)).cast(f.dataType) if strict
                else F.try_to_timestamp(c, F.lit(timestamp_format)).cast(f.dataType))
    if isinstance(f.dataType, T.IntegralType):  # "3.0" is 3, "3.5" an error
        number = c.cast("decimal(38,10)") if strict else c.try_cast("decimal(38,10)")
        whole = F.when(number == F.floor(number), number)
        if strict:
            whole = F.coalesce(whole, F.when(number.isNotNull(), F.raise_error(
                F.concat(F.lit(f"{f.name}: not a whole number: "), c)).cast("decimal(38,10)")))
            return whole.cast(f.dataType)
        return whole.try_cast(f.dataType)
    if isinstance(f.dataType, T.BooleanType):
        known = F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False)
        return known.otherwise(c.cast("boolean") if strict else c.try_cast("boolean"))
    return c.cast(f.dataType) if strict else c.try_cast(f.dataType)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             na_tokens=NA_TOKENS, timestamp_format: str | None = None,
             on_error: str = "fail", multi_line: bool = False) -> DataFrame:
    """Read a headered CSV file with an explicit schema, matching columns by name.

    Every column is first read as text so that missing-value tokens can be
    mapped to null before the typed cast. A doubled quote inside quotes is
    one quote. ``multi_line`` also allows newlines inside quotes; a file can
    then not be split over tasks. With ``on_error="fail"`` the cast is
    ANSI-checked, so a malformed date fails the job instead of silently
    becoming null; ``on_error="null"`` turns unparsable values into nulls
    (use ``quarantine`` to list the affected rows).
    """
    raw = _scan(spark, path, schema, multi_line)
    tokens = list(na_tokens)
    return raw.select(*[_typed(f, tokens, timestamp_format, on_error).alias(f.name) for f in schema])


def checked_csv(spark: SparkSession, path: str, schema: T.StructType, na_tokens=NA_TOKENS,
                timestamp_format: str | None = None, multi_line: bool = False) -> DataFrame:
    """Every row of a CSV file: the typed columns and ``_errors``, what did not parse in it.

    ``_errors`` is an array of (column, text, file), empty for a good row; a
    bad value is null in its typed column. Good rows and rejects are filters
    of this one table, so one read feeds both (see ``load_csv``).
    """
    tokens = list(na_tokens)
    raw = _scan(spark, path, schema, multi_line, "_file")
    found = []
    for f in schema:
        if not isinstance(f.dataType, T.StringType):
            c = F.col(f.name)
            bad = c.isNotNull() & ~c.isin(tokens) & _typed(f, tokens, timestamp_format, "null").isNull()
            found.append(F.when(bad, F.struct(F.lit(f.name).alias("column"), c.alias("text"), F.col("_file").alias("file"))))
    kind = "array<struct<column:string,text:string,file:string>>"
    errors = F.array_compact(F.array(*found)) if found else F.array().cast(kind)
    return raw.select(*[_typed(f, tokens, timestamp_format, "null").alias(f.name) for f in schema],
                      errors.cast(kind).alias("_errors"))


def load_csv(spark: SparkSession, path: str, schema: T.StructType, target: str, **options) -> tuple[DataFrame, DataFrame]:
    """Read a CSV file once and write its good rows and its rejects; (good rows, rejects).

    Both lie in one published version of ``target`` (``sources.versions``), so
    they always belong to the same read. Good rows have the schema's columns;
    rejects also have ``_errors``, the columns that did not parse with their
    text and file. Every row of the file is in exactly one of the two.
    """
    rows = checked_csv(spark, path, schema, **options).withColumn("_rejected", F.size("_errors") > 0)
    folder = versions.publish(spark, target, lambda out: rows.write.partitionBy("_rejected").parquet(out))
    both = T.StructType([*schema.fields, T.StructField("_errors", rows.schema["_errors"].dataType),
                         T.StructField("_rejected", T.BooleanType())])
    written = spark.read.schema(both).parquet(folder)
    return written.where(~F.col("_rejected")).select(*schema.names), written.where("_rejected").drop("_rejected")


def quarantine(spark: SparkSession, path: str, schema: T.StructType, na_tokens=NA_TOKENS,
               timestamp_format: str | None = None, multi_line: bool = False) -> DataFrame:
    """Rows of a CSV file holding a value that does not parse as its column's type, as text."""
    tokens = list(na_tokens)
    bad = F.lit(False)
    for f in schema:
        if not isinstance(f.dataType, T.StringType):
            c = F.col(f.name)
            bad = bad | (c.isNotNull() & ~c.isin(tokens) & _typed(f, tokens, timestamp_format, "null").isNull())
    return _scan(spark, path, schema, multi_line).where(bad)


def read_entity_csv(spark: SparkSession, name: str, path: str, **kw) -> DataFrame:
    return read_csv(spark, path, SCHEMAS[name], **kw)


def csv_loaders(paths: dict[str, str], rejects: str | None = None, **kw) -> dict:
    """Table loaders for ``Tables`` reading the five entity CSV files.

    ``paths`` maps table name (subscription, account, feature_usage,
    support_ticket, churn_event) to a file or folder; every file is read
    with its fixed schema and the missing-value tokens. With ``rejects``, a
    folder, bad rows do not end the job: each file is loaded once into
    ``<rejects>/<name>`` (``load_csv``) and its good rows are the table.
    """
    if rejects:
        return {name: (lambda spark, _src, p=path, n=name: load_csv(spark, p, SCHEMAS[n], f"{rejects}/{n}", **kw)[0])
                for name, path in paths.items()}
    return {name: (lambda spark, _src, p=path, n=name: read_entity_csv(spark, n, p, **kw))
            for name, path in paths.items()}
