"""Data-quality operators: profiles, duplicates, dedupe, surrogate keys, rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spineworks.functions import is_blank, percent_half_up


_KINDS = ("null", "empty", "whitespace")


def profile_metrics(df: DataFrame, kinds=_KINDS) -> list[Column]:
    """Aggregates behind ``column_profile``: rows, and per column nulls, empty and whitespace-only strings.

    They also serve as metrics of ``DataFrame.observe``, so a table that is
    written anyway is profiled in the same pass. Non-text columns are never
    empty or blank.
    """
    tests = {"null": lambda c: c.isNull(), "empty": lambda c: c == "",
             "whitespace": lambda c: is_blank(c)}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for f in df.schema.fields:
        text = isinstance(f.dataType, T.StringType)
        for k in kinds:
            if k == "null" or text:
                aggs.append(F.count(F.when(tests[k](F.col(f.name)), 1)).alias(f"{k}__{f.name}"))
    return aggs


def observed_profile(df: DataFrame, table: str, metrics: Mapping[str, int]) -> list[tuple]:
    """Rows of ``column_profile`` (all kinds) from the observed ``profile_metrics`` of ``df``."""
    return [(table, f.name, i + 1, *[int(metrics.get(f"{k}__{f.name}", 0)) for k in _KINDS], int(metrics["_rows"]))
            for i, f in enumerate(df.schema.fields)]


def column_profile(df: DataFrame, table: str, kinds=_KINDS) -> DataFrame:
    """Per column: nulls, empty strings and whitespace-only strings, plus the row count.

    One scan and one global aggregate for all columns and all requested
    checks; the single result row is unpivoted to (table_name, column, ...).
    """
    one = df.agg(*profile_metrics(df, kinds))
    structs = []
    for i, f in enumerate(df.schema.fields):
        text = isinstance(f.dataType, T.StringType)
        fields = [F.lit(f.name).alias("column"), F.lit(i + 1).alias("position")]
        for k in kinds:
            v = F.col(f"{k}__{f.name}") if (k == "null" or text) else F.lit(0).cast("bigint")
            fields.append(v.alias(f"{k}_count"))
        structs.append(F.struct(*fields))
    return one.select(F.col("_rows").alias("rows"), F.explode(F.array(*structs)).alias("p")).select(
        F.lit(table).alias("table_name"), "p.*", "rows")


def profile_report(profile: DataFrame, kind: str) -> DataFrame:
    """(table_name, column, <kind>_count, <kind>_percentage), non-zero rows only.

    ``kind`` is ``null``, ``empty`` or ``whitespace``. Percentages are
    rounded half-up to 2 decimals on the exact ratio.
    """
    cnt = f"{kind}_count"
    return (profile.where(F.col(cnt) > 0)
            .select("table_name", "column", cnt,
                    percent_half_up(F.col(cnt), F.col("rows")).alias(f"{kind}_percentage"))
            .orderBy(F.asc("table_name"), F.desc(cnt), F.asc("position")))


_WORD = 64  # ids in one bitmap word


def _members(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as (column number, text, word, bits, n).

    Whole numbers are bits of 64-bit words (word number = value / 64), merged
    by OR: up to 64 neighbouring ids are one row, scattered ids one row each,
    so a word is never worse than the value itself. Other types are compared
    as text, which is exact within one column's type. A null is one value.
    One scan and one aggregation (map-side first, so a hot value is collapsed
    in every task) for all columns; ``n`` counts the rows.
    """
    one, no_word = F.lit(1).cast("long"), F.lit(None).cast("long")
    parts = []
    for i, c in enumerate(columns):
        if isinstance(df.schema[c].dataType, T.IntegralType):
            v = F.col(c).cast("long")
            text = F.lit(None).cast("string")
            word = F.call_function("div", v - F.pmod(v, F.lit(_WORD)), F.lit(_WORD))
            bits = F.when(v.isNull(), one).otherwise(
                F.call_function("shiftleft", one, F.pmod(v, F.lit(_WORD)).cast("int")))
        else:
            text, word, bits = F.col(c).cast("string"), no_word, one
        parts.append(F.struct(F.lit(i).alias("c"), text.alias("text"), word.alias("word"), bits.alias("bits")))
    return (df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
            .groupBy("c", "text", "word").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("n")))


def distinct_counts(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """(table_name, column, nunique, rows): distinct values per column, null counted once.

    Every row contributes to each column, so a column's counts add up to the
    row count: one scan yields both numbers. Ids cross the shuffle as bitmap
    words (see ``_members``), not as text.
    """
    per_column = _members(df, columns).groupBy("c").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("nunique"),
        F.sum("n").cast("bigint").alias("rows"))
    # An empty table yields no members; the fixed column list keeps its rows (0).
    names = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("c", "column"))
    return names.join(F.broadcast(per_column), "c", "left").select(
        F.lit(table).alias("table_name"), "column",
        F.coalesce(F.col("nunique"), F.lit(0)).cast("bigint").alias("nunique"),
        F.coalesce(F.col("rows"), F.lit(0)).cast("bigint").alias("rows"))


def distinct_row(df: DataFrame, columns: Mapping[str, str], rows_name: str) -> DataFrame:
    """One row: the number of rows and, per alias, the distinct non-null values of its column."""
    names = list(columns)
    members = _members(df, [columns[a] for a in names])
    known = F.col("text").isNotNull() | F.col("word").isNotNull()
    return members.agg(
        *[F.coalesce(F.sum(F.when((F.col("c") == i) & known, F.bit_count("bits"))), F.lit(0)).cast("bigint").alias(a)
          for i, a in enumerate(names)],
        F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("n"))), F.lit(0)).cast("bigint").alias(rows_name))


def duplicate_rows_count(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Number of rows that repeat an earlier row on all columns but ``ignore``.

    Nulls compare equal. Grouping uses map-side partial counts, so a group
    of copies holding a third of the table is pre-counted in every task.
    """
    cols = [c for c in df.columns if c not in set(ignore)]
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates")))


def duplicate_members(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All rows belonging to a group with more than one row on ``cols``.

    Grouped counts (map-side combined) find the repeated keys; a null-safe
    semi join brings back their rows. A hot repeated key joins a single
    key row, so AQE can split it instead of buffering the whole group in one
    window partition.
    """
    dup = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
           .select(*[F.col(c).alias(f"_d_{c}") for c in cols]))
    cond = None
    for c in cols:
        e = df[c].eqNullSafe(dup[f"_d_{c}"])
        cond = e if cond is None else cond & e
    return df.join(dup, cond, "left_semi")


def dedupe_keep_min(df: DataFrame, id_col: str) -> DataFrame:
    """Drop rows equal on all columns but ``id_col``, keeping the smallest id.

    ``groupBy(...).agg(min(id))``: partial aggregation, no sort and no
    window, so even a very large group of copies is reduced map-side.
    """
    others = [c for c in df.columns if c != id_col]
    return df.groupBy(*others).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def surrogate_key(df: DataFrame, name: str, order: Sequence[str], staging: str, start: int = 1,
                  num_partitions: int | None = None) -> DataFrame:
    """Replace row ids with consecutive integers ``start..start+n-1`` in ``order``.

    File order is not reproducible in a distributed scan, so the order is
    defined by content (``order`` columns, nulls first). Steps, all
    distributed: a tiebreak column splits runs of identical rows so range
    partitioning can cut even a huge group of copies; rows are range
    partitioned and sorted; each row's position within its partition comes
    from ``monotonically_increasing_id``; the ranked rows are written to the
    folder ``staging`` (on a cluster: shared), so that the per-partition
    counts and the numbering see the same partitioning; per-partition offsets
    (one row per partition, a bounded broadcast) complete the keys.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first(c) for c in order] + [F.asc("_tie")]
    (df.withColumn("_tie", F.monotonically_increasing_id())
     .repartitionByRange(n, *keys).sortWithinPartitions(*keys)
     .withColumn("_mid", F.monotonically_increasing_id()).drop("_tie")
     .write.mode("overwrite").parquet(staging))
    ranked = spark.read.parquet(staging)
    pid = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranked.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        (F.sum("_cnt").over(_running_by("_pid")) - F.col("_cnt")).alias("_off"))
    out = ranked.join(F.broadcast(offsets), pid == F.col("_pid"))
    others = [c for c in df.columns if c != name]
    return out.select((F.col("_off") + local + F.lit(start)).cast("bigint").alias(name), *others)


def _running_by(col: str):
    from pyspark.sql import Window
    # Offsets table has one row per partition (bounded), so an unpartitioned
    # running sum is cheap.
    return Window.orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rule_violations(df: DataFrame, table: str, id_col: str,
                    rules: Mapping[str, Column]) -> DataFrame:
    """(table_name, rule, <id>) for every row breaking a rule; one scan for all rules.

    A rule is a boolean condition; unknown (null) counts as not broken, as in
    a pandas boolean mask.
    """
    tags = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
                                     for name, cond in rules.items()]))
    return (df.select(F.col(id_col).cast("string").alias("record_id"), tags.alias("_tags"))
            .where(F.size("_tags") > 0)
            .select(F.lit(table).alias("table_name"), F.explode("_tags").alias("rule"),
                    "record_id"))


def drop_where(df: DataFrame, cond: Column) -> DataFrame:
    """Keep rows where ``cond`` is not true (unknown counts as not true)."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def shape(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    """(table_name, rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"))
