"""Differences of two tables by a digest tree: only buckets that differ are opened.

Rows are dealt into leaf buckets by a hash of their content, so equal rows
meet in one bucket on both sides. A leaf's digest is order-free: the number
of rows and two sums of 64-bit row hashes, which merge by addition. Leaves are
few enough to be compared at once. Where few of them differ, each is cut into
as many children by further bits of the hash, and the rows of the others are
read no more; only the rows of the last level's differing nodes are compared
exactly. Tables that differ in a few rows shuffle those rows and their few
neighbours, and numbers for all others.

A digest table can be kept beside a stored table and given to ``reconcile``,
so an unchanged side need not even be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leaves of the tree. The numbers of differing leaves are all that reaches the driver and is broadcast.
LEAVES = 4096
#: Differing leaves up to which they are cut further: at most so many times ``LEAVES`` numbers are collected.
REFINE = 16
_SUMS = ("n", "s1", "s2")


def _hashed(df: DataFrame) -> DataFrame:
    # to_json names the columns and leaves out nulls: one text for each content
    text = F.to_json(F.struct(*sorted(df.columns)))
    return df.withColumn("__h1", F.xxhash64(text)).withColumn("__h2", F.xxhash64(F.concat(F.lit("2"), text)))


def _leaf(leaves: int):
    return F.pmod(F.col("__h1"), F.lit(leaves)).cast("int")


def _child(leaves: int):
    """Node of the second level: leaf and child in one number."""
    return F.pmod(F.col("__h1"), F.lit(leaves)) * leaves + F.pmod(F.col("__h2"), F.lit(leaves))


def _summed(hashed: DataFrame, node) -> DataFrame:
    big = "decimal(38,0)"
    return hashed.groupBy(node.alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__h1").cast(big)).alias("s1"), F.sum(F.col("__h2").cast(big)).alias("s2"))


def digests(df: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(leaf, n, s1, s2): order-free digests of the leaves that hold rows; digests of parts merge by addition."""
    return _summed(_hashed(df), _leaf(leaves))


def merged(*tables: DataFrame) -> DataFrame:
    """Digest table of the union of the tables behind ``tables``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _differing(a: DataFrame, b: DataFrame) -> list[int]:
    """Nodes whose digests differ."""
    signed = a.select("leaf", *_SUMS).unionByName(b.select("leaf", *[(-F.col(c)).alias(c) for c in _SUMS]))
    differ = "n <> 0 or s1 <> 0 or s2 <> 0"
    per_leaf = signed.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in _SUMS]).where(differ)
    return sorted(r[0] for r in per_leaf.select("leaf").collect())


def reconcile(left: DataFrame, right: DataFrame, left_digests: DataFrame | None = None,
              right_digests: DataFrame | None = None, leaves: int = LEAVES) -> DataFrame:
    """Rows whose number of copies differs: the columns, ``left_rows`` and ``right_rows``.

    Nulls are equal, columns are matched by name. EXCEPT (distinct) of the
    two tables are the rows where the other side's count is 0; EXCEPT ALL
    repeats a row by the surplus. Digest tables of unchanged sides save their
    scan unless they differ.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    right = right.select(*left.columns)
    opened = _differing(left_digests if left_digests is not None else digests(left, leaves),
                        right_digests if right_digests is not None else digests(right, leaves))
    spark = left.sparkSession

    def inside(df: DataFrame, node, nodes: list[int]) -> DataFrame:
        wanted = F.broadcast(spark.createDataFrame([(i,) for i in nodes], "__node long"))
        return df.join(wanted, node == F.col("__node"), "left_semi")
    kept = [inside(_hashed(df), _leaf(leaves), opened) for df in (left, right)]
    if 0 < len(opened) <= REFINE:
        opened = _differing(*[_summed(df, _child(leaves)) for df in kept])
        kept = [inside(df, _child(leaves), opened) for df in kept]

    def rows(df: DataFrame, side: str, other: str) -> DataFrame:
        return df.select(*left.columns, F.lit(1).cast("long").alias(side), F.lit(0).cast("long").alias(other))
    both = rows(kept[0], "left_rows", "right_rows").unionByName(rows(kept[1], "right_rows", "left_rows"))
    return both.groupBy(*left.columns).agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows")).where("left_rows <> right_rows")


def only_left(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    """``left EXCEPT right``: distinct rows of ``left`` that ``right`` lacks."""
    return reconcile(left, right, **options).where("right_rows = 0").drop("left_rows", "right_rows")
