"""A stated query set against all rows, in bounded blocks: shared by the two vector searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage

#: Vectors of one block, and queries of one block.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024


#: A null id inside a kernel: behind all others in ties.
NO_ID = (1 << 63) - 1


def vectors(table: DataFrame, id_col: str, vector_col: str, every: int) -> DataFrame:
    """(vec_id, v, dim, is_query): the rows that take part, with v as array<double>.

    Left out: vectors null, empty or holding null or non-finite components.
    Every other row is a candidate of its own, also without an id or with
    the id of another row. Queries are the rows whose id is divisible by
    ``every``.
    """
    v = F.col("v")
    df = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    return df.select("vec_id", "v", F.size("v").alias("dim"), asks.alias("is_query"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.zeros((0, dim))


def search(rows: DataFrame, k: int, kernel: Callable, score_type: str,
           block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``kernel`` over all blocks, ties to smaller vec_id (null last).

    ``kernel(ids, own, matrix, query_own, query_matrix, k)`` returns (query
    index, row index, score) of the best k rows of each query. ``own``
    numbers rows: a query leaves out the row of its own number, and only
    that. Two query rows with one id each get an answer, with ranks of its
    own. Rows and queries of one dimension are dealt by hash of the row
    number into blocks; a row block and a query block make one group, of
    bounded size. Vectors of other dimensions have no inner product with a
    query.
    """
    ship(rows.sparkSession)
    # written, so that all readers see the same numbers
    rows = stage(rows.withColumn("own", F.monotonically_increasing_id()), "vectors")
    n_blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    dims = stage(rows.groupBy("dim").agg(
        n_blocks(F.count("*"), block_rows).alias("row_blocks"),
        n_blocks(F.sum(F.col("is_query").cast("int")), block_queries).alias("query_blocks"),
        F.max("is_query").alias("asked")).where("asked").drop("asked"), "dims")
    h = F.xxhash64("own")
    dealt = rows.join(dims, "dim")
    homes = dealt.select("dim", "vec_id", "own", "v", F.lit(False).alias("asks"), F.pmod(h, "row_blocks").cast("int").alias("rb"),
                         F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"))
    asks = dealt.where("is_query").select("dim", "vec_id", "own", "v", F.lit(True).alias("asks"),
                                          F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"),
                                          F.pmod(h, "query_blocks").cast("int").alias("qb"))
    kind = pa.int64() if score_type == "long" else pa.float64()
    names = ["query_id", "query_own", "vec_id", "score"]

    def meet(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        home = table.filter(pa.compute.invert(table.column("asks"))).sort_by("own")
        ask = table.filter(table.column("asks")).sort_by("own")
        if not len(home) or not len(ask):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), kind)], names)
        ids = home.column("vec_id").fill_null(NO_ID).to_numpy()
        own, asked = home.column("own").to_numpy(), ask.column("own").to_numpy()
        q, r, s = kernel(ids, own, _matrix(home.column("v"), dim), asked, _matrix(ask.column("v"), dim), k)
        found = pa.array(ids[r], mask=ids[r] == NO_ID)
        return pa.table([pa.array(ask.column("vec_id").to_numpy()[q]), pa.array(asked[q]), found, pa.array(s, kind)], names)

    found = homes.unionByName(asks).groupBy("dim", "rb", "qb").applyInArrow(
        meet, f"query_id long, query_own long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_own").orderBy(F.col("score").desc(), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
