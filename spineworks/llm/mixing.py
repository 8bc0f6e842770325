"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a hashed order, round after round. A
word's virtual finish time is the number of words its source has queued up
to it, divided by the source's target; a document's is that of its last
word. Time runs evenly through the budget, so the global order by finish
time is cut where the targets, and with them the total budget, are reached
(time 1). The document that a source has in service at the cut is taken up
to the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds rank, weight and target to rows (source, source_size, n): one row for each source.

    Weights repeat over the sources by code point, null last. The budget is
    ``share`` of all words. A target above ``cap`` times its source's size
    stops there, and the excess goes to the others by weight: with sources
    by size / weight, the water level is the largest of
    (budget - caps so far) / (weights left).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    df = sources.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    df = df.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    df = df.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return df.select("source", "source_size", "n", "weight",
                     F.least("most", F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, finish, text_hash), in the order of the mix.

    size: words of the text (null: 0). taken: words that the mix takes, all
    rounds counted, at most ceil(cap) times the size. finish: virtual finish
    time of the document in the first round (null where the target is 0).
    Null sources form one source, last. Documents queue by md5 of their id
    and text (a null id being the empty one), so reruns agree, and rows with
    null or equal ids spread over the queue like all others. Empty input
    gives an empty result.

    No window holds a whole source: its rows are dealt by hash over buckets
    of about sqrt(rows) rows, summed first and then numbered inside.
    """
    sized = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"),
                       F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).cast("binary")).alias("h")),
        "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = stage(targets(sums, weights, share, cap), "targets").withColumnRenamed("source", "plan_source")
    per = F.greatest(F.lit(256.0), F.sqrt("n"))
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    queued = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn(
        "bucket", F.floor(u * F.ceil(F.col("n") / per)).cast("int"))
    heads = queued.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = stage(heads.select(F.col("source").alias("head_source"), F.col("bucket").alias("head_bucket"),
                               F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead")), "heads")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    queued = queued.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    queued = queued.join(heads, F.col("source").eqNullSafe(F.col("head_source"))
                         & (F.col("bucket") == F.col("head_bucket")))
    start = F.col("ahead") + F.col("inside")
    goal = F.floor("target")
    taken = F.lit(0).cast("long")
    rounds = int(-(-cap // 1))
    for r in range(rounds):
        left = goal - F.lit(r) * F.col("source_size") - start
        taken = taken + F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long")
    finish = F.when(F.col("target") > 0, (start + F.col("size")) / F.col("target"))
    return queued.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source",
                         finish.alias("finish"), "text_hash").orderBy(F.col("finish").asc_nulls_last(), "source", "doc_id")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Rows of ``docs``, all columns, as often as the mix takes them.

    A document taken in part gives a last row with its first words, joined
    by single spaces. Documents of which no word is taken give no row.
    Equal rows (id and text) share what they take.
    """
    plan = mix(docs, id_col, text_col, source_col, weights, share, cap).where("taken > 0").groupBy(
        F.col("doc_id").alias("plan_id"), F.col("text_hash").alias("plan_hash")).agg(
        F.max("size").alias("size"), F.sum("taken").alias("taken"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"),
                       F.xxhash64(text).alias("own_hash")).dropDuplicates(["own_id", "own_hash"])
    rows = rows.join(stage(plan, "mix"), F.col("own_id").eqNullSafe(F.col("plan_id")) & (F.col("own_hash") == F.col("plan_hash")))
    rest = F.col("taken") % F.col("size")
    full = F.array_repeat(F.lit(None).cast("int"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    part = F.when(rest > 0, F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("first_words", F.explode(F.concat(full, part)))
    own = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(f"({WORD})")), F.lit(1), F.col("first_words")), " ")
    text = F.when(F.col("first_words").isNull(), own).otherwise(cut)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE]
             [((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight,
             2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(floor(target)::BIGINT - start, size))
        + greatest(0, least(floor(target)::BIGINT - source_size - start, size)))::BIGINT AS taken,
       source, CASE WHEN target > 0 THEN (start + size)::DOUBLE / target END AS finish
FROM q
"""
