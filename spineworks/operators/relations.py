"""Set and key relations between tables, in forms that hold at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bits of the key bitmap that lets left rows pass an anti join unshuffled.
#: It is broadcast as 64-bit words: a quarter million rows of 16 bytes at most,
#: however many keys there are.
BITMAP_BITS = 1 << 24


def _place(key: str, bits: int) -> tuple[Column, Column]:
    """(word number, bit) of a key's hash place; never null, so no filter on them is pushed below an aggregate."""
    if bits < 64 or bits & (bits - 1):
        raise ValueError("the bitmap's size must be a power of two, 64 at least")
    place = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    return F.shiftrightunsigned(place, 6), place.bitwiseAND(F.lit(63)).cast("int")


def key_bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Words (number, bits): which of ``bits`` hash places the keys take; bitmaps of parts merge by OR.

    At most ``bits`` / 64 rows, whatever the number of keys. A null takes the
    place of its hash too.
    """
    word, bit = _place(key, bits)
    # The count keeps the optimizer from merging this aggregate with a distinct
    # below it, whose exchange other uses of the keys share.
    return (keys.groupBy(word.alias("__bitmap_word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bitmap_bits"),
                 F.count(F.lit(1)).alias("__bitmap_n"))
            .where("__bitmap_n > 0").drop("__bitmap_n"))


def _by_bitmap(left: DataFrame, key: str, bitmap: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely absent, rows that may match); null keys are absent."""
    word, bit = _place(key, bits)
    looked = left.withColumn("__bitmap_at", word).join(
        F.broadcast(bitmap), F.col("__bitmap_at") == F.col("__bitmap_word"), "left")
    hit = F.call_function("bit_get", F.col("__bitmap_bits"), bit)
    may = F.col(key).isNotNull() & (F.coalesce(hit.cast("int"), F.lit(0)) == 1)
    return looked.where(~may).select(*left.columns), looked.where(may).select(*left.columns)


def split_by_bitmap(left: DataFrame, key: str, keys: DataFrame, keys_key: str, bits: int = BITMAP_BITS
                    ) -> tuple[DataFrame, DataFrame]:
    """``left`` in two parts: rows whose key is surely not among ``keys`` (null ones too), and possible matches.

    Only the second part needs a join. It scans the left side twice.
    """
    return _by_bitmap(left, key, key_bitmap(keys, keys_key, bits), bits)


def anti_join(left: DataFrame, key: str, keys: DataFrame, keys_key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``left`` whose key is not among the distinct ``keys``; null keys stay.

    A bitmap of the keys is broadcast first. Left rows whose place is not set
    are surely absent: they pass without a shuffle, straight from the scan.
    Only possible matches (the real ones, and one in ``bits`` / number of keys
    by chance) reach the exact join. Where keys outnumber the bits by far,
    all rows are possible matches and the plan is the plain join. The price
    is a second scan of the left side's files, never a second shuffle.
    """
    absent, possible = _by_bitmap(left, key, key_bitmap(keys, keys_key, bits), bits)
    # Keys are non-null on both sides here; comparing null-safely gives both
    # join inputs their own exchange on the join key. That is what lets AQE
    # split a hot left key: skew splitting needs shuffle stages directly under
    # the join, which the distinct aggregate's partitioning does not provide.
    checked = possible.join(keys.select(F.col(keys_key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    return absent.unionByName(checked)


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``left`` where ``key NOT IN (SELECT right_key FROM right)``.

    SQL semantics: if the right side is empty every left row passes (a null
    key too); otherwise a null left key, or any null on the right, makes the
    predicate unknown and the row is dropped. The built-in null-aware plan
    broadcasts the whole right side; here the anti join runs against the
    distinct right keys behind a bitmap of bounded size (``anti_join``), plus
    one global row (number of distinct keys, whether a null is among them)
    that is a single row and therefore always safe to broadcast.
    """
    # The distinct right keys (null kept as a key) answer everything NOT IN
    # needs: "is the right side empty", "does it hold a null" and the bitmap
    # are aggregates over them. All uses read the same aggregate, so Spark
    # reuses its exchange: the right side is scanned and shuffled once, and
    # only distinct keys cross the shuffle.
    keys = right.select(F.col(right_key).alias("_rk")).distinct()
    stats = keys.agg(F.count(F.lit(1)).alias("_n"),
                     F.count(F.when(F.col("_rk").isNull(), 1)).alias("_nulls"))
    # Rows the anti join lets through that NOT IN rejects (a null left key)
    # are removed by the final condition, and any null on the right empties
    # the result there.
    return (anti_join(left, key, keys, "_rk", bits).crossJoin(F.broadcast(stats))
            .where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull()))
            .drop("_n", "_nulls"))


def in_except(left: DataFrame, key: str, include: DataFrame, include_key: str,
              exclude: DataFrame, exclude_key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``left`` whose key is in ``include EXCEPT exclude`` (null = null in EXCEPT).

    ``IN`` never matches a null key, so the result is the left rows with a
    non-null key present in ``include`` and absent from ``exclude``. Both
    key sets are deduplicated (map-side) before the joins, so a hot key on
    the left meets exactly one row on the right.
    """
    exc = exclude.select(F.col(exclude_key).alias("_k")).distinct()
    if include is left and include_key == key:
        # Every non-null key of the left side is in its own key set, so only
        # the exclusion remains.
        return anti_join(left.where(F.col(key).isNotNull()), key, exc, "_k", bits)
    inc = include.select(F.col(include_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    keys = inc.join(exc, "_k", "left_anti")
    return left.where(F.col(key).isNotNull()).join(
        keys.select(F.col("_k").alias("_i")), F.col(key).eqNullSafe(F.col("_i")), "left_semi")


def full_outer_skew_safe(big: DataFrame, small: DataFrame, key: str,
                         small_key: str | None = None, colocated: bool = False) -> DataFrame:
    """Full outer join where ``big`` may hold very hot keys.

    Written as ``big LEFT JOIN small`` (AQE can split a skewed left side)
    plus the ``small`` rows whose key never occurs in ``big`` (anti join
    against big's distinct keys, so no hot key reaches that join). Output
    columns: all of ``big`` then all of ``small``; the two sides must have
    disjoint column names. With ``colocated`` (both sides bucketed by the key,
    which they only are without hot keys) it is one plain join in place.
    """
    if not set(big.columns).isdisjoint(small.columns):
        raise ValueError("full_outer_skew_safe needs disjoint column names")
    sk = small_key or key
    if colocated:
        return big.join(small, big[key] == small[sk], "full")
    matched = big.join(small, big[key] == small[sk], "left")
    big_keys = big.select(F.col(key).alias("_bk")).where(F.col("_bk").isNotNull()).distinct()
    only_small = small.join(big_keys, small[sk] == F.col("_bk"), "left_anti")
    big_nulls = only_small.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in big.schema.fields],
        *[F.col(c) for c in small.columns])
    return matched.unionByName(big_nulls)


def left_join_unique_to_skewed(unique: DataFrame, skewed: DataFrame, key: str,
                               skewed_key: str, skewed_cols: Sequence[str], colocated: bool = False) -> DataFrame:
    """``unique LEFT JOIN skewed`` where ``unique`` has one row per key.

    A plain left outer join cannot split a hot key on its right side. This
    form joins inner (AQE splits hot keys on either side of an inner join),
    then adds the unmatched ``unique`` rows with null right columns, found by
    an anti join against the deduplicated right keys. ``unique`` is often an
    aggregate by the key; a null-safe comparison gives it its own exchange, as
    splitting needs. With ``colocated`` (both sides bucketed by the key, which
    they only are without hot keys) it is one plain left join in place.
    """
    right = skewed.select(F.col(skewed_key).alias("_sk"), *skewed_cols)
    if colocated:
        return unique.join(right, F.col(key) == F.col("_sk"), "left").drop("_sk")
    same = F.col(key).isNotNull() & F.col(key).eqNullSafe(F.col("_sk"))
    inner = unique.join(right, same, "inner").drop("_sk")
    right_keys = skewed.select(F.col(skewed_key).alias("_sk")).where(
        F.col("_sk").isNotNull()).distinct()
    unmatched = unique.join(right_keys, F.col(key) == F.col("_sk"), "left_anti")
    nulls = [F.lit(None).cast(skewed.schema[c].dataType).alias(c) for c in skewed_cols]
    return inner.unionByName(unmatched.select(*unique.columns, *nulls))
