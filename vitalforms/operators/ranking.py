"""Exact ranks and cuts over whole tables without a one-task window.

A plain ``row_number`` over a large group sorts the group in one task.  Here
rows are first put into order-preserving buckets; the bucket sizes give each
bucket its offset and only the rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"


def digest(*key: Column, seed: str = "") -> Column:
    """Stable pseudo-random order key: the MD5 of the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def with_digest_bucket(df: DataFrame, order: str, width: int = 4) -> DataFrame:
    """Bucket an MD5 order column by its leading hex digits (16**width buckets)."""
    return df.withColumn(_BUCKET, F.substring(F.col(order), 1, width))


def with_position_bucket(df: DataFrame, order: str, buckets: int = 4096) -> DataFrame:
    """Bucket a numeric order column at its approximate quantiles.

    The bounds are at most ``buckets`` numbers, read once and put into the
    plan as literals, so every use of the column sees the same buckets.
    Rows with a null position are a bucket of their own, which comes last.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    numeric = df.select(F.col(order).cast("double").alias("_p"))
    bounds = sorted(set(numeric.approxQuantile("_p", probabilities, 0.2 / buckets)))
    if not bounds:
        return df.withColumn(_BUCKET, F.when(F.col(order).isNotNull(), F.lit(0.0)))
    splits = [float("-inf"), *bounds, float("inf")]
    keyed = df.withColumn("_p", F.col(order).cast("double"))
    return Bucketizer(splits=splits, inputCol="_p", outputCol=_BUCKET).transform(keyed).drop("_p")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _bucket_offsets(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, bucket) -> rows before the bucket, rows in it, rows in the group."""
    sizes = df.groupBy(*group, _BUCKET).agg(F.count(F.lit(1)).alias("_in"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy(F.col(_BUCKET).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group, _BUCKET, "_in",
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
        F.sum("_in").over(whole).alias("_total"),
    )


def ranked(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (),
           out: str = "rank") -> DataFrame:
    """Rank from 1 of every row of a bucketed table, within its group.

    Without groups there is one offset a bucket (16**4 digests, 4,096 quantiles),
    which every task gets whole: the rows move once, to be sorted in their buckets.
    """
    offsets = _bucket_offsets(df, group)
    joined = null_safe_join(df, offsets if group else F.broadcast(offsets), [*group, _BUCKET])
    w = Window.partitionBy(*group, _BUCKET).orderBy(*order)
    return (joined.withColumn(out, F.row_number().over(w) + F.col("_before"))
            .drop(_BUCKET, "_in", "_before", "_total"))


def ranked_by_digest(df: DataFrame, key: Sequence[Column], ties: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """Rank from 1 of every row in the order of the digest of its key; equal digests follow ``ties``.

    Rows move to the bucket of their digest without it: 32 random characters a
    row would be half of what is written, so it is made again where it is sorted.
    """
    keyed = df.withColumn(_BUCKET, F.unhex(F.substring(digest(*key), 1, 4)))  # two bytes, in the order of the characters
    offsets = _bucket_offsets(keyed.select(_BUCKET), ()).select(F.col(_BUCKET).alias("_at"), "_before")
    w = Window.partitionBy(_BUCKET).orderBy(digest(*key), *ties)
    numbered = keyed.repartition(_BUCKET).withColumn(out, F.row_number().over(w))
    joined = numbered.join(F.broadcast(offsets), F.col(_BUCKET) == F.col("_at"))
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop(_BUCKET, "_at", "_before")


def flag_first(df: DataFrame, order: str, size: Column, group: Sequence[str] = (),
               out: str = "chosen") -> DataFrame:
    """Mark the first ``size`` rows of each group of a bucketed table.

    ``size`` may use the column ``_total`` (rows in the group).  ``order``
    must be unique within a group, nulls aside.  Only the bucket that holds the
    cut is sorted; the rows themselves are compared with the cut value and never
    shuffled.  Rows with a null order come last, in the order of their digests;
    only these are ranked one by one.
    """
    keys = df.select(*group, order, _BUCKET)
    offsets = _bucket_offsets(keys, group).withColumn("_k", size.cast("long") - F.col("_before"))
    known = F.col(_BUCKET).isNotNull()
    edge = offsets.filter(known & (F.col("_k") >= 1) & (F.col("_k") <= F.col("_in"))).select(
        *group, _BUCKET, "_k")
    near = null_safe_join(keys, edge, [*group, _BUCKET])
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(order)
    cut = (near.withColumn("_n", F.row_number().over(w))
           .filter(F.col("_n") == F.col("_k"))
           .select(*group, F.col(order).alias("_cut")))
    every = offsets.groupBy(*group).agg(
        (F.max(size.cast("long")) >= F.max("_total")).alias("_all"),
        (F.max(size.cast("long")) - F.coalesce(F.sum(F.when(known, F.col("_in"))), F.lit(0))).alias("_left"))
    if group:
        joined = null_safe_join(df, null_safe_join(every, cut, group, "left"), group, "left")
    else:
        joined = df.withColumns({"_cut": cut.scalar(), "_all": every.select("_all").scalar(), "_left": every.select("_left").scalar()})
    placed = joined.filter(F.col(order).isNotNull()) if df.schema[order].nullable else joined
    flagged = placed.withColumn(out, F.coalesce(
        F.col("_all") | (F.col("_left") >= 0) | (F.col(order) <= F.col("_cut")), F.lit(False)))
    if df.schema[order].nullable:
        row = F.md5(F.to_json(F.struct(*[c for c in df.columns if c != _BUCKET])))
        last = with_digest_bucket(joined.filter(F.col(order).isNull()).withColumn("_row", row), "_row")
        last = ranked(last, ["_row"], group, "_n").withColumn(out, F.coalesce(F.col("_n") <= F.col("_left"), F.lit(False)))
        flagged = flagged.unionByName(last.select(*[c for c in flagged.columns if c != _BUCKET]), allowMissingColumns=True)
    return flagged.drop(_BUCKET, "_cut", "_all", "_left")
