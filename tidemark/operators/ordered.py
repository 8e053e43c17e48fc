"""Ordered state over keys that may be hot.

A window over one key sends the whole key to one task. These helpers cut a key into
buckets of its order column, run the window per (key, bucket), and carry a few
numbers per bucket across: the carried table has one row per bucket, so a key with a
third of all rows still spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(df: DataFrame, bucket: Column) -> DataFrame:
    """``bucket`` must be non-decreasing in the order column, e.g. a date or ``floor(ord / width)``."""
    return df.withColumn("_bucket", bucket)


def _local(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_bucket").orderBy(*order)


def with_carried(local: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what is carried into their bucket; null keys are keys like others."""
    names = [*keys, "_bucket"]
    renamed = carried.select(*[F.col(k).alias(f"_carried_{i}") for i, k in enumerate(names)], *[c for c in carried.columns if c not in names])
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & F.col(k).eqNullSafe(F.col(f"_carried_{i}"))
    return local.join(renamed, same).drop(*[f"_carried_{i}" for i in range(len(names))])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Inclusive running sum per key over a bucketed frame."""
    upto = _local(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_value", value)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    local = rows.withColumn("_sum", F.sum("_value").over(upto))
    return with_carried(local, carried, keys).withColumn(out, F.col("_sum") + F.col("_carry")).drop("_value", "_sum", "_carry")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    return running_sum(df, keys, order, F.lit(1), out)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], out: str) -> DataFrame:
    """Struct of ``cols`` of the preceding row of the key, across buckets; null on the first row."""
    rows = df.withColumn("_row", F.struct(*cols))
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    local = rows.withColumn("_prev", F.lag("_row").over(_local(keys, order)))
    return with_carried(local, carried, keys).withColumn(out, F.coalesce("_prev", "_carry")).drop("_row", "_prev", "_carry")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The value of the nearest row of the key at or before each row where it is not null, across buckets; else null."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_value", value)
    held = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by("_value", held).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    local = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(upto(_local(keys, order))))
    return with_carried(local, carried, keys).withColumn(out, F.coalesce("_own", "_carry")).drop("_value", "_own", "_carry")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``is_first``: whether a row is the first of its keys; an aggregate and an equi join, no window."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, list(keys)).withColumn("is_first", F.struct(*order) == F.col("_first")).drop("_first")
