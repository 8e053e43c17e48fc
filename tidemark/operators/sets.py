"""Set operations U1-U5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import as_col


def ordered_union(*dfs: DataFrame) -> DataFrame:
    """Union that remembers which input a row came from."""
    out = None
    for i, df in enumerate(dfs):
        part = df.withColumn("source_ord", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def array_delta(a: Column | str, b: Column | str) -> Column:
    """Sorted (added, removed) values from ``a`` to ``b``."""
    return F.struct(
        F.array_sort(F.array_except(as_col(b), as_col(a))).alias("added"), F.array_sort(F.array_except(as_col(a), as_col(b))).alias("removed")
    )


def row_delta(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``after`` that ``before`` lacks."""
    return after.select(*keys).distinct().join(before.select(*keys), list(keys), "left_anti")


def metric_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return a.select(name).union(b.select(name)).distinct()


def distinct_trimmed(df: DataFrame, col: str, ord_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct trimmed non-empty values with the position where each was first seen."""
    value = F.trim(F.col(col))
    return df.where(F.length(value) > 0).groupBy(*by, value.alias(col)).agg(F.min(ord_col).alias("position"))
