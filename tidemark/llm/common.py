"""What several operators of this subpackage share: batches, folders, order, permutations of hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

U64 = np.uint64
#: The first number that stands for a text without an id.
NO_ID = 1 << 62


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost nothing before it."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def row_key(id_col: str, text_col: str) -> Column:
    """The id of a row; for a row without one a number from 2^62 on that stands for its text, so that equal texts share it.

    Smaller than all such numbers are the ids of any table numbered below 2^62. Two different texts without an id
    share a number with a chance of 2^-62.
    """
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder of the session; Spark's writers make it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of at most ``most_bytes`` each, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at, n = 0, len(column)
    while at < n:
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right"))
        end = max(at + 1, upto)
        yield at, end
        at = end


def quantile_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending values of an integer column that cut its rows into about equal parts.

    Only these few numbers reach the driver. Fixed bounds, unlike a range exchange of its own, put a row
    into the same part however often a lost task is computed again.
    """
    if parts < 2:
        return []
    probabilities = [i / parts for i in range(1, parts)]
    found = df.select(key).where(F.col(key).isNotNull()).approxQuantile(key, probabilities, 0.2 / parts)
    return sorted({int(v) for v in found})


def part_of(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are at most ``key``, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds)).cast("int")


def shuffle_parts(spark: SparkSession) -> int:
    """The number of partitions the session asks of a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
