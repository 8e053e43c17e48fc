"""Ranks along a linked list that is spread over many tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: So many elements at most are walked in one task at the end; longer lists are contracted first.
REST = 4096
LINK = "struct<link: {0}, steps: bigint>"


def list_ranks(items: DataFrame) -> DataFrame:
    """``(item, rank)`` for ``items(item, prev, next)``: the number of elements before each, from 0.

    The list is contracted: in each round every element whose hash is smaller than those of both neighbours leaves,
    so no two neighbours do, about a third goes, and the two that stay become neighbours at the summed distance. A
    round is one shuffle of what is left; its result is checkpointed, as are the elements that left with their
    distance to the element before. When at most ``REST`` elements are left, one task walks them. Then the rounds
    are undone from the last to the first: an element's rank is that of the element it left behind plus the
    distance. All elements of one list are meant, in any key type; an empty table gives no rows.
    """
    kind = items.schema["item"].dataType.simpleString()
    link = LINK.format(kind)
    far = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("link"), F.lit(1).cast("long").alias("steps"))).alias(name)
    now = checkpointed(items.select("item", far("prev"), far("next")))
    gone: list[DataFrame] = []
    rounds = 0
    while now.count() > REST:
        rounds += 1
        key = lambda c: F.xxhash64(F.lit(rounds), c)  # noqa: B023, E731
        leaves = F.col("prev").isNotNull() & F.col("next").isNotNull() & (key(F.col("item")) < key(F.col("prev.link"))) & (key(F.col("item")) < key(F.col("next.link")))
        marked = checkpointed(now.withColumn("leaves", F.coalesce(leaves, F.lit(False))))
        gone.append(marked.where("leaves").select("item", "prev"))
        steps = F.col("prev.steps") + F.col("next.steps")
        none = F.lit(None).cast(link)
        told = lambda item, prev, next_: F.struct(item.alias("item"), prev.alias("prev"), next_.alias("next"), F.lit(True).alias("told"))
        messages = F.array(
            told(F.col("prev.link"), none, F.struct(F.col("next.link").alias("link"), steps.alias("steps"))),
            told(F.col("next.link"), F.struct(F.col("prev.link").alias("link"), steps.alias("steps")), none),
        )
        own = F.array(F.struct(F.col("item").alias("item"), F.col("prev").alias("prev"), F.col("next").alias("next"), F.lit(False).alias("told")))
        sent = marked.select(F.explode(F.when(F.col("leaves"), messages).otherwise(own)).alias("m")).select("m.*")
        pick = lambda c, told: F.first(F.when(F.col("told") == told, F.col(c)), ignorenulls=True)
        now = checkpointed(sent.groupBy("item").agg(*[F.coalesce(pick(c, True), pick(c, False)).alias(c) for c in ("prev", "next")]))
    ranks = [checkpointed(_walked(now, kind))]
    for left in reversed(gone):
        known = ranks[0]
        for more in ranks[1:]:
            known = known.unionByName(more)
        before = known.select(F.col("item").alias("_before"), F.col("rank").alias("_rank"))
        ranks.append(checkpointed(left.join(before, F.col("prev.link") == F.col("_before")).select("item", (F.col("_rank") + F.col("prev.steps")).alias("rank"))))
    out = ranks[0]
    for more in ranks[1:]:
        out = out.unionByName(more)
    return out


def _walked(rest: DataFrame, kind: str) -> DataFrame:
    """Ranks of at most ``REST`` elements, from the one without a predecessor on."""

    def walk(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        after = {str(r["prev"]["link"]) if r["prev"] else None: r for r in rows}
        names, found, at, rank = [], [], None, 0
        while at in after:
            row = after[at]
            rank += row["prev"]["steps"] if row["prev"] else 0
            names.append(row["item"])
            found.append(rank)
            at = str(row["item"])
        if len(names) != len(rows):
            raise ValueError(f"not one list: {len(rows)} elements, {len(names)} in reach of its head")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(names, batches_type[0]), pa.array(found, pa.int64())], ["item", "rank"])

    from pyspark.sql.pandas.types import to_arrow_type

    batches_type = [to_arrow_type(rest.schema["item"].dataType)]
    return rest.select("item", "prev").coalesce(1).mapInArrow(walk, f"item {kind}, rank long")
