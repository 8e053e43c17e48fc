"""Chat formatting: cumulative snapshots collapse to the longest, then conversations are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Messages of a segment: what one task ever holds of a conversation's text.
SEGMENT_MESSAGES = 1024
#: Turn numbers of a block, as a power of two: the rows of one window.
BLOCK_BITS = 10
SUMS = ("s0", "s1", "s2", "s3")


def _halves(*cols: Column) -> list[Column]:
    """Two hashes as four halves of 32 bits, whose sums over a conversation cannot overflow."""
    hashes = [F.xxhash64(F.lit(salt), *cols) for salt in (1, 2)]
    return [h for x in hashes for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]


def turn_prefixes(messages: DataFrame) -> DataFrame:
    """``(conv, turn, last, here, n, s0 .. s3)``: a rolling hash of each conversation up to each of its turns.

    The hash of a message covers its turn, role and text, so the sum over all messages so far stands for the
    prefix; ``n`` counts them and ``here`` those of the turn. Sums roll within a block of turn numbers; one row a
    block carries the sum of the blocks before, so a conversation of any length spreads over tasks. A null turn
    is the first block.
    """
    block = F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 60)))
    turns = messages.groupBy("conv", "turn").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMS]).withColumn("block", block)
    whole = turns.groupBy("conv", "block").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])
    order = Window.partitionBy("conv").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv", "block", F.lead("block").over(order).isNotNull().alias("more"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in ("n", *SUMS)])
    inner = Window.partitionBy("conv", "block").orderBy("turn")
    rolling = turns.select("conv", "block", "turn", F.col("n").alias("here"), F.lead("block").over(inner).isNull().alias("edge"), *[F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("n", *SUMS)])
    return rolling.join(carried, ["conv", "block"]).select("conv", "turn", (F.col("edge") & ~F.col("more")).alias("last"), "here", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in ("n", *SUMS)])


def maximal_conversations(prefixes: DataFrame, singles: DataFrame) -> DataFrame:
    """``(conv, copies, n, s0 .. s3)``: conversations that prefix no longer one, the smallest id of equal ones, and how many are equal.

    ``singles`` holds conversations of one message without an id; where only such are equal, ``conv`` is null.
    """
    keys = ["n", *SUMS]
    named = prefixes.where("last").groupBy(*keys).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    alone = singles.groupBy(*SUMS).agg(F.count("*").alias("copies")).select(F.lit(1).cast("long").alias("n"), *SUMS, F.lit(None).cast("long").alias("conv"), "copies")
    ends = named.unionByName(alone).groupBy(*keys).agg(F.min("conv").alias("conv"), F.sum("copies").alias("copies"))
    longer = prefixes.where("NOT last").select(*keys).distinct()
    return ends.join(longer, keys, "left_anti").select("conv", "copies", *keys)


def chat_documents(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, segment, n_turns, copies, rendered)``: maximal conversations, rendered turn by turn.

    A logged conversation whose messages are the first turns of a longer one is a snapshot and goes; of equal
    conversations the smallest id stays, ``copies`` counts them. Repeated rows of a conversation count once;
    different messages of one turn are all kept, by role and text. Every row with a null id is a conversation of
    its own, which may be the snapshot or the equal of any other; its id stays null. A null turn comes before all
    others and differs from every number, a null role or text renders empty but differs from an empty one. A
    conversation of more than ``SEGMENT_MESSAGES`` messages is rendered in several segments, to be read in order;
    ``n_turns`` counts the turns that have messages in the segment. An empty table gives an empty result. No task
    holds more than a segment of a conversation; the messages of one turn are sorted by one task, which spills.
    """
    own = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    known = lambda c, other: (F.col(c).isNull(), F.coalesce(c, F.lit(other)))
    content = (*known("turn", 0), *known("role", ""), *known("text", ""))
    hashes = [h.alias(c) for c, h in zip(SUMS, _halves(*content))]
    prefixes = checkpointed(turn_prefixes(own.where("conv IS NOT NULL").select("conv", "turn", *hashes).distinct()))
    kept = checkpointed(maximal_conversations(prefixes, own.where("conv IS NULL").select(*hashes)))
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")).alias("line")

    named = own.join(kept.select("conv", "copies"), "conv").distinct()
    place = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
    starts = prefixes.select(F.col("conv").alias("c"), F.col("turn").alias("t"), (F.col("n") - F.col("here")).alias("start"))
    placed = named.withColumn("place", place).join(starts, (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).select("conv", "copies", F.struct("turn").alias("turn"), (F.col("start") + F.col("place") - 1).alias("at"), line)
    segments = placed.groupBy("conv", F.floor(F.col("at") / SEGMENT_MESSAGES).alias("segment")).agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("at", "turn", "line"))).alias("messages"))
    many = segments.select(
        F.col("conv").alias("conv_id"), "segment", F.array_size(F.array_distinct(F.transform("messages", lambda m: m["turn"]))).cast("long").alias("n_turns"), "copies",
        F.array_join(F.transform("messages", lambda m: m["line"]), "").alias("rendered"))

    alone = own.where("conv IS NULL").select("turn", "role", "text").distinct().select(*hashes, line)
    single = alone.join(kept.where("conv IS NULL").select("copies", *SUMS), list(SUMS))
    return many.unionByName(single.select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("segment"), F.lit(1).cast("long").alias("n_turns"), "copies", F.col("line").alias("rendered")))
