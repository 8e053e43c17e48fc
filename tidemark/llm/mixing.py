"""Mixing sources to target weights: whole copies for certain, the rest by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.operators.ordered import bucketed, running_sum

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that one task ranks, about.
RANK_ROWS = 1 << 12
#: Fractions of a copy below this are rounding.
TINY = 1e-9


def uniform(seed: str, *cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on ``seed`` and the columns alone: 52 bits of an MD5 sum."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, size)`` rows.

    Sources by code point, null last, weigh ``weights`` in turn and share the words of all. A target stops at
    ``most`` times its source's words and the excess is shared again by weight: sources are filled in ascending
    order of words by weight, so one ordered pass over a row a source gives what sharing again and again ends in.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = own.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (number % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = weighed.withColumn("full", F.lit(most) * F.col("source_size") * rest <= (F.sum("source_size").over(every) - before) * F.col("weight"))
    left = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(0)).over(every)
    share = (left * F.col("weight")).cast("double") / F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    return filled.select("source", "source_size", F.when(F.col("full"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def expected_copies(units: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """``(source, weight, whole, odd, need, ...)``: what each weight class of a source gets.

    Expected copies are proportional to the weight, at most ``most``, and sum to the target in words. ``whole`` of
    them are certain, ``odd`` is the probability of one more, and ``need`` the words that those draws have to give.
    """
    classes = units.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    known = classes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole_source = Window.partitionBy("source")
    order = whole_source.orderBy(F.col("weight").desc())
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("weight") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = known.withColumn("full", (F.col("target") - most * before) * F.col("weight") >= most * rest)
    factor = (F.col("target") - most * F.sum(F.when(F.col("full"), F.col("words")).otherwise(0)).over(whole_source)) / F.sum(F.when(~F.col("full"), F.col("weight") * F.col("words")).otherwise(0.0)).over(whole_source)
    copies = filled.withColumn("copies", F.when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), F.col("weight") * factor)))
    parts = copies.withColumn("whole", F.floor(F.col("copies") + TINY)).withColumn("odd", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole")))
    need = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source)
    drawn = F.sum(F.when(F.col("odd") > TINY, F.col("rows")).otherwise(0)).over(whole_source)
    return parts.select("source", "weight", "whole", "odd", need.alias("need"), F.floor(drawn / RANK_ROWS + 1).alias("buckets"))


def _fitting(left: DataFrame) -> DataFrame:
    """``(source, cum)`` of documents beyond the cut that still fit into what it left open.

    Of each size class (a power of two) of a source the two first in order are looked at, largest first; each that
    fits is taken, so about one halving of the open words needs one class.
    """
    order = Window.partitionBy("source", "octave").orderBy("cum")
    few = left.withColumn("octave", F.length(F.bin("size"))).withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    lists = few.groupBy("source").agg(F.first("open").alias("open"), F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "cum"))).alias("found"))
    start = F.struct(F.col("open").alias("open"), F.array().cast("array<bigint>").alias("cums"))

    def take(state: Column, one: Column) -> Column:
        fits = -one["less"] <= state["open"]
        return F.struct(F.when(fits, state["open"] + one["less"]).otherwise(state["open"]).alias("open"), F.when(fits, F.concat(state["cums"], F.array(one["cum"]))).otherwise(state["cums"]).alias("cums"))

    return lists.select("source", F.explode(F.aggregate("found", start, take)["cums"]).alias("cum"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | None = None, source_weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix"
) -> DataFrame:
    """``(doc_id, source, mark, size, source_size, target, copies, taken)``: how often the mix takes each document.

    A document's expected copies within its source grow with ``weight`` (by default the whole part of the square
    root of its words, so that a source that cannot be taken whole gives its longer texts more often; few distinct
    values are meant). Whole copies are certain. For the rest, documents are ranked by the odds of their random
    number divided by their inclusion odds, and the first ones are taken while they fit the words still needed;
    the sample is of fixed size in words, the unit of the targets. What the cut leaves open goes to the next
    documents that fit. Random numbers come from the seed, the id and the text, so reruns agree.

    Texts are read once and counted where they lie; only numbers are shuffled. Ranks run per source and slice of
    the order, with one carried sum a slice, so a hot source spreads.

    Null and empty texts have size 0 and no copies; null ids are documents like others; null is a source of its
    own, the last. Of repeated rows each is a document of its own; those of equal rank are interchangeable. A very
    long text is one document and is taken only where it fits. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.md5(F.col(text_col).cast("string")).alias("mark"), size.alias("size"), *([] if weight is None else [weight.cast("double").alias("weight")]))
    if weight is None:
        own = own.withColumn("weight", F.floor(F.sqrt("size")).cast("double"))
    units = checkpointed(own)
    targets = checkpointed(source_targets(units, source_weights, most))
    classes = expected_copies(units, targets, most)
    named = [F.col(c).alias(f"c_{c}") if c in ("source", "weight") else F.col(c) for c in classes.columns]
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("weight") == F.col("c_weight")) & (F.col("size") > 0)
    shared = units.join(classes.select(*named), same, "left").drop("c_source", "c_weight", "weight")
    shared = checkpointed(shared.withColumn("whole", F.coalesce("whole", F.lit(0)).cast("long")))

    u = uniform(seed, F.col("doc_id"), F.col("mark"))
    odds = (u / (1 - u)) * ((1 - F.col("odd")) / F.col("odd"))
    drawn = shared.where(F.col("odd") > TINY).withColumn("odds", odds)
    sliced = bucketed(drawn, F.floor(F.col("odds") / (1 + F.col("odds")) * F.col("buckets")))
    # a join on a null source finds nothing, so the key of the ranks is a source that is never null
    keyed = sliced.withColumn("_key", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))))
    ranked = checkpointed(running_sum(keyed, ["_key"], ["odds", "doc_id", "mark"], F.col("size"), "cum").drop("_key", "_bucket"))
    rest = ranked.where("cum > need")
    used = ranked.where("cum <= need").groupBy("source").agg(F.max("cum").alias("used")).withColumnRenamed("source", "s")
    opened = rest.join(used, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("open", F.col("need") - F.coalesce("used", F.lit(0))).where(F.col("size") <= F.col("open"))
    more = _fitting(opened).select(F.col("source").alias("m_source"), F.col("cum").alias("m_cum"))
    one_more = ranked.join(more, F.col("source").eqNullSafe(F.col("m_source")) & (F.col("cum") == F.col("m_cum")), "left").withColumn("extra", ((F.col("cum") <= F.col("need")) | F.col("m_cum").isNotNull()).cast("long"))
    columns = ["doc_id", "source", "mark", "size"]
    decided = one_more.select(*columns, (F.col("whole") + F.col("extra")).alias("copies")).unionByName(shared.where(F.coalesce(F.col("odd"), F.lit(0.0)) <= TINY).select(*columns, F.col("whole").alias("copies")))
    total = targets.withColumnRenamed("source", "s")
    return decided.join(total, F.col("source").eqNullSafe(F.col("s"))).select(*columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` takes them, with their copy number from 0 as ``copy_no``.

    Rows are found by id, source and text. Rows equal in all three share their copies as evenly as they go.
    """
    keys = ("doc_id", "source", "mark")
    shares = plan.groupBy(*keys).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], "_copies", "_rows")
    mine = (F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.md5(F.col(text_col).cast("string")))
    same = F.lit(True)
    for k, c in zip(keys, mine):
        same = same & F.col(f"_{k}").eqNullSafe(c)
    found = docs.join(shares, same)
    single = found.where("_rows = 1").withColumn("_mine", F.col("_copies"))
    number = F.row_number().over(Window.partitionBy("_doc_id", "_source", "_mark").orderBy(F.lit(0)))
    several = found.where("_rows > 1").withColumn("_mine", F.floor(F.col("_copies") / F.col("_rows")) + (number <= F.col("_copies") % F.col("_rows")).cast("long"))
    both = single.unionByName(several).where("_mine > 0")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), (F.col("_mine") - 1).cast("int"))).alias("copy_no"))
