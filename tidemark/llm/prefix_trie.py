"""The trie of conversation prefixes, its subtrees measured on an Euler tour."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, part_of, quantile_bounds, shuffle_parts
from tidemark.llm.list_ranking import list_ranks
from tidemark.operators.ordered import bucketed, previous, running_sum

WORD = r"[^\x20\x09-\x0D]+"
#: Turns, positions of the tour and ids that one task handles together.
TURNS, STOPS, IDS = 1024, 1 << 14, 4096
KEY = ("k0", "k1", "k2", "k3")


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, position, content, words)``: the turns of each conversation from position 1 on.

    By turn, null first; rows of one turn by the MD5 sum of role and text, so equal rows stand together. A null
    role or text is empty. Rows without a conversation id belong to none and are left out. Texts are hashed and
    counted where they are read; a conversation, and a turn of many rows, is numbered in slices.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(turn_col).cast("long")
    content = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    own = conversations.where(F.col(conv_col).cast("long").isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), turn.isNotNull().alias("timed"), F.coalesce(turn, F.lit(0)).alias("turn"), content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    said = checkpointed(own.groupBy("conv", "timed", "turn", "content", "words").agg(F.count("*").alias("n")))
    turns = said.groupBy("conv", "timed", "turn").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    upto = running_sum(bucketed(turns, F.struct("timed", F.floor(F.col("turn") / TURNS))), ["conv"], ["timed", "turn"], F.col("total"), "upto").drop("_bucket")
    placed = said.join(upto, ["conv", "timed", "turn"]).withColumn("before", F.col("upto") - F.col("total"))
    several = running_sum(bucketed(placed.where("kinds > 1"), F.substring("content", 1, 3)), ["conv", "timed", "turn"], ["content"], F.col("n"), "inner")
    columns = ["conv", "content", "words", "n", "before"]
    both = placed.where("kinds = 1").select(*columns).unionByName(several.select("conv", "content", "words", "n", (F.col("before") + F.col("inner") - F.col("n")).alias("before")))
    return both.select("conv", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("position"), "content", "words")


def rebuilt_turns(turns: DataFrame, convs: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """``(conv, depth, content, words)``: each conversation c begins with the first h turns of c - c % ``period``.

    h is the CRC-32 of the decimal id modulo ``heads``; all turns if there are fewer, none if that conversation is
    absent; then come c's own turns after its first h.
    """
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    base = lambda c: c - c % period
    early = turns.where(F.col("position") < heads)
    sizes = early.groupBy("conv").agg(F.count("*").alias("has")).select(F.col("conv").alias("base"), "has")
    taken = convs.select("conv", head(F.col("conv")).alias("head"), base(F.col("conv")).alias("base")).join(sizes, "base", "left")
    # a conversation that is its own base stays as it is: what it borrows is what it skips
    taken = checkpointed(taken.where("conv <> base").select("conv", "base", "head", F.least("head", F.coalesce("has", F.lit(0))).alias("borrowed")))
    lent = early.select(F.col("conv").alias("base"), F.col("position").alias("depth"), "content", "words")
    first = taken.where("borrowed > 0").join(lent, "base").where("depth <= borrowed").select("conv", "depth", "content", "words")
    kept = turns.join(taken.select("conv", "head", "borrowed"), "conv", "left").where("head IS NULL OR position > head")
    return first.unionByName(kept.select("conv", (F.col("position") - F.coalesce("head", F.lit(0)) + F.coalesce("borrowed", F.lit(0))).alias("depth"), "content", "words"))


def _halves(*cols: Column) -> list[Column]:
    """Two hashes as four halves of 32 bits, whose sums over a conversation cannot overflow."""
    hashes = [F.xxhash64(F.lit(salt), *cols) for salt in (1, 2)]
    return [h for x in hashes for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``(conv, depth, words, last, k0 .. k3, p0 .. p3)``: 128 bits for the first ``depth`` turns, and for one turn less.

    Sums of position-bound hashes roll within slices of a conversation; one row a slice carries the sums before it.
    """
    own = turns.select("conv", "depth", "words", F.floor(F.col("depth") / TURNS).alias("slice"), *[h.alias(k) for h, k in zip(_halves(F.col("depth"), F.col("content")), KEY)])
    whole = own.groupBy("conv", "slice").agg(*[F.sum(k).alias(k) for k in KEY])
    order = Window.partitionBy("conv").orderBy("slice")
    carried = whole.select("conv", "slice", F.lead("slice").over(order).isNull().alias("ends"), *[F.coalesce(F.sum(k).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b{k}") for k in KEY])
    inner = Window.partitionBy("conv", "slice").orderBy("depth")
    rolled = own.select("conv", "slice", "depth", "words", F.lead("depth").over(inner).isNull().alias("edge"), *[F.col(k).alias(f"own_{k}") for k in KEY], *[F.sum(k).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in KEY])
    sums = rolled.join(carried, ["conv", "slice"])
    return sums.select("conv", "depth", "words", (F.col("edge") & F.col("ends")).alias("last"), *[(F.col(k) + F.col(f"b{k}")).alias(k) for k in KEY], *[(F.col(k) + F.col(f"b{k}") - F.col(f"own_{k}")).alias(f"p{k[1]}") for k in KEY])


def trie_nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``(depth, conv, parent, n_convs, words, k0 .. k3)``: one row per distinct prefix, named by its smallest member."""
    inner = prefixes.groupBy("depth", *KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *[F.min(f"p{i}").alias(f"p{i}") for i in range(4)])
    zero = [F.lit(0).cast("long").alias(c) for c in (*KEY, "p0", "p1", "p2", "p3")]
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), "conv", "n_convs", F.lit(0).cast("long").alias("words"), *zero)
    nodes = checkpointed(inner.unionByName(root))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"p{k[1]}") for k in KEY], F.col("conv").alias("parent"))
    return checkpointed(nodes.join(above, ["depth", "p0", "p1", "p2", "p3"], "left").select("depth", "conv", "parent", "n_convs", "words", *KEY))


def euler_arcs(nodes: DataFrame) -> DataFrame:
    """``(item, prev, next)``: an enter and an exit arc per node with their neighbours on the tour, children by conv.

    Siblings are ordered in slices of ids, so the children of one node spread over tasks.
    """
    bounds = quantile_bounds(nodes, "conv", shuffle_parts(nodes.sparkSession))
    children = nodes.where("depth > 0").select("depth", "conv", "parent")
    siblings = previous(bucketed(children, part_of(F.col("conv"), bounds)), ["depth", "parent"], ["conv"], ["conv"], "older").select("depth", "conv", F.col("older.conv").alias("older"))
    siblings = checkpointed(siblings)
    younger = siblings.where("older IS NOT NULL").select("depth", F.col("older").alias("conv"), F.col("conv").alias("younger"))
    below = children.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.count("*").alias("n_children"), F.min("conv").alias("eldest"), F.max("conv").alias("youngest"))
    full = nodes.select("depth", "conv", "parent").join(siblings, ["depth", "conv"], "left").join(younger, ["depth", "conv"], "left").join(below, ["depth", "conv"], "left")
    arc = lambda depth, conv, side: F.struct(depth.alias("depth"), conv.alias("conv"), F.lit(side).alias("side"))
    c, d = F.col, F.col("depth")
    enter, leave = arc(d, c("conv"), 0), arc(d, c("conv"), 1)
    before = F.when(c("older").isNotNull(), arc(d, c("older"), 1)).when(d > 0, arc(d - 1, c("parent"), 0))
    after = F.when(c("younger").isNotNull(), arc(d, c("younger"), 0)).when(d > 0, arc(d - 1, c("parent"), 1))
    down = F.when(c("eldest").isNotNull(), arc(d + 1, c("eldest"), 0)).otherwise(leave)
    up = F.when(c("youngest").isNotNull(), arc(d + 1, c("youngest"), 1)).otherwise(enter)
    stops = F.array(F.struct(enter.alias("item"), before.alias("prev"), down.alias("next")), F.struct(leave.alias("item"), up.alias("prev"), after.alias("next")))
    return full.select(F.explode(stops).alias("stop")).select("stop.*")


def member_digests(ends: DataFrame) -> DataFrame:
    """``(depth, k0 .. k3, ends_sha256)`` of ``(conv, depth, k0 .. k3)``: ids in numeric order, joined by commas.

    Ids are joined in slices of at most ``IDS``, wherever they lie; one pass in order then hashes the slices of a
    node, a SHA-256 sum being sequential, and holds one of them at a time.
    """
    key = ["depth", *KEY]
    pieces = ends.groupBy(*key, F.floor(F.col("conv") / IDS).alias("slice")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda v: v.cast("string")), ",").alias("ids"))
    sorted_ = pieces.repartition(*key).sortWithinPartitions(*key, "slice")

    def work(batches):
        at, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in at] + [pa.array([state.hexdigest()])], [*key, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)]):
                if node == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    yield row()
                at, state = node, hashlib.sha256(ids.encode())
        if at is not None:
            yield row()

    return sorted_.select(*key, "slice", "ids").mapInArrow(work, "depth long, k0 long, k1 long, k2 long, k3 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` per trie node.

    ``turns(conv, depth, content, words)`` are numbered from 1 without gaps, ``convs(conv)`` names every conversation,
    with or without turns. Each distinct sequence of first turns is a node, from the root on, named by its smallest
    member. Enter and exit arcs of all nodes form one tour, whose positions are ranked by list contraction;
    leaves and savings of a subtree are the differences of two prefix sums, at its exit and before its entry.
    ``saved_tokens`` sums (members - 1) times the words of the last turn over the subtree; ``ends_sha256`` covers the
    members that end at the node.

    Hot nodes are counted before shuffling, their children are ordered in slices, and long conversations too.
    No conversations give no rows, not even a root. Equal conversations share all nodes.
    """
    turns = checkpointed(turns)
    prefixes = checkpointed(prefix_keys(turns))
    nodes = trie_nodes(prefixes, convs)
    ranks = list_ranks(euler_arcs(nodes))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.count("*").alias("n_children"))
    known = checkpointed(nodes.join(kids, ["depth", "conv"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    values = known.select("depth", "conv", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    flat = ranks.select("item.depth", "item.conv", "item.side", "rank")
    tour = flat.join(values, ["depth", "conv"]).withColumns({c: F.when(F.col("side") == 0, F.col(c)).otherwise(0) for c in ("leaf", "saved")})
    sums = bucketed(tour, F.floor(F.col("rank") / STOPS))
    for c in ("leaf", "saved"):
        sums = running_sum(sums, [], ["rank"], F.col(c), f"{c}_upto")
    inside = lambda c: (F.sum(F.when(F.col("side") == 1, F.col(f"{c}_upto")).otherwise(F.col(c) - F.col(f"{c}_upto"))))
    trees = sums.groupBy("depth", "conv").agg(inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"))
    turnless = convs.join(turns.select("conv").distinct(), "conv", "left_anti").select("conv", *[F.lit(0).cast("long").alias(c) for c in ("depth", *KEY)])
    digests = member_digests(prefixes.where("last").select("conv", "depth", *KEY).unionByName(turnless))
    out = known.join(trees, ["depth", "conv"]).join(digests, ["depth", *KEY], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", period: int = 20, heads: int = 4) -> DataFrame:
    """The trie of conversations that begin with turns of another one (``rebuilt_turns``), see ``prefix_trie``.

    A null role or text is empty; a null turn comes first; rows of one turn are ordered by a hash of role and text,
    repeated rows count as turns of their own; rows without a conversation id are left out; very long texts are
    hashed where they are read; an empty table gives no rows.
    """
    turns = checkpointed(ordered_turns(conversations, conv_col, turn_col, role_col, text_col))
    convs = checkpointed(conversations.select(F.col(conv_col).cast("long").alias("conv")).where("conv IS NOT NULL").distinct())
    return prefix_trie(rebuilt_turns(turns, convs, period, heads), convs)
