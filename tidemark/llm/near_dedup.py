"""Near duplicates by circulant MinHash, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, U64, checkpointed, mix64, row_key, slices
from tidemark.llm.components import components
from tidemark.llm.wordhash import shingle_set, word_hashes

#: Texts of a batch are worked on in slices of so many bytes, which bounds the memory of a task.
SLICE_BYTES = 1 << 20
UNIVERSE_BITS = 20
#: Shingles of one side of a block of comparisons: some 8 MB of hashes.
BLOCK_SHINGLES = 1 << 20


class CirculantMinHash:
    """All signature coordinates from two permutations.

    The first permutation scatters a shingle over ``2**UNIVERSE_BITS`` places, the second ranks places;
    coordinate k reads the second shifted by k round the circle. The coordinates of one shingle therefore lie
    side by side, and a signature is one gather of short rows and one minimum. Bands join ``rows``
    coordinates each: texts of similarity s share a band with probability 1 - (1 - s**rows)**bands, which is
    1 - 1e-5 at 0.85 for 24 bands of 6.
    """

    def __init__(self, bands: int = 24, rows: int = 6, seed: int = 1) -> None:
        self.bands, self.rows, self.size, self.seed = bands, rows, bands * rows, seed
        rng = np.random.default_rng(seed)
        second = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        self.circle = sliding_window_view(np.concatenate([second, second[: self.size]]), self.size)
        self.salt = U64(rng.integers(1, 1 << 62))
        self.weights = rng.integers(1, 1 << 62, (bands, rows), dtype=np.uint64) | U64(1)

    def __reduce__(self):  # tasks make the tables anew instead of receiving them
        return CirculantMinHash, (self.bands, self.rows, self.seed)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        place = (mix64(shingles ^ self.salt) >> U64(64 - UNIVERSE_BITS)).astype(np.int64)
        out = np.full(self.size, np.iinfo(np.uint32).max, dtype=np.uint32)
        for i in range(0, len(place), 2048):
            np.minimum(out, self.circle[place[i : i + 2048]].min(axis=0), out=out)
        return out

    def bucket_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band; the band's number is part of it."""
        parts = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        return mix64((parts * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def shingle_marks(docs: DataFrame, id_col: str, text_col: str, width: int, hasher: CirculantMinHash) -> DataFrame:
    """``(node, doc_id, n_shingles, set_a, set_b, buckets)`` of each row; set_a and set_b are a 128-bit key of the set, ``node`` is the id or stands for it."""

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, end in slices(texts, SLICE_BYTES):
                hashes, bounds = word_hashes([None if t is None else t.encode() for t in texts[at:end].to_pylist()], lower=True)
                counts, first, second, keys = [], [], [], []
                for i in range(end - at):
                    found = shingle_set(hashes[bounds[i] : bounds[i + 1]], width)
                    counts.append(len(found))
                    first.append(np.sum(mix64(found), dtype=np.uint64))
                    second.append(np.sum(mix64(found ^ U64(0xD1B54A32D192ED03)), dtype=np.uint64))
                    keys.append(hasher.bucket_keys(found) if len(found) else np.zeros(0, dtype=np.uint64))
                flat = np.concatenate(keys).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32()), pa.array(flat))
                longs = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids[at:end], batch.column(2)[at:end], pa.array(counts, pa.int64()), longs(first), longs(second), lists], ["node", "doc_id", "n_shingles", "set_a", "set_b", "buckets"])

    cols = docs.select(row_key(id_col, text_col).alias("node"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return cols.mapInArrow(work, "node long, doc_id long, n_shingles long, set_a long, set_b long, buckets array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, shingles)``: the whole shingle set of each row, as 64-bit hashes."""

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, end in slices(texts, SLICE_BYTES):
                hashes, bounds = word_hashes([None if t is None else t.encode() for t in texts[at:end].to_pylist()], lower=True)
                sets = [shingle_set(hashes[bounds[i] : bounds[i + 1]], width) for i in range(end - at)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids[at:end], lists], ["node", "shingles"])

    cols = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(work, "node long, shingles array<long>")


def _at_least(shared, one, two, percent: int):
    return 100 * shared >= percent * (one + two - shared)


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole shingle sets have 100 * intersection >= ``percent`` * union."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = F.array_size(F.array_intersect("of_a", "of_b"))
    checked = both.select("a", "b", F.array_size("of_a").alias("n_a"), F.array_size("of_b").alias("n_b"), shared.alias("shared"))
    return checked.where(_at_least(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()


def joining_links(nodes: list[int], parts: list[int], sets: list[np.ndarray], asked: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links from asked rows to all others that join different parts, as few as join them; exact, by products of 0/1 matrices."""
    query = [i for i, q in enumerate(asked) if q]
    base = [i for i, q in enumerate(asked) if not q]
    if not query or not base:
        return []
    names, places = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    line = np.zeros(len(sets), dtype=np.int64)
    line[query], line[base] = np.arange(len(query)), np.arange(len(base))
    is_query = np.array(asked)[row]
    shared = np.zeros((len(query), len(base)), dtype=np.float32)
    step = max(256, (4 << 20) // (len(query) + len(base)))
    for at in range(0, len(names), step):
        inside = (places >= at) & (places < at + step)
        one, two = np.zeros((len(query), step), dtype=np.float32), np.zeros((len(base), step), dtype=np.float32)
        one[line[row[inside & is_query]], places[inside & is_query] - at] = 1
        two[line[row[inside & ~is_query]], places[inside & ~is_query] - at] = 1
        shared += one @ two.T
    size = np.array([len(s) for s in sets], dtype=np.int64)
    count = shared.astype(np.int64)
    part = np.array(parts)
    linked = _at_least(count, size[query][:, None], size[base][None, :], percent) & (part[query][:, None] != part[base][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    out = []
    for q, b in zip(*np.nonzero(linked)):
        x, y = find(parts[query[q]]), find(parts[base[b]])
        if x != y:
            root[x] = y
            out.append((nodes[query[q]], nodes[base[b]]))
    return out


def links_across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that join different components inside a bucket of ``rows(bucket, node, n, component)``.

    The members outside a bucket's largest component are compared with all its members, in blocks of bounded
    shingles each, so that a crowded bucket spreads over tasks and no pair is ever a row.
    """
    by_part = rows.groupBy("bucket", "component").agg(F.count("*").alias("members"), F.sum("n").alias("held"))
    plan = by_part.groupBy("bucket").agg(F.max_by("component", F.struct("members", -F.col("component"))).alias("main"), F.sum("held").alias("held"), F.max_by("held", F.struct("members", -F.col("component"))).alias("main_held"), F.count("*").alias("parts"))
    plan = plan.where("parts > 1").select("bucket", "main", F.ceil((F.col("held") - F.col("main_held")) / BLOCK_SHINGLES).alias("q_blocks"), F.ceil(F.col("held") / BLOCK_SHINGLES).alias("b_blocks"))
    known = rows.join(plan, "bucket")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    as_base = known.select("bucket", "node", "component", F.lit(False).alias("asked"), own("b_blocks").alias("b_block"), F.explode(upto("q_blocks")).alias("q_block"))
    as_query = known.where("component <> main").select("bucket", "node", "component", F.lit(True).alias("asked"), F.explode(upto("b_blocks")).alias("b_block"), own("q_blocks").alias("q_block"))
    dealt = as_base.unionByName(as_query).join(sets, "node").repartition("bucket", "q_block", "b_block").sortWithinPartitions("bucket", "q_block", "b_block")

    def work(batches):
        key, held = None, []

        def settle():
            found = joining_links(*map(list, zip(*held)), percent) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            nodes, parts, asked = (batch.column(k).to_pylist() for k in (3, 4, 5))
            lists = batch.column(6)
            flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, now in enumerate(keys):
                if now != key:
                    if held:
                        yield settle()
                    key = now
                held.append((nodes[i], parts[i], flat[edge[i] : edge[i + 1]].copy(), asked[i]))
        if held:
            yield settle()

    return dealt.select("bucket", "q_block", "b_block", "node", "component", "asked", "shingles").mapInArrow(work, "a long, b long").distinct()


def linked_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``(node, doc_id, n_shingles, component, component_id)`` of each row: its own node, the node its component is named by, and its smallest id.

    A row without an id has a node that stands for its text (``row_key``). Texts with equal sets are first one node (their smallest), so copies in any number never meet in a
    bucket. In every bucket all nodes are compared with one of them, the one that shares buckets with most
    others and so lies at the centre: rows grow with the members, not with their pairs, and the links found
    join most buckets into one component. In buckets that still hold several components, the nodes outside the
    largest are compared with all members in blocks (``links_across``), so no link between different texts that
    any band found is lost. Every comparison is exact, on whole sets.
    """
    marks = checkpointed(shingle_marks(docs, id_col, text_col, width, CirculantMinHash(bands, rows)))
    with_words = marks.where("n_shingles > 0")
    classes = with_words.groupBy("set_a", "set_b").agg(F.min("node").alias("node"), F.first("n_shingles").cast("int").alias("n"), F.first("buckets").alias("buckets"))
    members = classes.select("node", "n", F.explode("buckets").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowded = checkpointed(members.join(sizes, "bucket"))
    company = crowded.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = crowded.join(company, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"), "n")).alias("p")).select("bucket", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pivot_n"))
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    stars = checkpointed(crowded.join(pivots, "bucket").where((F.col("node") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())

    wanted = crowded.select("node").distinct()
    texts = docs.select(row_key(id_col, text_col).alias("node"), F.col(text_col).cast("string").alias("text")).join(wanted, "node", "left_semi")
    sets = checkpointed(shingle_sets(texts, "node", "text", width))
    linked = checkpointed(similar_pairs(stars, sets, percent))
    found = components(linked)
    open_rows = checkpointed(crowded.where("size > 2").select("bucket", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    more = checkpointed(links_across(open_rows, sets, percent))
    whole = components(linked.unionByName(more))

    named = classes.select("set_a", "set_b", "node").join(whole, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("found"))
    rows_out = marks.select("node", "doc_id", "n_shingles", "set_a", "set_b").withColumnRenamed("node", "own").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("own"))
    out = rows_out.select(F.col("own").alias("node"), "doc_id", "n_shingles", component.alias("component"))
    if marks.where(F.col("doc_id").isNull() | (F.col("node") >= NO_ID)).isEmpty():
        return out.withColumn("component_id", F.col("component"))
    smallest = out.where("doc_id IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(smallest, "component", "left").select("node", "doc_id", "n_shingles", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, bands: int = 24, rows: int = 6) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row of ``docs``.

    Texts are linked when 100 * |intersection| >= ``percent`` * |union| of their shingle sets;
    ``component_id`` is the smallest id reachable and ``kept`` marks the rows that carry it. How: ``linked_rows``.

    Null or wordless texts have no shingles and link with nothing. Rows with a null id link by their text, to each
    other and to rows with one, and two texts may meet through them; they lend no id to a component, so without any
    other id in it ``component_id`` is null and they are kept. Rows that repeat an id are each judged by their own
    text. An empty table gives an empty result.
    """
    found = linked_rows(docs, id_col, text_col, width, percent, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, bands: int = 24, rows: int = 6) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns: the one with the smallest id.

    In a component without any id the row stays whose ``row_key`` is smallest. Rows that repeat the id and the text
    of one that stays go; with another text they stay, if that text is kept. Null and empty texts are kept, once an id,
    those without an id once in all. An empty table gives an empty result.
    """
    found = linked_rows(docs, id_col, text_col, width, percent, bands, rows)
    stays = F.col("node") == F.coalesce("component_id", "component")
    kept = found.where(stays).select(F.struct("node").alias("__kept")).distinct()
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.struct(row_key(id_col, text_col).alias("node")).alias("__kept"))
    same = F.sha2(F.col(f"row.{text_col}").cast("binary"), 256).alias("__text")
    return own.join(kept, "__kept", "left_semi").groupBy("__kept", same).agg(F.first("row").alias("row")).select("row.*")
