"""Best-fit packing by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, slices
from tidemark.llm.tokens import encoder_of

CAPACITY = 1024
SLICE_BYTES = 4 << 20
#: Pieces of one shard at most about: all shards hold as many whatever the input, so a task's memory is fixed.
SHARD_PIECES = 16_384
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 12
POPULATION = 5


class Packing:
    """One individual: the bin of every item and the fill of every bin."""

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray) -> None:
        names, self.bin_of = np.unique(bin_of, return_inverse=True)
        self.fills = np.bincount(self.bin_of, weights=sizes, minlength=len(names)).astype(np.int64)

    def rank(self) -> tuple[int, int]:
        """Fewer bins first, then fuller bins (a sum of squares prefers full bins beside an empty one)."""
        return len(self.fills), -int((self.fills * self.fills).sum())


def best_fit(sizes: list[int], order: list[int], fills: list[int], capacity: int) -> list[int]:
    """The bin of each item of ``order``, placed in turn where it leaves the least room; ``fills`` grows.

    A bit for each amount of free room that some bin has makes the search one shift and one lowest bit.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, fill in enumerate(fills):
        room = capacity - fill
        free[room].append(b)
        mask |= 1 << room
    out = []
    for item in order:
        size = sizes[item]
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            fills[b] += size
        else:
            room, b = capacity, len(fills)
            fills.append(size)
        room -= size
        free[room].append(b)
        mask |= 1 << room
        out.append(b)
    return out


def decreasing(sizes: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> Packing:
    """Best fit in decreasing order, the order blurred by ``noise`` tokens."""
    order = np.argsort(-(sizes + rng.random(len(sizes)) * noise), kind="stable")
    placed = np.empty(len(sizes), dtype=np.int64)
    placed[order] = best_fit(sizes.tolist(), order.tolist(), [], capacity)
    return Packing(placed, sizes)


def exact_fill(sizes: np.ndarray, capacity: int) -> Packing:
    """Bins from the largest item left, closed exactly where one or two items do so.

    Sizes in stock are bits of two integers, one the mirror of the other, so the sizes that have a partner for a
    given room are one shift and one AND. Of several pairs the most even one goes, which keeps the extremes for
    later; without any the largest item that fits goes, and the search repeats.
    """
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for item, size in enumerate(sizes.tolist()):
        stock[size].append(item)
    held = sum(1 << size for size in range(1, capacity + 1) if stock[size])
    mirror = sum(1 << (capacity - size) for size in range(1, capacity + 1) if stock[size])
    placed, b = np.empty(len(sizes), dtype=np.int64), 0
    while held:
        room, take = capacity, [held.bit_length() - 1]
        while take:
            for size in take:
                placed[stock[size].pop()] = b
                room -= size
                if not stock[size]:
                    held ^= 1 << size
                    mirror ^= 1 << (capacity - size)
            fits = held & ((1 << (room + 1)) - 1)
            if not fits or not room:
                take = []
            elif fits >> room & 1:
                take = [room]
            else:
                pairs = fits & (mirror >> (capacity - room))
                half = room // 2
                if room % 2 == 0 and len(stock[half]) < 2:
                    pairs &= ~(1 << half)
                upper = pairs >> (room - half)
                even = room - half + (upper & -upper).bit_length() - 1
                take = [even, room - even] if upper else [fits.bit_length() - 1]
        b += 1
    return Packing(placed, sizes)


def crossover(taker: Packing, giver: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of the giver enter the taker.

    The taker's bins that share an item with them are emptied, which removes the duplicates; their other items
    are displaced and go back by best fit, largest first.
    """
    full = np.flatnonzero(giver.fills >= np.quantile(giver.fills, 0.25))
    chosen = np.zeros(len(giver.fills), dtype=bool)
    chosen[full[rng.random(len(full)) < rng.uniform(0.1, 0.5)]] = True
    injected = chosen[giver.bin_of]
    emptied = np.zeros(len(taker.fills), dtype=bool)
    emptied[taker.bin_of[injected]] = True
    # a few of the emptiest bins give way as well, or their gaps would stay
    emptied |= (taker.fills < capacity) & (rng.random(len(taker.fills)) < 0.3)
    displaced = np.flatnonzero(emptied[taker.bin_of] & ~injected)
    bin_of = np.where(injected, giver.bin_of + len(taker.fills), taker.bin_of)
    bin_of[displaced] = -1
    names, dense = np.unique(bin_of, return_inverse=True)
    fills = np.bincount(dense, weights=sizes, minlength=len(names)).astype(np.int64)
    if len(displaced):  # name -1 is place 0
        fills, dense = fills[1:], dense - 1
    order = displaced[np.argsort(-sizes[displaced], kind="stable")]
    dense[order] = best_fit(sizes.tolist(), order.tolist(), fills.tolist(), capacity)
    return Packing(dense, sizes)


def evolve(sizes: np.ndarray, own: np.ndarray | None, guest: np.ndarray | None, capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """The best packing an island finds in some generations, from its own elite and a migrated one if given.

    The first population holds one filled exactly, one by best fit in decreasing order, and blurred ones of that.
    An island stops at the bound that no packing passes.
    """
    rng = np.random.default_rng(seed)
    people = [Packing(p, sizes) for p in (own, guest) if p is not None]
    if not people:
        people = [exact_fill(sizes, capacity), decreasing(sizes, capacity, 0.0, rng)]
    people += [decreasing(sizes, capacity, rng.uniform(8, 256), rng) for _ in range(population - len(people))]
    bound = -(-int(sizes.sum()) // capacity)
    people.sort(key=Packing.rank)
    for _ in range(generations):
        if len(people[0].fills) == bound:
            break
        one, two = rng.choice(len(people), 2, replace=False)
        child = crossover(people[min(one, two)], people[max(one, two)], sizes, capacity, rng)
        people = sorted([*people, child], key=Packing.rank)[:population]
    return people[0].bin_of


def pack(pieces: DataFrame, row_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``(row_col, sequence_id, offset)`` for every row of ``pieces``; sizes are 1 to ``capacity``, rows are unique.

    Shards of about ``SHARD_PIECES`` rows by hashed row number are independent problems. Every shard is evolved
    on ``ISLANDS`` islands, each its own task; after each epoch an island's elite migrates to the next. The
    best island of a shard wins. Pieces of the whole capacity fill a sequence alone and enter no shard.
    """
    whole = pieces.where(F.col(size_col) == capacity).select(row_col, (2 * F.col(row_col) + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col(size_col) < capacity).select(F.col(row_col).alias("row"), F.col(size_col).cast("int").alias("size"))
    shards = max(1, -(-rest.count() // SHARD_PIECES))
    state = rest.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "size").select(
        "*", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.lit(-1).alias("bin"), F.lit(False).alias("guest"))

    def epoch(number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("row", kind="stable")
            own, guest = rows[~rows.guest], rows[rows.guest]
            first = own.bin.iloc[0] < 0
            sizes = own["size"].to_numpy(np.int64)
            bins = evolve(sizes, None if first else own.bin.to_numpy(), None if first else guest.bin.to_numpy(), capacity, hash((number, int(own.shard.iloc[0]), int(own.island.iloc[0]))) & 0x7FFFFFFF)
            return pd.DataFrame({"shard": own.shard, "row": own.row, "size": own["size"], "island": own.island, "bin": bins.astype(np.int32)})

        return run

    for number in range(EPOCHS):
        found = state.groupBy("shard", "island").applyInPandas(epoch(number), "shard int, row long, size int, island int, bin int")
        moves = F.explode(F.array(F.struct("island", F.lit(False).alias("guest")), F.struct(((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(True).alias("guest")))).alias("to")
        state = found.select("shard", "row", "size", "bin", moves).select("shard", "row", "size", "bin", "to.island", "to.guest")

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        best = min((Packing(g.bin.to_numpy(), g["size"].to_numpy(np.int64)).rank(), k) for k, g in rows.groupby("island"))[1]
        own = rows[rows.island == best].sort_values(["bin", "row"])
        start = own["size"].cumsum() - own["size"]
        offset = start - start.groupby(own.bin).transform("first")
        return pd.DataFrame({"row": own.row, "sequence_id": (own.shard.astype("int64") * (4 * SHARD_PIECES) + own.bin) * 2, "offset": offset.astype("int64")})

    placed = found.groupBy("shard").applyInPandas(settle, "row long, sequence_id long, offset long")
    return whole.unionByName(placed.withColumnRenamed("row", row_col))


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the token ids of every row and an end id, cut into pieces.

    Only rows of more than ``capacity`` ids are cut: into whole pieces, of which the first may be shorter.
    """

    def work(batches):
        encoder = encoder_of(tokenizer_path, " ")
        end_bytes = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at, end in slices(batch.column(1), SLICE_BYTES):
                rows: list[tuple] = []
                found, bounds = encoder.encode(batch.column(1)[at:end])
                for i, doc_id in enumerate(batch.column(0)[at:end].to_pylist()):
                    raw = found[bounds[i] : bounds[i + 1]].tobytes() + end_bytes
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return cols.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of every row.

    Texts are encoded once; only the small table of pieces is written to the checkpoint folder and packed.
    A null or empty text is its end id alone. Rows that repeat an id, or have none, are pieces of their own.
    An empty table gives an empty result.
    """
    pieces = checkpointed(token_pieces(docs, id_col, text_col, tokenizer_path, end_id, capacity).withColumn("row", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces, "row", "length", capacity), "row").drop("row")
