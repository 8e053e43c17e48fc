"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import part_of, quantile_bounds, shuffle_parts

PRIME = (1 << 31) - 1
#: Two independent bases modulo the same prime give 62 bits.
BASES = (1_103_515_245, 1_664_525_171)
RUNG_HEX = 6
#: Spreads both halves of a span hash over the bits that a rung keeps; the halves of a single code point are equal.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


class Powers:
    """Powers of the bases and of their inverses, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = [np.ones(1, dtype=np.uint64)] * len(BASES)

    def upto(self, n: int) -> "Powers":
        if len(self.up[0]) < n:
            size = 1 << n.bit_length()
            self.up = [_powers(b, size) for b in BASES]
            self.down = [_powers(pow(b, -1, PRIME), size) for b in BASES]
        return self


class PrefixHashes:
    """Prefix arrays of one text: entry i is the hash of its first i code points.

    ``span`` answers any span in constant time; ``common`` finds the longest common extension of two
    positions by binary search over spans.
    """

    def __init__(self, code: np.ndarray, powers: Powers) -> None:
        self.n, self.powers = len(code), powers.upto(len(code) + 1)
        values = code.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up in powers.up:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(values * up[: self.n] % np.uint64(PRIME), out=sums[1:])
            self.sums.append(sums % np.uint64(PRIME))

    @classmethod
    def of(cls, text: str, powers: Powers) -> "PrefixHashes":
        return cls(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), powers)

    def joined(self, keep: int, other: "PrefixHashes", take: int) -> "PrefixHashes":
        """Prefix arrays of this text's first ``keep`` code points followed by the other's first ``take``; nothing is hashed again."""
        new = object.__new__(PrefixHashes)
        new.n, new.powers = keep + take, self.powers.upto(keep + take + 1)
        p = np.uint64(PRIME)
        new.sums = [np.concatenate([a[: keep + 1], (a[keep] + b[1 : take + 1] * up[keep]) % p]) for a, b, up in zip(self.sums, other.sums, new.powers.up)]
        return new

    def span(self, begin, end) -> np.ndarray:
        """62-bit hash of the code points from ``begin`` up to ``end``; takes arrays."""
        p = np.uint64(PRIME)
        high, low = ((s[end] + p - s[begin]) % p * down[begin] % p for s, down in zip(self.sums, self.powers.down))
        return high << np.uint64(31) | low

    def common(self, at: int, other: "PrefixHashes", there: int) -> int:
        """Length of the longest common extension of position ``at`` here and ``there`` in the other text."""
        lo, hi = 0, min(self.n - at, other.n - there)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(at, at + mid) == other.span(there, there + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def rungs(n: int) -> np.ndarray:
    """Lengths up to n at which a fingerprint keeps span hashes: about four for each doubling, the same for every text."""
    steps = np.unique(np.rint(2.0 ** (np.arange(0, 4 * max(1, n.bit_length()) + 4) / 4)).astype(np.int64))
    return steps[steps <= n]


def fingerprint(hashes: PrefixHashes) -> str:
    """Length, hash of the whole, and hashes of the first and last ``rungs`` code points, in hex."""
    n = hashes.n
    at = rungs(n)
    heads = hashes.span(np.zeros(len(at), dtype=np.int64), at)
    tails = hashes.span(n - at, np.full(len(at), n))
    kept = np.uint64(64 - 4 * RUNG_HEX)
    hexed = lambda x: "".join(f"{v:0{RUNG_HEX}x}" for v in (x * SPREAD >> kept).tolist())
    return f"{n:x}-{int(hashes.span(0, n)):016x}-{hexed(heads)}-{hexed(tails)}"


def likeness(one: str, two: str) -> float:
    """Share of the longer text that the two have in common at their ends, from fingerprints alone, 0 to 1.

    The longest common prefix and suffix are located by binary search over the rungs, so each is a lower
    bound within a fifth; together they are no longer than the shorter text. Equal fingerprints give 1.
    """
    if one == two:
        return 1.0
    (n, _, heads, tails), (m, _, other_heads, other_tails) = one.split("-"), two.split("-")
    shortest, longest = sorted((int(n, 16), int(m, 16)))
    at = rungs(shortest).tolist()
    shared = 0
    for a, b in ((heads, other_heads), (tails, other_tails)):
        lo, hi = 0, len(at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[(mid - 1) * RUNG_HEX : mid * RUNG_HEX] == b[(mid - 1) * RUNG_HEX : mid * RUNG_HEX]:
                lo = mid
            else:
                hi = mid - 1
        shared += at[lo - 1] if lo else 0
    return min(shared, shortest) / longest if longest else 0.0


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCHEMA``: fingerprints of every whole text and of its edited text, and how alike they are.

    The order is descending id, then ascending text; a null text is empty and null ids come last. The edited
    text has its last floor(n / 2) code points replaced by the first as many (or all) of the next row; the
    last row's next is the first, so a single row follows itself. An empty table gives an empty result.

    Rows are dealt by id bounds and sorted within a part: one shuffle of the texts. Only the first text of each
    part is copied, to the end of the part before it. A task streams its part and holds two texts at a time.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"))
    bounds = quantile_bounds(own.select(F.col("doc_id").alias("key")), "key", shuffle_parts(spark))
    parts = len(bounds) + 1
    own = own.withColumn("part", part_of(F.col("key"), bounds))
    # one row a part reaches the driver
    heads = sorted((r["part"], r["head"]) for r in own.groupBy("part").agg(F.max("key").alias("head")).collect())
    before = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    own = own.withColumn("last", F.lit(False))
    if heads:
        to = F.element_at(F.create_map(*[F.lit(v) for item in before.items() for v in item]), F.col("key"))
        guests = own.where(F.col("key").isin(list(before))).select("key", "text").groupBy("key").agg(F.min("text").alias("text"))
        own = own.unionByName(guests.select(F.lit(None).cast("long").alias("doc_id"), "text", "key", to.cast("int").alias("part"), F.lit(True).alias("last")))
    ordered = own.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "last", F.col("key").desc(), "text")

    def work(batches):
        powers = Powers()
        out: list[tuple] = []
        held = None

        def flush():
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, text, guest = (batch.column(k)[row].as_py() for k in (0, 1, 2))
                hashes = PrefixHashes.of(text, powers)
                print_now = fingerprint(hashes)
                if held is not None:
                    held_id, held_text, held_hashes, held_print = held
                    half = held_hashes.n // 2
                    keep, take = held_hashes.n - half, min(half, hashes.n)
                    edited = held_text[:keep] + text[:take]
                    edited_print = fingerprint(held_hashes.joined(keep, hashes, take))
                    out.append((held_id, held_hashes.n, hashlib.sha256(edited.encode()).hexdigest(), held_print, edited_print, likeness(held_print, edited_print), likeness(held_print, print_now)))
                    if len(out) >= 2000:
                        yield flush()
                held = None if guest else (doc_id, text, hashes, print_now)
        if out:
            yield flush()

    return ordered.select("doc_id", "text", "last").mapInArrow(work, SCHEMA)
