"""Token-id files: ids in fixed-width bits, in blocks with document offsets."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import part_of, quantile_bounds, shuffle_parts, slices
from tidemark.llm.tokens import encoder_of

SLICE_BYTES = 6 << 20
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "part int, block int, before long, n_ids long, bits int, payload binary, doc_ids array<long>, doc_starts array<long>"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side in ``bits`` bits each, lowest bit first."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes
        return cells[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(cells, axis=1, bitorder="little", count=bits), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, begin: int, count: int) -> np.ndarray:
    """``count`` ids from place ``begin`` on, without touching the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=count, offset=begin * bits // 8).astype("<u4")
    first, last = begin * bits // 8, ((begin + count) * bits + 7) // 8
    raw = np.frombuffer(payload[first:last] + b"\0" * 8, dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(raw.view(), shape=(len(raw) - 7, 8), strides=(1, 1))
    at = np.arange(begin, begin + count, dtype=np.int64) * bits - first * 8
    found = np.ascontiguousarray(words[at >> 3]).view("<u8").ravel()
    return ((found >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def encoded_texts(docs: DataFrame, tokenizer_path: str, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """``(doc_id, ids)``: the ids of every text and the end id, in the fewest whole bytes, encoded where the text is read."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = carrier(vocabulary)

    def work(batches):
        encoder = encoder_of(tokenizer_path, "")
        for batch in batches:
            for at, upto in slices(batch.column(1), SLICE_BYTES):
                found, bounds = encoder.encode(batch.column(1)[at:upto])
                ids = np.insert(found.astype(kind), bounds[1:], end_id)
                offsets = (bounds + np.arange(len(bounds))) * ids.itemsize
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), upto - at, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:upto], column.cast(pa.binary())], ["doc_id", "ids"])

    return own.mapInArrow(work, "doc_id long, ids binary")


def carrier(vocabulary: int) -> str:
    """The smallest whole-byte type that holds every id of a vocabulary, for ids on their way to the files."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def token_blocks(docs: DataFrame, tokenizer_path: str, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Blocks of packed ids in ascending id order (null ids first, ties by their ids); a null text is its end id alone.

    Texts are encoded where they are read; their ids, in whole bytes, are dealt by document id bounds and sorted
    within parts in the one shuffle. Part and block number order the blocks of all parts. A block holds whole
    documents; the offsets say where each begins. Rows with equal ids, or none, share a part.
    """
    own = encoded_texts(docs, tokenizer_path, vocabulary, id_col, text_col, end_id)
    bounds = quantile_bounds(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", shuffle_parts(docs.sparkSession))
    dealt = own.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part_of(F.col("doc_id"), bounds)))
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    bits, kind = bits_for(vocabulary), carrier(vocabulary)

    def work(batches):
        part, block, before, total = 0, 0, 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal block, before, total
            starts = np.concatenate(([0], np.cumsum([len(x) for _, x in held])))
            payload = pack_bits(np.concatenate([x for _, x in held]), bits)
            row = [[part], [block], [before], [total], [bits], [payload], [[d for d, _ in held]], [starts[:-1].tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            block, before, total = block + 1, before + total, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, ids, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                held.append((doc_id, np.frombuffer(ids.as_buffer(), dtype=kind)))
                total += len(held[-1][1])
                if total >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return ordered.select("doc_id", "ids", "part").mapInArrow(work, BLOCK_SCHEMA)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, **columns) -> str:
    """Writes the blocks as Parquet files, one row a block, through Spark's committer; gives the folder back."""
    token_blocks(docs, tokenizer_path, vocabulary, **columns).write.mode("overwrite").option("compression", "none").parquet(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the files; start counts the ids of all before it.

    Blocks are read where they lie. The ids of all earlier parts come from a table of one row a part, at most as many
    as a shuffle has partitions, which is broadcast: joined by a shuffle, every block would move.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))

    def work(batches):
        for batch in batches:
            before, n_ids, bits, payload, doc_ids, starts = (batch.column(k) for k in range(6))
            for row in range(batch.num_rows):
                at = np.array(starts[row].as_py(), dtype=np.int64)
                ends = np.append(at[1:], n_ids[row].as_py())
                ids = unpack_bits(payload[row].as_py(), bits[row].as_py(), 0, n_ids[row].as_py())
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at, ends)]
                yield pa.RecordBatch.from_arrays([doc_ids[row].values, pa.array(at + before[row].as_py()), pa.array(ends - at), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(F.broadcast(earlier), "part").select((F.col("before") + F.col("earlier")).alias("before"), "n_ids", "bits", "payload", "doc_ids", "doc_starts")
    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
