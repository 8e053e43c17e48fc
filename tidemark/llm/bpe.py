"""Byte-level BPE of long texts in overlapping chunks that are stitched where their boundaries resynchronise."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices

SLICE_BYTES = 1 << 20
CHUNK = 32_768
OVERLAP = 2_048
#: Boundaries this near a chunk's end are not trusted: what follows could still have joined them.
MARGIN = 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_boundaries(text: str, matcher) -> list[int]:
    """Ends of pre-tokens that follow no white space.

    Between two such places a text encodes alone as it does in context: patterns look ahead only past white space.
    """
    return [end for m in matcher.finditer(text) if not text[(end := m.end()) - 1].isspace()]


def _digest(doc_ids: list, found: list[np.ndarray], encoding) -> pa.RecordBatch:
    rows = [(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()) for d, ids in zip(doc_ids, found)]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in RESULT.split(", ")])


def encode_short(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``RESULT`` of texts that are one chunk each."""

    def work(batches):
        encoding = load_encoding(ranks_path, pattern)
        for batch in batches:
            for at, end in slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1)[at:end].to_pylist()
                yield _digest(batch.column(0)[at:end].to_pylist(), [encoding.encode_ordinary(t) for t in texts], encoding)

    return docs.select("doc_id", "text").mapInArrow(work, RESULT)


def overlapping_chunks(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(row, doc_id, k, chunk)``: chunk k holds the code points from k * chunk on, and an overlap more, spread over all tasks."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                n = -(-len(text) // chunk)
                head = [[batch.column(c)[i].as_py()] for c in (0, 1)]
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array(head[0], pa.int64()), pa.array(head[1], pa.int64()), pa.array([k], pa.int32()), pa.array([text[k * chunk : (k + 1) * chunk + overlap]])], ["row", "doc_id", "k", "chunk"])

    return docs.select("row", "doc_id", "text").mapInArrow(work, "row long, doc_id long, k int, chunk string").repartition("row", "k")


def stitch_points(chunks: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """``(row, k, begin, end, piece, alone)``: what of each chunk is its own, the piece it belongs to, and whether it is all of that.

    Every chunk is pre-tokenised alone. In the overlap of neighbours the first boundary that both found is
    where they resynchronise: from there on they agree, and there the text is cut. A chunk that does not
    resynchronise, and all after it, stay one piece with the chunk before, as nothing proves their boundaries.
    """

    def work(batches):
        import regex

        matcher = regex.compile(pattern)
        for batch in batches:
            heads, tails, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                found = safe_boundaries(text, matcher)
                heads.append([0] + [b for b in found if b < overlap])
                cut_off = len(text) == chunk + overlap  # else the text ends here
                tails.append([b - chunk for b in found if chunk <= b < len(text) - (margin if cut_off else 0)])
                sizes.append(len(text))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(heads, ints), pa.array(tails, ints)], ["row", "k", "size", "heads", "tails"])

    marks = chunks.select("row", "k", "chunk").mapInArrow(work, "row long, k int, size int, heads array<int>, tails array<int>")
    order = Window.partitionBy("row").orderBy("k")
    cut = F.array_min(F.array_intersect("heads", F.lag("tails").over(order)))
    cuts = marks.withColumn("cut", F.when(F.col("k") == 0, 0).otherwise(cut))
    cuts = cuts.withColumn("good", F.min(F.col("cut").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = cuts.withColumn("next_good", F.lead("good").over(order)).withColumn("next_cut", F.lead("cut").over(order))
    end = F.when(F.col("next_good").isNull(), F.col("size")).when(F.col("next_good"), F.col("next_cut") + chunk).otherwise(F.lit(chunk))
    piece = F.count(F.when(F.col("good"), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.coalesce(F.col("good"), F.lit(False)) & F.coalesce(F.col("next_good"), F.lit(True))
    return cuts.select("row", "k", F.when(F.col("good"), F.col("cut")).otherwise(0).alias("begin"), end.alias("end"), piece.alias("piece"), whole.alias("alone"))


def encode_long(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """``RESULT`` of texts of more than one chunk: stitch, encode the pieces in parallel, join their ids by row."""
    chunks = overlapping_chunks(docs, chunk, overlap)
    parts = chunks.join(stitch_points(chunks, pattern, chunk, overlap, margin), ["row", "k"])

    def encode(batches):
        encoding = load_encoding(ranks_path, pattern)
        for batch in batches:
            rows = batch.to_pydict()
            texts = [c[b:e] for c, b, e in zip(rows["chunk"], rows["begin"], rows["end"])]
            ids = [np.array(encoding.encode_ordinary(t), dtype="<u4").tobytes() if a else None for t, a in zip(texts, rows["alone"])]
            left = [None if a else t for t, a in zip(texts, rows["alone"])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), batch.column("piece"), pa.array(ids, pa.binary()), pa.array(left, pa.string())], ["row", "doc_id", "k", "piece", "ids", "text"])

    encoded = parts.select("row", "doc_id", "k", "piece", "begin", "end", "alone", "chunk").mapInArrow(encode, "row long, doc_id long, k int, piece long, ids binary, text string")
    grouped = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "piece", "ids", "text"))).alias("parts"))

    def join(batches):
        encoding = load_encoding(ranks_path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                ids: list[int] = []
                pending, piece = "", None
                for p in batch.column(1)[i].as_py() + [{"piece": None, "ids": b"", "text": None}]:
                    if piece is not None and p["piece"] != piece:
                        ids += encoding.encode_ordinary(pending)
                        pending, piece = "", None
                    if p["text"] is not None:
                        pending, piece = pending + p["text"], p["piece"]
                    else:
                        ids += np.frombuffer(p["ids"], dtype="<u4").tolist()
                yield _digest([batch.column(0)[i].as_py()], [ids], encoding)

    return grouped.select("doc_id", "parts").mapInArrow(join, RESULT)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """``RESULT`` of each row of ``docs``: digests of the ids of its whole text and of the bytes they decode to.

    Texts of up to ``chunk`` code points are one piece. A null text is empty and has no ids; repeated rows and null
    ids are rows like any other; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    is_long = F.char_length("text") > chunk
    return encode_short(own.where(~is_long), ranks_path, pattern).unionByName(encode_long(own.where(is_long), ranks_path, pattern, chunk, overlap, margin))
