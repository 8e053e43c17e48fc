"""Ranked lexical search: an impact-ordered index, read with no random access (NRA)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_folder, slices
from tidemark.llm.wordhash import word_spans

#: The constants of a score.
UNIT, TF_SCALE, NORM_SCALE, SLOPE = 1_000_000_000, 1000, 8, 75
#: Bytes of texts in a shard, items searched together, entries of a list read first.
SHARD_BYTES, BLOCK_ITEMS, FIRST_READ = 2 << 20, 1000, 64
SHARD_SCHEMA = "n_docs_all long, n_terms_all long, terms binary, starts binary, docs binary, gains binary, ids array<long>"
#: Bytes that are part of no term: ASCII other than letters and digits.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length factor of documents of ``n`` terms; in exact integers where 64 bits do not hold the product."""
    if len(n) and int(n.max()) * SLOPE * n_docs >= 1 << 63:
        return np.array([100 - SLOPE + SLOPE * int(v) * n_docs // n_terms for v in n], dtype=np.int64)
    return 100 - SLOPE + SLOPE * n.astype(np.int64) * n_docs // max(1, n_terms)


def term_counts(texts: list[bytes | None]) -> np.ndarray:
    """The number of terms of each text."""
    raw = OUTSIDE[np.frombuffer(b"\n" + b"\n".join(t or b"" for t in texts), dtype=np.uint8)]
    begin = np.flatnonzero(raw[:-1] & ~raw[1:]) + 1
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return np.diff(np.searchsorted(begin, np.concatenate(([0], ends)), "right"))


def shard_of(texts: list[bytes | None], n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted term hashes, where the list of each begins, and all lists: documents and gains, greatest gain first.

    A gain is what one unit of a term's weight adds to the score of the document. Equal gains stand by document.
    """
    _, _, _, hashes, bounds = word_spans(texts, lower=True, outside=OUTSIDE)
    n = np.diff(bounds)
    terms, term_of = np.unique(hashes, return_inverse=True)
    pairs, tf = np.unique(term_of.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), n), return_counts=True)
    term, doc = pairs // max(1, len(texts)), pairs % max(1, len(texts))
    gain = (UNIT * tf) // (TF_SCALE * tf + NORM_SCALE * norms(n, n_docs, n_terms)[doc])
    order = np.lexsort((doc, -gain, term))
    return terms, np.searchsorted(term, np.arange(len(terms) + 1)), doc[order].astype("<u4"), gain[order].astype("<u4")


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes an impact-ordered index, one row a shard of some ``SHARD_BYTES`` of texts; gives the folder back.

    A first pass counts the documents with a term and all terms; a second one, where the texts are read and without
    a shuffle, sorts each shard's lists. Terms are named by 64-bit hashes; two terms of a shard that share one would
    count as one, which has a chance of about 1e-9 at 200 000 terms. Null and empty texts have no term. Every row
    is a document of its own, with the ids it has, null included.
    """
    text = F.col(text_col).cast("string")

    def count(batches):
        for batch in batches:
            for at, upto in slices(batch.column(0), SHARD_BYTES):
                n = term_counts(batch.column(0)[at:upto].cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([int(np.count_nonzero(n))]), pa.array([int(n.sum())])], ["docs", "terms"])

    totals = docs.select(text.alias("text")).mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (v or 0 for v in totals)
    names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]

    def work(batches):
        for batch in batches:
            for at, upto in slices(batch.column(1), SHARD_BYTES):
                column = batch.column(1)[at:upto].cast(pa.binary())
                parts = shard_of(column.to_pylist(), n_docs, n_terms)
                blobs = [pa.array([p.tobytes()], pa.binary()) for p in (parts[0], parts[1].astype("<u4"), *parts[2:])]
                yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms]), *blobs, pa.array([batch.column(0)[at:upto].to_pylist()], pa.list_(pa.int64()))], names)

    docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(work, SHARD_SCHEMA).write.mode("overwrite").parquet(folder)
    return folder


def no_random_access(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` best by (score descending, id ascending), from sequential reads alone.

    ``lists`` hold documents and what each adds to its score, greatest first; ``ids`` order equal scores. What was
    read of a document bounds its score from below; the lists it was not met in add at most the next entry of each,
    which bounds it from above. Reading goes on, in steps that double, until every document that can still reach
    the k-th best lower bound has an interval of width zero: then membership, ties and scores are settled.
    """
    lower = np.zeros(n_docs, dtype=np.int64)
    unseen = np.ones((n_docs, len(lists)), dtype=bool)
    ahead = np.array([g[0] if len(g) else 0 for _, g in lists], dtype=np.int64)
    at, step = 0, FIRST_READ
    while True:
        for t in np.flatnonzero(ahead):
            docs, gains = lists[t]
            read = docs[at : at + step]
            lower[read] += gains[at : at + step]
            unseen[read, t] = False
            ahead[t] = gains[at + step] if at + step < len(gains) else 0
        at, step = at + step, 2 * step
        least = max(1, int(np.partition(lower, n_docs - k)[n_docs - k])) if n_docs > k else 1
        near = np.flatnonzero(lower + int(ahead.sum()) >= least)
        open_ = unseen[near] @ ahead
        near, open_ = near[lower[near] + open_ >= least], open_[lower[near] + open_ >= least]
        if not open_.any():
            best = near[np.lexsort((ids[near], -lower[near]))][:k]
            return best, lower[best]


def terms_of(text: str | None) -> Counter:
    """How often each term, by its hash, occurs in a query."""
    return Counter(word_spans([None if text is None else text.encode()], lower=True, outside=OUTSIDE)[3].tolist())


def blocks_of(items: DataFrame, most: int) -> Iterator[list]:
    """The rows of ``items`` in lists of at most ``most``; one partition at a time reaches the driver."""
    block = []
    for row in items.toLocalIterator():
        block.append(row)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def _search_block(index: DataFrame, block: list, k: int) -> DataFrame:
    """The results of some items, with ``no`` for their place in the block."""
    wanted = [terms_of(text) for _, text in block]
    terms = np.array(sorted(set().union(*wanted)), dtype=np.uint64)

    def count(batches):
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1)):
                own, starts = np.frombuffer(own.as_py(), dtype="<u8"), np.frombuffer(starts.as_py(), dtype="<u4").astype(np.int64)
                place = np.searchsorted(own, terms)
                has = np.flatnonzero(own[np.minimum(place, len(own) - 1)] == terms) if len(own) else []
                yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(np.diff(starts)[place[has]], pa.int64())], ["t", "df"])

    found = index.select("terms", "starts").mapInArrow(count, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()  # one row per term of the block
    n_docs = index.select("n_docs_all").first()
    weights = np.zeros(len(terms), dtype=np.int64)
    for t, df in found:
        weights[t] = math.floor(1000 * math.log((2 * n_docs[0] + 2) / (2 * df + 1)))
    queries = [(np.searchsorted(terms, np.array(list(q), dtype=np.uint64)), np.array(list(q.values()), dtype=np.int64)) for q in wanted]

    def search(batches):
        for batch in batches:
            for own, starts, docs, gains, ids in zip(*batch.columns):
                own, starts = np.frombuffer(own.as_py(), dtype="<u8"), np.frombuffer(starts.as_py(), dtype="<u4")
                docs, gains, doc_ids = np.frombuffer(docs.as_py(), dtype="<u4"), np.frombuffer(gains.as_py(), dtype="<u4").astype(np.int64), ids.values
                numbers = np.array([(1 << 63) - 1 if v is None else v for v in doc_ids.to_pylist()], dtype=np.int64)
                place = np.searchsorted(own, terms)
                has = own[np.minimum(place, len(own) - 1)] == terms if len(own) else np.zeros(len(terms), dtype=bool)
                nos, picked, scores = [], [], []
                for no, (which, times) in enumerate(queries):
                    factors = weights[which] * times
                    live = [(place[t], f) for t, f in zip(which, factors) if f and has[t]]
                    if live:
                        best, score = no_random_access([(docs[starts[p] : starts[p + 1]], gains[starts[p] : starts[p + 1]] * f) for p, f in live], len(numbers), k, numbers)
                        nos.append(np.full(len(best), no)), picked.append(best), scores.append(score)
                if nos:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nos), pa.int32()), doc_ids.take(pa.array(np.concatenate(picked))), pa.array(np.concatenate(scores))], ["no", "doc_id", "score"])

    each = index.select("terms", "starts", "docs", "gains", "ids").mapInArrow(search, "no int, doc_id long, score long")
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, folder: str, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of the index for every item, scores above 0.

    The score sums, over an item's terms with repeats, the term's weight times the document's gain, all in 64-bit
    integers; equal scores stand by ascending id, null last. Items are taken in blocks of ``BLOCK_ITEMS``; a block
    reads the index once for the documents of its terms and once for the search. Each shard is searched by sequential
    reads of its own lists (``no_random_access``), which settles its own best; the best of all shards follow by rank.

    An item without text or terms, or with none in the index, has no rows; repeated items and repeated documents
    count each for itself; a very long text is a shard of its own. Results of a block are written to the shared folder.
    """
    index = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    out = fresh_folder(spark, "ranked-search")
    schema = "item_id long, rank int, doc_id long, score long"
    rows = spark.createDataFrame([], schema)
    for number, block in enumerate(blocks_of(items.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")), BLOCK_ITEMS)):
        if not any(terms_of(text) for _, text in block):
            continue
        names = spark.createDataFrame([(no, item_id) for no, (item_id, _) in enumerate(block)], "no int, item_id long")
        _search_block(index, block, k).join(names, "no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score").write.parquet(f"{out}/block={number}")
        rows = spark.read.schema(schema).parquet(f"{out}/block=*")
    return rows
