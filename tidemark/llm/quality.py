"""Quality rules: counts over words and lines, then zstandard compression bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.wordhash import windows, word_hashes

SLICE_BYTES = 1 << 20
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: (texts under so many bytes, lowest ratio, highest ratio) of compressed to whole size. Text that repeats itself
#: lies below the low end. The high end lies about midway between the highest ratio of the documents at sf0.1 and the
#: lowest of base64 noise of that length; under 256 bytes the two overlap. Noise in fewer symbols, such as hex
#: digits, keeps about 0.53 and is not told from prose by these.
WHOLE_BANDS = ((256, 0.20, 0.93), (512, 0.15, 0.79), (1024, 0.15, 0.735), (2048, 0.12, 0.67), (4096, 0.12, 0.63), (16384, 0.10, 0.61), (1 << 62, 0.08, 0.58))
CHUNK_BYTES = 4096
CHUNK_BAND = (0.06, 0.63)
#: A text is rejected by its chunks when more than this share of them leaves the band.
CHUNK_SHARE = 0.5
#: Small chunks look for noise inside a text: over the highest ratio of any such chunk of the documents at sf0.1 (0.68)
#: and under the lowest of base64 noise (0.78); hex digits stay under it. A smaller share of them rejects a text.
SMALL_BYTES = 1024
SMALL_HIGH = 0.72
SMALL_SHARE = 0.15
LEVEL = 3

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, chunks long, chunks_out long, small_chunks long, small_out long, n_bytes long"


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs twice or more in the text, first occurrences included."""
    runs = windows(hashes, width)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(runs), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line, white space included."""
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            if line in seen:
                count += 1
            seen.add(line)
    return count


def chunk_ratios(text: bytes, size: int, packer: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of the fixed chunks of ``size`` bytes; the last, partial one counts from half a chunk on.

    A text shorter than two chunks has none: its whole ratio says the same.
    """
    if len(text) < 2 * size:
        return []
    parts = (text[i : i + size] for i in range(0, len(text), size))
    return [len(packer.compress(p)) / len(p) for p in parts if 2 * len(p) >= size]


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, int, int]:
    """Ratio of the whole text, number of chunks and how many leave their band, number of small chunks and how many are noise."""
    if not text:
        return 0.0, 0, 0, 0, 0
    large, small = chunk_ratios(text, CHUNK_BYTES, packer), chunk_ratios(text, SMALL_BYTES, packer)
    return len(packer.compress(text)) / len(text), len(large), sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in large), len(small), sum(r > SMALL_HIGH for r in small)


def text_statistics(docs: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """``id_cols`` and the columns of ``FIELDS`` for each row; a null text counts as empty."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def work(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        keep = bytes(set(range(256)) - set(SYMBOLS))
        for batch in batches:
            last = batch.num_columns - 1
            for at, end in slices(batch.column(last), SLICE_BYTES):
                raw = [(t or "").encode() for t in batch.column(last)[at:end].to_pylist()]
                hashes, bounds = word_hashes(raw)
                rows = []
                for i, text in enumerate(raw):
                    words = hashes[bounds[i] : bounds[i + 1]]
                    chars = len(text.decode()) - sum(map(text.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
                    rows.append((len(words), chars, len(text.translate(None, keep)), duplicate_lines(text), repeated_words(words), *compression(text, packer), len(text)))
                kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[at:end] for k in range(last)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*batch.schema.names[:last], *names])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*id_cols).schema)
    return docs.select(*id_cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).mapInArrow(work, f"{carried}, {FIELDS}")


def with_verdicts(stats: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``."""
    size = F.col("n_bytes")
    low, high = F.lit(WHOLE_BANDS[-1][1]), F.lit(WHOLE_BANDS[-1][2])
    for limit, lo, hi in reversed(WHOLE_BANDS[:-1]):
        low, high = F.when(size < limit, lo).otherwise(low), F.when(size < limit, hi).otherwise(high)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    in_band = F.col("zstd_ratio").between(low, high) & (F.col("chunks_out") <= CHUNK_SHARE * F.col("chunks")) & (F.col("small_out") <= SMALL_SHARE * F.col("small_chunks"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & in_band).drop("n_bytes")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, compression ratios and verdicts of each row of ``docs``, row for row and without a shuffle.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PERCENT`` per cent of the words in
    repeated windows. ``kept``: not base_failed, the zstandard ratio of the whole text within the band of its
    length, at most ``CHUNK_SHARE`` of its fixed chunks outside theirs, and at most ``SMALL_SHARE`` of its small chunks
    above ``SMALL_HIGH``: a low ratio is repetition, a high one is noise that no prose has.

    Null, empty and wordless texts have no words and fail. Very long texts are read whole, chunk by chunk. Rows with equal texts get equal verdicts, null ids
    are carried through, an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_verdicts(text_statistics(own, ["doc_id"], "text"))


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Nulls, empty, equal and very long texts as there; equal rows stay or go together, an empty table stays empty.
    """
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return with_verdicts(text_statistics(own, ["row"], "text")).where("kept").select("row.*")
