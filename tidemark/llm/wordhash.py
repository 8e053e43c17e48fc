"""Words of many texts at once, as 64-bit hashes in numpy.

Words are the maximal runs of bytes other than ASCII white space. The hash of a word is a span hash over
prefix sums of a polynomial in an odd base modulo 2**64, so one pass over all bytes serves all words.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import U64, mix64

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240917)
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | U64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        for name, base in (("_powers", BASE), ("_inverses", INVERSE)):
            steps = np.full(n + n // 2, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def word_spans(texts: list[bytes | None], lower: bool = False, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one run of bytes; begin, end and hash of every word; where the words of each text begin (one more at the end).

    A word is a maximal run of bytes that are not ``outside``, among which must be the line feed. Null counts as
    empty. ``lower`` folds A-Z only.
    """
    joined = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    if lower:
        raw = LOWER[raw]
    space = outside[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    powers, inverses = _grown(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(LETTER[raw] * powers[: len(raw)], out=sums[1:])
    spans = (sums[end] - sums[begin]) * inverses[begin]
    hashes = mix64(spans ^ (end - begin).astype(np.uint64))
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
    doc_at = np.concatenate(([1], 1 + np.cumsum(sizes)))
    return raw, begin, end, hashes, np.searchsorted(begin, doc_at)


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and where the words of each text begin (one more at the end)."""
    return word_spans(texts, lower)[3:]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring words of one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * PLACE[k]
    return mix64(total)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a shorter text is one shingle of all its words, none has none."""
    n = len(hashes)
    if 0 < n < width:
        return mix64(np.sum(hashes * PLACE[:n], dtype=np.uint64, keepdims=True) + PLACE[width + n : width + n + 1])
    return np.unique(windows(hashes, width))
