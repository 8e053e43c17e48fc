"""Token ids by public tokenizers, each distinct piece of a batch of texts looked up once."""

from __future__ import annotations

import ctypes
import gc
import os
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class PieceEncoder:
    """Encodes columns of texts with the tokenizers library.

    ``glue`` is what a piece keeps of the blank before it: a blank for byte-level vocabularies, nothing for those
    that drop white space. A blank before a character that is no white space always begins a new match of such a
    pre-tokeniser, whatever stands around it, so pieces encode alone as they do within the text; so do the two
    sides of a single line break, and the marks after a word of letters. Words of letters are one match and go to
    the vocabulary's model directly, other pieces through the whole tokenizer; texts with blanks side by
    side are encoded whole. The cache, some 70 MB at ``most`` pieces, then keeps its older half: frequent pieces
    came first.
    """

    def __init__(self, path: str, glue: str, most: int = 350_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters, self.glue, self.most = self.tokenizer.model, byte_letters(), glue, most
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_word(self, piece: str) -> bool:
        """One match of letters whose lower case needs no context."""
        return piece.removeprefix(self.glue).isalpha() and (bool(self.glue) or (max(piece) < "ɐ" and piece.lower().isalpha()))

    def _atoms(self, piece: str) -> list[str]:
        if "\n" in piece:
            lines = piece.split("\n")
            if not self.glue:
                return [a for line in lines for a in self._atoms(line)]
            if all(line and not line[0].isspace() and not line[-1].isspace() for line in [lines[0].removeprefix(self.glue), *lines[1:]]):
                return [a for k, line in enumerate(lines) for a in ((["\n"] if k else []) + self._atoms(line))]
            return [piece]
        stem = piece.rstrip(ASCII_MARKS)
        return [stem, piece[len(stem) :]] if len(stem) < len(piece) and stem and self._is_word(stem) else [piece]

    def pieces(self, names: list[str]) -> list[bytes]:
        """Ids of each piece."""
        if len(self.known) > self.most:
            self.known = dict(islice(self.known.items(), self.most // 2 + 1))
        known, glue = self.known, self.glue
        found = list(map(known.get, names))
        missing = [k for k, ids in enumerate(found) if ids is None]
        words, split = [], []
        for k in missing:
            name = names[k]
            body = name[1:] if glue and name[:1] == glue else name
            if body.isalpha() and (glue or body.isascii()):  # most pieces: one word, looked up once
                words.append(name)
                split.append(None)
            else:
                split.append(self._atoms(name))
        new = {a for atoms in split if atoms for a in atoms if a not in known}
        words += [a for a in new if self._is_word(a)]
        rest = list(new.difference(words))
        tokenize, letters = self.model.tokenize, self.letters
        for word in words:
            spelled = word if glue else word.lower()
            if glue or not word.isascii():
                spelled = spelled.encode().decode("latin-1").translate(letters)
            known[word] = array("I", [t.id for t in tokenize(spelled)]).tobytes()
        known.update(zip(rest, self._whole(rest)))
        for k, atoms in zip(missing, split):
            found[k] = known[names[k]] if atoms is None else b"".join([known[a] for a in atoms])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) one after the other, and where those of each text begin (one more at the end)."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        offsets, flat = offsets - offsets[0], split.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()
        table = self.pieces([self.glue + n for n in names] if self.glue else names)
        if self.glue:  # the first piece of a text follows no blank
            first, at = np.unique(codes[offsets[:-1]], return_inverse=True)
            codes[offsets[:-1]] = len(table) + at
            table += self.pieces([names[c] for c in first])
            odd = np.array([not n or n[0].isspace() for n in names] + [False] * len(first))
            blanks = np.add.reduceat(odd[codes], offsets[:-1]) > 0
            for i in np.flatnonzero(blanks):
                codes[offsets[i] : offsets[i + 1]] = len(table) + 1
                codes[offsets[i]] = len(table)
                table += [self._whole([texts[int(i)].as_py()])[0], b""]
        sizes = np.fromiter((len(t) // 4 for t in table), dtype=np.int64, count=len(table))
        starts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), dtype="<u4")
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[codes] - ends + lengths, lengths)
        return every[place], np.concatenate(([0], ends))[offsets]


@lru_cache(maxsize=2)
def encoder_of(path: str, glue: str) -> PieceEncoder:
    """The encoder of a Python worker, whose tasks share its cache."""
    return PieceEncoder(path, glue)


def drop_encoders() -> None:
    """Frees what tasks of an earlier stage left in a Python worker: the encoders with their caches, and the heap they held."""
    if encoder_of.cache_info().currsize:
        encoder_of.cache_clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns the freed memory of a Python worker to the system, which the allocators would keep for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
