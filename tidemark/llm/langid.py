"""Language identification: scripts narrow the candidates, Viterbi labels the spans of mixed texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.tokens import drop_encoders, give_back

#: First code point of each script range of the Unicode standard that has a spelling of its own.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPT_RANGES}))
_STARTS = np.array([at for at, _ in SCRIPT_RANGES], dtype=np.int64)
_CODES = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPT_RANGES], dtype=np.int8)

GRAM_BUCKETS = 1 << 15
#: Texts learned from, for each language, at most: the documented bound of the training sample.
TRAIN_TEXTS = 4000
#: What a change of language costs, in nats of word score.
SWITCH_PENALTY = 25.0
#: A language is a candidate for a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.01
SCORE_BYTES = 1 << 20
VITERBI_BYTES = 1 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter (general category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters) of all texts: gram bucket of each letter, first letter and script of each word, words of each text.

    The gram of a letter is the letter with its two neighbours in the word, lower-cased, a blank at either end.
    """
    lowered = [(t or "").lower() for t in texts]
    code = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter_table()[code]
    spelled = np.where(is_letter, code, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    key = spelled[at - 1] * np.uint64(0x9E3779B97F4A7C15) + spelled[at] * np.uint64(0xC2B2AE3D27D4EB4F) + spelled[at + 1] * np.uint64(0x165667B19E3779F9)
    bucket = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int32)
    begins = np.flatnonzero(~is_letter[at - 1])
    script = _CODES[np.searchsorted(_STARTS, code[at[begins]], "right") - 1]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(lowered)))
    return bucket, begins, script, np.searchsorted(at[begins], np.concatenate(([0], ends)))


class LanguageModel:
    """Log-probabilities of grams by language and the languages of each script; bounded by languages x buckets."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray) -> None:
        self.langs = langs
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32) if langs else np.zeros((GRAM_BUCKETS, 0), np.float32)
        share = letters / np.maximum(letters.sum(axis=0, keepdims=True), 1)
        allowed = share >= SCRIPT_SHARE
        allowed[~allowed.any(axis=1)] = True  # a script nobody taught leaves all candidates
        self.handicap = np.where(allowed, 0.0, -1e4).astype(np.float32)

    def word_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each word in each language, letters of each word, words of each text."""
        bucket, begins, script, bounds = grams(texts)
        if not len(begins):
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64), bounds
        scores = np.add.reduceat(self.table[bucket], begins, axis=0) + self.handicap[script]
        return scores, np.diff(np.append(begins, len(bucket))), bounds


def viterbi(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Best language of every word of every text, when each change within a text costs ``SWITCH_PENALTY``.

    All texts advance together, one word a step; those that have ended drop out.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts with more words than the step
    came = np.zeros(scores.shape, dtype=np.int32 if scores.shape[1] > 32_000 else np.int16)
    own = np.arange(scores.shape[1], dtype=came.dtype)
    state = np.zeros((len(sizes), scores.shape[1]), dtype=np.float64)
    for t in range(steps):
        m = alive[t]
        at = starts[:m] + t
        if t:
            now = state[:m]
            best = now.argmax(axis=1)
            jump = now[np.arange(m), best] - SWITCH_PENALTY
            change = jump[:, None] > now
            came[at] = np.where(change, best[:, None], own)
            state[:m] = np.where(change, jump[:, None], now) + scores[at]
        else:
            state[:m] = scores[at]
    label = np.zeros(len(scores), dtype=came.dtype)
    current = state.argmax(axis=1).astype(came.dtype) if len(sizes) else np.zeros(0, came.dtype)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        label[at] = current[:m]
        current[:m] = came[at, current[:m]]
    return label


def learn(docs: DataFrame, text_col: str, lang_col: str, order_by, most: int = TRAIN_TEXTS) -> LanguageModel:
    """A model of the rows with a language, from at most about ``most`` texts of each.

    The sample takes the rows whose hashed ``order_by`` falls under a threshold by language, set by the count of
    its rows. The counts of grams are summed on the executors; at most languages x ``GRAM_BUCKETS`` sums reach
    the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((GRAM_BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0)))
    chance = F.lit(1.0)
    for lang in langs:
        chance = F.when(F.col(lang_col) == lang, min(1.0, most / sizes[lang])).otherwise(chance)
    picked = rows.where(F.pmod(F.xxhash64(order_by), F.lit(1_000_000)) < chance * 1_000_000)

    def count(batches):
        drop_encoders()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by = batch.column(0).to_pylist()
            for at, end in slices(batch.column(1), SCORE_BYTES):
                texts = batch.column(1)[at:end].to_pylist()
                bucket, begins, script, bounds = grams(texts)
                letter_at = np.append(begins, len(bucket))[bounds]
                lengths = np.diff(np.append(begins, len(bucket)))
                for i, lang in enumerate(by[at:end]):
                    own = sums.setdefault(lang, np.zeros(GRAM_BUCKETS + len(SCRIPT_NAMES), dtype=np.int64))
                    own[:GRAM_BUCKETS] += np.bincount(bucket[letter_at[i] : letter_at[i + 1]], minlength=GRAM_BUCKETS)
                    words = slice(bounds[i], bounds[i + 1])
                    np.add.at(own, GRAM_BUCKETS + script[words].astype(np.int64), lengths[words])
        give_back()
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(own[some])], ["lang", "bucket", "n"])

    parts = picked.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "lang string, bucket int, n long")
    sums = np.zeros((GRAM_BUCKETS + len(SCRIPT_NAMES), len(langs)))
    for r in parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        sums[r["bucket"], langs.index(r["lang"])] = r["n"]
    return LanguageModel(langs, sums[:GRAM_BUCKETS], sums[GRAM_BUCKETS:])


def identify(docs: DataFrame, model: LanguageModel, id_cols: list[str], text_col: str = "text", spans: bool = True) -> DataFrame:
    """``id_cols``, ``lang_pred``, ``score``, ``n_spans`` and, if asked, ``spans`` (first word, words, language) of each row.

    ``lang_pred`` is the language with most letters in its spans, the first by name on ties, and ``score``
    its share of the letters. A null text, one without a letter, and any text when nothing was learned give
    ``und`` with score 0 and no span. Texts are read whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*id_cols).schema

    def work(batches):
        drop_encoders()
        own: LanguageModel = shipped.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at, end in slices(texts, VITERBI_BYTES):
                part = texts[at:end]
                found = [own.word_scores(part[i:j].to_pylist()) for i, j in slices(part, SCORE_BYTES)]
                scores = np.concatenate([f[0] for f in found])
                letters = np.concatenate([f[1] for f in found])
                counts = np.concatenate([np.diff(f[2]) for f in found])
                del found
                label = viterbi(scores, counts) if own.langs else np.zeros(0, np.int8)
                bounds = np.concatenate(([0], np.cumsum(counts)))
                doc = np.repeat(np.arange(len(counts)), counts)
                by = np.zeros((len(counts), max(1, len(own.langs))))
                if own.langs:
                    np.add.at(by, (doc, label), letters)
                total = by.sum(axis=1)
                best = by.argmax(axis=1)
                known = total > 0
                share = np.where(known, by[np.arange(len(counts)), best] / np.maximum(total, 1), 0.0)
                names = [own.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
                turn = np.zeros(len(label), dtype=bool)
                if len(label):
                    turn[0] = True
                    turn[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                edge = np.flatnonzero(turn)
                n_spans = np.bincount(doc[edge], minlength=len(counts)) if len(label) else np.zeros(len(counts), np.int64)
                out = [*(batch.column(k)[at:end] for k in range(batch.num_columns - 1)), pa.array(names, pa.string()), pa.array(share), pa.array(n_spans.astype(np.int64))]
                labels = [f.name for f in fields] + ["lang_pred", "score", "n_spans"]
                if spans:
                    length = np.diff(np.append(edge, len(label)))
                    cells = pa.StructArray.from_arrays([pa.array((edge - bounds[doc[edge]]).astype(np.int64)), pa.array(length.astype(np.int64)), pa.array([own.langs[k] for k in label[edge]], pa.string())], ["first_word", "words", "lang"])
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_spans))), pa.int32()), cells))
                    labels.append("spans")
                yield pa.RecordBatch.from_arrays(out, labels)
        give_back()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, n_spans long"] + ["spans array<struct<first_word: long, words: long, lang: string>>"] * spans)
    return docs.select(*id_cols, F.col(text_col).cast("string").alias("__text")).mapInArrow(work, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spans: bool = True) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_spans`` (and ``spans``) of each row of ``docs``.

    Learns from the text and language of rows that are not held out; neither language, source nor id enters a
    prediction. Null ids are held out, repeated rows get equal predictions, an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("held_out"))
    model = learn(own.where(~F.col("held_out")), "text", "lang", F.col("doc_id"))
    return identify(own, model, ["doc_id", "held_out"], "text", spans)


#: A text with less than this share of its letters in its own main language is rejected as mixed.
MIN_SCORE = 0.5


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is identified with at least ``min_score``, with all their columns.

    Where no row has a language to learn from, the rows that have a letter stay.
    """
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col, F.col(id_col))
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return identify(own, model, ["row"], "text", spans=False).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
