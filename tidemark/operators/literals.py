"""Rule keys found literally in texts, as equi joins instead of a rules x texts scan.

A key that occurs in a text brings every token that is complete inside the key, in
order. So a key has one anchor: three of its complete tokens in a row, else its longest
complete token, else (two cut tokens) the junction between them, else (a key inside one
token) the first characters of its longest run. Texts offer the same anchors, the join is
on the anchor, and every candidate pair is verified on the whole text, which makes the
result exact. Texts are cut once for all kinds of anchors; while the rules are few, a text
offers only anchors that some key has. A text meets all its candidate keys at once, so it
is shuffled and decoded once. The engine broadcasts the rule side of the join while it is
small and shuffles both sides by anchor beyond that, splitting hot anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import as_col, placeholder_regex_col

TOKEN = r"[\p{L}\p{N}_]+"
PLACEHOLDER = r"\{[A-Za-z_][A-Za-z0-9_]*\}"


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


#: A key inside one token is looked up by its first characters, as many of these as it has: long enough that few keys share them.
GRAMS = (12, 8, 6, 4, 3, 2, 1)
#: So many anchors at most are sent to where the texts are cut; beyond, texts offer every anchor of the kinds that occur.
NARROW = 200_000
#: Runs whose anchors a worker remembers.
KNOWN_RUNS = 200_000
TRIPLE, WORD, JUNCTION, GRAM = 3, 1, 2, 0


def _anchorer() -> Callable[[Iterator], Iterator]:
    """Rows (key) become (key, kind, anchor)."""
    grams, triple, word, junction, gram = GRAMS, TRIPLE, WORD, JUNCTION, GRAM

    def anchor(key: str) -> tuple[int, str]:
        import re

        runs = re.findall(r"\w+|\W+", key)
        first = 0 if re.match(r"\w", key) else 1
        inner = [r for i, r in enumerate(runs) if i % 2 == first and 0 < i < len(runs) - 1]
        if len(inner) >= 3:
            at = (len(inner) - 1) // 2 - (len(inner) == 3)
            return triple, "\0".join(inner[at:at + 3])
        if inner:
            return word, max(inner, key=lambda t: (len(t), t))
        if len(runs) == 3 and first == 0 and len(runs[0]) > 1 and len(runs[2]) > 1:
            return junction, runs[0][-2:] + runs[1] + runs[2][:2]
        longest = max(runs, key=lambda t: (len(t), t))
        return gram, longest[:next(g for g in grams if g <= len(longest))]

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = [anchor(k.as_py().decode("utf-8", "surrogateescape")) for k in batch.columns[0]]
            anchors = pa.array([a.encode("utf-8", "surrogateescape") for _, a in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.columns[0], pa.array([k for k, _ in found], pa.int32()), anchors], ["_rule", "_kind", "_anchor"])

    return work


def _offerer(wanted: dict[int, set[str] | None]) -> Callable[[Iterator], Iterator]:
    """Rows (id, text) become (id, kind, anchor), each once a text; ``wanted`` holds the anchors of each kind, None for all."""
    grams, triple, word, junction, gram, most = GRAMS, TRIPLE, WORD, JUNCTION, GRAM, KNOWN_RUNS

    def work(batches):
        import re

        import pyarrow as pa

        cut, starts = re.compile(r"\w+|\W+").findall, re.compile(r"\w").match
        asked = {k: None if v is None else {tuple(a.split("\0")) for a in v} if k == triple else frozenset(v) for k, v in wanted.items()}
        sizes = grams if asked.get(gram) is None else sorted({len(a) for a in asked[gram]})
        known: dict[str, tuple] = {}

        def inside(run):
            own = known.get(run)
            if own is None:
                own = {run[i:i + g] for g in sizes for i in range(len(run) - g + 1)}
                own = tuple(own if asked[gram] is None else own & asked[gram])
                if len(known) >= most:
                    known.clear()
                known[run] = own
            return own

        def offers(text):
            runs = cut(text)
            first = 0 if starts(text) else 1
            tokens = runs[first::2]
            for kind, some in asked.items():
                if kind == triple:
                    have = set(zip(tokens, tokens[1:], tokens[2:]))
                elif kind == word:
                    have = set(tokens)
                elif kind == junction:
                    have = {runs[i - 1][-2:] + runs[i] + runs[i + 1][:2] for i in range(first + 1, len(runs) - 1, 2)}
                else:
                    yield kind, set().union(*map(inside, set(runs)))
                    continue
                have = have if some is None else have & some
                yield kind, map("\0".join, have) if kind == triple else have

        def rows(at, kinds, anchors, ids):
            columns = [ids.take(pa.array(at, pa.int64())), pa.array(kinds, pa.int32()), pa.array(anchors, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["_id", "_kind", "_anchor"])

        for batch in batches:
            ids, texts = batch.columns
            at, kinds, anchors = [], [], []
            for i in range(len(ids)):
                for kind, have in offers(texts[i].as_py().decode("utf-8", "surrogateescape")):
                    new = [a.encode("utf-8", "surrogateescape") for a in have]
                    anchors += new
                    at += [i] * len(new)
                    kinds += [kind] * len(new)
                if len(at) >= 100_000:
                    yield rows(at, kinds, anchors, ids)
                    at, kinds, anchors = [], [], []
            if at:
                yield rows(at, kinds, anchors, ids)

    return work


def _wanted(anchored: DataFrame) -> dict[int, set[str] | None]:
    """The anchors of each kind while they are few, else None for each kind there is."""
    few = anchored.select("_kind", "_anchor").distinct().limit(NARROW + 1).collect()  # at most NARROW + 1 anchors
    kinds = {r["_kind"] for r in few}
    if len(few) > NARROW:
        return dict.fromkeys((TRIPLE, WORD, JUNCTION, GRAM))
    return {k: {bytes(r["_anchor"]).decode("utf-8", "surrogateescape") for r in few if r["_kind"] == k} for k in kinds}


def _counter() -> Callable[[Iterator], Iterator]:
    """Rows (id, text, keys) become a row per key that occurs: id, key, non-overlapping count and line of the first."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts, lists = batch.columns
            at, found, hits, lines = [], [], [], []
            for i in range(len(ids)):
                text = texts[i].as_py()
                for key in lists[i].as_py():
                    if n := text.count(key):
                        at.append(i), found.append(key), hits.append(n), lines.append(text.count(b"\n", 0, text.find(key)) + 1)
            columns = [ids.take(pa.array(at, pa.int64())), pa.array(found, pa.binary()), pa.array(hits, pa.int64()), pa.array(lines, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", "hits", "first_line"])

    return count


def literal_hits(
    texts: DataFrame, id_col: str, text_col: str, rules: DataFrame, rule_id: str, key_col: str, ignore_case: bool = False, narrow: bool = True
) -> DataFrame:
    """(rule, text, hits, first_line) for every rule key that occurs in a text, non-overlapping count.

    ``narrow`` looks at the keys first, so that texts offer only what some key asks for; False saves that look
    where the rules are large and the texts short.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    key, text = fold(as_col(key_col)), fold(as_col(text_col))
    keyed = rules.select(rule_id, key.cast("binary").alias("_key")).where(F.length("_key") > 0)
    anchored = keyed.select("_key").distinct().mapInArrow(_anchorer(), "_rule binary, _kind int, _anchor binary")
    wanted = _wanted(anchored) if narrow else dict.fromkeys((TRIPLE, WORD, JUNCTION, GRAM))
    held = texts.select(F.col(id_col).alias("_id"), text.cast("binary").alias("_text")).where("_text IS NOT NULL AND _id IS NOT NULL")
    own = held.schema["_id"].dataType
    offered = (held if wanted else held.limit(0)).mapInArrow(_offerer(wanted), T.StructType([T.StructField("_id", own), T.StructField("_kind", T.IntegerType()), T.StructField("_anchor", T.BinaryType())]))
    pairs = offered.join(anchored, ["_kind", "_anchor"]).select("_id", "_rule")
    bags = pairs.groupBy("_id").agg(F.collect_set("_rule").alias("_keys")).withColumnRenamed("_id", "_bag")
    joined = held.join(bags, F.col("_id") == F.col("_bag")).select("_id", "_text", "_keys")
    schema = T.StructType([T.StructField("_id", own), T.StructField("_key", T.BinaryType()), T.StructField("hits", T.LongType()), T.StructField("first_line", T.LongType())])
    return joined.mapInArrow(_counter(), schema).join(keyed, "_key").select(rule_id, F.col("_id").alias(id_col), "hits", "first_line")


def paths_in_texts(texts: DataFrame, id_col: str, text_col: str, paths: DataFrame, path_id: str, path_col: str) -> DataFrame:
    """Hits of paths in texts, ignoring case and whichever slash either side writes."""
    slashed = lambda c: F.translate(as_col(c), "\\", "/")
    return literal_hits(texts.select(id_col, slashed(text_col).alias("_t")), id_col, "_t", paths.select(path_id, slashed(path_col).alias("_p")), path_id, "_p", ignore_case=True)


def identifier_hits(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame, rule_id: str, key_col: str) -> DataFrame:
    """Occurrences of keys that stand alone, between characters of no identifier.

    All tokens of such a key are whole tokens of the text. A key of one token is counted in the join of tokens
    itself; one of several (``Foo.Bar``, ``List<Page>``) is anchored on its longest and verified on the text.
    """
    text = as_col(text_col)
    keyed = rules.select(F.col(rule_id), as_col(key_col).alias("_key")).withColumn("_parts", _tokens(F.col("_key"))).where(F.size("_parts") > 0)
    longest = F.array_max(F.transform("_parts", lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))))["t"]
    anchored = keyed.select(rule_id, "_key", longest.alias("_token"))
    words = texts.select(F.col(id_col), F.explode(_tokens(text)).alias("_token"))
    counted = words.join(anchored, "_token").groupBy(rule_id, id_col, "_key", "_token").agg(F.count(F.lit(1)).alias("_n"))
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.col("_key"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    alone = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])"))
    found = counted.join(texts.select(F.col(id_col), text.alias("_text")), id_col).withColumn("hits", F.when(F.col("_key") == F.col("_token"), F.col("_n")).otherwise(F.regexp_count(F.col("_text"), alone)))
    before = F.substring(F.col("_text"), F.lit(1), F.regexp_instr(F.col("_text"), alone) - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return found.where("hits > 0").select(rule_id, id_col, F.col("hits").cast("bigint").alias("hits"), line.cast("bigint").alias("first_line"))


def placeholder_hits(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame, rule_id: str, key_col: str) -> DataFrame:
    """Keys with ``{name}`` holes: anchored on their longest literal part, verified as a regular expression."""
    parts = F.filter(F.split(as_col(key_col), PLACEHOLDER, -1), lambda p: F.length(p) > 0)
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("l"), p.alias("p"))))["p"]
    literal = rules.select(rule_id, longest.alias("_part"), F.concat(F.lit("(?s)"), placeholder_regex_col(key_col)).alias("_regex"))
    near = literal_hits(texts, id_col, text_col, literal, rule_id, "_part").select(rule_id, id_col)
    joined = texts.select(F.col(id_col), as_col(text_col).alias("_text")).join(near.join(literal.select(rule_id, "_regex"), rule_id), id_col)
    n = F.regexp_count(F.col("_text"), F.col("_regex"))
    before = F.substring(F.col("_text"), F.lit(1), F.regexp_instr(F.col("_text"), F.col("_regex")) - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return joined.where(n > 0).select(rule_id, id_col, n.cast("bigint").alias("hits"), line.cast("bigint").alias("first_line"))
