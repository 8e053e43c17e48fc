"""Linking by shared tokens, and scoring the entries of a catalogue for projects."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import slashes
from tidemark.operators.lines import explode_lines
from tidemark.operators.literals import literal_hits
from tidemark.operators.ordered import bucketed, last_known

LONG_TOKEN = r"[\p{L}\p{N}_]{4,}"


def tokens_of(df: DataFrame, id_col: str, text_col: str, pattern: str = LONG_TOKEN) -> DataFrame:
    folded = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), F.lower))
    return df.select(id_col, F.explode(folded).alias("token"))


def link_by_tokens(obs: DataFrame, obs_id: str, obs_text: str, files: DataFrame, file_id: str, file_text: str, pattern: str = LONG_TOKEN) -> DataFrame:
    """First file (in file order) that shares a token with each observation.

    The first file per token is a unique-key lookup, so a token that half of all files
    use costs one row: no pairs of a token's observations and files are ever made.
    """
    first = tokens_of(files, file_id, file_text, pattern).groupBy("token").agg(F.min(file_id).alias(file_id))
    return tokens_of(obs, obs_id, obs_text, pattern).join(first, "token").groupBy(obs_id).agg(F.min(file_id).alias(file_id))


# How a stack frame, a test's own words, a report's source and a generated line's origin are written.
FRAME = r"(?i)\s+in\s+([^\r\n]+?\.cs):line\s+(\d{1,9})(?!\d)"
TEST_TOKEN = r"[A-Za-z_][A-Za-z0-9_]{3,}"
NO_TEST_TOKENS = ("failed", "passed", "test", "name", "error")
SOURCE_FILE = r"(?i)Source file:[ \t]*`?([^`\r\n]+\.cs)`?"
SOURCE_FIELD = r"(?i)\"sourceFile(?:Path)?\"\s*:\s*\"([^\"]+\.cs)\""
ORIGIN_LINE = r"(?i)//\s*Original:.*//\s*line\s+(\d{1,9})(?!\d)"
#: Lines of a file that one task looks at together.
LINES = 1024


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def test_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, token)``: the words of a test's name or message that may name a file, in lower case."""
    return tokens_of(df, id_col, text_col, TEST_TOKEN).where(~F.col("token").isin(*NO_TEST_TOKENS))


def resolve_frames(frames: DataFrame, files: DataFrame, depth: int | None = None) -> DataFrame:
    """``(frame, file)``: the known file whose path ends like a frame's, most segments first, then in file order.

    frames(frame), files(file, path). Both sides are cut into their own path endings, which meet by equality; a
    frame matches where one path ends with the other, so a log that shows an absolute path finds a relative one.
    ``depth`` bounds the segments compared, None compares whole paths. The first file per ending is a unique-key
    lookup, so a name that all projects use costs one row.
    """

    def endings(path: Column) -> Column:
        parts = F.filter(F.split(F.lower(slashes(path)), "/"), lambda p: (p != "") & (p != "."))
        most = F.size(parts) if depth is None else F.least(F.size(parts), F.lit(depth))
        return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), most), lambda n: F.struct(n.alias("n"), (n == most).alias("whole"), F.array_join(F.slice(parts, -n, n), "/").alias("ending"))))

    own = frames.select("frame", F.explode(endings(F.col("frame"))).alias("e")).select("frame", "e.*")
    known = files.select("file", F.explode(endings(F.col("path"))).alias("e")).select("file", "e.*")
    # whole ending of either side: the whole known path ends the frame, or the whole frame ends a known path
    by_file = known.where("whole").groupBy("ending").agg(F.min("file").alias("file"))
    by_frame = known.groupBy("ending").agg(F.min("file").alias("file"))
    hits = own.join(by_file, "ending").select("frame", "n", "file").unionByName(own.where("whole").join(by_frame, "ending").select("frame", "n", "file"))
    return hits.groupBy("frame").agg(F.min(F.struct((-F.col("n")).alias("less"), "file")).alias("b")).select("frame", F.col("b.file").alias("file"))


def _first_by_token(generated: DataFrame) -> DataFrame:
    """``(token, first)``: the first file whose name contains a word or whose text has it, with the stage.

    Names offer all parts that may be a word of a test (quadratic in the length of one name, not in their number),
    each different name once, so the words of the tests are never compared with names.
    """
    names = generated.where("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.min("file").alias("file"))
    runs = names.select("file", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit("[a-z0-9_]{4,}"), F.lit(0)))).alias("run"))
    starts = runs.select("file", "run", F.explode(F.sequence(F.lit(1), F.length("run") - 3)).alias("at"))
    spans = starts.select("file", "run", "at", F.explode(F.sequence(F.lit(4), F.length("run") - F.col("at") + 1)).alias("n"))
    by_name = spans.select("file", F.substring("run", F.col("at"), F.col("n")).alias("token"), F.lit("name").alias("stage")).where(F.rlike("token", F.lit("^[a-z_]")))
    by_text = test_tokens(generated, "file", "text").withColumn("stage", F.lit("token"))
    return by_name.unionByName(by_text).groupBy("token").agg(F.min(F.struct("file", "stage")).alias("first"))


def first_files(obs: DataFrame, generated: DataFrame) -> DataFrame:
    """``(obs, file, stage)``: the first generated file whose name contains a token of the test, or whose text has it as a word."""
    best = test_tokens(obs, "obs", "words").join(_first_by_token(generated), "token").groupBy("obs").agg(F.min("first").alias("first"))
    return best.select("obs", "first.file", "first.stage")


def report_sources(reports: DataFrame) -> DataFrame:
    """Reports that name a source file, with it as ``source_file``."""
    text = F.col("text")
    return reports.withColumn("source_file", F.coalesce(_found(text, SOURCE_FILE), _found(text, SOURCE_FIELD))).where("source_file IS NOT NULL")


def origin_lines(wanted: DataFrame, generated: DataFrame, nearest: bool = True) -> DataFrame:
    """``(file, line, source_line)`` for ``wanted(file, line)``: the origin marker at or above the line, else the file's first.

    A null line asks for the first marker, as ``nearest=False`` does for all. Lines are looked up in slices of the
    file with the last marker carried across, so a long file spreads over tasks.
    """
    lines = explode_lines(generated.select("file", "text"), "text", ["file"])
    marks = lines.select("file", F.col("line_no").cast("long").alias("line"), _found(F.col("line"), ORIGIN_LINE).cast("long").alias("mark")).where("mark IS NOT NULL")
    first = marks.groupBy("file").agg(F.min_by("mark", "line").alias("first"))
    asked = wanted.select("file", F.col("line").cast("long").alias("line")).distinct()
    if not nearest:
        return asked.join(first, "file").select("file", "line", F.col("first").alias("source_line"))
    rows = marks.select("file", "line", "mark", F.lit(0).alias("asks")).unionByName(asked.where("line IS NOT NULL").select("file", "line", F.lit(None).cast("long").alias("mark"), F.lit(1).alias("asks")))
    near = last_known(bucketed(rows, F.floor(F.col("line") / LINES)), ["file"], ["line", "asks"], F.col("mark"), "near").where("asks = 1").select("file", "line", "near")
    both = asked.join(first, "file").join(near.withColumnsRenamed({"file": "_f", "line": "_l"}), (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")), "left")
    return both.select("file", "line", F.coalesce("near", "first").alias("source_line"))


def link_failures(obs: DataFrame, generated: DataFrame, reports: DataFrame, depth: int | None = None, nearest: bool = True) -> DataFrame:
    """Failures with the generated file and the source they come from, found in stages.

    obs(obs, words, snippet), generated(file, path, name, text), reports(report, text); ``file`` and ``report`` are in
    the order in which the first one wins. The file of a failure is that of the first stack frame of its snippet
    (with the frame's line; a frame of no known file keeps its own path and no ``file``), else the first whose name
    or text has a word of the test. The source is that of the first report that mentions the generated file's name or
    a word of the test and names a source file, else the line that the generated file itself gives as its origin.

    Returns ``(obs, stage, file, generated_path, generated_line, report, source_file, source_line)``, one row a failure
    that has a file or a source. Null texts have no words, frames or marks. Failures, files and reports that repeat
    their number are one: the first frame by text counts, the smallest path and source.
    """
    framed = obs.select("obs", F.trim(F.regexp_extract("snippet", FRAME, 1)).alias("frame"), F.regexp_extract("snippet", FRAME, 2).alias("line")).where("frame <> ''")
    framed = framed.groupBy("obs").agg(F.min(F.struct("frame", F.col("line").cast("long").alias("line"))).alias("f")).select("obs", "f.frame", "f.line")
    known = resolve_frames(framed.select("frame").distinct(), generated.select("file", "path"), depth)
    by_frame = framed.join(known, "frame", "left").select("obs", "file", F.col("frame").alias("shown"), "line", F.lit("frame").alias("stage"))
    # one look at the words of all tests: the first file and the first report of each word
    sourced = report_sources(reports)
    said = test_tokens(sourced, "report", "text").groupBy("token").agg(F.min("report").alias("report"))
    lookup = _first_by_token(generated).join(said, "token", "full")
    best = test_tokens(obs, "obs", "words").join(lookup, "token").groupBy("obs").agg(F.min("first").alias("first"), F.min("report").alias("report"))
    rest = best.where("first IS NOT NULL").select("obs", "first.file", "first.stage").join(framed.select("obs"), "obs", "left_anti")
    by_word = rest.select("obs", "file", F.lit(None).cast("string").alias("shown"), F.lit(None).cast("long").alias("line"), "stage")
    paths = generated.groupBy(F.col("file").alias("_file")).agg(F.min("path").alias("path"))
    found = by_frame.unionByName(by_word).join(paths, F.col("file") == F.col("_file"), "left").drop("_file").withColumn("generated_path", F.coalesce("path", "shown")).drop("path", "shown")
    base = found.withColumn("base", F.lower(F.substring_index(slashes("generated_path"), "/", -1)))

    sources = sourced.groupBy("report").agg(F.min("source_file").alias("source_file"))
    mentions = literal_hits(sourced.select("report", F.lower("text").alias("text")), "report", "text", base.select("base").distinct().withColumn("key", F.col("base")), "base", "key")
    by_base = base.join(mentions.groupBy("base").agg(F.min("report").alias("report")), "base").select("obs", "report")
    by_token = best.where("report IS NOT NULL").select("obs", "report")
    picked = by_base.unionByName(by_token).groupBy("obs").agg(F.min("report").alias("report")).join(sources, "report")
    full = obs.select("obs").distinct().join(base.drop("base"), "obs", "left").join(picked, "obs", "left")
    wanted = full.where("report IS NULL AND file IS NOT NULL")
    origins = origin_lines(wanted.select("file", "line"), generated, nearest).withColumnsRenamed({"file": "_f", "line": "_l"})
    lined = full.join(origins, F.col("report").isNull() & (F.col("file") == F.col("_f")) & F.col("line").eqNullSafe(F.col("_l")), "left")
    out = lined.select("obs", "stage", "file", "generated_path", F.col("line").alias("generated_line"), "report", "source_file", "source_line")
    return out.where("generated_path IS NOT NULL OR source_file IS NOT NULL")


def score_catalogue(
    projects: DataFrame, catalogue: DataFrame, on: tuple[Column, Column], mismatch: int, penalties: Sequence[tuple[int, Callable[[Column], Column]]], start: int = 100
) -> DataFrame:
    """Catalogue entries of a project's own key, scored, and one row for all others; an equi join of any sizes.

    ``on`` is the key of a project and of an entry, ``mismatch`` what an entry of another key loses. An entry of
    the same key starts at ``start`` and loses the penalties whose condition holds. All entries of other keys
    are one row without a ``profile`` that bounds them: ``start`` less ``mismatch``.
    """
    entries = catalogue.select(on[1].alias("_key"), F.struct(*[F.col(c) for c in catalogue.columns]).alias("profile"))
    scored = projects.withColumn("_key", on[0]).join(entries, "_key").drop("_key")
    score = F.lit(start)
    for cost, holds in penalties:
        score = score - F.when(holds(F.col("profile")), cost).otherwise(0)
    own = scored.withColumn("score", F.least(F.greatest(score, F.lit(0)), F.lit(100)))
    others = projects.withColumn("profile", F.lit(None).cast(entries.schema["profile"].dataType)).withColumn("score", F.lit(max(0, start - mismatch)))
    return own.unionByName(others)
