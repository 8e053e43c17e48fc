"""Review packs, pilots, boards and guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import CATEGORY_PATTERNS, FILE_SIGNALS, matching_labels, potential_helpers, signal_counts, tag_categories
from tidemark.functions.text import half_even
from tidemark.operators.aggregates import method_stats, overall_status, review_status, root_causes
from tidemark.operators.joins import outer_diff
from tidemark.operators.ranking import covering_slice, impact, rank_pilots, top_k

# Artefact kinds a review expects.
EXPECTED_ARTIFACTS = (("selector-evidence", "medium"), ("evidence-manifest", "low"))


def pr_pack(lines: DataFrame, keys: Sequence[str], by: Sequence[str], artifacts: DataFrame, reported: DataFrame) -> dict[str, DataFrame]:
    """Changed files with their review status, risks per review and the overall status.

    lines(by..., keys..., line), artifacts(by..., kind), reported(by..., syntax, unsupported, unmapped).
    """
    files = review_status(lines, [*by, *keys])
    todo = files.groupBy(*by).agg(F.sum("todo").alias("todo"), F.count(F.lit(1)).alias("files"))
    present = artifacts.groupBy(*by).agg(*[F.bool_or(F.col("kind") == kind).alias(f"_has_{i}") for i, (kind, _) in enumerate(EXPECTED_ARTIFACTS)])
    facts = todo.join(reported, list(by), "left").join(present, list(by), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    risks = [
        ("syntax-errors", "blocker", n("syntax") > 0), ("remaining-todos", "high", n("todo") > 20), ("remaining-todos", "medium", (n("todo") > 0) & (n("todo") <= 20)),
        ("unsupported-actions", "medium", n("unsupported") > 0), ("unmapped-targets", "medium", n("unmapped") > 0),
        *[(f"missing-{kind}", sev, ~F.coalesce(F.col(f"_has_{i}"), F.lit(False))) for i, (kind, sev) in enumerate(EXPECTED_ARTIFACTS)],
    ]
    long = facts.select(*by, F.explode(matching_labels([(f"{sev}|{name}", cond) for name, sev, cond in risks])).alias("_r")).select(
        *by, F.substring_index("_r", "|", 1).alias("severity"), F.substring_index("_r", "|", -1).alias("risk")
    )
    return {"files": files, "risks": long, "status": overall_status(long, by)}


def runbook_candidates(files: DataFrame, path_col: str, k: int = 5, signals: Mapping[str, str] = FILE_SIGNALS, text_col: str = "text") -> DataFrame:
    """Best files to start a migration with."""
    return rank_pilots(signal_counts(files, signals, text_col), path_col, k)


# Patterns of the pilot estimate.
TEST_MARKS = r"\[(?:Test|Fact|Theory|TestCase|TestCaseSource)\b|public\s+(?:async\s+)?(?:Task|void)\s+\w+\s*\("
SCORE_MARKS = (r"FindElement|FindElements|By\.", r"Click\s*\(|SendKeys\s*\(|Clear\s*\(", r"Assert\.|Should\s*\(", r"Wait|Until|WebDriverWait")


def pilot_candidates(files: DataFrame, path_col: str, text_col: str = "text", test_marks: str = TEST_MARKS, score_marks: Sequence[str] = SCORE_MARKS, categories=CATEGORY_PATTERNS, simple=None) -> DataFrame:
    """Estimated tests (at least 1), categories and score per file."""
    count = lambda p: F.regexp_count(F.col(text_col), F.lit(p))
    tagged = tag_categories(files.withColumn("_p", F.col(path_col)), categories, text_col=text_col, path_col="_p", **({"simple": simple} if simple else {})).drop("_p")
    score = F.size("categories") * 10
    for p in score_marks:
        score = score + count(p)
    return tagged.withColumns({"tests": F.greatest(F.lit(1), count(test_marks)).cast("bigint"), "score": score.cast("bigint"), "helpers": potential_helpers(text_col)})


def pilot_select(candidates: DataFrame, by: Sequence[str], categories: Sequence[str], budget: int) -> DataFrame:
    return covering_slice(candidates, by, categories, budget)


# --- boards: no formula is public for these, the thresholds and weights are ours ------------------------------


def explain_todos(todos: DataFrame, key_rules: Sequence[tuple[str, str, int]], by: Sequence[str] = (), file_col: str = "file") -> DataFrame:
    """Root causes of open points with an impact: occurrences and files weigh as in the mapping proposals."""
    groups = root_causes(todos, key_rules, by, file_col=file_col)
    return groups.withColumn("impact", impact(F.col("n"), F.col("file_count"), F.lit(False)))


def migration_board(tests: DataFrame, errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Card per file: tests, open points, active share, compile errors and its best test."""
    cards = tests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tests"), F.sum("todo_lines").alias("todo_lines"), F.sum("active_lines").alias("active_lines"),
        F.max(F.struct(F.col("level"), F.col("active_ratio"), F.col("test"))).alias("_best"),
    )
    joined = cards.join(errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("compile_errors")), list(keys), "left")
    share = F.when(F.col("active_lines") + F.col("todo_lines") == 0, 0.0).otherwise(half_even(F.col("active_lines") / (F.col("active_lines") + F.col("todo_lines")), 2))
    return joined.select(
        *keys, "tests", "todo_lines", share.alias("active_ratio"), F.coalesce("compile_errors", F.lit(0)).alias("compile_errors"), F.col("_best.level").alias("best_level"), F.col("_best.test").alias("best_test")
    )


def smoke_plan(lines_with_test: DataFrame, errors: DataFrame, keys: Sequence[str], k: int | None = None) -> DataFrame:
    """Tests to run first: no compile errors in their file, highest level, most assertions; with ``k`` the first k."""
    stats = method_stats(lines_with_test, keys)
    clean = stats.join(errors.select(*keys).distinct(), list(keys), "left_anti").where("level >= 3")
    return top_k(clean, k, F.col("level").desc(), F.col("assertions").desc(), F.col("active_ratio").desc(), "test", *keys)


def config_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries added, removed or changed between two configurations, by section and key."""
    tag = lambda df: df.select(F.concat_ws("\u001f", "section", "key").alias("id"), "section", "key", "canon")
    d = outer_diff(tag(before), tag(after), "id", ignore_case=False)
    change = F.when(F.col("side") == "both", F.when(~F.col("base.canon").eqNullSafe(F.col("cur.canon")), F.lit("changed"))).otherwise(F.col("side"))
    return d.select(
        F.coalesce("cur.section", "base.section").alias("section"), F.coalesce("cur.key", "base.key").alias("key"), change.alias("change")
    ).where(F.col("change").isNotNull())


GUARDED = ("todo", "unmapped", "unsupported", "syntax", "suppressed")


def guard(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str] = GUARDED) -> DataFrame:
    """Guard per project: a measure that rose fails it; the failing measures are listed."""
    b = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in metrics])
    joined = after.join(b, list(keys))
    failed = matching_labels([(m, F.col(m) > F.col(f"{m}_before")) for m in metrics])
    rows = joined.withColumn("failed", failed)
    return rows.withColumn("status", F.when(F.size("failed") == 0, "PASS").otherwise("FAIL"))


