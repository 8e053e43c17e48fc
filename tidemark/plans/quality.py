"""Quality dashboard, budgets, gates, preservation and left-over checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import contains_any_exact, matching_labels
from tidemark.functions.text import contains_ci, half_even, source_line, trim_all
from tidemark.operators.aggregates import quality_level
from tidemark.operators.joins import loss_checks, pair_identities
from tidemark.operators.ranking import ticket_board, ticket_priority

EMPTY_CODE = "EMPTY_TEST_AFTER_SUPPRESSION"
PAGE_LIKE = ("Page.", "Rows", "Loader")


def looks_like_page(c: str) -> Column:
    return contains_ci(c, "page.") | contains_any_exact(c, PAGE_LIKE)


def looks_like_call(c: str) -> Column:
    return F.contains(F.col(c), F.lit(".")) & F.contains(F.col(c), F.lit("("))


def guardrails(todo_categories: DataFrame, unsupported: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Three guardrails, one row each; every input reduces to one flag."""
    flag = lambda df, cond, name: df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("hit")).select(F.lit(name).alias("guardrail"), "hit")
    parts = flag(todo_categories, F.col("code") == EMPTY_CODE, "unsafe-suppression")
    parts = parts.unionByName(flag(unmapped, looks_like_page("subject"), "pom-helper-recovery"))
    parts = parts.unionByName(flag(unsupported, looks_like_call("subject"), "pom-helper-recovery"))
    parts = parts.unionByName(flag(unmapped, F.lit(True), "selector-evidence"))
    merged = parts.groupBy("guardrail").agg(F.bool_or("hit").alias("_hit"))
    return merged.select("guardrail", F.when(F.col("_hit"), "attention_required").otherwise("pass").alias("status"))


def quality_dashboard(runs: DataFrame, todo_categories: DataFrame, unsupported: DataFrame, unmapped: DataFrame) -> dict[str, DataFrame]:
    """Summary per run, ranked categories, guardrails and the ticket board, as frames.

    todo_categories(code, n), unsupported(subject, n), unmapped(subject, n).
    """
    board = ticket_board([("unmapped-target", unmapped, "subject", "n"), ("unsupported-action", unsupported, "subject", "n"), ("todo-category", todo_categories, "code", "n")])
    return {
        "summary": quality_level(runs),
        "categories": todo_categories.withColumn("priority", ticket_priority(F.col("n"))),
        "guardrails": guardrails(todo_categories, unsupported, unmapped),
        "tickets": board,
    }


# --- budgets and gates ------------------------------------------------------------------------------

# The four budgeted measures.
BUDGETED = ("todo", "unmapped", "unsupported", "warnings")


def evaluate_budget(actual: DataFrame, budget: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures over their maximum; ``issues`` names them, ``passed`` when there is none."""
    limits = budget.select(*keys, *[F.col(m).alias(f"{m}_max") for m in BUDGETED])
    joined = actual.join(limits, list(keys))
    issues = matching_labels([(m, F.col(m) > F.col(f"{m}_max")) for m in BUDGETED])
    return joined.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


# Gate defaults, and issue categories that no gate can switch off.
GATE_DEFAULTS: Mapping[str, int | bool] = {
    "max_todo": 0, "max_unsupported": 0, "max_unmapped": 0, "max_raw": 0, "fail_on_page_todo": True, "fail_on_syntax": True,
    "fail_on_placeholders": True, "fail_on_literals": True, "fail_on_leaks": True,
}
PRESERVATION_CATEGORIES = (
    "DuplicateSourceTestIdentity", "DuplicateTargetTestIdentity", "MissingTargetTest", "UnexpectedTargetTest", "VacuumTest", "VacuumSetUp",
    "AssertionLoss", "TestCaseLoss", "SemanticNoOp", "PartialMappingLoss",
)


def issue_counts(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the gates need to know about a report's issues, one row per report."""
    error = F.col("severity") == "Error"
    config = F.col("category") == "Config"
    return issues.groupBy(*keys).agg(
        F.count_if(error & config).alias("config_errors"),
        F.count_if(config & F.startswith("message", F.lit("Potential config leak"))).alias("leaks"),
        F.count_if(error & F.col("category").isin(*PRESERVATION_CATEGORIES)).alias("preservation_errors"),
    )


def quality_gate(reports: DataFrame) -> DataFrame:
    """Exit code per report: 3 syntax, 2 configuration, 1 thresholds and preservation, 0 passed; the worst wins.

    Reports carry the counts and the gate columns; a null gate takes its default.
    """
    gate = lambda name: F.coalesce(F.col(name), F.lit(GATE_DEFAULTS[name]))
    c = F.col
    failed = [
        ("syntax", 3, gate("fail_on_syntax") & (c("syntax") > 0)),
        ("config", 2, c("config_errors") > 0),
        ("page-todo", 1, gate("fail_on_page_todo") & (c("page_todo") > 0)),
        ("todo", 1, c("todo") > gate("max_todo")),
        ("unsupported", 1, c("unsupported") > gate("max_unsupported")),
        ("unmapped", 1, c("unmapped") > gate("max_unmapped")),
        ("raw", 1, c("raw") > gate("max_raw")),
        ("scope", 2, c("scope_warnings") > 0),
        ("placeholders", 1, gate("fail_on_placeholders") & (c("placeholders") > 0)),
        ("literals", 1, gate("fail_on_literals") & (c("literals") > 0)),
        ("leaks", 2, gate("fail_on_leaks") & (c("leaks") > 0)),
        ("preservation", 1, c("preservation_errors") > 0),
    ]
    code = F.greatest(F.lit(0), *[F.when(cond, level).otherwise(0) for _, level, cond in failed])
    return reports.withColumns({"failed_gates": matching_labels([(name, cond) for name, _, cond in failed]), "exit_code": code})


def preservation_check(src: DataFrame, tgt: DataFrame, keys: Sequence[str], src_setup: DataFrame | None = None, tgt_setup: DataFrame | None = None) -> DataFrame:
    """Missing, unexpected, ambiguous and lossy tests, and set-up that lost its behaviour."""
    pairs, issues = pair_identities(src, tgt, keys)
    losses = loss_checks(src.join(pairs, list(keys), "left_semi"), tgt.join(pairs, list(keys), "left_semi"), keys)
    out = issues.select(*keys, "category").unionByName(losses)
    if src_setup is not None and tgt_setup is not None:
        vacuum = loss_checks(src_setup, tgt_setup, keys).where(F.col("category").isin("VacuumTest", "AssertionLoss"))
        out = out.unionByName(vacuum.withColumn("category", F.when(F.col("category") == "VacuumTest", "VacuumSetUp").otherwise(F.col("category"))))
    return out


# --- left-overs in generated lines ------------------------------------------------------------------

# A placeholder counts as resolved when the nearest quote before it opens an interpolated string.
INTERPOLATED = r"\$\"[^\"]*\{NAME\}"


def placeholder_leftovers(lines: DataFrame, placeholders: Sequence[str], line_col: str = "line") -> DataFrame:
    """Active lines that still hold ``{name}`` outside an interpolated string, one row per name."""
    line = F.col(line_col)
    active = ~F.startswith(trim_all(line), F.lit("//"))
    found = [
        (name, F.contains(line, F.lit("{" + name + "}")) & ~F.rlike(line, F.lit(INTERPOLATED.replace("NAME", name)))) for name in placeholders
    ]
    return lines.where(active & F.contains(line, F.lit("{"))).withColumn("placeholder", F.explode(matching_labels(found))).withColumn("source_line", source_line(line))


def suspicious_literals(lines: DataFrame, placeholders: Sequence[str], line_col: str = "line") -> DataFrame:
    """Active lines without interpolation where a placeholder's name stands as a plain literal."""
    line = F.col(line_col)
    active = ~F.startswith(trim_all(line), F.lit("//")) & ~F.contains(line, F.lit("$"))
    found = [(q + name + q, F.contains(line, F.lit(q + name + q))) for name in placeholders for q in ('"', "'")]
    return lines.where(active).withColumn("literal", F.explode(matching_labels(found))).withColumn("source_line", source_line(line))


# --- performance -------------------------------------------------------------------------------------

MAX_REGRESSION_RATIO = 1.35


def perf_regression(current: DataFrame, baseline: DataFrame, budgets: DataFrame, key: str, max_ratio: float = MAX_REGRESSION_RATIO) -> DataFrame:
    """Verdict per measured scenario: hard limit, regression over the baseline, soft limit, ok.

    current/baseline(key, duration_ms, memory_mb); budgets(key, soft_ms, hard_ms, soft_mb, hard_mb).
    """
    base = baseline.select(key, F.col("duration_ms").alias("base_ms"))
    joined = current.join(base, key, "left").join(budgets, key, "left")
    ratio = F.when(F.col("base_ms") > 0, half_even(F.col("duration_ms") / F.col("base_ms"), 2))
    over = lambda kind: (F.col("duration_ms") > F.col(f"{kind}_ms")) | (F.col("memory_mb") > F.col(f"{kind}_mb"))
    measured = joined.withColumn("ratio", ratio)
    verdict = (
        F.when(F.coalesce(over("hard"), F.lit(False)), "hard-limit").when(F.coalesce(F.col("ratio") > max_ratio, F.lit(False)), "regression")
        .when(F.coalesce(over("soft"), F.lit(False)), "soft-limit").otherwise("ok")
    )
    return measured.withColumn("verdict", verdict)
