"""Remediation cycles: residual identity, decision, guard and rebaseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import matching_labels
from tidemark.functions.text import first_flag, residual_message, trim_all
from tidemark.operators.joins import check_candidates, opened_closed

# --- residuals ------------------------------------------------------------------------------------------


def residual_id(category: Column, source_file: Column, source_line: Column, generated_file: Column, generated_line: Column, message: Column) -> Column:
    """Stable identity of an issue. The generated place counts only when no source line is known."""
    path = lambda c: F.coalesce(F.replace(trim_all(c), F.lit("\\"), F.lit("/")), F.lit(""))
    known = source_line.isNotNull()
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [
        F.lower(trim_all(category)), path(source_file), text(source_line), F.when(known, F.lit("")).otherwise(path(generated_file)),
        F.when(known, F.lit("")).otherwise(text(generated_line)), residual_message(message),
    ]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def residual_inventory(issues: DataFrame, by: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """Residuals of a run; the last issue of an identity wins.

    Info is not actionable, a plain TODO comment does not bear progress. A max_by over
    the issue order replaces ordered upserts.
    """
    known = issues.where(F.length(F.trim(F.coalesce("category", F.lit("")))) > 0)
    severity = F.when(F.length(F.trim(F.coalesce("severity", F.lit("")))) == 0, F.lit("Unknown")).otherwise(F.col("severity"))
    actionable = F.lower(severity) != "info"
    rows = known.withColumns(
        {
            "residual_id": residual_id(*[F.col(c) for c in ("category", "source_file", "source_line", "generated_file", "generated_line", "message")]),
            "severity": severity, "actionable": actionable, "progress_bearing": actionable & (F.lower("category") != "todo"),
        }
    )
    fields = ["category", "severity", "message", "source_file", "source_line", "generated_file", "generated_line", "actionable", "progress_bearing"]
    kept = rows.groupBy(*by, "residual_id").agg(F.max_by(F.struct(*fields), ord_col).alias("_r"), F.count(F.lit(1)).alias("issues"))
    return kept.select(*by, "residual_id", *[F.col(f"_r.{f}").alias(f) for f in fields], "issues")


# --- decision -------------------------------------------------------------------------------------------

HARD_DEFECTS = ("syntax", "structural", "semantic_loss")
SOFT_DEFECTS = ("unsupported", "unmapped", "raw", "page_todo")
STRUCTURE = ("tests_found", "generated_files")


def residual_change(before: DataFrame, after: DataFrame, chain: Sequence[str], candidates: DataFrame) -> DataFrame:
    """Progress-bearing residuals opened and closed per cycle, and how many named ones closed.

    before/after(chain..., residual_id, progress_bearing), candidates(chain..., residual_id).
    """
    bearing = lambda df: df.where("progress_bearing").select(*chain, "residual_id")
    moved = opened_closed(bearing(before), bearing(after), [*chain, "residual_id"])
    per = moved.groupBy(*chain).agg(F.count_if(F.col("change") == "opened").alias("opened"), F.count_if(F.col("change") == "closed").alias("closed"))
    named = candidates.join(bearing(before), [*chain, "residual_id"], "left_semi")
    done = named.join(moved.where("change = 'closed'").withColumn("_done", F.lit(1)).drop("change"), [*chain, "residual_id"], "left")
    per_named = done.groupBy(*chain).agg(F.count(F.lit(1)).alias("named"), F.count("_done").alias("named_closed"))
    return per.join(per_named, list(chain), "full_outer").na.fill(0)


def _worse(name: str) -> Column:
    return F.col(f"after.{name}") > F.col(f"before.{name}")


def _better(name: str) -> Column:
    return F.col(f"after.{name}") < F.col(f"before.{name}")


def _any(conds: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def project_verification() -> tuple[Column, Column]:
    """(improved, regressed) of project verification: a lost pass regresses, a won pass improves, failed runs compare diagnostics."""
    b, a = F.col("before.project_status"), F.col("after.project_status")
    failing = (b == "failed") & (a == "failed")
    return ((b != "passed") & (a == "passed")) | (failing & _better("project_diagnostics")), ((b == "passed") & (a != "passed")) | (failing & _worse("project_diagnostics"))


def remediation_decision(pairs: DataFrame) -> DataFrame:
    """Decision and reason per cycle, in the fixed order of the policy.

    pairs: structs ``before`` and ``after`` (identity hashes, defects, structure,
    project status), ``visited`` and the counts of :func:`residual_change`. Deleting TODO
    text is never progress.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    verify_better, verify_worse = project_verification()
    changed = lambda c: ~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    shrunk = [F.col(f"after.{c}") < F.col(f"before.{c}") for c in STRUCTURE]
    hard_worse = _any([_worse(d) for d in HARD_DEFECTS] + shrunk + [verify_worse])
    hard_better = _any([_better(d) for d in HARD_DEFECTS] + [verify_better])
    missed = (n("named") > 0) & (n("named_closed") == 0)
    progress = n("closed") > 0
    soft_worse = _any([_worse(d) for d in SOFT_DEFECTS] + [_worse("todo")])
    improved = hard_better | _any([_better(d) for d in SOFT_DEFECTS])
    reject, accept, stall = "REJECT_REGRESSION", "ACCEPT", "REJECT_NO_PROGRESS"
    ladder = [
        (f"{reject}|SOURCE_SNAPSHOT_CHANGED", changed("source_sha")), (f"{reject}|TOOL_IDENTITY_CHANGED", changed("tool_sha")),
        (f"{reject}|ENVIRONMENT_IDENTITY_CHANGED", changed("environment_sha")), ("REJECT_CYCLE|REMEDIATION_CYCLE_DETECTED", F.col("visited")),
        (f"{reject}|DETERMINISTIC_SAFETY_REGRESSION", hard_worse), (f"{stall}|CANDIDATE_RESIDUAL_NOT_CLOSED", missed),
        (f"{reject}|RESIDUAL_DEBT_REGRESSION", n("opened") > n("closed")), (f"{accept}|RESIDUAL_IDENTITY_IMPROVEMENT", progress & (n("opened") == 0)),
        (f"{accept}|RESIDUAL_REPLACEMENT_PROGRESS", progress), (f"{reject}|DETERMINISTIC_METRIC_REGRESSION", soft_worse),
        (f"{accept}|DETERMINISTIC_IMPROVEMENT", improved), (f"{stall}|TODO_TEXT_REMOVAL_IS_NOT_PROGRESS", _better("todo")),
    ]
    verdict = first_flag([(k, F.coalesce(v, F.lit(False))) for k, v in ladder], f"{stall}|NO_DETERMINISTIC_IMPROVEMENT")
    return pairs.withColumn("_v", verdict).withColumns(
        {"decision": F.substring_index("_v", "|", 1), "reason": F.substring_index("_v", "|", -1), "requires_rollback": ~F.startswith("_v", F.lit(accept))}
    ).drop("_v")


# --- guard ----------------------------------------------------------------------------------------------


def candidate_flags(states: DataFrame, candidates: DataFrame, available: DataFrame, exhausted: DataFrame, chain: Sequence[str]) -> DataFrame:
    """Per chain: candidates named, how many are invalid or exhausted, and open residuals left. Counts only."""
    verdicts = check_candidates(candidates, available, exhausted, [*chain, "residual_id"])
    first = F.min(F.when(F.col("verdict") != "ready", F.struct("residual_id", "verdict")))
    named = verdicts.groupBy(*chain).agg(F.count(F.lit(1)).alias("selected"), first.alias("_bad"))
    left = available.join(exhausted, [*chain, "residual_id"], "left_anti").groupBy(*chain).agg(F.count(F.lit(1)).alias("open_left"))
    out = states.join(named, list(chain), "left").join(left, list(chain), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.withColumns({"selected": zero("selected"), "open_left": zero("open_left"), "first_bad": F.col("_bad.verdict")}).drop("_bad")


def cycle_guard(states: DataFrame) -> DataFrame:
    """Status of the next cycle per chain, ten outcomes in fixed order.

    states: accepted/observed hashes, current_state, rollback_required, cycle_in_progress,
    autonomy and the columns of :func:`candidate_flags`.
    """
    current = F.coalesce("current_state", F.lit(""))
    same = lambda a, b: F.lower(F.coalesce(F.col(a), F.lit(""))) == F.lower(F.coalesce(F.col(b), F.lit("")))
    source_ok, config_ok = same("observed_source", "source_sha"), same("observed_config", "config_sha")
    ladder = [
        ("BLOCKED_BASELINE_MISMATCH|REMEDIATION_ACCEPTED_STATE_MISMATCH", (current != "") & (current != F.col("state_hash"))),
        ("BLOCKED_WORKSPACE_MISMATCH|REMEDIATION_WORKSPACE_SOURCE_CONFIG_MISMATCH", ~source_ok & ~config_ok),
        ("BLOCKED_WORKSPACE_MISMATCH|REMEDIATION_WORKSPACE_SOURCE_MISMATCH", ~source_ok), ("BLOCKED_WORKSPACE_MISMATCH|REMEDIATION_WORKSPACE_CONFIG_MISMATCH", ~config_ok),
        ("BLOCKED_CANDIDATE_INVALID|REMEDIATION_RESIDUAL_CANDIDATE_NOT_IN_BASELINE", F.col("first_bad") == "invalid"),
        ("BLOCKED_CANDIDATE_EXHAUSTED|REMEDIATION_RESIDUAL_CANDIDATE_ALREADY_EXHAUSTED", F.col("first_bad") == "exhausted"),
        ("ROLLBACK_CONFIRMED|REMEDIATION_ROLLBACK_CONFIRMED", F.col("rollback_required")), ("ABORT_CONFIRMED|REMEDIATION_ACTIVE_CYCLE_BASELINE_RESTORED", F.col("cycle_in_progress")),
        ("BLOCKED_AUTONOMY_NOT_RUNNING|AUTONOMY_STATE_NOT_RUNNING", F.upper(F.coalesce("autonomy", F.lit(""))) != "RUNNING"),
        ("BLOCKED_CANDIDATE_REQUIRED|REMEDIATION_RESIDUAL_CANDIDATE_REQUIRED", (F.col("open_left") > 0) & (F.col("selected") == 0)),
        ("READY_INITIAL_BASELINE|REMEDIATION_BASELINE_INITIALIZED", current == ""),
    ]
    verdict = first_flag([(k, F.coalesce(v, F.lit(False))) for k, v in ladder], "READY|REMEDIATION_BASELINE_READY")
    return states.withColumn("_v", verdict).withColumns(
        {"status": F.substring_index("_v", "|", 1), "reason": F.substring_index("_v", "|", -1), "ready": F.rlike("_v", F.lit("^(?:READY|ROLLBACK_CONFIRMED)"))}
    ).drop("_v")


REBASELINE_DEFECTS = ("syntax", "unsupported", "unmapped", "raw", "todo", "page_todo")


def rebaseline_check(pairs: DataFrame) -> DataFrame:
    """A new tool may take over only with the same inputs and no worse measure."""
    changed = lambda c: ~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    shrunk = [(c, F.col(f"after.{c}") < F.col(f"before.{c}")) for c in STRUCTURE]
    regressions = [(d, _worse(d)) for d in REBASELINE_DEFECTS] + shrunk + [("project", project_verification()[1])]
    flagged = matching_labels([(n, F.coalesce(c, F.lit(False))) for n, c in regressions])
    rows = pairs.withColumn("regressions", flagged)
    reason = first_flag(
        [
            ("SOURCE_SNAPSHOT_CHANGED", changed("source_sha")), ("CONFIG_IDENTITY_CHANGED", changed("config_sha")), ("ENVIRONMENT_IDENTITY_CHANGED", changed("environment_sha")),
            ("TOOL_IDENTITY_UNCHANGED", ~changed("tool_sha")), ("NEW_TOOL_REGRESSION", F.size("regressions") > 0),
        ],
        "NEW_TOOL_BASELINE_VERIFIED",
    )
    judged = rows.withColumn("reason", reason)
    return judged.withColumn("status", F.when(F.col("reason") == "NEW_TOOL_BASELINE_VERIFIED", "REBASELINE_CONFIRMED").otherwise("REBASELINE_REJECTED"))
