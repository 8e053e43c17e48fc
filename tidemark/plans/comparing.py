"""Snapshot diff, scenario status, triage, release gate, metamorphic and determinism checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import matching_labels
from tidemark.functions.text import evidence_age, first_flag
from tidemark.operators.aggregates import issue_clusters
from tidemark.operators.joins import contract_changes, outer_diff, tree_diff, variants_with_run
from tidemark.operators.ranking import rank_of

# Severity of a scenario status, and the smallest duration change that counts.
STATUS_SEVERITY: Mapping[str, int] = {
    "Pass": 0, "UnsupportedAsExpected": 0, "PassWithWarnings": 1, "NonDeterministic": 2, "SourceInvalid": 3, "InfrastructureFailure": 4,
    "Regression": 5, "MigratorFailure": 6,
}
UNKNOWN_SEVERITY = 5
MIN_DURATION_DELTA_MS = 1000
DURATION_PERCENT = 20.0
LOWER_IS_BETTER = ("todo", "unmapped", "unsupported", "warnings")
HIGHER_IS_BETTER = ("source_passed", "source_expected", "target_passed", "target_expected")


def snapshot_diff(baseline: DataFrame, current: DataFrame, key: str = "id", duration_percent: float = DURATION_PERCENT) -> DataFrame:
    """Per scenario: kind of change, regressions, improvements and neutral reasons as label arrays.

    Both sides carry id, expected_status, actual_status, contract_hash, the measures
    above, quality_passed, oracle_passed, diagnostics, checks, duration_ms,
    semantic_hash. One full outer join; everything else is column logic on the pair.
    """
    pairs = outer_diff(baseline, current, key)
    b, c = (lambda n: F.col(f"base.{n}")), (lambda n: F.col(f"cur.{n}"))
    ok_b, ok_c = b("actual_status") == b("expected_status"), c("actual_status") == c("expected_status")
    sev = lambda x: rank_of(x, STATUS_SEVERITY, UNKNOWN_SEVERITY)
    both_bad = ~ok_b & ~ok_c
    blank = lambda x: F.coalesce(F.length(F.trim(x)), F.lit(0)) == 0
    delta = c("duration_ms") - b("duration_ms")
    percent = F.when(b("duration_ms") > 0, delta * 100.0 / b("duration_ms"))
    counted = F.abs(delta) >= MIN_DURATION_DELTA_MS
    added, removed = F.array_sort(F.array_except(c("diagnostics"), b("diagnostics"))), F.array_sort(F.array_except(b("diagnostics"), c("diagnostics")))
    flag = lambda cond: F.coalesce(cond, F.lit(False))

    worse = [
        ("expected-status", b("expected_status") != c("expected_status")),
        ("contract-missing", ~blank(b("contract_hash")) & blank(c("contract_hash"))),
        ("contract-changed", ~blank(b("contract_hash")) & ~blank(c("contract_hash")) & (F.lower(b("contract_hash")) != F.lower(c("contract_hash")))),
        ("status", ok_b & ~ok_c),
        ("severity", both_bad & (sev(c("actual_status")) > sev(b("actual_status")))),
        *[(m, c(m) > b(m)) for m in LOWER_IS_BETTER],
        ("quality", b("quality_passed") & ~c("quality_passed")),
        ("oracle", b("oracle_passed") & ~c("oracle_passed")),
        *[(m, c(m) < b(m)) for m in HIGHER_IS_BETTER],
        ("diagnostics-added", F.size(added) > 0),
        ("duration", counted & (percent > duration_percent)),
    ]
    better = [
        ("status", ~ok_b & ok_c),
        ("severity", both_bad & (sev(c("actual_status")) < sev(b("actual_status")))),
        *[(m, c(m) < b(m)) for m in LOWER_IS_BETTER],
        ("quality", ~b("quality_passed") & c("quality_passed")),
        ("oracle", ~b("oracle_passed") & c("oracle_passed")),
        *[(m, c(m) > b(m)) for m in HIGHER_IS_BETTER],
        ("diagnostics-removed", F.size(removed) > 0),
        ("duration", counted & (percent < -duration_percent)),
    ]
    neutral = [
        ("actual-status", both_bad & (sev(c("actual_status")) == sev(b("actual_status"))) & (b("actual_status") != c("actual_status"))),
        ("checks", (F.size(F.array_except(c("checks"), b("checks"))) > 0) | (F.size(F.array_except(b("checks"), c("checks"))) > 0)),
        ("semantic-hash", ~F.lower(b("semantic_hash")).eqNullSafe(F.lower(c("semantic_hash")))),
    ]
    paired = F.col("side") == "both"
    labels = lambda rules: F.when(paired, matching_labels([(n, flag(x)) for n, x in rules])).otherwise(F.array().cast("array<string>"))
    out = pairs.withColumns({"regressions": labels(worse), "improvements": labels(better), "changes": labels(neutral)})
    one_sided_bad = (F.col("side") == "removed") | ((F.col("side") == "added") & ~flag(ok_c))
    kind = (
        F.when(F.col("side") == "added", "Added").when(F.col("side") == "removed", "Removed").when(F.size("regressions") > 0, "Regressed")
        .when(F.size("improvements") > 0, "Improved").when(F.size("changes") > 0, "Changed").otherwise("Unchanged")
    )
    is_worse = F.when(paired, F.size("regressions") > 0).otherwise(one_sided_bad)
    return out.withColumns({"kind": kind, "is_regression": is_worse, "is_improvement": paired & (F.size("regressions") == 0) & (F.size("improvements") > 0)})


def diff_summary(diffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    kinds = ("Unchanged", "Changed", "Added", "Removed")
    return diffs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("projects"), *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds],
        F.count_if("is_improvement").alias("improvements"), F.count_if("is_regression").alias("regressions"),
    )


# --- scenario status -----------------------------------------------------------------------------------

# Stages of a scenario and outcomes that stop it.
SOURCE_STAGES = ("SourceRestore", "SourceBuild", "SourceTest")
BROKEN = ("InfrastructureFailure", "TimedOut")
STAGE_NAMES = (*SOURCE_STAGES, "Migration", "ProjectVerify", "TargetBuild", "TargetTest")


def stage_table(stages: DataFrame, run: Sequence[str]) -> DataFrame:
    """Last outcome and exit code of each stage as columns of one row per run (stages are a fixed few)."""
    pick = lambda name: F.max(F.when(F.col("stage") == name, F.struct("ord", "outcome", "exit_code"))).alias(name)
    return stages.groupBy(*run).agg(*[pick(name) for name in STAGE_NAMES])


def scenario_status(runs: DataFrame) -> DataFrame:
    """Actual status of each run by the ordered policy.

    runs: a :func:`stage_table` with expected_status, source_preserved, artifacts_present,
    failed_stages, orchestration, verify_present, verify_status, verify_categories,
    quality_passed, oracle_passed, todo, unmapped, unsupported, warnings.
    """
    out = lambda name: F.col(f"{name}.outcome")
    absent = lambda name: F.col(name).isNull() | (out(name) == "Skipped")
    broken = lambda name: F.coalesce(out(name).isin(*BROKEN), F.lit(False))
    failed = lambda name: F.coalesce(out(name) == "Failed", F.lit(False))
    any_of = lambda f, names: F.greatest(*[f(n) for n in names])
    unverified = failed("ProjectVerify") | (F.lower("verify_status") != "passed")
    known_restore = (F.col("expected_status") == "InfrastructureFailure") & F.exists("verify_categories", lambda x: F.lower(x) == "nuget-restore")
    warned = (F.col("todo") > 0) | (F.col("unmapped") > 0) | (F.col("unsupported") > 0)
    partial = F.lower("orchestration") == "passedwithwarnings"
    expected_gap = F.col("expected_status") == "UnsupportedAsExpected"
    evidence = warned | (F.col("Migration.exit_code") == 1) | partial
    rules = [
        ("InfrastructureFailure", any_of(broken, SOURCE_STAGES)),
        ("SourceInvalid", any_of(failed, SOURCE_STAGES)),
        ("MigratorFailure", absent("Migration")),
        ("InfrastructureFailure", broken("Migration")),
        ("MigratorFailure", ~F.col("source_preserved") | ~F.col("artifacts_present")),
        ("Regression", (F.size("failed_stages") > 0) | (F.lower("orchestration") == "failed")),
        ("MigratorFailure", failed("Migration") & ~F.coalesce(F.col("Migration.exit_code") == 1, F.lit(False))),
        ("MigratorFailure", absent("ProjectVerify")),
        ("InfrastructureFailure", broken("ProjectVerify")),
        ("MigratorFailure", ~F.col("verify_present")),
        ("InfrastructureFailure", unverified & known_restore),
        ("Regression", unverified),
    ]
    for stage in ("TargetBuild", "TargetTest"):
        rules += [("Regression", absent(stage)), ("InfrastructureFailure", broken(stage)), ("Regression", failed(stage))]
    rules += [
        ("Regression", ~F.col("quality_passed") | ~F.col("oracle_passed")),
        ("UnsupportedAsExpected", expected_gap & evidence),
        ("Regression", expected_gap),
        ("PassWithWarnings", warned | (F.col("warnings") > 0) | partial),
    ]
    return runs.withColumn("actual_status", first_flag([(n, F.coalesce(x, F.lit(False))) for n, x in rules], "Pass"))


# --- triage ---------------------------------------------------------------------------------------------

# Stage that stands for a status when no stage failed, and limits of automatic repair.
STATUS_STAGE = {"NonDeterministic": "determinism", "MigratorFailure": "migration", "InfrastructureFailure": "infrastructure", "SourceInvalid": "source-validation"}
MANUAL_STATUS = ("SourceInvalid", "InfrastructureFailure", "NonDeterministic")
MANUAL_STAGE = ("infrastructure", "source-validation", "determinism")
MANUAL_FEATURES = ("IJavaScriptExecutor", "Actions", "Dynamic", "RawStatement")
PROJECT_FEATURES = ("ProjectReference", "CentralPackageManagement", "MultiTargeting")
SEED_TAGS = ("generated", "metamorphic")
MAX_COMPONENTS = 3


def _overlap(col: str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.col(col), F.array(*[F.lit(v) for v in values]))


def triage_findings(runs: DataFrame, max_components: int = MAX_COMPONENTS) -> DataFrame:
    """Findings of a run: stage, codes, regression level and disposition.

    runs(id, expected_status, actual_status, failed_stage (kebab case or null),
    verify_present, verify_status, quality_passed, oracle_passed, categories, semantics,
    features, tags, template, components).
    """
    unexpected = F.col("actual_status") != F.col("expected_status")
    weak_pass = (F.col("expected_status") == "Pass") & (~F.col("quality_passed") | ~F.col("oracle_passed"))
    by_status = F.create_map(*[F.lit(x) for kv in STATUS_STAGE.items() for x in kv])
    stage = F.coalesce(
        F.col("failed_stage"),
        F.when(~F.col("verify_present") | (F.lower("verify_status") == "failed"), F.lit("project-verify")),
        F.when(~F.col("oracle_passed"), F.lit("semantic-oracle")), F.when(~F.col("quality_passed"), F.lit("quality-evaluation")),
        F.try_element_at(by_status, F.col("actual_status")), F.lit("migration"),
    )
    extra = matching_labels(
        [("QUALITY_BUDGET", ~F.col("quality_passed")), ("SEMANTIC_ORACLE", ~F.col("oracle_passed")), ("NON_DETERMINISTIC", F.col("actual_status") == "NonDeterministic")]
    )
    codes = F.array_sort(F.array_distinct(F.filter(F.concat("categories", extra), lambda x: F.length(F.trim(x)) > 0)))
    found = runs.where(unexpected | weak_pass).withColumns({"stage": stage, "diagnostics": codes})
    project_level = (
        F.contains("stage", F.lit("project")) | F.contains("stage", F.lit("target-build")) | _overlap("features", PROJECT_FEATURES)
        | F.coalesce(F.lower("template") == "multi-project", F.lit(False))
    )
    level = F.when(_overlap("tags", SEED_TAGS), "SavedSeed").when(project_level, "ProjectFixture").otherwise("UnitTest")
    manual = (
        F.col("actual_status").isin(*MANUAL_STATUS) | (F.col("expected_status") != "Pass") | F.col("stage").isin(*MANUAL_STAGE) | _overlap("features", MANUAL_FEATURES)
        | F.exists("diagnostics", lambda x: F.contains(F.lower(x), F.lit("nuget"))) | (F.size(F.array_distinct("components")) > max_components)
    )
    return found.withColumns({"regression_level": level, "disposition": F.when(manual, "ManualReview").otherwise("AutoFixEligible")})


def triage(runs: DataFrame, families: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    findings = triage_findings(runs)
    clusters, members = issue_clusters(findings, families)
    return {"findings": findings, "clusters": clusters, "members": members}


# --- gates ----------------------------------------------------------------------------------------------


def release_gate(run: DataFrame, baseline: DataFrame, evidence: DataFrame, as_of: Column, max_days: int = 14, schema: str = "real-project-evidence/v1") -> DataFrame:
    """Issues that block a release, with how often each occurs; an empty result passes.

    run(id, expected_status, actual_status, contract_hash), baseline(id, contract_hash),
    evidence(project, source_revision, tool_revision, status, executed_at,
    schema_version, artifacts ARRAY<STRUCT<path, size>>).
    """
    blank = lambda c: F.coalesce(F.length(F.trim(F.col(c))), F.lit(0)) == 0
    age = evidence_age("executed_at", as_of, max_days)
    checks = matching_labels(
        [
            ("evidence-schema", F.col("schema_version") != schema), ("evidence-project-missing", blank("project")),
            ("evidence-revision-missing", blank("source_revision") | blank("tool_revision")), ("evidence-status", F.lower("status") != "pass"),
            ("evidence-without-artifact", F.size("artifacts") == 0), ("evidence-artifact-empty", F.exists("artifacts", lambda a: a["size"] <= 0)),
            ("evidence-none-verified", (F.size("artifacts") > 0) & ~F.exists("artifacts", lambda a: a["size"] > 0)),
            ("evidence-in-future", age["future"]), ("evidence-stale", age["stale"]),
        ]
    )
    from_evidence = evidence.select(F.explode(checks).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    unexpected = run.where(F.col("actual_status") != F.col("expected_status")).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("unexpected-outcome").alias("issue"), "n")
    changed = contract_changes(run, baseline).groupBy(F.col("reason").alias("issue")).agg(F.count(F.lit(1)).alias("n"))
    return from_evidence.unionByName(unexpected).unionByName(changed)


SIGNATURE_FIELDS = ("actual_status", "source_passed", "source_expected", "target_passed", "target_expected", "todo", "unmapped", "unsupported", "warnings", "quality_passed", "oracle_passed")


def signature(row: str) -> Column:
    fields = [F.concat(F.lit(f"{n}="), F.col(f"{row}.{n}").cast("string")) for n in SIGNATURE_FIELDS]
    return F.concat_ws("|", *fields, F.concat(F.lit("diagnostics="), F.array_join(F.array_sort(F.col(f"{row}.categories")), ",")))


def metamorphic_check(variants: DataFrame, run: DataFrame, family: Sequence[str] = ("family",)) -> DataFrame:
    """Variants of a family must look like its reference: first healthy one in order, else the first present.

    variants(family, id, ord, expected_status), run(id, ..., source_preserved). The
    reference signature is one aggregate row per family and joined back.
    """
    rows = variants_with_run(variants, run, "id").withColumn("signature", F.when(F.col("missing"), F.lit("missing")).otherwise(signature("run")))
    r = lambda n: F.col(f"run.{n}")
    strict = F.col("run.expected_status") == "Pass"
    healthy = (r("actual_status") == r("expected_status")) & r("source_preserved") & (~strict | (r("quality_passed") & r("oracle_passed")))
    ref = rows.where(~F.col("missing")).groupBy(*family).agg(
        F.min_by(F.struct("id", "signature"), F.struct(~healthy, F.col("ord"))).alias("reference")
    )
    joined = rows.join(ref, list(family), "left")
    flag = lambda cond: ~F.col("missing") & F.coalesce(cond, F.lit(False))
    wants_pass = F.col("expected_status") == "Pass"
    reasons = matching_labels(
        [
            ("missing-from-run", F.col("missing")), ("unexpected-status", flag(r("actual_status") != F.col("expected_status"))), ("source-changed", flag(~r("source_preserved"))),
            ("quality-changed", flag(wants_pass & ~r("quality_passed"))), ("oracle-changed", flag(wants_pass & ~r("oracle_passed"))),
            ("signature-differs", flag(F.col("signature") != F.col("reference.signature"))),
        ]
    )
    judged = joined.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
    useful = (
        ~F.col("missing") & ~F.col("passed") & (r("source_passed") >= r("source_expected")) & ~r("actual_status").isin("SourceInvalid", "InfrastructureFailure")
        & (r("actual_status").isin("Regression", "MigratorFailure", "NonDeterministic") | ~r("quality_passed") | ~r("oracle_passed"))
    )
    return judged.withColumn("useful_candidate", F.coalesce(useful, F.lit(False)))


def determinism_check(a: DataFrame, b: DataFrame, by: Sequence[str], exits: DataFrame, path: str = "path", sha: str = "sha") -> DataFrame:
    """IDENTICAL per invocation only when every file and the exit codes agree.

    a/b(by..., path, sha); exits(by..., exit_a, exit_b). The digest of a run is equal
    exactly when its files are, so the file comparison decides.
    """
    keyed = lambda df: df.withColumn("_p", F.struct(*by, path))
    diffs = tree_diff(keyed(a).select("_p", sha), keyed(b).select("_p", sha), "_p", sha)
    counts = diffs.select(*[F.col(f"_p.{c}").alias(c) for c in by]).groupBy(*by).agg(F.count(F.lit(1)).alias("differing_files"))
    joined = exits.join(counts, list(by), "left").withColumn("differing_files", F.coalesce("differing_files", F.lit(0)))
    same = (F.col("differing_files") == 0) & (F.col("exit_a") == F.col("exit_b"))
    return joined.withColumn("verdict", F.when(same, "IDENTICAL").otherwise("DIFFERENT"))
