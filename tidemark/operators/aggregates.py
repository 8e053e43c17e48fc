"""Aggregates A1-A27. All of them combine before the shuffle; none collects an unbounded group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clamp, half_even, trim_all
from tidemark.operators.joins import family
from tidemark.operators.lines import is_active_line
from tidemark.operators.ranking import rank_of, top_k, top_k_per


def n() -> Column:
    return F.count(F.lit(1))


# --- reports and quality ---------------------------------------------------------------------------


def file_report(actions: DataFrame, keys: Sequence[str], todos: DataFrame | None = None) -> DataFrame:
    """Per-file counts and converted tests.

    actions(keys..., test, in_setup, confidence, target_kind, is_unsupported); todos has
    the keys with ``todo`` and ``empty_after`` counts. Tests reduce first, then files,
    so a file with very many actions combines on the map side twice.
    """
    unsupported = F.col("is_unsupported")
    per_test = actions.groupBy(*keys, "test", "in_setup").agg(
        F.count_if(F.col("confidence") == "Semantic").alias("semantic"),
        F.count_if(F.col("confidence") == "SyntaxFallback").alias("fallback"),
        F.count_if(unsupported).alias("unsupported"),
        F.count_if(F.col("target_kind").isNotNull() & (F.col("target_kind") != "Unresolved")).alias("mapped"),
        F.count_if(F.col("target_kind") == "Unresolved").alias("unmapped"),
    )
    body = ~F.col("in_setup")
    per_file = per_test.groupBy(*keys).agg(
        F.count_if(body).alias("total_tests"),
        F.count_if(body & (F.col("unsupported") == 0)).alias("_clean"),
        F.bool_or(F.col("in_setup") & (F.col("unsupported") > 0)).alias("_setup_bad"),
        *[F.sum(c).alias(c) for c in ("semantic", "fallback", "unsupported", "mapped", "unmapped")],
    )
    joined = per_file if todos is None else per_file.join(todos.select(*keys, "todo", "empty_after"), list(keys), "left")
    if todos is None:
        joined = joined.withColumns({"todo": F.lit(0), "empty_after": F.lit(0)})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    converted = F.when(F.col("_setup_bad"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("_clean") - zero("empty_after")))
    return joined.select(
        *keys, "total_tests", converted.cast("bigint").alias("converted_tests"), "semantic", "fallback", "unsupported", "mapped", "unmapped", zero("todo").alias("todo")
    )


REPORT_COUNTS = ("total_tests", "converted_tests", "semantic", "fallback", "unsupported", "mapped", "unmapped", "todo")


def run_summary(file_reports: DataFrame, by: Sequence[str]) -> DataFrame:
    return file_reports.groupBy(*by).agg(
        n().alias("files"), *[F.sum(c).alias(c) for c in REPORT_COUNTS],
        F.count_if((F.col("todo") > 0) | (F.col("unmapped") > 0) | (F.col("unsupported") > 0)).alias("files_with_warnings"),
    )


def quality_level(runs: DataFrame) -> DataFrame:
    """Coverage, densities (half-even) and the quality level of a run."""
    total = F.col("mapped") + F.col("unmapped")
    tests = F.greatest(F.col("total_tests"), F.lit(1))
    coverage = F.when(total == 0, F.lit(100.0)).otherwise(half_even(F.col("mapped") * 100.0 / total, 2))
    per_test = lambda c: half_even(F.col(c) * 1.0 / tests, 2)
    measured = runs.withColumns({"coverage": coverage, "todo_per_test": per_test("todo"), "unsupported_per_test": per_test("unsupported")})
    clean = (F.col("unsupported") == 0) & (F.col("unmapped") == 0) & (F.col("todo") == 0)
    level = (
        F.when(clean, "clean")
        .when((F.col("coverage") >= 90) & (F.col("unsupported_per_test") <= 0.10) & (F.col("todo_per_test") <= 0.25), "near_ready")
        .when(F.col("coverage") >= 70, "needs_profile_iteration")
        .otherwise("needs_discovery")
    )
    return measured.withColumn("level", level)


def count_with_example(df: DataFrame, by: Sequence[str], example_cols: Sequence[str]) -> DataFrame:
    """Count per group with its first example; first means smallest in the order of ``example_cols``."""
    agg = df.groupBy(*by).agg(n().alias("n"), F.min(F.struct(*example_cols)).alias("_e"))
    return agg.select(*by, "n", *[F.col(f"_e.{c}").alias(f"example_{c}") for c in example_cols])


def occurrences(df: DataFrame, by: Sequence[str], file_col: str, weight: str | None = None) -> DataFrame:
    """Occurrences and distinct affected files per group. Files reduce per (group, file) first."""
    per_file = df.groupBy(*by, file_col).agg((F.sum(weight) if weight else n()).alias("_w"))
    return per_file.groupBy(*by).agg(F.sum("_w").alias("occurrences"), n().alias("files"), F.min(file_col).alias("example_file"))


def affected_files(df: DataFrame, by: Sequence[str], file_col: str) -> DataFrame:
    """The affected files themselves, as rows: a group may touch any number of them."""
    return df.select(*by, file_col).distinct()


def is_parameterized(df: DataFrame, base: Sequence[str], full: str) -> DataFrame:
    """Whether a method is called with more than one argument list; min and max decide, nothing is collected."""
    return df.groupBy(*base).agg(n().alias("calls"), (F.min(full) != F.max(full)).alias("parameterized"), F.min(full).alias("example"))


def frequency_confidence(facts: DataFrame, by: Sequence[str], weight: str, high: int = 10, medium: int = 3) -> DataFrame:
    counted = facts.groupBy(*by).agg(F.sum(weight).alias("n"))
    return counted.withColumn("confidence", F.when(F.col("n") >= high, "High").when(F.col("n") >= medium, "Medium").otherwise("Low"))


# --- reuse ------------------------------------------------------------------------------------------

# Thresholds of the reuse verdict.
REUSE_LEVELS = ((70, "high-reuse"), (40, "partial-reuse"))


def reuse_ratio(rules: DataFrame, hits: DataFrame, by: Sequence[str], rule_id: str, count_col: str | None = None) -> DataFrame:
    """Share of rules with at least one hit, per layer (or overall with no ``by``), and with ``count_col`` the hits."""
    counted = F.sum(count_col) if count_col else F.lit(None).cast("bigint")
    used = hits.groupBy(rule_id).agg(F.lit(1).alias("_used"), counted.alias("_hits"))
    agg = rules.join(used, rule_id, "left").groupBy(*by).agg(n().alias("rules"), F.count("_used").alias("matched"), *([F.coalesce(F.sum("_hits"), F.lit(0)).alias("hits")] if count_col else []))
    score = F.when(F.col("rules") == 0, 0.0).otherwise(half_even(100.0 * F.col("matched") / F.col("rules"), 1))
    verdict = F.when(F.col("score") >= 70, REUSE_LEVELS[0][1]).when(F.col("score") >= 40, REUSE_LEVELS[1][1]).when(F.col("score") > 0, "low-reuse").otherwise("no-signal")
    return agg.withColumn("score", score).withColumn("verdict", verdict)


# --- failures ---------------------------------------------------------------------------------------

# Severity and root cause of each failure category.
CATEGORY_SEVERITY = {
    "auth/session-not-ready": "error", "environment/flaky-infra": "error", "strict-mode-violation": "warning", "locator-not-found": "warning",
    "assertion-mismatch": "warning", "timeout-wait-state": "warning", "navigation-route-missing": "warning", "test-data-missing": "warning",
    "modal/dialog-state": "warning", "frame/shadow-dom": "warning",
}
ROOT_CAUSES = {
    "locator-not-found": "selector-evidence-gap", "strict-mode-violation": "selector-evidence-gap", "frame/shadow-dom": "selector-context-gap",
    "timeout-wait-state": "wait-or-product-state-gap", "navigation-route-missing": "navigation-or-route-gap",
    "assertion-mismatch": "assertion-semantics-gap", "auth/session-not-ready": "environment-auth-gap",
    "environment/flaky-infra": "environment-auth-gap", "test-data-missing": "test-data-setup-gap", "modal/dialog-state": "modal-dialog-state-gap",
}
SEVERITY_WEIGHT = {"error": 3, "warning": 2, "info": 1}
ENVIRONMENT_CATEGORIES = ("auth/session-not-ready", "environment/flaky-infra")


def label_of(c: str, table: Mapping[str, str], default: str) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.col(c)), F.lit(default))


def failure_groups(
    obs: DataFrame, by: Sequence[str] = (), severity: Mapping[str, str] = CATEGORY_SEVERITY, causes: Mapping[str, str] = ROOT_CAUSES
) -> tuple[DataFrame, DataFrame]:
    """(groups, causes): counts per category, then per root cause with the severity of its top group."""
    groups = obs.groupBy(*by, "category").agg(n().alias("n")).withColumn("severity", label_of("category", severity, "info"))
    caused = groups.withColumn("root_cause", label_of("category", causes, "unclassified-runtime-gap"))
    weight = rank_of("severity", SEVERITY_WEIGHT, 1)
    rolled = caused.groupBy(*by, "root_cause").agg(
        F.sum("n").alias("n"), F.max_by("severity", F.struct(weight, F.col("n"))).alias("severity"), F.array_sort(F.collect_set("category")).alias("categories")
    )
    return groups, rolled


def readiness(groups: DataFrame, by: Sequence[str], traces: Column, links: Column) -> DataFrame:
    """Readiness score 0..100 of a run from its failure groups; ``traces`` and ``links`` are counts per run."""
    weight = rank_of("severity", SEVERITY_WEIGHT, 1)
    agg = groups.groupBy(*by).agg(
        F.sum(weight * F.least(F.col("n"), F.lit(10)) * 4).alias("_cost"), F.bool_or(F.col("category").isin(*ENVIRONMENT_CATEGORIES)).alias("_env")
    )
    score = 100 - F.col("_cost") - F.when(F.col("_env"), 25).otherwise(0) - F.when(traces == 0, 15).otherwise(0) - F.when(links == 0, 5).otherwise(0)
    scored = agg.withColumn("score", clamp(score).cast("bigint")).drop("_cost", "_env")
    level = F.when(F.col("score") >= 85, "ready").when(F.col("score") >= 65, "nearly-ready").when(F.col("score") >= 40, "needs-targeted-fixes").otherwise("blocked")
    return scored.withColumn("level", level)


# --- helpers ----------------------------------------------------------------------------------------

# Priority of helper semantics and of risks (first present wins).
SEMANTICS_PRIORITY = ("RequiredSideEffect", "ProjectWaitHelper", "AssertionHelper", "UnknownUnsafe", "ReadOnlyProbe", "SafeWaitElide")
RISK_PRIORITY = ("high", "medium", "unknown", "low")


def _first_present(col: str, labels: Sequence[str]) -> Column:
    ranks = {label: i for i, label in enumerate(labels)}
    names = F.array(*[F.lit(label) for label in labels])
    return F.get(names, F.min(rank_of(col, ranks, len(labels) - 1)))


def helper_families(helpers: DataFrame, by: str = "name", top: int | None = None) -> DataFrame:
    """Families of helpers by name, ignoring case: count, mean confidence, worst semantics and risk, evidence by frequency.

    Evidence labels are a small vocabulary of kinds and are counted per (family, label) before they are gathered;
    ``top`` keeps the most frequent of a family.
    """
    keyed = helpers.withColumn("_k", F.lower(F.col(by)))
    fam = keyed.groupBy("_k").agg(
        F.min(by).alias("name"), n().alias("occurrences"), half_even(F.avg("confidence"), 2).alias("confidence"),
        _first_present("semantics", SEMANTICS_PRIORITY).alias("semantics"), _first_present("risk", RISK_PRIORITY).alias("risk"),
    )
    counts = keyed.select("_k", F.explode("evidence").alias("label")).groupBy("_k", "label").agg(n().alias("c"))
    lead = counts.withColumn("rank", F.row_number().over(Window.partitionBy("_k").orderBy(F.col("c").desc(), "label")))
    lead = lead if top is None else lead.where(F.col("rank") <= top)
    evidence = lead.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "c"))).alias("_e"))
    text = F.transform("_e", lambda e: F.concat(e["label"], F.lit(" ("), e["c"].cast("string"), F.lit(")")))
    return fam.join(evidence, "_k", "left").withColumn("top_evidence", F.coalesce(text, F.array().cast("array<string>"))).drop("_k", "_e")


def gathered(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Distinct elements of an array column per group, sorted; elements are reduced to distinct rows before they meet."""
    return df.select(*by, F.explode(col).alias("_v")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias(col))


def base_class_usage(types: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Base classes by use, with the distinct attributes of their classes and a confidence."""
    based = types.where(F.col("base_class").isNotNull())
    counted = based.groupBy(*by, "base_class").agg(n().alias("usage"), F.min("namespace").alias("namespace"))
    used = counted.join(gathered(based, [*by, "base_class"], "attributes"), [*by, "base_class"], "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
    used = used.select(*by, "base_class", "usage", "attributes", "namespace")
    return used.withColumn("confidence", F.when(F.col("usage") >= 3, "High").otherwise("Medium"))


# --- runs -------------------------------------------------------------------------------------------


def status_counts(runs: DataFrame, by: Sequence[str], col: str, labels: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(n().alias("total"), *[F.count_if(F.col(col) == x).alias(f"n_{x}") for x in labels])


# Exit codes of unexpected statuses, most severe first, and of an accepted suite.
EXIT_ORDER = (("MigratorFailure", 11), ("Regression", 10), ("SourceInvalid", 12), ("InfrastructureFailure", 13), ("NonDeterministic", 14))
EXIT_ACCEPTED, EXIT_OTHER = 0, 10


def suite_exit_code(runs: DataFrame, by: Sequence[str], order: Sequence[tuple[str, int]] = EXIT_ORDER) -> DataFrame:
    """Exit code per suite: the first status in order that occurs unexpectedly."""
    unexpected = F.col("actual_status") != F.col("expected_status")
    position = F.when(unexpected, rank_of("actual_status", {s: i for i, (s, _) in enumerate(order)}, len(order)))
    agg = runs.groupBy(*by).agg(F.min(position).alias("_p"), F.count_if(unexpected).alias("unexpected"))
    codes = F.array(*[F.lit(code) for _, code in order], F.lit(EXIT_OTHER))
    return agg.select(*by, "unexpected", F.coalesce(F.get(codes, F.col("_p")), F.lit(EXIT_ACCEPTED)).alias("exit_code"))


SEVERE, MEDIUM_STATUS = ("MigratorFailure", "NonDeterministic"), "Regression"
MAX_COMPONENTS = 3


def cluster_key(families: Mapping[str, Sequence[str]] | None = None) -> Column:
    fam = (lambda x: family(x, families)) if families else family
    feats = F.array_sort(F.array_distinct(F.filter(F.transform("features", fam), lambda x: F.length(x) > 0)))
    return F.concat(
        F.lit("stage="), F.col("stage"), F.lit("|diag="), F.array_join("diagnostics", ","), F.lit("|semantic="), F.array_join("semantics", ","),
        F.lit("|features="), F.array_join(feats, ","),
    )


def issue_clusters(findings: DataFrame, families: Mapping[str, Sequence[str]] | None = None, max_components: int = MAX_COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """(clusters, members). Findings share a cluster when stage, codes, semantic kinds and feature families agree.

    Unions are over small vocabularies (features, components), reduced to distinct rows before they meet. Scenario ids are rows of ``members``, never one list per cluster. The
    component budget is judged on the full union. A cluster's id is the short hash of
    its key, the same in every run.
    """
    keyed = findings.withColumn("fingerprint", cluster_key(families))
    agg = keyed.groupBy("fingerprint").agg(
        F.min("stage").alias("stage"), n().alias("findings"),
        F.bool_or(F.col("actual_status").isin(*SEVERE)).alias("_high"), F.bool_or(F.col("actual_status") == MEDIUM_STATUS).alias("_medium"),
        F.bool_and(F.col("disposition") == "AutoFixEligible").alias("_auto"),
        F.bool_or(F.col("regression_level") == "ProjectFixture").alias("_project"), F.bool_and(F.col("regression_level") == "SavedSeed").alias("_seed"),
    )
    for c in ("features", "components"):
        agg = agg.join(gathered(keyed, ["fingerprint"], c), "fingerprint", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    cid = F.concat(F.lit("cluster-"), F.substring(F.sha2("fingerprint", 256), 1, 8))
    clusters = agg.select(
        cid.alias("cluster_id"), "fingerprint", "stage", "findings", "features", "components",
        F.when(F.col("_high"), "high").when(F.col("_medium"), "medium").otherwise("low").alias("severity"),
        F.when(F.col("_project"), "ProjectFixture").when(F.col("_seed"), "SavedSeed").otherwise("UnitTest").alias("regression_level"),
        F.when(F.col("_auto") & (F.size("components") <= max_components), "AutoFixEligible").otherwise("ManualReview").alias("disposition"),
    )
    return clusters, keyed.select(cid.alias("cluster_id"), "id")


def merge_metrics(after: DataFrame, before: DataFrame, by: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Metrics of many artefacts: the greatest value per name, against the same of the run before."""
    cur = after.groupBy(*by, name).agg(F.max(value).alias("after"))
    old = before.groupBy(*by, name).agg(F.max(value).alias("before"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = cur.join(old, [*by, name], "full_outer")
    return joined.select(*by, name, zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("delta"))


def duplicate_keys(df: DataFrame, by: Sequence[str], key: str, ord_col: str) -> DataFrame:
    """Second and later rows of a key with the position of the first; blank keys do not count."""
    k = F.trim(F.col(key))
    rows = df.withColumn("_k", k).where(F.length("_k") > 0)
    first = rows.groupBy(*by, "_k").agg(F.min(ord_col).alias("first_position"), n().alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(first, [*by, "_k"]).where(F.col(ord_col) > F.col("first_position"))
    return joined.select(*by, F.col("_k").alias(key), F.col(ord_col).alias("position"), "first_position")


def section_sizes(before: DataFrame, after: DataFrame, section: str) -> DataFrame:
    """Entries per section on both sides; one shuffle over the union."""
    both = before.select(section, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(section, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    agg = both.groupBy(section).agg(F.sum("_b").alias("before"), F.sum("_a").alias("after"))
    return agg.withColumn("change", F.col("after") - F.col("before"))


def missing_pairs(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Value pairs of every two dimensions that never occur together. Domains are configuration."""
    dims = list(domains)
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1 :]]
    seen = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("dim_a"), F.col(a).cast("string").alias("value_a"), F.lit(b).alias("dim_b"), F.col(b).cast("string").alias("value_b")) for a, b in pairs])
        ).alias("p")
    ).select("p.*").distinct()
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("dim_a"), F.lit(str(x)).alias("value_a"), F.lit(b).alias("dim_b"), F.lit(str(y)).alias("value_b"))
            for a, b in pairs for x in domains[a] for y in domains[b]
        ]
    )
    grid = df.sparkSession.range(1).select(F.explode(cells).alias("p")).select("p.*")
    return grid.join(seen, ["dim_a", "value_a", "dim_b", "value_b"], "left_anti")


# Categories of repeated open points in run artefacts.
CLUSTER_PATTERNS = (
    ("unresolvedSymbols", r"(?i)\bUNRESOLVED_SYMBOL\b.*"),
    ("unmappedActions", r"(?i)\bUNMAPPED(?:_TARGET|_ACTION)?\b.*"),
    ("todoClusters", r"(?i)\bTODO\b.*"),
    ("syntaxFallbacks", r"(?i)\bSYNTAX_FALLBACK\b.*"),
    ("verificationBlockers", r"(?i)\b(?:VERIFY_PROJECT|VALIDATION).*(?:FAIL|BLOCK|MISSING|ERROR).*"),
)


def pattern_clusters(lines: DataFrame, k: int | None = None, patterns: Sequence[tuple[str, str]] = CLUSTER_PATTERNS, line_col: str = "line") -> DataFrame:
    """Repeated texts per category, most frequent first; with ``k`` the first k overall."""
    found = F.array(
        *[
            F.when(F.rlike(F.col(line_col), F.lit(p)), F.struct(F.lit(c).alias("category"), trim_all(F.regexp_extract(line_col, p, 0)).alias("text")))
            for c, p in patterns
        ]
    )
    hits = lines.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("h")).select("h.*").where(F.length("text") > 0)
    counts = hits.groupBy("category", "text").agg(n().alias("occurrences"))
    return top_k(counts, k, F.col("occurrences").desc(), "category", "text")


def root_causes(todos: DataFrame, key_rules: Sequence[tuple[str, str, int]], by: Sequence[str] = (), examples: int = 5, file_col: str = "file", ord_col: str = "line_no") -> DataFrame:
    """Normalised groups of TODO messages: (prefix, pattern, group) rules give the key, the first match wins.

    Rules are ours where no formula is public: a message without a match groups under its
    code. Representative files are limited per group before they are gathered.
    """
    key = None
    for prefix, pattern, group in key_rules:
        text = F.regexp_extract("message", pattern, group)
        cond, value = text != "", F.concat(F.lit(prefix + ":"), text)
        key = F.when(cond, value) if key is None else key.when(cond, value)
    keyed = todos.withColumn("group_key", key.otherwise(F.col("code")))
    groups = keyed.groupBy(*by, "group_key").agg(n().alias("n"), F.min(F.struct(file_col, ord_col)).alias("_e"))
    files = keyed.select(*by, "group_key", file_col).distinct()
    lead = top_k_per(files, [*by, "group_key"], examples, file_col).groupBy(*by, "group_key").agg(F.array_sort(F.collect_list(file_col)).alias("files"))
    touched = files.groupBy(*by, "group_key").agg(n().alias("file_count"))
    joined = groups.join(lead, [*by, "group_key"]).join(touched, [*by, "group_key"])
    return joined.select(*by, "group_key", "n", "file_count", F.col(f"_e.{file_col}").alias("example_file"), F.col(f"_e.{ord_col}").alias("example_line"), "files")


def method_stats(lines: DataFrame, by: Sequence[str], test_col: str = "test", line_col: str = "line") -> DataFrame:
    """Active, TODO, await, assertion and locator lines per test, active ratio and readiness level.

    Level thresholds are ours: 5 with no TODO and an assertion, 4 with no TODO, 3 from
    half active lines, 2 from any active line, else 1.
    """
    line = F.col(line_col)
    has = lambda *words: F.rlike(line, F.lit("|".join(words)))
    todo = F.contains(line, F.lit("TODO"))
    agg = lines.where(F.col(test_col).isNotNull()).groupBy(*by, test_col).agg(
        n().alias("lines"), F.count_if(is_active_line(line)).alias("active_lines"), F.count_if(todo).alias("todo_lines"),
        F.count_if(has("await ")).alias("awaits"), F.count_if(has("Assert", "Expect", "Should")).alias("assertions"),
        F.count_if(has(r"Locator\(", "GetBy", r"locator\(", "getBy")).alias("locators"),
    )
    executable = F.col("active_lines") + F.col("todo_lines")
    ratio = F.when(executable == 0, 0.0).otherwise(half_even(F.col("active_lines") / executable, 2))
    staged = agg.withColumn("active_ratio", ratio)
    level = (
        F.when((F.col("todo_lines") == 0) & (F.col("assertions") > 0), 5).when((F.col("todo_lines") == 0) & (F.col("active_lines") > 0), 4)
        .when(F.col("active_ratio") >= 0.5, 3).when(F.col("active_lines") > 0, 2).otherwise(1)
    )
    return staged.withColumn("level", level)


def review_status(lines: DataFrame, keys: Sequence[str], line_col: str = "line") -> DataFrame:
    """Signals of each changed file and how much review it still needs."""
    line = F.col(line_col)
    any_of = lambda words: F.rlike(line, F.lit("|".join(words)))
    agg = lines.groupBy(*keys).agg(
        F.count_if(F.contains(F.lower(line), F.lit("todo"))).alias("todo"), F.count_if(is_active_line(line)).alias("active"),
        F.count_if(any_of(["Assert", "Expect", "Should"])).alias("assertions"), F.count_if(any_of([r"Locator\(", "GetBy", r"locator\(", "getBy"])).alias("locators"),
    )
    return agg.withColumn("status", F.when(F.col("todo") == 0, "review-ready").when(F.col("todo") <= 3, "targeted-review").otherwise("needs-migration-work"))


# Overall review status by the worst risk.
REVIEW_STATUS = (("blocker", "blocked"), ("high", "needs-fixes"), ("medium", "review-with-risks"))


def overall_status(risks: DataFrame, by: Sequence[str], severity: str = "severity") -> DataFrame:
    worst = F.min(rank_of(severity, {s: i for i, (s, _) in enumerate(REVIEW_STATUS)}, len(REVIEW_STATUS)))
    labels = F.array(*[F.lit(s) for _, s in REVIEW_STATUS], F.lit("ready-for-review"))
    return risks.groupBy(*by).agg(F.get(labels, worst).alias("status"), n().alias("risks"))


def evidence_manifest(files: DataFrame, path_col: str, text_col: str, redacted: Column) -> DataFrame:
    """Checksum, size and redaction note per file; redacted text is what gets hashed."""
    changed = redacted != F.col(text_col)
    return files.select(
        *[c for c in files.columns if c != text_col], F.sha2(redacted, 256).alias("sha256"), F.octet_length(redacted).cast("bigint").alias("size_bytes"),
        F.when(changed, "redacted").otherwise("none").alias("redaction"),
    )


def manifest_kinds(manifest: DataFrame, kind: str, path_col: str, examples: int = 10) -> DataFrame:
    """Files per kind with at most ``examples`` paths."""
    counts = manifest.groupBy(kind).agg(n().alias("files"), F.sum("size_bytes").alias("size_bytes"))
    lead = top_k_per(manifest.select(kind, path_col), [kind], examples, path_col).groupBy(kind).agg(F.array_sort(F.collect_list(path_col)).alias("examples"))
    return counts.join(lead, kind)
