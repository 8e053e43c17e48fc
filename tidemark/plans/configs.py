"""Layered configuration: merge, delta merge, policy and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import SUPPRESSION_SECTION, broad_rule, dangerous_rule, matching_labels
from tidemark.functions.text import is_blank
from tidemark.operators.aggregates import duplicate_keys, section_sizes
from tidemark.operators.sets import distinct_trimmed
from tidemark.operators.windows import internal_conflicts, last_wins, ordered_merge


def merge_layers(rules: DataFrame, by: Sequence[str] = ("section",), key: str = "key", ord_col: str = "ord") -> DataFrame:
    """Layered rules: the last layer's value at the first layer's position; blank keys drop out."""
    return last_wins(rules, [*by, key], ord_col)


def merge_scalars(settings: DataFrame, by: Sequence[str], layer_ord: str, cols: Sequence[str]) -> DataFrame:
    """Last non-empty value of each setting over the layers; one aggregate for all settings."""
    def last(c: str) -> Column:
        empty = F.col(c).isNull() | (F.length(F.trim(F.col(c).cast("string"))) == 0)
        return F.max_by(F.when(~empty, F.col(c)), F.when(~empty, F.col(layer_ord))).alias(c)

    return settings.groupBy(*by).agg(*[last(c) for c in cols])


def merge_lists(values: DataFrame, by: Sequence[str], col: str, ord_col: str) -> DataFrame:
    """Union of list settings over the layers, distinct after trimming, in first-seen order."""
    return distinct_trimmed(values, col, ord_col, by)


# Safety switches of a delta that block it, and trust levels that do.
SAFETY_SWITCHES = ("assertionSuppressionAllowed", "overSuppressionAllowed", "autoPromotionAllowed")
UNSAFE_TRUST = ("dangerous", "deprecated")


def delta_safety(deltas: DataFrame) -> DataFrame:
    """Findings per delta file: switches, trust. deltas(delta_file, trust, safety MAP<STRING, BOOLEAN>)."""
    on = lambda name: F.coalesce(F.try_element_at("safety", F.lit(name)), F.lit(False))
    findings = matching_labels(
        [(f"dangerous-delta-safety:{n}", on(n)) for n in SAFETY_SWITCHES]
        + [("trust-missing", is_blank("trust")), ("unsafe-delta-trust", F.lower("trust").isin(*UNSAFE_TRUST))]
    )
    return deltas.select("delta_file", F.explode(findings).alias("finding"))


def merge_deltas(entries: DataFrame) -> DataFrame:
    """Status of every delta entry against base and earlier deltas.

    entries(section, key, canon, ord, is_base, delta_file): keys compare ignoring case.
    Entries that would suppress assertions are never applied.
    """
    keyed = entries.withColumn("_k", F.lower(F.col("key")))
    return ordered_merge(keyed, ["section", "_k"], "canon", "ord", dangerous_rule("section", "canon").isNotNull(), F.col("is_base")).drop("_k")


def validate_merge(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Problems of a merged candidate: lost entries, inner conflicts, assertion or broad suppression."""
    lost = section_sizes(base, candidate, "section").where(F.col("after") < F.col("before")).select(F.lit("candidate-removed-base-entry").alias("problem"), "section", F.lit(None).cast("string").alias("key"))
    inner = internal_conflicts(candidate, ["section", "key"], "canon", "ord").select(F.lit("candidate-internal-conflict").alias("problem"), "section", "key")
    suppressing = candidate.where(F.lower("section") == SUPPRESSION_SECTION.lower())
    bad = suppressing.withColumn("problem", F.explode(matching_labels([
        ("assertion-suppression", dangerous_rule("section", "canon").isNotNull()), ("broad-suppression", broad_rule("section", "canon"))
    ]))).select("problem", "section", "key")
    return lost.unionByName(inner).unionByName(bad)


# Generation policies.
CONSERVATIVE, BALANCED, AGGRESSIVE = "conservative", "balanced", "aggressive"
POLICY_SECTIONS = ("Methods", "ParameterizedMethods")


def apply_policy(rules: DataFrame, policy: Column | str, section_col: str = "section", review_col: str = "requires_review") -> DataFrame:
    """Review flags of method rules rewritten by the policy: conservative forces review, aggressive lifts it."""
    p = F.lower(F.trim(F.lit(policy) if isinstance(policy, str) else policy))
    known = F.when(p.isin(CONSERVATIVE, BALANCED, AGGRESSIVE), p).otherwise(F.lit(BALANCED))
    method = F.col(section_col).isin(*POLICY_SECTIONS)
    review = F.when(method & (known == CONSERVATIVE), True).when(method & (known == AGGRESSIVE), False).otherwise(F.col(review_col))
    note = F.when(method & (known != BALANCED), F.concat(F.lit("GenerationPolicy="), known))
    return rules.withColumns({review_col: review, "policy_note": note})


# --- validation -----------------------------------------------------------------------------------------

# Target kinds, match modes and placeholders with a meaning of their own.
TARGET_KINDS = ("TestId", "Locator", "Text", "PageObjectProperty", "RawExpression", "CssSelector", "TestIdBeginning", "ClassNameBeginning")
MATCH_MODES = ("First", "Nth")
SPECIAL_PLACEHOLDERS = r"^(?:result|TARGET|T|type|genericType|typeArgument|(?:T|type|genericType|arg|argument)\d+)$"
PLACEHOLDER = r"\{(\w+)\}"


def validate_rules(rules: DataFrame, by: Sequence[str] = ("section",), kinds: Sequence[str] = TARGET_KINDS, special: str = SPECIAL_PLACEHOLDERS) -> DataFrame:
    """Violations of mapping rules, one row each.

    rules(section, ord, key, target, target_kind, match_mode, idx, statements ARRAY).
    Row checks are one array per rule; only the duplicate check needs a shuffle.
    """
    ui = F.col("section") == "UiTargets"
    methods = F.col("section").isin("Methods", "ParameterizedMethods")
    no_statements = F.coalesce(F.size("statements"), F.lit(0)) == 0
    holes = F.array_distinct(F.regexp_extract_all(F.coalesce("key", F.lit("")), F.lit(PLACEHOLDER), F.lit(1)))
    used = F.array_distinct(F.flatten(F.transform(F.coalesce("statements", F.array().cast("array<string>")), lambda s: F.regexp_extract_all(s, F.lit(PLACEHOLDER), F.lit(1)))))
    unknown = F.filter(F.array_except(used, holes), lambda p: ~F.rlike(p, F.lit(special)))
    found = matching_labels(
        [
            ("missing-key", is_blank("key")),
            ("missing-target", ui & is_blank("target")),
            ("missing-kind", ui & is_blank("target_kind")),
            ("unsupported-kind", ui & ~is_blank("target_kind") & ~F.col("target_kind").isin(*kinds)),
            ("unknown-match", ui & F.col("match_mode").isNotNull() & ~F.col("match_mode").isin(*MATCH_MODES)),
            ("nth-without-index", ui & F.coalesce(F.col("match_mode") == "Nth", F.lit(False)) & F.col("idx").isNull()),
            ("no-statements", methods & ~is_blank("key") & no_statements & is_blank("target")),
            ("statements-and-target", (F.col("section") == "ParameterizedMethods") & ~no_statements & ~is_blank("target")),
            ("unknown-placeholder", (F.col("section") == "ParameterizedMethods") & (F.size(unknown) > 0)),
        ]
    )
    rows = rules.select(*by, F.col("ord").alias("position"), F.explode(found).alias("violation"))
    dup = duplicate_keys(rules.select(*by, "key", "ord"), by, "key", "ord").select(*by, "position", F.lit("duplicate-key").alias("violation"))
    return rows.unionByName(dup)


# Objects of a scenario contract with their required and further properties, and the id form.
CONTRACT_SHAPE = {
    "$": (("schemaVersion", "id", "tags", "source", "project", "app", "oracle", "qualityBudget", "expected", "implementation"), ("seed",)),
    "$.source": (("language", "testFramework", "template", "features", "migrationFiles"), ("adapterConfig",)),
    "$.project": (("entryProject", "files"), ("references", "msBuild")),
    "$.project.msBuild": ((), ("nullable", "implicitUsings", "fileScopedNamespace")),
    "$.app": (("baseUrlEnvironmentVariable", "pages"), ()),
    "$.qualityBudget": ((), ("todoMax", "unmappedMax", "unsupportedMax", "warningsMax")),
    "$.expected": (("status",), ()),
    "$.implementation": (("state", "block"), ("notes", "contentHash")),
}
SCENARIO_ID = r"^[a-z0-9][a-z0-9-]{1,78}[a-z0-9]$"


def _shape_issues(held: Column, names: Column, path: str, required: Sequence[str], optional: Sequence[str]) -> Column:
    """Unknown and missing properties of one object by its names; an absent object is its parent's issue."""
    list_of = lambda values: F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    label = lambda code: (lambda n: F.concat(F.lit(f"{code}:{path}."), n))
    wrong = F.array(F.lit(f"SCHEMA_TYPE_INVALID:{path}"))
    unknown = F.transform(F.sort_array(F.array_except(names, list_of((*required, *optional)))), label("SCHEMA_PROPERTY_UNKNOWN"))
    missing = F.transform(F.array_except(list_of(required), names), label("SCHEMA_PROPERTY_REQUIRED"))
    absent = F.lit(False) if path == "$" else ~held
    return F.when(absent, F.array().cast("array<string>")).when(names.isNull(), wrong).otherwise(F.concat(unknown, missing))


def validate_contracts(contracts: DataFrame, json_col: str, keys: Sequence[str], shape=CONTRACT_SHAPE, version: str = "scenario/v1") -> DataFrame:
    """Violations of JSON contracts as (code, detail): shape, version, id form, budgets, file lists and paths. Row-local, no shuffle.

    A contract is parsed for its names and once more for the objects it holds; what the checks read is a column before they read it.
    """
    tops = list(dict.fromkeys(["schemaVersion", "id", "project", "source", "qualityBudget", *[p.split(".")[1] for p in shape if p != "$"]]))
    top = contracts.select(*keys, F.col(json_col).alias("_doc"), F.json_tuple(json_col, *tops).alias(*[f"_{n}" for n in tops]))

    def held(path: str) -> Column:
        if path == "$":
            return F.col("_doc")
        name, *deeper = path.removeprefix("$.").split(".")
        return F.get_json_object(f"_{name}", "$." + ".".join(deeper)) if deeper else F.col(f"_{name}")

    listed = lambda path: F.coalesce(F.from_json(held(path), "array<string>"), F.array().cast("array<string>"))
    budget = F.coalesce(F.map_values(F.from_json("_qualityBudget", "map<string,double>")), F.array().cast("array<double>"))
    objects = {path: (F.col(f"_held{i}"), F.col(f"_names{i}")) for i, path in enumerate(shape)}
    rows = top.select(
        *keys, "_schemaVersion", "_id", F.json_object_keys("_doc").isNotNull().alias("_is_object"), listed("$.project.files").alias("_files"), listed("$.source.migrationFiles").alias("_migration"),
        budget.alias("_budget"), *[held(p).isNotNull().alias(f"_held{i}") for i, p in enumerate(shape)], *[F.json_object_keys(held(p)).alias(f"_names{i}") for i, p in enumerate(shape)],
    ).withColumn("_folded", F.transform("_files", F.lower))
    files, migration, folded = F.col("_files"), F.col("_migration"), F.col("_folded")
    unlisted = F.filter(migration, lambda m: ~F.array_contains(folded, F.lower(m)))
    checks = matching_labels(
        [
            ("SCHEMA_VERSION_UNSUPPORTED:", ~F.coalesce(F.col("_schemaVersion") == version, F.lit(False))),
            ("SCENARIO_ID_INVALID:", ~F.coalesce(F.rlike("_id", F.lit(SCENARIO_ID)), F.lit(False))),
            ("QUALITY_BUDGET_NEGATIVE:", F.exists("_budget", lambda x: x < 0)),
            ("PROJECT_FILES_MISSING:", F.size(files) == 0), ("MIGRATION_FILES_MISSING:", F.size(migration) == 0),
            ("DUPLICATE_PROJECT_PATH:", F.size(F.array_distinct(folded)) < F.size(files)),
            ("PROJECT_PATH_EMPTY:", F.exists(files, lambda p: F.length(F.trim(p)) == 0)),
            ("PROJECT_PATH_ABSOLUTE:", F.exists(files, lambda p: F.rlike(p, F.lit(r"^(?:/|[A-Za-z]:)")))),
            ("PROJECT_PATH_ESCAPES_SCENARIO:", F.exists(files, lambda p: F.contains(p, F.lit("..")) & escapes(p))),
        ]
    )
    shapes = [_shape_issues(*objects[path], path, required, optional) for path, (required, optional) in shape.items()]
    none = F.array().cast("array<string>")
    extra = F.when(F.col("_is_object"), F.concat(checks, F.transform(unlisted, lambda m: F.concat(F.lit("MIGRATION_FILE_NOT_IN_PROJECT:"), m)))).otherwise(none)
    out = rows.select(*keys, F.explode(F.concat(*shapes, extra)).alias("_t"))
    cut = F.position(F.lit(":"), F.col("_t"))
    return out.select(*keys, F.substring_index("_t", ":", 1).alias("code"), F.substring(F.col("_t"), cut + 1, F.lit(2**31 - 1)).alias("detail"))


def escapes(path: Column) -> Column:
    """Whether a relative path climbs above its own root at any point."""
    depth = F.aggregate(
        F.split(path, "/", -1),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["d"] + F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)).alias("d"),
            F.least(s["low"], s["d"] + F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)).alias("low"),
        ),
        lambda s: s["low"],
    )
    return depth < 0


