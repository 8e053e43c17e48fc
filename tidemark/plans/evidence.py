"""Selector evidence, page-object index, learned packs and configuration gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import contains_any, matching_labels
from tidemark.functions.text import clamp, contains_ci, json_unescape, values_match
from tidemark.operators.joins import drop_mapped, match_evidence
from tidemark.operators.ranking import top_k

# Score terms, levels and unsafe target kinds.
SOURCE_TERM, CONFIG_TERM, GENERATED_TERM, AGREEMENT_TERM, UNSAFE_TERM, INFERRED_TERM = 35, 30, 25, 10, 20, 15
LEVELS = ((85, "high"), (65, "medium"), (40, "low"))
UNSAFE_KINDS = ("rawexpression", "playwrightlocator", "unresolved")


def selector_evidence(src: DataFrame, cfg: DataFrame, gen: DataFrame) -> DataFrame:
    """Evidence items with score, confidence and the reasons that make one unsafe."""
    items = match_evidence(src, cfg, gen)
    has = lambda side: F.col(side).isNotNull()
    s, c, g = (lambda n: F.col(f"source.{n}")), (lambda n: F.col(f"config.{n}")), (lambda n: F.col(f"generated.{n}"))
    source_config = values_match(s("source_expr"), c("source_expr")) | values_match(s("value"), c("target"))
    config_generated = values_match(g("target"), c("target")) | F.coalesce(F.contains(F.lower(g("locator")), F.lower(c("target"))), F.lit(False))
    flag = lambda x: F.coalesce(x, F.lit(False))
    dynamic = F.rlike(s("value"), F.lit(r"[{}$+]")) | contains_ci(s("value"), "TODO")
    unsafe = matching_labels(
        [
            ("raw-target-kind", flag(F.lower(c("target_kind")).isin(*UNSAFE_KINDS))), ("nth-match", flag(F.lower(c("match_mode")) == "nth")),
            ("dynamic-selector", flag(dynamic)), ("todo-locator", flag(contains_ci(g("locator"), "TODO"))), ("nth-locator", flag(contains_ci(g("locator"), ".Nth("))),
        ]
    )
    rows = items.withColumn("unsafe", unsafe)
    inferred = ~has("source") | F.startswith(F.lower("source_expr"), F.lit("selector:"))
    term = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (
        term(has("source"), SOURCE_TERM) + term(has("config"), CONFIG_TERM) + term(has("generated"), GENERATED_TERM) + term(has("source") & has("config") & source_config, AGREEMENT_TERM)
        + term(has("config") & has("generated") & config_generated, AGREEMENT_TERM) - term(F.size("unsafe") > 0, UNSAFE_TERM) - term(inferred, INFERRED_TERM)
    )
    scored = rows.withColumns({"score": clamp(score), "inferred": inferred})
    level = F.when(~has("source") & (has("config") | has("generated")), "cannot-prove")
    for least, name in LEVELS:
        level = level.when(F.col("score") >= least, name)
    return scored.withColumn("confidence", level.otherwise("cannot-prove"))


# --- page objects ---------------------------------------------------------------------------------------

# Confidence of a fact by where it comes from; the weights are ours.
SOURCE_ORIGIN, TARGET_ORIGIN, INFERRED_ORIGIN = "SourcePom", "TargetPom", "InferredUsage"


def pom_index(selectors: DataFrame, locators: DataFrame, usages: DataFrame) -> DataFrame:
    """Facts of source and target page objects, and used names that no fact backs, as candidates.

    selectors(source_expr, kind, value), locators(locator, locator_kind, target),
    usages(expression). Facts reduce to one row each with a count before they meet the
    usages; the candidates are an anti join. A source selector bound to a name is high,
    an unbound one low; a target test id is medium, text and CSS need review.
    """
    count = F.count(F.lit(1)).alias("n")
    bound = ~F.startswith("source_expr", F.lit("selector:"))
    src = selectors.groupBy(F.col("source_expr").alias("expression"), F.col("kind").alias("selector_kind"), F.col("value").alias("selector")).agg(count).select(
        "expression", "selector_kind", "selector", F.lit(SOURCE_ORIGIN).alias("origin"), F.when(~F.startswith("expression", F.lit("selector:")), "high").otherwise("low").alias("confidence"), "n"
    )
    tgt = locators.groupBy(F.col("locator").alias("expression"), F.col("locator_kind").alias("selector_kind"), F.col("target").alias("selector")).agg(count).select(
        "expression", "selector_kind", "selector", F.lit(TARGET_ORIGIN).alias("origin"), F.when(F.col("selector_kind") == "GetByTestId", "medium").otherwise("low").alias("confidence"), "n"
    )
    used = usages.groupBy("expression").agg(count)
    backed = selectors.where(bound).select(F.col("source_expr").alias("expression")).distinct()
    guess = used.join(backed, "expression", "left_anti").select(
        "expression", F.lit("TestId").alias("selector_kind"), F.substring_index("expression", ".", -1).alias("selector"), F.lit(INFERRED_ORIGIN).alias("origin"), F.lit("low").alias("confidence"), "n"
    )
    return src.unionByName(tgt).unionByName(guess)


# --- learned packs --------------------------------------------------------------------------------------

# Scores of learned mappings, kinds that carry mappings, signs of missing proof, report sizes.
REVIEWED_SCORE, EVIDENCE_SCORE, UNSAFE_SCORE = 85, 70, 45
MAPPING_KINDS = ("selector-evidence", "migration-report", "generated-output", "config-proposals")
UNPROVEN = ("unsafe", "inferred", "cannot-prove", "raw", "TODO")
SOURCE_PATTERN = r"\"[Ss]ourceExpression\"\s*:\s*\"([^\"]*)\""
TARGET_PATTERN = r"\"[Tt]argetExpression\"\s*:\s*\"([^\"]*)\""
NO_TARGET = "<review target locator>"


def learned_mappings(
    evidence: DataFrame, config: DataFrame, kinds: Sequence[str] = MAPPING_KINDS, source_pattern: str = SOURCE_PATTERN, target_pattern: str = TARGET_PATTERN, unproven: Sequence[str] = UNPROVEN
) -> DataFrame:
    """Source -> target mappings of the configuration and of evidence files; the first of a pair wins, ignoring case.

    evidence(ord, path, kind, text), config(ord, source, target). The n-th distinct source
    of a file meets its n-th distinct target; all of them, whatever the file's size.
    """
    folded = lambda p: F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), json_unescape))
    files = evidence.where(F.col("kind").isin(*kinds)).select("ord", "path", "kind", "text", folded(source_pattern).alias("_s"), folded(target_pattern).alias("_t"))
    longest = F.greatest(F.size("_s"), F.size("_t"))
    rows = files.where(longest > 0).select("ord", "path", "kind", "text", "_s", "_t", F.explode(F.sequence(F.lit(0), longest - 1)).alias("_i"))
    found = rows.select(
        F.lit(1).alias("tier"), "ord", F.col("_i").alias("pos"), F.coalesce(F.get("_s", F.col("_i")), F.concat(F.lit("artifact:"), F.col("path"))).alias("source"),
        F.coalesce(F.get("_t", F.col("_i")), F.lit(NO_TARGET)).alias("target"), "kind", contains_any("text", unproven).alias("_text_unproven"),
    )
    risky = F.col("_text_unproven") | contains_any("source", unproven) | contains_any("target", unproven)
    found = found.withColumns({"score": F.when(risky, UNSAFE_SCORE).otherwise(EVIDENCE_SCORE), "safety": F.when(risky, "manual-only").otherwise("review-required")}).drop("_text_unproven")
    known = config.select(
        F.lit(0).alias("tier"), "ord", F.lit(0).alias("pos"), "source", "target", F.lit("adapter-config").alias("kind"), F.lit(REVIEWED_SCORE).alias("score"), F.lit("review-required").alias("safety")
    )
    every = known.unionByName(found).where((F.length(F.trim("source")) > 0) & (F.length(F.trim("target")) > 0))
    key = [F.lower("source").alias("_ks"), F.lower("target").alias("_kt")]
    first = every.groupBy(*key).agg(F.min(F.struct("tier", "ord", "pos", "source", "target", "kind", "score", "safety")).alias("_m"))
    return first.select("_m.*")


def reusable_candidates(mappings: DataFrame, helpers: DataFrame, poms: DataFrame, most: int | None = None) -> DataFrame:
    """Reusable mappings, helpers and page patterns, each ranked; with ``most`` so many of each."""
    m = top_k(mappings.where("safety <> 'manual-only'"), most, F.col("score").desc(), "tier", "ord", "pos").select(F.lit(1).alias("part"), F.col("source").alias("key"), "target", "score")
    h = top_k(helpers.where("score >= 70"), most, F.col("score").desc(), "method").select(F.lit(2).alias("part"), F.col("method").alias("key"), F.col("classification").alias("target"), "score")
    p = top_k(poms.where("classification = 'test-id-convention'"), most, F.col("n").desc(), "kind", "value").select(F.lit(3).alias("part"), F.col("kind").alias("key"), F.col("value").alias("target"), "score")
    return m.unionByName(h).unionByName(p)


def pom_patterns(evidence: DataFrame, pattern: str, kinds: Sequence[str], test_id_words: Sequence[str] = ("data-tid", "testid")) -> DataFrame:
    """Selector conventions in evidence texts: pattern groups are kind and value; distinct ignoring case."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("v"))
    rows = evidence.where(F.col("kind").isin(*kinds)).select(F.explode(pairs).alias("p")).select(F.col("p.k").alias("kind"), F.col("p.v").alias("value")).where(F.length(F.trim("value")) > 0)
    seen = rows.groupBy(F.lower("kind").alias("_k"), F.lower("value").alias("_v")).agg(F.min("kind").alias("kind"), F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
    test_id = contains_any("kind", ("TId", "TestId")) | contains_any("value", test_id_words)
    return seen.select(
        "kind", "value", "n", F.when(test_id, "test-id-convention").otherwise("selenium-selector").alias("classification"), F.when(test_id, 75).otherwise(60).alias("score")
    )


def learn_pack(evidence: DataFrame, config: DataFrame, helpers: DataFrame, pom_pattern: str, pom_kinds: Sequence[str], **patterns) -> dict[str, DataFrame]:
    """Mappings, page patterns, ranked candidates and what still lacks proof."""
    mappings = learned_mappings(evidence, config, **patterns)
    poms = pom_patterns(evidence, pom_pattern, pom_kinds)
    lacks = lambda df, cond, name: df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("hit")).select(F.lit(name).alias("finding"), "hit")
    findings = (
        lacks(mappings, F.col("safety") == "manual-only", "manual-selector-review").where("hit")
        .unionByName(lacks(helpers, F.col("score") < 70, "manual-helper-review").where("hit"))
        .unionByName(lacks(evidence, F.col("kind") == "selector-evidence", "missing-selector-evidence").where("NOT hit"))
        .unionByName(lacks(evidence, F.col("kind").isin("verify", "project-verify"), "missing-verify-evidence").where("NOT hit"))
    )
    return {"mappings": mappings, "poms": poms, "candidates": reusable_candidates(mappings, helpers, poms), "findings": findings.select("finding")}


# --- configuration gaps ----------------------------------------------------------------------------------

def author_config(selector_gaps: DataFrame, helper_gaps: DataFrame, mapped: DataFrame, has_helper_inventory: Column, per_kind: int | None = None) -> DataFrame:
    """Ranked configuration proposals for what is not mapped yet: most frequent first; with ``per_kind`` so many of each kind.

    selector_gaps(key), helper_gaps(key), mapped(key). The rank is global over the few kept rows.
    """
    def lead(df: DataFrame, kind: int, area: str, safety: Column) -> DataFrame:
        counts = drop_mapped(df, mapped, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return top_k(counts, per_kind, F.col("n").desc(), "key").select(F.lit(kind).alias("kind_ord"), F.lit(area).alias("area"), "key", "n", safety.alias("safety"))

    ui = lead(selector_gaps, 1, "UiTargets", F.lit("review-required"))
    helper = lead(helper_gaps, 2, "ParameterizedMethods", F.when(has_helper_inventory, "review-required").otherwise("manual-only"))
    return ui.unionByName(helper)
