"""Reuse of rule profiles in projects, and which profile suits a project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import contains_any
from tidemark.operators.aggregates import count_with_example, reuse_ratio
from tidemark.operators.facts import extract_expressions
from tidemark.operators.joins import coverage
from tidemark.operators.linking import score_catalogue
from tidemark.operators.literals import identifier_hits, literal_hits, placeholder_hits
from tidemark.operators.ranking import top_k_per

# Sections whose keys are whole identifiers.
IDENTIFIER_SECTIONS = ("Identifier", "KnownTypes", "SourceOnly")
HOLES = r"\{.*\}"


def rule_hits(rules: DataFrame, files: DataFrame, file_id: str, text_col: str) -> DataFrame:
    """Hits of every rule in every file by the kind of its key: identifier, pattern with holes, or literal.

    rules(rule_id, section, key). Each kind goes through its own equi join.
    """
    named = contains_any("section", IDENTIFIER_SECTIONS)
    holes = F.rlike("key", F.lit(HOLES))
    usable = rules.where(F.length(F.trim("key")) > 0)
    parts = [
        identifier_hits(files, file_id, text_col, usable.where(named), "rule_id", "key"),
        placeholder_hits(files, file_id, text_col, usable.where(~named & holes), "rule_id", "key"),
        literal_hits(files, file_id, text_col, usable.where(~named & ~holes), "rule_id", "key"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def profile_match(rules: DataFrame, files: DataFrame, lines: DataFrame, file_id: str = "path", text_col: str = "text") -> dict[str, DataFrame]:
    """Reuse per layer with its hits, used rules, project expressions with their coverage, and the gaps; all rows, the caller cuts.

    rules(rule_id, layer, section, key); lines are the masked lines of the same files. The hits are reduced to
    one row a rule before any report reads them.
    """
    hits = rule_hits(rules, files, file_id, text_col)
    used = hits.groupBy("rule_id").agg(F.sum("hits").alias("hits"), F.min(F.struct(F.col(file_id).alias("f"), F.col("first_line").alias("l"))).alias("_e"))
    matched = rules.join(used, "rule_id").select("layer", "section", "key", "hits", F.col("_e.f").alias("example_file"), F.col("_e.l").alias("example_line"))
    signals = count_with_example(extract_expressions(lines), ["expression"], [file_id, "line_no"])
    covered = coverage(signals, rules.select("section", "key"))
    return {"layers": reuse_ratio(rules, used, ["layer"], "rule_id", "hits"), "matched": matched, "signals": covered, "gaps": covered.where("covered_by = ''")}


# Score terms of a profile for a project, and levels.
LANGUAGE_MISMATCH, FRAMEWORK_MISMATCH, TARGET_MISMATCH, FRAMEWORK_UNKNOWN = 45, 30, 20, 8
TID_MATCH, TID_MISSING, TID_UNWANTED, HEAVY, UNSURE = 8, 6, 10, 8, 8
LEVELS = ((85, "strong"), (65, "usable"), (40, "review-required"))
UNSURE_CONFIDENCE = ("none", "low", "ambiguous")


def recommend_profiles(signals: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Profiles of a project's language scored, with level and gate codes, and one row for the profiles of all other languages.

    signals(project..., language, framework, target, confidence, data_tid, data_testid,
    pom_files, helper_files); catalogue(id, language, framework, target_framework, tags).
    A profile of another language loses so much that no bonus makes it usable; the row without a profile says so.
    """
    c = F.col
    tagged = lambda p: F.array_contains(p["tags"], "data-tid")
    unknown = c("framework") == "unknown"
    asked = F.length(F.trim(F.coalesce("target", F.lit("")))) > 0
    prefers_tid = c("data_tid") > c("data_testid")
    terms = [
        (FRAMEWORK_UNKNOWN, "PROFILE_FRAMEWORK_UNKNOWN", lambda p: unknown),
        (FRAMEWORK_MISMATCH, "PROFILE_SOURCE_FRAMEWORK_MISMATCH", lambda p: ~unknown & (F.lower(p["framework"]) != F.lower("framework"))),
        (TARGET_MISMATCH, "PROFILE_TARGET_FRAMEWORK_MISMATCH", lambda p: asked & (F.lower(p["target_framework"]) != F.lower("target"))),
        (-TID_MATCH, None, lambda p: prefers_tid & tagged(p)),
        (TID_MISSING, "PROFILE_TEST_ID_ATTRIBUTE_REVIEW", lambda p: prefers_tid & ~tagged(p)),
        (TID_UNWANTED, None, lambda p: ~prefers_tid & tagged(p)),
        (HEAVY, "PROFILE_POM_HEAVY_PROJECT", lambda p: c("pom_files") >= 3),
        (HEAVY, "PROFILE_HELPER_HEAVY_PROJECT", lambda p: c("helper_files") >= 3),
        (UNSURE, None, lambda p: c("confidence").isin(*UNSURE_CONFIDENCE)),
    ]
    scored = score_catalogue(signals, catalogue, (F.lower("language"), F.lower("language")), LANGUAGE_MISMATCH, [(cost, cond) for cost, _, cond in terms])
    p: Column = F.col("profile")
    gates = F.filter(F.array(F.when(p.isNull(), F.lit("PROFILE_SOURCE_LANGUAGE_MISMATCH")), *[F.when(p.isNotNull() & cond(p), F.lit(code)) for _, code, cond in terms if code]), lambda x: x.isNotNull())
    level = F.when(F.col("score") >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:]:
        level = level.when(F.col("score") >= least, name)
    return scored.withColumns({"profile_id": p["id"], "gates": gates, "level": level.otherwise("poor")})


def best_profiles(recommendations: DataFrame, project: Sequence[str], k: int = 5) -> DataFrame:
    return top_k_per(recommendations, project, k, F.col("score").desc(), "profile_id")
