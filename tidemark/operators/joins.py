"""Joins J1-J23 on keys. Lookups are reduced to unique keys first, so a hot key never multiplies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import glob_any
from tidemark.functions.predicates import matching_labels
from tidemark.functions.text import as_col, first_flag, match_value
from tidemark.operators.literals import literal_hits


def outer_diff(base: DataFrame, cur: DataFrame, key: str, ignore_case: bool = True) -> DataFrame:
    """Full outer pairing of two snapshots on ``key``: struct ``base``, struct ``cur``, ``side``."""
    fold = F.lower(F.col(key)) if ignore_case else F.col(key)
    b = base.select(fold.alias("_k"), F.struct(*base.columns).alias("base"))
    c = cur.select(fold.alias("_k"), F.struct(*cur.columns).alias("cur"))
    side = F.when(F.col("base").isNull(), F.lit("added")).when(F.col("cur").isNull(), F.lit("removed")).otherwise(F.lit("both"))
    return b.join(c, "_k", "full_outer").select(F.col("_k").alias("key"), "base", "cur", side.alias("side"))


def tree_diff(a: DataFrame, b: DataFrame, path: str, sha: str) -> DataFrame:
    """Paths whose hash differs or that one side lacks."""
    left = a.select(path, F.col(sha).alias("left_sha"))
    right = b.select(path, F.col(sha).alias("right_sha"))
    joined = left.join(right, path, "full_outer").where(~F.col("left_sha").eqNullSafe(F.col("right_sha")))
    kind = F.when(F.col("left_sha").isNull(), F.lit("added")).when(F.col("right_sha").isNull(), F.lit("removed")).otherwise(F.lit("changed"))
    return joined.withColumn("difference", kind)


def opened_closed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids present on one side only, as ``opened`` or ``closed``; one shuffle for both directions."""
    both = before.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(after.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_a")))
    seen = both.groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a")).where(F.col("_b") != F.col("_a"))
    return seen.select(*keys, F.when(F.col("_a") == 1, "opened").otherwise("closed").alias("change"))


def drop_mapped(candidates: DataFrame, rules: DataFrame, key: str, rule_key: str | None = None) -> DataFrame:
    """Candidates without a rule of the same key, global or scoped."""
    return candidates.join(rules.select(F.col(rule_key or key).alias(key)), key, "left_anti")


def check_candidates(selected: DataFrame, available: DataFrame, exhausted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict per selected candidate: it must be available and must not be exhausted."""
    flags = available.select(*keys, F.lit(1).alias("_ok"), F.lit(0).alias("_used")).unionByName(
        exhausted.select(*keys, F.lit(0).alias("_ok"), F.lit(1).alias("_used"))
    ).groupBy(*keys).agg(F.max("_ok").alias("_ok"), F.max("_used").alias("_used"))
    verdict = F.when(F.coalesce("_ok", F.lit(0)) == 0, F.lit("invalid")).when(F.col("_used") == 1, F.lit("exhausted")).otherwise(F.lit("ready"))
    return selected.join(flags, list(keys), "left").withColumn("verdict", verdict).drop("_ok", "_used")


# Issue categories of identity pairing, one place for both sides.
DUPLICATE_SOURCE, DUPLICATE_TARGET = "DuplicateSourceTestIdentity", "DuplicateTargetTestIdentity"
MISSING_TARGET, UNEXPECTED_TARGET = "MissingTargetTest", "UnexpectedTargetTest"


def pair_identities(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs, issues) on structural identity; an identity pairs only when it is single on both sides."""
    sides = src.select(*keys, F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionByName(tgt.select(*keys, F.lit(0).alias("_s"), F.lit(1).alias("_t")))
    counts = sides.groupBy(*keys).agg(F.sum("_s").alias("source_count"), F.sum("_t").alias("target_count"))
    s, t = F.col("source_count"), F.col("target_count")
    found = matching_labels(
        [(DUPLICATE_SOURCE, s > 1), (DUPLICATE_TARGET, t > 1), (MISSING_TARGET, (s == 1) & (t == 0)), (UNEXPECTED_TARGET, (t == 1) & (s == 0))]
    )
    issues = counts.select(*keys, "source_count", "target_count", F.explode(found).alias("category"))
    return counts.where((s == 1) & (t == 1)).select(*keys), issues


def loss_checks(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Losses of paired tests. Both sides carry ``behavior``, ``assertions`` and ``cases`` counts.

    A test is paired when it is single on both sides, as in ``pair_identities``; repeated ones are left out here.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        counts = [F.first(c).alias(f"{mark}_{c}") for c in ("behavior", "assertions", "cases")]
        return df.groupBy(*keys).agg(*counts, F.count("*").alias("_n")).where("_n = 1").drop("_n")

    s, t = side(src, "s"), side(tgt, "t")
    found = matching_labels(
        [
            ("VacuumTest", (F.col("s_behavior") > 0) & (F.col("t_behavior") == 0)),
            ("AssertionLoss", (F.col("s_assertions") > 0) & (F.col("t_assertions") < F.col("s_assertions"))),
            ("TestCaseLoss", F.col("t_cases") < F.col("s_cases")),
        ]
    )
    return s.join(t, list(keys)).select(*keys, F.explode(found).alias("category"))


# --- rule lookups ---------------------------------------------------------------------------------

# Order in which sections cover an expression.
COVERAGE_ORDER = {"UiTargets": 1, "Tables": 2, "Pagination": 3, "Methods": 4, "ParameterizedMethods": 5, "Scoped UiTargets": 6}
DOTTED = r"^[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*+$"


def coverage(expressions: DataFrame, rules: DataFrame, expr_col: str = "expression", section_col: str = "section", key_col: str = "key") -> DataFrame:
    """Section that covers each expression, by precedence; empty text when none does.

    A rule covers the expression that is its key or, for methods, the name before its arguments; a parameterised
    pattern also covers every dotted expression that it contains, found as literals in the patterns. Rules are reduced
    to one row per covered text and section, and the expressions join once.
    """
    order = F.create_map(*[F.lit(x) for kv in COVERAGE_ORDER.items() for x in kv])
    own = rules.where(F.length(F.trim(F.col(key_col))) > 0).select(F.col(section_col).alias("_s"), F.col(key_col).alias("_rule"))
    name = F.substring_index("_rule", "(", 1)
    texts = F.array_distinct(F.when(F.col("_s") == "ParameterizedMethods", F.array(name)).when(F.col("_s") == "Methods", F.array(F.col("_rule"), name)).otherwise(F.array("_rule")))
    direct = own.select("_s", F.explode(texts).alias(expr_col))
    patterns = own.where(F.col("_s") == "ParameterizedMethods").select("_rule").distinct().withColumn("_pattern", F.col("_rule"))
    dotted = expressions.select(expr_col).distinct().where(F.col(expr_col).rlike(DOTTED)).withColumn("_expr", F.col(expr_col))
    inside = literal_hits(patterns, "_rule", "_pattern", dotted, expr_col, "_expr", narrow=False).select(F.lit("ParameterizedMethods").alias("_s"), expr_col).distinct()
    lookup = direct.unionByName(inside).groupBy(expr_col).agg(F.min(F.struct(F.try_element_at(order, F.col("_s")).alias("o"), F.col("_s").alias("s"))).alias("_best"))
    return expressions.join(lookup, expr_col, "left").withColumn("covered_by", F.coalesce("_best.s", F.lit(""))).drop("_best")


def resolve_rules(actions: DataFrame, rules: DataFrame, key: str, scope_col: str = "scope", target_col: str = "target") -> DataFrame:
    """Target of each action: the rule of its scope, else the global rule (null scope), of the same key."""
    best = rules.groupBy(scope_col, key).agg(F.max_by(target_col, "layer_ord").alias("_t"))
    scoped = best.where(F.col(scope_col).isNotNull()).withColumnRenamed("_t", "_scoped")
    global_ = best.where(F.col(scope_col).isNull()).select(key, F.col("_t").alias("_global"))
    joined = actions.join(scoped, [scope_col, key], "left").join(global_, key, "left")
    origin = F.when(F.col("_scoped").isNotNull(), "scope").when(F.col("_global").isNotNull(), "global").otherwise("none")
    return joined.withColumns({"target": F.coalesce("_scoped", "_global"), "origin": origin}).drop("_scoped", "_global")


def longest_prefix(actions: DataFrame, rules: DataFrame, expr_col: str, key_col: str, target_col: str, sep: str = ".") -> DataFrame:
    """Rule whose key plus separator starts the expression, longest key first, ties by key.

    Distinct expressions are cut into their own prefixes, so the search is an equi
    join and each expression meets at most one rule per segment.
    """
    distinct = actions.select(expr_col).distinct()
    parts = F.split(F.col(expr_col), "\\" + sep, -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    pieces = distinct.where(F.size(parts) > 1).select(expr_col, F.explode(prefixes).alias(key_col))
    hit = pieces.join(rules.select(key_col, target_col), key_col)
    best = hit.groupBy(expr_col).agg(F.max_by(F.struct(F.col(key_col), F.col(target_col)), F.struct(F.length(key_col), F.col(key_col))).alias("_b"))
    return actions.join(best, expr_col, "left").select(*actions.columns, F.col(f"_b.{key_col}").alias("matched_key"), F.col(f"_b.{target_col}").alias("target"))


def assign_scope(paths: DataFrame, scopes: Mapping[str, Sequence[str]], path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """(assigned, conflicts): scopes are a driver-side rule table, matched as one expression on distinct paths."""
    named = matching_labels([(name, glob_any(path_col, globs)) for name, globs in sorted(scopes.items())])
    matched = paths.select(path_col).distinct().withColumn("scopes", named)
    scope = F.when(F.size("scopes") == 1, F.element_at("scopes", 1))
    return matched.where(F.size("scopes") <= 1).select(path_col, scope.alias("scope")), matched.where(F.size("scopes") > 1)


def variants_with_run(variants: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """Variants with the run row of the same id, ignoring case; a missing one is kept and marked.

    Of several run rows with one id the smallest stands, so variants never multiply.
    """
    r = run.groupBy(F.lower(F.col(key)).alias("_k")).agg(F.min(F.struct(*run.columns)).alias("run"))
    return variants.withColumn("_k", F.lower(F.col(key))).join(r, "_k", "left").drop("_k").withColumn("missing", F.col("run").isNull())


# Reasons of a contract change, in the order they are tested.
NOT_IN_BASELINE, NO_BASELINE_HASH, NO_RUN_HASH, HASH_CHANGED, MISSING_FROM_RUN = (
    "not-in-baseline", "baseline-without-hash", "run-without-hash", "contract-changed", "missing-from-run",
)


def contract_changes(run: DataFrame, baseline: DataFrame, key: str = "id", sha: str = "contract_hash", ord_col: str | None = None) -> DataFrame:
    """Scenarios whose contract is not the trusted one, with the reason. One row per id counts on both sides.

    It is the first by ``ord_col`` where that is given, else the smallest by id and hash.
    """
    row = F.struct(key, sha)
    pick = F.min(row) if ord_col is None else F.min_by(row, F.struct(ord_col, key, sha))
    first = lambda df, name: df.groupBy(F.lower(F.col(key)).alias("_k")).agg(pick.alias(name))
    both = first(run, "_run").join(first(baseline, "_base"), "_k", "full_outer")
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    base_sha, run_sha = F.col(f"_base.{sha}"), F.col(f"_run.{sha}")
    reason = first_flag(
        [
            (MISSING_FROM_RUN, F.col("_run").isNull()), (NOT_IN_BASELINE, F.col("_base").isNull()), (NO_BASELINE_HASH, blank(base_sha)),
            (NO_RUN_HASH, blank(run_sha)), (HASH_CHANGED, F.lower(base_sha) != F.lower(run_sha)),
        ]
    )
    return both.select(F.coalesce(F.col(f"_run.{key}"), F.col(f"_base.{key}")).alias(key), reason.alias("reason")).where(F.col("reason").isNotNull())


# Families that source features belong to.
FEATURE_FAMILIES: Mapping[str, Sequence[str]] = {
    "locator": ("By.Id", "By.CssSelector", "By.XPath"),
    "element-lookup": ("FindElement", "FindElements"),
    "assertion": ("Assert.That", "Assert.Multiple", "FluentAssertions"),
    "wait": ("WebDriverWait", "CustomWait"),
    "page-object": ("PageObject", "PageObjectProperty"),
    "project-topology": ("ProjectReference", "CentralPackageManagement", "MultiTargeting"),
    "unsupported-boundary": ("IJavaScriptExecutor", "Actions", "Dynamic", "RawStatement"),
}


def family(c: Column | str, families: Mapping[str, Sequence[str]] = FEATURE_FAMILIES) -> Column:
    pairs = [(name, fam) for fam, names in families.items() for name in names]
    lookup = F.create_map(*[F.lit(x) for p in pairs for x in p])
    feature = F.trim(as_col(c))
    return F.coalesce(F.try_element_at(lookup, feature), F.lower(feature))


def feature_family(df: DataFrame, col: str, families: Mapping[str, Sequence[str]] = FEATURE_FAMILIES) -> DataFrame:
    """Family of a feature through a constant map; unknown features are their own family in lower case."""
    return df.withColumn("family", family(col, families))


def base_class_attributes(types: DataFrame) -> DataFrame:
    """Classes with the attributes of their own base class merged in (a self join on the base's name)."""
    bases = types.where(F.col("base_class").isNull()).groupBy(F.col("class_name").alias("base_class")).agg(F.min("attributes").alias("_inherited"))
    joined = types.join(bases, "base_class", "left")
    merged = F.array_sort(F.array_union(F.col("attributes"), F.coalesce("_inherited", F.array().cast("array<string>"))))
    return joined.select(*types.columns, merged.alias("all_attributes"))


def resolve_calls(calls: DataFrame, methods: DataFrame, callee: str = "callee", symbol: str = "symbol") -> DataFrame:
    """Call edges with the method they reach; unresolved and out-of-source calls are told apart."""
    known = methods.select(F.col(symbol).alias(callee)).distinct().withColumn("_in", F.lit(True))
    joined = calls.join(known, callee, "left")
    in_source = F.coalesce("_in", F.lit(False))
    state = F.when(~F.col("resolved"), "unresolved").when(in_source, "in-source").otherwise("external")
    return joined.withColumns({"in_source": F.col("resolved") & in_source, "state": state}).drop("_in")


# --- three-way evidence ---------------------------------------------------------------------------


def _first(df: DataFrame, key: Column, struct_name: str) -> DataFrame:
    """First row (by ``ord``) per match value, as one struct: a unique-key lookup."""
    keyed = df.withColumn("_v", key).where(F.col("_v").isNotNull())
    return keyed.groupBy("_v").agg(F.min_by(F.struct(*df.columns), "ord").alias(struct_name))


def _earlier(a: Column, b: Column) -> Column:
    return F.when(b.isNull() | (a["ord"] <= b["ord"]), a).otherwise(b)


def match_evidence(src: DataFrame, cfg: DataFrame, gen: DataFrame) -> DataFrame:
    """Triples source / config / generated; each side may drive, the first driver of a key keeps it.

    src(ord, source_expr, kind, value), cfg(ord, source_expr, target, target_kind, match_mode, scope),
    gen(ord, locator, target). Sides meet on the comparison form of their values. Every
    lookup is first reduced to one row per value, so three hot values cost three rows.
    """
    v = match_value
    cfg_by_expr, cfg_by_target = _first(cfg, v("source_expr"), "_ce"), _first(cfg, v("target"), "_ct")
    gen_by_target = _first(gen, v("target"), "_g")
    src_by_expr, src_by_value = _first(src, v("source_expr"), "_se"), _first(src, v("value"), "_sv")

    def look(df: DataFrame, key: Column, lookup: DataFrame, name: str, alias: str) -> DataFrame:
        return df.join(lookup.select(F.col("_v").alias(f"_v_{alias}"), F.col(name).alias(alias)), key == F.col(f"_v_{alias}"), "left").drop(f"_v_{alias}")

    def drive(df: DataFrame, number: int) -> DataFrame:
        return df.select(F.lit(number).alias("driver"), "ord", "source", "config", "generated")

    s = src.select("ord", F.struct(*src.columns).alias("source"))
    s = look(s, v(F.col("source.source_expr")), cfg_by_expr, "_ce", "ce")
    s = look(s, v(F.col("source.value")), cfg_by_target, "_ct", "ct").withColumn("config", _earlier(F.col("ce"), F.col("ct")))
    s = look(s, v(F.col("config.target")), gen_by_target, "_g", "gt")
    s = look(s, v(F.col("source.value")), gen_by_target, "_g", "gs").withColumn("generated", F.coalesce("gt", "gs"))

    c = cfg.select("ord", F.struct(*cfg.columns).alias("config"))
    c = look(c, v(F.col("config.source_expr")), src_by_expr, "_se", "se")
    c = look(c, v(F.col("config.target")), src_by_value, "_sv", "sv").withColumn("source", _earlier(F.col("se"), F.col("sv")))
    c = look(c, v(F.col("config.target")), gen_by_target, "_g", "gt")
    c = look(c, v(F.col("source.value")), gen_by_target, "_g", "gs").withColumn("generated", F.coalesce("gt", "gs"))

    g = gen.select("ord", F.struct(*gen.columns).alias("generated"))
    g = look(g, v(F.col("generated.target")), src_by_value, "_sv", "source")
    g = look(g, v(F.col("generated.target")), cfg_by_target, "_ct", "ct")
    # A locator also meets a config whose target it merely contains.
    firsts = cfg_by_target.select(F.col("_ct.ord").alias("cfg_ord"), F.col("_ct.target").alias("cfg_target"), F.col("_ct").alias("cc"))
    inside = literal_hits(gen.select("ord", "locator"), "ord", "locator", firsts, "cfg_ord", "cfg_target", ignore_case=True)
    inside = inside.groupBy("ord").agg(F.min("cfg_ord").alias("cfg_ord")).join(firsts.select("cfg_ord", "cc"), "cfg_ord").drop("cfg_ord")
    g = g.join(inside, "ord", "left").withColumn("config", _earlier(F.col("ct"), F.col("cc")))

    triples = drive(s, 1).unionByName(drive(c, 2)).unionByName(drive(g, 3))
    expr = F.coalesce("source.source_expr", "config.source_expr", "generated.target", F.lit("unknown"))
    key = F.lower(F.concat_ws("|", expr, F.coalesce("source.value", F.lit("")), F.coalesce("config.target", F.lit("")), F.coalesce("generated.locator", F.lit(""))))
    keyed = triples.withColumns({"source_expr": expr, "stable_key": key})
    first = F.min_by(F.struct("driver", "ord", "source_expr", "source", "config", "generated"), F.struct("driver", "ord"))
    # A source drives every one of its rows; only the other two drivers give way to an earlier key.
    own = keyed.where(F.col("driver") == 1)
    claimed = own.select("stable_key").distinct()
    rest = keyed.where(F.col("driver") > 1).join(claimed, "stable_key", "left_anti").groupBy("stable_key").agg(first.alias("_r"))
    cols = ["driver", "ord", "source_expr", "source", "config", "generated"]
    return own.select("stable_key", *cols).unionByName(rest.select("stable_key", *[F.col(f"_r.{c}").alias(c) for c in cols]))
