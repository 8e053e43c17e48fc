"""Snapshot diff, status policy, triage, gates, metamorphic and determinism checks bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.aggregating import PART_FAMILIES
from tidemark.catalog.registry import query, table
from tidemark.plans import comparing as C
from tidemark.session import parts_for



def scenarios(spark, sf, current):
    """Orders as scenario rows; the second side loses, alters and re-measures some of them."""
    o = table(spark, sf, "orders")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    if current:
        o = o.where(k % 17 != 0)
    bump = lambda up, down: (F.when(k % up == 0, 1).otherwise(0) - F.when(k % down == 0, 1).otherwise(0)) if current else F.lit(0)
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'Pass' WHEN 'F' THEN 'Regression' ELSE 'PassWithWarnings' END")
    if current:
        status = F.when(k % 13 == 0, F.lit("MigratorFailure")).when(k % 23 == 0, F.lit("SourceInvalid")).when(k % 41 == 0, F.lit("Pass")).otherwise(status)
    contract = F.md5(cust.cast("string").cast("binary"))
    if current:
        contract = F.when(k % 29 == 0, F.lit("")).when(k % 31 == 0, F.md5(k.cast("string").cast("binary"))).otherwise(F.upper(contract))
    st = lambda c: c.cast("string")
    diag = F.array(F.concat(F.lit("D"), st(cust % 5)), F.concat(F.lit("E"), st((k + (F.when(k % 43 == 0, 1).otherwise(0) if current else F.lit(0))) % 3)))
    shift = F.when(k % 47 == 0, 5000).when(k % 53 == 0, -5000).when(k % 59 == 0, 300).otherwise(0) if current else F.lit(0)
    return o.select(
        (F.concat(F.lit("SC-"), st(k)) if current else F.concat(F.lit("sc-"), st(k))).alias("id"),
        F.when(k % 5 == 0, F.lit("UnsupportedAsExpected")).otherwise(F.lit("Pass")).alias("expected_status"), status.alias("actual_status"), contract.alias("contract_hash"),
        (cust % 7 + bump(61, 67)).alias("todo"), (cust % 3 + bump(71, 73)).alias("unmapped"), (cust % 2 + bump(79, 83)).alias("unsupported"), (cust % 4 + bump(89, 97)).alias("warnings"),
        (k % 9 - bump(101, 103)).alias("source_passed"), (k % 9).alias("source_expected"), (k % 8 - bump(107, 109)).alias("target_passed"), (k % 8).alias("target_expected"),
        (k % (113 if current else 127) != 0).alias("quality_passed"), (k % (131 if current else 137) != 0).alias("oracle_passed"), diag.alias("diagnostics"),
        F.array(st(k % (2 if current else 4))).alias("checks"), (F.floor(F.col("o_totalprice") / 30) + shift).cast("bigint").alias("duration_ms"),
        F.md5(st(F.when(k % 139 == 0, k + 1).otherwise(k) if current else k).cast("binary")).alias("semantic_hash"),
    )


def scenario_sql(current):
    b = (lambda u, d: f"(CASE WHEN o_orderkey % {u} = 0 THEN 1 ELSE 0 END - CASE WHEN o_orderkey % {d} = 0 THEN 1 ELSE 0 END)") if current else (lambda u, d: "0")
    status = "CASE o_orderstatus WHEN 'O' THEN 'Pass' WHEN 'F' THEN 'Regression' ELSE 'PassWithWarnings' END"
    contract = "md5(o_custkey::VARCHAR)"
    if current:
        status = f"CASE WHEN o_orderkey % 13 = 0 THEN 'MigratorFailure' WHEN o_orderkey % 23 = 0 THEN 'SourceInvalid' WHEN o_orderkey % 41 = 0 THEN 'Pass' ELSE {status} END"
        contract = f"CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 31 = 0 THEN md5(o_orderkey::VARCHAR) ELSE upper({contract}) END"
    return f"""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'UnsupportedAsExpected' ELSE 'Pass' END AS expected_status, {status} AS actual_status, {contract} AS contract_hash,
      o_custkey % 7 + {b(61, 67)} AS todo, o_custkey % 3 + {b(71, 73)} AS unmapped, o_custkey % 2 + {b(79, 83)} AS unsupported, o_custkey % 4 + {b(89, 97)} AS warnings,
      o_orderkey % 9 - {b(101, 103)} AS source_passed, o_orderkey % 9 AS source_expected, o_orderkey % 8 - {b(107, 109)} AS target_passed, o_orderkey % 8 AS target_expected,
      o_orderkey % {113 if current else 127} <> 0 AS quality_passed, o_orderkey % {131 if current else 137} <> 0 AS oracle_passed,
      ['D' || (o_custkey % 5), 'E' || ((o_orderkey + {"CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END" if current else "0"}) % 3)] AS diagnostics, [(o_orderkey % {2 if current else 4})::VARCHAR] AS checks,
      floor(o_totalprice / 30)::BIGINT + {"CASE WHEN o_orderkey % 47 = 0 THEN 5000 WHEN o_orderkey % 53 = 0 THEN -5000 WHEN o_orderkey % 59 = 0 THEN 300 ELSE 0 END" if current else "0"} AS duration_ms,
      md5(({"CASE WHEN o_orderkey % 139 = 0 THEN o_orderkey + 1 ELSE o_orderkey END" if current else "o_orderkey"})::VARCHAR) AS semantic_hash FROM orders {"WHERE o_orderkey % 17 <> 0" if current else ""}"""


def _cs(name, cond):
    return f"CASE WHEN {cond} THEN '{name}' END"


SEV = "CASE {0} WHEN 'Pass' THEN 0 WHEN 'UnsupportedAsExpected' THEN 0 WHEN 'PassWithWarnings' THEN 1 WHEN 'NonDeterministic' THEN 2 WHEN 'SourceInvalid' THEN 3 WHEN 'InfrastructureFailure' THEN 4 WHEN 'Regression' THEN 5 WHEN 'MigratorFailure' THEN 6 ELSE 5 END"
SB, SC_ = SEV.format("b.actual_status"), SEV.format("c.actual_status")
OKB, OKC = "(b.actual_status = b.expected_status)", "(c.actual_status = c.expected_status)"
PCT = "(b.duration_ms > 0 AND abs(c.duration_ms - b.duration_ms) >= 1000 AND (c.duration_ms - b.duration_ms) * 100.0 / b.duration_ms {0})"
WORSE = [
    _cs("expected-status", "b.expected_status <> c.expected_status"), _cs("contract-missing", "b.contract_hash <> '' AND c.contract_hash = ''"),
    _cs("contract-changed", "b.contract_hash <> '' AND c.contract_hash <> '' AND lower(b.contract_hash) <> lower(c.contract_hash)"), _cs("status", f"{OKB} AND NOT {OKC}"),
    _cs("severity", f"NOT {OKB} AND NOT {OKC} AND {SC_} > {SB}"), *[_cs(m, f"c.{m} > b.{m}") for m in C.LOWER_IS_BETTER], _cs("quality", "b.quality_passed AND NOT c.quality_passed"),
    _cs("oracle", "b.oracle_passed AND NOT c.oracle_passed"), *[_cs(m, f"c.{m} < b.{m}") for m in C.HIGHER_IS_BETTER],
    _cs("diagnostics-added", "len(list_filter(c.diagnostics, lambda x: NOT list_contains(b.diagnostics, x))) > 0"), _cs("duration", PCT.format("> 20")),
]
BETTER = [
    _cs("status", f"NOT {OKB} AND {OKC}"), _cs("severity", f"NOT {OKB} AND NOT {OKC} AND {SC_} < {SB}"), *[_cs(m, f"c.{m} < b.{m}") for m in C.LOWER_IS_BETTER],
    _cs("quality", "NOT b.quality_passed AND c.quality_passed"), _cs("oracle", "NOT b.oracle_passed AND c.oracle_passed"), *[_cs(m, f"c.{m} > b.{m}") for m in C.HIGHER_IS_BETTER],
    _cs("diagnostics-removed", "len(list_filter(b.diagnostics, lambda x: NOT list_contains(c.diagnostics, x))) > 0"), _cs("duration", PCT.format("< -20")),
]
NEUTRAL = [
    _cs("actual-status", f"NOT {OKB} AND NOT {OKC} AND {SC_} = {SB} AND b.actual_status <> c.actual_status"), _cs("checks", "b.checks <> c.checks"), _cs("semantic-hash", "b.semantic_hash <> c.semantic_hash"),
]
DIFF_SQL = f"""WITH b AS ({scenario_sql(False)}), c AS ({scenario_sql(True)}),
  j AS (SELECT coalesce(b.k, c.k) AS k, b.k IS NULL AS added, c.k IS NULL AS removed, {OKC} AS okc, CASE WHEN b.k IS NULL OR c.k IS NULL THEN '' ELSE concat_ws(',', {', '.join(WORSE)}) END AS regressions,
     CASE WHEN b.k IS NULL OR c.k IS NULL THEN '' ELSE concat_ws(',', {', '.join(BETTER)}) END AS improvements, CASE WHEN b.k IS NULL OR c.k IS NULL THEN '' ELSE concat_ws(',', {', '.join(NEUTRAL)}) END AS changes FROM b FULL JOIN c ON b.k = c.k),
  d AS (SELECT *, CASE WHEN added THEN 'Added' WHEN removed THEN 'Removed' WHEN regressions <> '' THEN 'Regressed' WHEN improvements <> '' THEN 'Improved' WHEN changes <> '' THEN 'Changed' ELSE 'Unchanged' END AS kind,
     CASE WHEN removed THEN true WHEN added THEN NOT okc ELSE regressions <> '' END AS is_regression, NOT added AND NOT removed AND regressions = '' AND improvements <> '' AS is_improvement FROM j)"""


@query("c06_snapshot_diff", f"{DIFF_SQL} SELECT 'sc-' || k AS id, kind, is_regression, is_improvement, regressions, improvements, changes FROM d")
def c06(spark, sf):
    d = C.snapshot_diff(scenarios(spark, sf, False), scenarios(spark, sf, True))
    return d.select(
        F.col("key").alias("id"), "kind", "is_regression", "is_improvement", *[F.array_join(c, ",").alias(c) for c in ("regressions", "improvements", "changes")]
    )


@query(
    "c06_diff_summary",
    f"""{DIFF_SQL} SELECT count(*) AS projects, count(*) FILTER (kind = 'Unchanged') AS unchanged, count(*) FILTER (kind = 'Changed') AS changed, count(*) FILTER (kind = 'Added') AS added, count(*) FILTER (kind = 'Removed') AS removed,
       count(*) FILTER (is_improvement) AS improvements, count(*) FILTER (is_regression) AS regressions FROM d""",
)
def c06b(spark, sf):
    return C.diff_summary(C.snapshot_diff(scenarios(spark, sf, False), scenarios(spark, sf, True)))


# Line items as stage rows of an order: the line number names the stage.
STAGE_ROWS_SQL = """st AS (SELECT l_orderkey AS id, l_linenumber AS ord, CASE l_linenumber WHEN 1 THEN 'SourceRestore' WHEN 2 THEN 'SourceTest' WHEN 3 THEN 'Migration' WHEN 4 THEN 'ProjectVerify' WHEN 5 THEN 'TargetBuild' ELSE 'TargetTest' END AS stage,
    CASE WHEN l_quantity > 46 THEN 'Failed' WHEN l_quantity < 2 THEN 'InfrastructureFailure' WHEN l_quantity = 10 THEN 'Skipped' WHEN l_quantity = 11 THEN 'TimedOut' ELSE 'Passed' END AS outcome, (l_quantity % 2)::INT AS exit_code, l_extendedprice FROM lineitem),
  base AS (SELECT id, stage, max(ord) AS ord, min(outcome) AS outcome, min(exit_code) AS exit_code FROM st GROUP BY ALL),
  full_runs AS (SELECT id, 'Migration' AS stage, 0 AS ord, 'Passed' AS outcome, 0 AS exit_code FROM (SELECT DISTINCT id FROM st) WHERE id % 10 <> 0 UNION ALL SELECT id, s, 0, 'Passed', 0 FROM (SELECT DISTINCT id FROM st), (VALUES ('ProjectVerify'), ('TargetBuild'), ('TargetTest')) v(s) WHERE id % 7 <> 0 UNION ALL SELECT * FROM base),
  lastst AS (SELECT id, stage, max_by(outcome, ord) AS outcome, max_by(exit_code, ord) AS exit_code FROM full_runs GROUP BY 1, 2),
  p AS (SELECT id, max(outcome) FILTER (stage = 'SourceRestore') AS s1, max(outcome) FILTER (stage = 'SourceTest') AS s2, max(outcome) FILTER (stage = 'Migration') AS mig, max(exit_code) FILTER (stage = 'Migration') AS mig_exit,
     max(outcome) FILTER (stage = 'ProjectVerify') AS pv, max(outcome) FILTER (stage = 'TargetBuild') AS tb, max(outcome) FILTER (stage = 'TargetTest') AS tt FROM lastst GROUP BY id),
  r AS (SELECT p.*, CASE WHEN id % 6 = 0 THEN 'UnsupportedAsExpected' WHEN id % 6 = 1 THEN 'InfrastructureFailure' ELSE 'Pass' END AS expected, id % 31 <> 0 AS preserved, id % 37 <> 0 AS artifacts, id % 41 = 0 AS failed_stages, CASE WHEN id % 43 = 0 THEN 'Failed' WHEN id % 11 = 0 THEN 'PassedWithWarnings' ELSE 'Passed' END AS orch,
     id % 47 <> 0 AS vpresent, CASE WHEN id % 13 = 0 THEN 'failed' ELSE 'Passed' END AS vstatus, id % 26 = 13 AS restore, id % 53 <> 0 AS q, id % 59 <> 0 AS o, id % 4 AS todo, id % 3 AS warnings FROM p)"""


def status_runs(spark, sf):
    li = table(spark, sf, "lineitem")
    stage = F.expr("CASE l_linenumber WHEN 1 THEN 'SourceRestore' WHEN 2 THEN 'SourceTest' WHEN 3 THEN 'Migration' WHEN 4 THEN 'ProjectVerify' WHEN 5 THEN 'TargetBuild' ELSE 'TargetTest' END")
    outcome = F.expr("CASE WHEN l_quantity > 46 THEN 'Failed' WHEN l_quantity < 2 THEN 'InfrastructureFailure' WHEN l_quantity = 10 THEN 'Skipped' WHEN l_quantity = 11 THEN 'TimedOut' ELSE 'Passed' END")
    rows = li.select(F.col("l_orderkey").alias("id"), stage.alias("stage"), F.col("l_linenumber").alias("ord"), outcome.alias("outcome"), (F.col("l_quantity") % 2).cast("int").alias("exit_code"))
    # dealt by run once, in more tasks where there are more rows: a task sorts the same few whatever the size
    dealt = rows.repartition(parts_for(li), "id")
    base = dealt.groupBy("id", "stage").agg(F.max("ord").alias("ord"), F.min("outcome").alias("outcome"), F.min("exit_code").alias("exit_code"))
    k = F.col("id")
    # a stage without rows of its own counts as passed, with the lowest ordinal
    default = F.struct(F.lit(0).alias("ord"), F.lit("Passed").alias("outcome"), F.lit(0).alias("exit_code"))
    given = {"Migration": k % 10 != 0} | dict.fromkeys(("ProjectVerify", "TargetBuild", "TargetTest"), k % 7 != 0)
    every = C.stage_table(base, ["id"]).withColumns({stage: F.greatest(stage, F.when(cond, default)) for stage, cond in given.items()})
    return every.withColumns(
        {
            "expected_status": F.expr("CASE WHEN id % 6 = 0 THEN 'UnsupportedAsExpected' WHEN id % 6 = 1 THEN 'InfrastructureFailure' ELSE 'Pass' END"), "source_preserved": k % 31 != 0,
            "artifacts_present": k % 37 != 0, "failed_stages": F.when(k % 41 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")),
            "orchestration": F.expr("CASE WHEN id % 43 = 0 THEN 'Failed' WHEN id % 11 = 0 THEN 'PassedWithWarnings' ELSE 'Passed' END"), "verify_present": k % 47 != 0,
            "verify_status": F.expr("CASE WHEN id % 13 = 0 THEN 'failed' ELSE 'Passed' END"),
            "verify_categories": F.when(k % 26 == 13, F.array(F.lit("NuGet-Restore"))).otherwise(F.array().cast("array<string>")), "quality_passed": k % 53 != 0, "oracle_passed": k % 59 != 0,
            "todo": k % 4, "unmapped": F.lit(0), "unsupported": F.lit(0), "warnings": k % 3,
        }
    )


def _br(c):
    return f"coalesce({c} IN ('InfrastructureFailure', 'TimedOut'), false)"


@query(
    "c09_scenario_status",
    f"""WITH {STAGE_ROWS_SQL} SELECT id, CASE WHEN {_br('s1')} OR {_br('s2')} THEN 'InfrastructureFailure' WHEN coalesce(s1 = 'Failed', false) OR coalesce(s2 = 'Failed', false) THEN 'SourceInvalid'
      WHEN mig IS NULL OR mig = 'Skipped' THEN 'MigratorFailure' WHEN {_br('mig')} THEN 'InfrastructureFailure' WHEN NOT preserved OR NOT artifacts THEN 'MigratorFailure' WHEN failed_stages OR orch = 'Failed' THEN 'Regression'
      WHEN mig = 'Failed' AND mig_exit <> 1 THEN 'MigratorFailure' WHEN pv IS NULL OR pv = 'Skipped' THEN 'MigratorFailure' WHEN {_br('pv')} THEN 'InfrastructureFailure' WHEN NOT vpresent THEN 'MigratorFailure'
      WHEN pv = 'Failed' OR vstatus = 'failed' THEN CASE WHEN expected = 'InfrastructureFailure' AND restore THEN 'InfrastructureFailure' ELSE 'Regression' END
      WHEN tb IS NULL OR tb = 'Skipped' THEN 'Regression' WHEN {_br('tb')} THEN 'InfrastructureFailure' WHEN tb = 'Failed' THEN 'Regression'
      WHEN tt IS NULL OR tt = 'Skipped' THEN 'Regression' WHEN {_br('tt')} THEN 'InfrastructureFailure' WHEN tt = 'Failed' THEN 'Regression' WHEN NOT q OR NOT o THEN 'Regression'
      WHEN expected = 'UnsupportedAsExpected' THEN CASE WHEN todo > 0 OR mig_exit = 1 OR orch = 'PassedWithWarnings' THEN 'UnsupportedAsExpected' ELSE 'Regression' END
      WHEN todo > 0 OR warnings > 0 OR orch = 'PassedWithWarnings' THEN 'PassWithWarnings' ELSE 'Pass' END AS actual_status FROM r""",
)
def c09(spark, sf):
    return C.scenario_status(status_runs(spark, sf)).select("id", "actual_status")


# Parts as run rows for triage.
TRIAGE_SQL = """r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 12 = 0 THEN 'UnsupportedAsExpected' ELSE 'Pass' END AS expected, CASE p_size % 6 WHEN 0 THEN 'Pass' WHEN 1 THEN 'Regression' WHEN 2 THEN 'MigratorFailure' WHEN 3 THEN 'NonDeterministic' WHEN 4 THEN 'SourceInvalid' ELSE 'Pass' END AS actual,
     CASE WHEN p_partkey % 4 = 0 THEN 'target-build' WHEN p_partkey % 4 = 1 THEN 'migration' END AS failed_stage, p_partkey % 9 <> 0 AS vpresent, p_partkey % 8 <> 0 AS q, p_partkey % 7 <> 0 AS o, CASE WHEN p_partkey % 5 = 0 THEN ['nuget-restore'] ELSE ['C' || (p_size % 3)] END AS cats,
     [p_type, CASE WHEN p_partkey % 10 = 0 THEN 'Actions' ELSE 'By.Id' END] AS features, CASE WHEN p_partkey % 15 = 0 THEN ['generated'] ELSE ['x'] END AS tags, list_transform(range(0, p_partkey % 5), lambda i: 'comp' || i) AS comps FROM part),
   s AS (SELECT *, coalesce(failed_stage, CASE WHEN NOT vpresent THEN 'project-verify' END, CASE WHEN NOT o THEN 'semantic-oracle' END, CASE WHEN NOT q THEN 'quality-evaluation' END,
       CASE actual WHEN 'NonDeterministic' THEN 'determinism' WHEN 'MigratorFailure' THEN 'migration' WHEN 'SourceInvalid' THEN 'source-validation' END, 'migration') AS stage,
       list_sort(list_concat(cats, list_filter([CASE WHEN NOT q THEN 'QUALITY_BUDGET' END, CASE WHEN NOT o THEN 'SEMANTIC_ORACLE' END, CASE WHEN actual = 'NonDeterministic' THEN 'NON_DETERMINISTIC' END], lambda x: x IS NOT NULL))) AS codes
     FROM r WHERE actual <> expected OR (expected = 'Pass' AND (NOT q OR NOT o))),
   f AS (SELECT *, CASE WHEN list_contains(tags, 'generated') THEN 'SavedSeed' WHEN contains(stage, 'project') OR contains(stage, 'target-build') THEN 'ProjectFixture' ELSE 'UnitTest' END AS level,
       CASE WHEN actual IN ('SourceInvalid', 'NonDeterministic') OR expected <> 'Pass' OR stage IN ('source-validation', 'determinism') OR list_contains(features, 'Actions') OR len(list_filter(codes, lambda x: contains(lower(x), 'nuget'))) > 0 OR len(comps) > 3 THEN 'ManualReview' ELSE 'AutoFixEligible' END AS disposition FROM s)"""


def triage_runs(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    return table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 12 == 0, F.lit("UnsupportedAsExpected")).otherwise(F.lit("Pass")).alias("expected_status"),
        F.expr("CASE p_size % 6 WHEN 0 THEN 'Pass' WHEN 1 THEN 'Regression' WHEN 2 THEN 'MigratorFailure' WHEN 3 THEN 'NonDeterministic' WHEN 4 THEN 'SourceInvalid' ELSE 'Pass' END").alias("actual_status"),
        F.when(k % 4 == 0, F.lit("target-build")).when(k % 4 == 1, F.lit("migration")).alias("failed_stage"), (k % 9 != 0).alias("verify_present"), F.lit("passed").alias("verify_status"),
        (k % 8 != 0).alias("quality_passed"), (k % 7 != 0).alias("oracle_passed"),
        F.when(k % 5 == 0, F.array(F.lit("nuget-restore"))).otherwise(F.array(F.concat(F.lit("C"), (size % 3).cast("string")))).alias("categories"), F.array().cast("array<string>").alias("semantics"),
        F.array(F.col("p_type"), F.when(k % 10 == 0, F.lit("Actions")).otherwise(F.lit("By.Id"))).alias("features"),
        F.when(k % 15 == 0, F.array(F.lit("generated"))).otherwise(F.array(F.lit("x"))).alias("tags"), none.alias("template"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 5 - 1), lambda i: F.concat(F.lit("comp"), i.cast("string")))).alias("components"),
    )


@query(
    "c11_triage_findings",
    f"WITH {TRIAGE_SQL} SELECT id, stage, array_to_string(codes, ',') AS codes, level, disposition FROM f",
)
def c11(spark, sf):
    t = C.triage(triage_runs(spark, sf), PART_FAMILIES)["findings"]
    return t.select("id", "stage", F.array_join("diagnostics", ",").alias("codes"), F.col("regression_level").alias("level"), "disposition")


@query(
    "c11_triage_clusters",
    f"""WITH {TRIAGE_SQL}, k AS (SELECT *, 'stage=' || stage || '|diag=' || array_to_string(codes, ',') || '|semantic=|features=' || array_to_string(list_sort(list_distinct(list_transform(features, lambda x:
        CASE x WHEN 'LARGE' THEN 'large-family' WHEN 'MEDIUM' THEN 'large-family' WHEN 'ECONOMY' THEN 'cheap' ELSE lower(x) END))), ',') AS fp FROM f)
    SELECT 'cluster-' || left(sha256(fp), 8) AS cluster_id, fp AS fingerprint, count(*) AS findings, CASE WHEN bool_or(actual IN ('MigratorFailure', 'NonDeterministic')) THEN 'high' WHEN bool_or(actual = 'Regression') THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN bool_or(level = 'ProjectFixture') THEN 'ProjectFixture' WHEN bool_and(level = 'SavedSeed') THEN 'SavedSeed' ELSE 'UnitTest' END AS level, CASE WHEN bool_and(disposition = 'AutoFixEligible') AND len(list_distinct(flatten(list(comps)))) <= 3 THEN 'AutoFixEligible' ELSE 'ManualReview' END AS disposition FROM k GROUP BY fp""",
)
def c11b(spark, sf):
    t = C.triage(triage_runs(spark, sf), PART_FAMILIES)["clusters"]
    return t.select("cluster_id", "fingerprint", "findings", "severity", F.col("regression_level").alias("level"), "disposition")


@query(
    "c12_release_gate",
    """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE md5(p_name) END AS h FROM part WHERE p_partkey % 29 <> 0), r AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN md5(p_brand) ELSE md5(p_name) END AS h FROM part WHERE p_partkey % 37 <> 0),
    c AS (SELECT CASE WHEN r.p_partkey IS NULL THEN 'missing-from-run' WHEN b.p_partkey IS NULL THEN 'not-in-baseline' WHEN b.h = '' THEN 'baseline-without-hash' WHEN r.h IS NULL THEN 'run-without-hash' WHEN b.h <> r.h THEN 'contract-changed' END AS issue FROM r FULL JOIN b USING (p_partkey)),
    e AS (SELECT o_orderkey % 97 = 0 AS sch, o_orderkey % 101 = 0 AS stat, o_custkey % 3 AS n, o_orderdate FROM orders)
    SELECT issue, count(*) AS n FROM c WHERE issue IS NOT NULL GROUP BY 1 UNION ALL SELECT 'unexpected-outcome', count(*) FROM r WHERE p_size % 4 = 0
    UNION ALL SELECT 'evidence-schema', count(*) FROM e WHERE sch UNION ALL SELECT 'evidence-status', count(*) FROM e WHERE stat UNION ALL SELECT 'evidence-without-artifact', count(*) FROM e WHERE n = 0
    UNION ALL SELECT 'evidence-artifact-empty', count(*) FROM e WHERE n > 0 UNION ALL SELECT 'evidence-none-verified', count(*) FROM e WHERE n = 1
    UNION ALL SELECT 'evidence-in-future', count(*) FROM e WHERE o_orderdate > TIMESTAMP '2001-01-01' UNION ALL SELECT 'evidence-stale', count(*) FROM e WHERE o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 14 DAY""",
)
def c12(spark, sf):
    p, o = table(spark, sf, "part"), table(spark, sf, "orders")
    k = F.col("p_partkey")
    sid = k.cast("string").alias("id")
    base = p.where(k % 29 != 0).select(sid, F.when(k % 23 == 0, F.lit("")).otherwise(F.md5("p_name")).alias("contract_hash"))
    run = p.where(k % 37 != 0).select(
        sid, F.lit("Pass").alias("expected_status"), F.when(F.col("p_size") % 4 == 0, F.lit("Regression")).otherwise(F.lit("Pass")).alias("actual_status"),
        F.when(k % 31 == 0, F.lit(None).cast("string")).when(k % 10 == 0, F.md5("p_brand")).otherwise(F.md5("p_name")).alias("contract_hash"),
    )
    arts = F.expr("transform(slice(array(0, 1), 1, cast(o_custkey % 3 as int)), s -> struct(concat('a', s) as path, s as size))")
    evidence = o.select(
        F.lit("p").alias("project"), F.lit("1").alias("source_revision"), F.lit("2").alias("tool_revision"), F.when(F.col("o_orderkey") % 101 == 0, F.lit("fail")).otherwise(F.lit("Pass")).alias("status"),
        F.col("o_orderdate").alias("executed_at"), F.when(F.col("o_orderkey") % 97 == 0, F.lit("v0")).otherwise(F.lit("real-project-evidence/v1")).alias("schema_version"), arts.alias("artifacts"),
    )
    return C.release_gate(run, base, evidence, F.lit("2001-01-01 00:00:00"))


META_SQL = """v AS (SELECT p_brand AS family, p_partkey AS ord, 'v' || p_partkey AS id, 'Pass' AS expected FROM part),
   r AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'Regression' WHEN p_size % 7 = 0 THEN 'SourceInvalid' ELSE 'Pass' END AS actual, p_partkey % 19 <> 0 AS preserved, p_size % 5 AS sp, p_size % 5 AS se, p_size % 4 AS todo, p_partkey % 11 <> 0 AS q, p_partkey % 13 <> 0 AS o FROM part WHERE p_partkey % 17 <> 0),
   j AS (SELECT v.*, r.*, r.p_partkey IS NULL AS missing, actual || '/' || sp || '/' || todo || '/' || q || '/' || o AS sig FROM v LEFT JOIN r ON v.ord = r.p_partkey),
   ref AS (SELECT family, min_by(id, CASE WHEN actual = 'Pass' AND preserved AND q AND o THEN 0 ELSE 100000000 END + ord) AS ref_id, min_by(sig, CASE WHEN actual = 'Pass' AND preserved AND q AND o THEN 0 ELSE 100000000 END + ord) AS ref_sig FROM j WHERE NOT missing GROUP BY 1),
   z AS (SELECT j.*, ref_id, concat_ws(',', CASE WHEN missing THEN 'missing-from-run' END, CASE WHEN NOT missing AND actual <> 'Pass' THEN 'unexpected-status' END, CASE WHEN NOT missing AND NOT preserved THEN 'source-changed' END, CASE WHEN NOT missing AND NOT q THEN 'quality-changed' END,
      CASE WHEN NOT missing AND NOT o THEN 'oracle-changed' END, CASE WHEN NOT missing AND sig <> ref_sig THEN 'signature-differs' END) AS reasons FROM j LEFT JOIN ref USING (family))"""


@query(
    "c13_metamorphic_check",
    f"""WITH {META_SQL} SELECT id, ref_id, reasons, reasons = '' AS passed, (NOT missing AND reasons <> '' AND coalesce(actual <> 'SourceInvalid' AND (actual = 'Regression' OR NOT q OR NOT o), false)) AS useful FROM z""",
)
def c13(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    vid = F.concat(F.lit("v"), k.cast("string")).alias("id")
    variants = p.select(F.col("p_brand").alias("family"), k.alias("ord"), vid, F.lit("Pass").alias("expected_status"))
    run = p.where(k % 17 != 0).select(
        F.upper(vid).alias("id"), F.lit("Pass").alias("expected_status"), F.when(size % 9 == 0, F.lit("Regression")).when(size % 7 == 0, F.lit("SourceInvalid")).otherwise(F.lit("Pass")).alias("actual_status"),
        (k % 19 != 0).alias("source_preserved"), (size % 5).alias("source_passed"), (size % 5).alias("source_expected"), F.lit(1).alias("target_passed"), F.lit(1).alias("target_expected"),
        (size % 4).alias("todo"), F.lit(0).alias("unmapped"), F.lit(0).alias("unsupported"), F.lit(0).alias("warnings"), (k % 11 != 0).alias("quality_passed"), (k % 13 != 0).alias("oracle_passed"),
        F.array().cast("array<string>").alias("categories"),
    )
    out = C.metamorphic_check(variants, run)
    return out.select("id", F.col("reference.id").alias("ref_id"), F.array_join("reasons", ",").alias("reasons"), "passed", F.col("useful_candidate").alias("useful")).withColumn("ref_id", F.lower("ref_id"))


@query(
    "c19_determinism_check",
    """WITH d AS (SELECT source, count(*) FILTER (doc_id % 211 = 0 OR doc_id % 307 = 0) AS differing_files, min(doc_id) % 3 = 0 AS exit_diff FROM documents GROUP BY 1)
    SELECT source, differing_files, CASE WHEN differing_files = 0 AND NOT exit_diff THEN 'IDENTICAL' ELSE 'DIFFERENT' END AS verdict FROM d""",
)
def c19(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.select("source", F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    b = docs.where(F.col("doc_id") % 211 != 0).select("source", F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 307 == 0, F.reverse("text")).otherwise(F.col("text")), 256).alias("sha"))
    exits = docs.groupBy("source").agg(F.lit(0).alias("exit_a"), F.when(F.min("doc_id") % 3 == 0, 1).otherwise(0).alias("exit_b"))
    return C.determinism_check(a, b, ["source"], exits).select("source", "differing_files", "verdict")
