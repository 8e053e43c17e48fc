"""Remediation plans bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.predicates import ISSUES_SQL
from tidemark.catalog.registry import code_lines, query, sql_trim, table
from tidemark.operators.lines import scan_issue_lines
from tidemark.plans import remediation as R

US = "chr(31)"
MSG_SQL = sql_trim(r"regexp_replace(regexp_replace(regexp_replace(message, '\[([A-Z]+)-SOURCE-LINE:\d+\]', '[\1-SOURCE-LINE:*]', 'g'), '(?i)\bat line \d+\b', 'at line *', 'g'), '\s+', ' ', 'g')")


@query(
    "c15_residual_inventory",
    f"""WITH {ISSUES_SQL}, i AS (SELECT *, source AS sf, CASE WHEN doc_id % 2 = 0 THEN source_line END AS sl, lower({MSG_SQL}) AS m, line_no * 10 + list_position(['Todo','BlockedSymbolUsage','DownstreamStatementBlocked','SourceOnlyIdentifierUsage','RawDeclarationVariablesBlocked','PageTodo','ActiveTodoLocator'], category) + doc_id * 1000000 AS ord FROM issues),
    k AS (SELECT source, sha256(lower(category) || {US} || sf || {US} || coalesce(sl::VARCHAR, '') || {US} || CASE WHEN sl IS NOT NULL THEN '' ELSE 'gen/' || doc_id END || {US} || CASE WHEN sl IS NOT NULL THEN '' ELSE line_no::VARCHAR END || {US} || m) AS residual_id, ord, severity, category FROM i)
    SELECT source, residual_id, max_by(category, ord) AS category, max_by(severity, ord) AS severity, max_by(severity <> 'Info', ord) AS actionable, max_by(severity <> 'Info' AND category <> 'Todo', ord) AS progress_bearing, count(*) AS issues FROM k GROUP BY 1, 2""",
)
def c15(spark, sf):
    order = F.array_position(F.array(*[F.lit(c) for c in ("Todo", "BlockedSymbolUsage", "DownstreamStatementBlocked", "SourceOnlyIdentifierUsage", "RawDeclarationVariablesBlocked", "PageTodo", "ActiveTodoLocator")]), F.col("category"))
    issues = scan_issue_lines(code_lines(spark, sf)).select(
        "source", "category", "severity", "message", F.col("source").alias("source_file"), F.when(F.col("doc_id") % 2 == 0, F.col("source_line")).alias("source_line"),
        F.concat(F.lit("gen\\"), F.col("doc_id").cast("string")).alias("generated_file"), F.col("line_no").alias("generated_line"),
        (F.col("line_no") * 10 + order + F.col("doc_id") * 1000000).alias("ord"),
    )
    return R.residual_inventory(issues, ["source"]).select("source", "residual_id", "category", "severity", "actionable", "progress_bearing", "issues")


# Customers as chains; their orders are residuals before and after a cycle.
RUN_COLS = ("source_sha", "tool_sha", "environment_sha", "config_sha", "syntax", "structural", "semantic_loss", "unsupported", "unmapped", "raw", "page_todo", "todo", "tests_found", "generated_files", "project_status", "project_diagnostics")


def run_pairs(spark, sf):
    k = F.col("c_custkey")
    one = lambda n: F.when(k % n == 0, 1).otherwise(0)
    before = F.struct(
        *[F.lit("a").alias(c) for c in ("source_sha", "tool_sha", "environment_sha", "config_sha")],
        *[F.lit(5).alias(c) for c in ("syntax", "structural", "semantic_loss", "unsupported", "unmapped", "raw", "page_todo", "todo", "tests_found", "generated_files")],
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'not-run' END").alias("project_status"), F.lit(3).alias("project_diagnostics"),
    )
    ident = lambda n: F.when(k % n == 0, F.lit("b")).otherwise(F.lit("a"))
    after = F.struct(
        ident(61).alias("source_sha"), ident(67).alias("tool_sha"), ident(71).alias("environment_sha"), ident(73).alias("config_sha"), (5 + one(37) - one(41)).alias("syntax"), F.lit(5).alias("structural"),
        F.lit(5).alias("semantic_loss"), (5 + one(11) - one(7)).alias("unsupported"), F.lit(5).alias("unmapped"), F.lit(5).alias("raw"), F.lit(5).alias("page_todo"), (5 - one(3)).alias("todo"), (5 - one(43)).alias("tests_found"),
        F.lit(5).alias("generated_files"), F.expr("CASE WHEN c_custkey % 47 = 0 THEN 'failed' WHEN c_custkey % 4 = 0 THEN 'passed' WHEN c_custkey % 4 = 1 THEN 'failed' ELSE 'not-run' END").alias("project_status"), F.lit(3).alias("project_diagnostics"),
    )
    return table(spark, sf, "customer").select(k.alias("chain"), before.alias("before"), after.alias("after"), (k % 53 == 0).alias("visited"))


def residual_sides(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("residual_id"), (F.col("o_orderstatus") != "P").alias("progress_bearing"), "o_orderpriority")
    before = o.where("residual_id % 9 <> 0")
    after = o.where("residual_id % 7 <> 0")
    named = before.where("o_orderpriority = '1-URGENT'").select("chain", "residual_id")
    return before, after, named


DECISION_SQL = """o AS (SELECT o_custkey AS chain, o_orderkey AS r, o_orderstatus <> 'P' AS bears, o_orderpriority FROM orders),
    ch AS (SELECT chain, count(*) FILTER (bears AND r % 9 = 0 AND r % 7 <> 0) AS opened, count(*) FILTER (bears AND r % 9 <> 0 AND r % 7 = 0) AS closed, count(*) FILTER (bears AND r % 9 <> 0 AND o_orderpriority = '1-URGENT') AS named,
       count(*) FILTER (bears AND r % 9 <> 0 AND r % 7 = 0 AND o_orderpriority = '1-URGENT') AS named_closed FROM o GROUP BY 1),
    j AS (SELECT c_custkey AS k, coalesce(opened, 0) AS opened, coalesce(closed, 0) AS closed, coalesce(named, 0) AS named, coalesce(named_closed, 0) AS named_closed FROM customer LEFT JOIN ch ON chain = c_custkey),
    v AS (SELECT k, CASE WHEN k % 61 = 0 THEN 'REJECT_REGRESSION|SOURCE_SNAPSHOT_CHANGED' WHEN k % 67 = 0 THEN 'REJECT_REGRESSION|TOOL_IDENTITY_CHANGED' WHEN k % 71 = 0 THEN 'REJECT_REGRESSION|ENVIRONMENT_IDENTITY_CHANGED' WHEN k % 53 = 0 THEN 'REJECT_CYCLE|REMEDIATION_CYCLE_DETECTED'
      WHEN (k % 37 = 0 AND k % 41 <> 0) OR k % 43 = 0 OR (k % 4 = 0 AND k % 47 = 0) THEN 'REJECT_REGRESSION|DETERMINISTIC_SAFETY_REGRESSION' WHEN named > 0 AND named_closed = 0 THEN 'REJECT_NO_PROGRESS|CANDIDATE_RESIDUAL_NOT_CLOSED'
      WHEN opened > closed THEN 'REJECT_REGRESSION|RESIDUAL_DEBT_REGRESSION' WHEN closed > 0 AND opened = 0 THEN 'ACCEPT|RESIDUAL_IDENTITY_IMPROVEMENT' WHEN closed > 0 THEN 'ACCEPT|RESIDUAL_REPLACEMENT_PROGRESS'
      WHEN k % 11 = 0 AND k % 7 <> 0 THEN 'REJECT_REGRESSION|DETERMINISTIC_METRIC_REGRESSION' WHEN (k % 41 = 0 AND k % 37 <> 0) OR (k % 7 = 0 AND k % 11 <> 0) THEN 'ACCEPT|DETERMINISTIC_IMPROVEMENT'
      WHEN k % 3 = 0 THEN 'REJECT_NO_PROGRESS|TODO_TEXT_REMOVAL_IS_NOT_PROGRESS' ELSE 'REJECT_NO_PROGRESS|NO_DETERMINISTIC_IMPROVEMENT' END AS v FROM j)"""


@query("c16_remediation_decision", f"WITH {DECISION_SQL} SELECT k AS chain, string_split(v, '|')[1] AS decision, string_split(v, '|')[2] AS reason, NOT starts_with(v, 'ACCEPT') AS requires_rollback FROM v")
def c16(spark, sf):
    before, after, named = residual_sides(spark, sf)
    change = R.residual_change(before, after, ["chain"], named)
    return R.remediation_decision(run_pairs(spark, sf).join(change, "chain", "left")).select("chain", "decision", "reason", "requires_rollback")


GUARD_SQL = """o AS (SELECT o_custkey AS chain, o_orderkey AS r, o_orderstatus, o_orderpriority FROM orders), n AS (SELECT chain, count(*) FILTER (o_orderpriority = '1-URGENT' AND r % 3 = 0) AS selected,
      min_by(CASE WHEN o_orderstatus <> 'O' THEN 'invalid' ELSE 'exhausted' END, r) FILTER (o_orderpriority = '1-URGENT' AND r % 3 = 0 AND (o_orderstatus <> 'O' OR r % 5 = 0)) AS bad, count(*) FILTER (o_orderstatus = 'O' AND r % 5 <> 0) AS left_open FROM o GROUP BY 1),
    j AS (SELECT c_custkey AS k, coalesce(selected, 0) AS selected, bad, coalesce(left_open, 0) AS left_open FROM customer LEFT JOIN n ON chain = c_custkey)
    SELECT k AS chain, CASE WHEN k % 31 = 0 THEN 'BLOCKED_BASELINE_MISMATCH' WHEN k % 29 = 0 OR k % 23 = 0 THEN 'BLOCKED_WORKSPACE_MISMATCH' WHEN bad = 'invalid' THEN 'BLOCKED_CANDIDATE_INVALID' WHEN bad = 'exhausted' THEN 'BLOCKED_CANDIDATE_EXHAUSTED' WHEN k % 19 = 0 THEN 'ROLLBACK_CONFIRMED'
      WHEN k % 17 = 0 THEN 'ABORT_CONFIRMED' WHEN k % 13 = 0 THEN 'BLOCKED_AUTONOMY_NOT_RUNNING' WHEN left_open > 0 AND selected = 0 THEN 'BLOCKED_CANDIDATE_REQUIRED' WHEN k % 2 = 0 THEN 'READY_INITIAL_BASELINE' ELSE 'READY' END AS status,
      CASE WHEN k % 31 = 0 THEN 'REMEDIATION_ACCEPTED_STATE_MISMATCH' WHEN k % 29 = 0 AND k % 23 = 0 THEN 'REMEDIATION_WORKSPACE_SOURCE_CONFIG_MISMATCH' WHEN k % 29 = 0 THEN 'REMEDIATION_WORKSPACE_SOURCE_MISMATCH' WHEN k % 23 = 0 THEN 'REMEDIATION_WORKSPACE_CONFIG_MISMATCH'
      WHEN bad = 'invalid' THEN 'REMEDIATION_RESIDUAL_CANDIDATE_NOT_IN_BASELINE' WHEN bad = 'exhausted' THEN 'REMEDIATION_RESIDUAL_CANDIDATE_ALREADY_EXHAUSTED' WHEN k % 19 = 0 THEN 'REMEDIATION_ROLLBACK_CONFIRMED' WHEN k % 17 = 0 THEN 'REMEDIATION_ACTIVE_CYCLE_BASELINE_RESTORED'
      WHEN k % 13 = 0 THEN 'AUTONOMY_STATE_NOT_RUNNING' WHEN left_open > 0 AND selected = 0 THEN 'REMEDIATION_RESIDUAL_CANDIDATE_REQUIRED' WHEN k % 2 = 0 THEN 'REMEDIATION_BASELINE_INITIALIZED' ELSE 'REMEDIATION_BASELINE_READY' END AS reason FROM j"""


@query("c17_cycle_guard", f"WITH {GUARD_SQL}")
def c17(spark, sf):
    k = F.col("c_custkey")
    states = table(spark, sf, "customer").select(
        k.alias("chain"), F.lit("s").alias("state_hash"), F.lit("AB").alias("source_sha"), F.lit("CD").alias("config_sha"),
        F.when(k % 29 == 0, F.lit("x")).otherwise(F.lit("ab")).alias("observed_source"), F.when(k % 23 == 0, F.lit("x")).otherwise(F.lit("cd")).alias("observed_config"),
        F.when(k % 31 == 0, F.lit("t")).when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("s")).alias("current_state"), (k % 19 == 0).alias("rollback_required"),
        (k % 17 == 0).alias("cycle_in_progress"), F.when(k % 13 == 0, F.lit("Stopped")).otherwise(F.lit("running")).alias("autonomy"),
    )
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("residual_id"), "o_orderstatus", "o_orderpriority")
    ids = lambda cond: o.where(cond).select("chain", "residual_id")
    flags = R.candidate_flags(states, ids("o_orderpriority = '1-URGENT' AND residual_id % 3 = 0"), ids("o_orderstatus = 'O'"), ids("residual_id % 5 = 0"), ["chain"])
    return R.cycle_guard(flags).select("chain", "status", "reason")


@query(
    "c18_rebaseline_check",
    """WITH c AS (SELECT c_custkey AS k, concat_ws(',', CASE WHEN c_custkey % 37 = 0 AND c_custkey % 41 <> 0 THEN 'syntax' END, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 <> 0 THEN 'unsupported' END, CASE WHEN c_custkey % 43 = 0 THEN 'tests_found' END,
       CASE WHEN c_custkey % 4 = 0 AND c_custkey % 47 = 0 THEN 'project' END) AS regressions FROM customer),
    r AS (SELECT *, CASE WHEN k % 61 = 0 THEN 'SOURCE_SNAPSHOT_CHANGED' WHEN k % 73 = 0 THEN 'CONFIG_IDENTITY_CHANGED' WHEN k % 71 = 0 THEN 'ENVIRONMENT_IDENTITY_CHANGED' WHEN k % 5 = 0 THEN 'TOOL_IDENTITY_UNCHANGED' WHEN regressions <> '' THEN 'NEW_TOOL_REGRESSION' ELSE 'NEW_TOOL_BASELINE_VERIFIED' END AS reason FROM c)
    SELECT k AS chain, regressions, reason, CASE WHEN reason = 'NEW_TOOL_BASELINE_VERIFIED' THEN 'REBASELINE_CONFIRMED' ELSE 'REBASELINE_REJECTED' END AS status FROM r""",
)
def c18(spark, sf):
    tool = F.when(F.col("chain") % 5 == 0, F.lit("a")).otherwise(F.lit("b"))
    pairs = run_pairs(spark, sf).withColumn("after", F.col("after").withField("tool_sha", tool))
    return R.rebaseline_check(pairs).select("chain", F.array_join("regressions", ",").alias("regressions"), "reason", "status")
