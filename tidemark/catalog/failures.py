"""Failure classification, environment markers and the event oracle bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import LINES_SQL, doc_lines, query, sql_trim, table
from tidemark.plans import failures as P, observations as O

LOG_SHAPES = (
    "Failed {w}Test()", "Error: strict mode violation: {x}", "locator resolved to hidden {x}", "expect(locator).toHaveText failed {x}", "Expected: 1 but was {x}",
    "page.goto timeout {x}", "Timeout 3000ms exceeded. {x}", "login page {x}", "502 {x}", "fixture {x}", "{x}", "step failed {x}", "{x}", "target closed {x}", "playwright error {x}",
)
LOG_SQL = LINES_SQL + f""",
log AS (SELECT doc_id, source, line_no, CASE (doc_id + line_no) % {len(LOG_SHAPES)} """ + " ".join(
    f"WHEN {i} THEN replace(replace('{s}', '{{w}}', regexp_extract(line, '[A-Za-z]*', 0)), '{{x}}', line)" for i, s in enumerate(LOG_SHAPES)
) + " END AS line FROM lines)"


def log_lines(spark, sf):
    base = doc_lines(spark, sf).withColumn("w", F.regexp_extract("line", "[A-Za-z]*", 0))
    expr = None
    for i, shape in enumerate(LOG_SHAPES):
        text = F.replace(F.replace(F.lit(shape), F.lit("{w}"), F.col("w")), F.lit("{x}"), F.col("line"))
        cond = (F.col("doc_id") + F.col("line_no")) % len(LOG_SHAPES) == i
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return base.select("doc_id", "source", "line_no", expr.alias("line"))


def cascade_sql(rules):
    any_of = lambda words: "(" + " OR ".join(f"contains(lower(line), '{w}')" for w in words) + ")"
    return "CASE " + " ".join(f"WHEN {' AND '.join(any_of(g) for g in groups)} THEN '{label}'" for label, groups in rules) + " END"


T = sql_trim("line")
HEADER_SQL = rf"""CASE WHEN contains({T}, ' › ') OR starts_with(lower({T}), 'failed ') OR starts_with(lower({T}), 'passed ') OR contains(lower({T}), 'test name:') OR contains(lower({T}), 'fullname:')
    OR regexp_matches({T}, '(?:^|[^\p{{L}}\p{{N}}_])[a-zA-Z_][a-zA-Z0-9_<>]*\([^)]*\)') THEN {T} END"""
OBS_SQL = LOG_SQL + f""",
marked AS (SELECT doc_id, source, line_no, line, CASE WHEN length({T}) > 0 THEN {cascade_sql(P.FAILURE_RULES)} END AS category,
  last_value({HEADER_SQL} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS test,
  string_agg(rtrim(line), chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS snippet FROM log),
obs AS (SELECT doc_id, line_no, category, test, {T} AS message, md5(snippet) AS snippet FROM marked WHERE category IS NOT NULL
  UNION ALL SELECT doc_id, 1, 'unclassified-runtime-failure', NULL, 'failure text without a known pattern', NULL FROM marked GROUP BY doc_id
    HAVING count(category) = 0 AND bool_or(contains(lower(line), 'failed') OR contains(lower(line), 'error') OR contains(lower(line), 'timeout')))"""


@query("c05_classify_failures", f"WITH {OBS_SQL} SELECT doc_id, line_no::BIGINT AS line_no, category, test, message, snippet FROM obs")
def c05(spark, sf):
    out = P.classify_failures(log_lines(spark, sf), ["doc_id"])
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "category", "test", "message", F.md5("snippet").alias("snippet"))


STAGES = ("SourceRestore", "SourceTest", "TargetBuild", "TargetTest", "Migration")


@query(
    "c10_infra_markers",
    f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, line, CASE line_no % 5 WHEN 0 THEN 'SourceRestore' WHEN 1 THEN 'SourceTest' WHEN 2 THEN 'TargetBuild' WHEN 3 THEN 'TargetTest' ELSE 'Migration' END AS stage FROM lines),
    m AS (SELECT *, (stage IN ('SourceRestore', 'TargetBuild') AND contains(lower(line), 'heron')) OR (stage IN ('SourceTest', 'TargetTest') AND contains(lower(line), ' was ')) AS infra FROM s)
    SELECT doc_id, line_no::BIGINT AS line_no, infra, CASE WHEN doc_id % 13 = 0 THEN 'TimedOut' WHEN doc_id % 17 = 0 THEN 'InfrastructureFailure' WHEN line_no % 3 = 0 THEN 'Passed' WHEN infra THEN 'InfrastructureFailure' ELSE 'Failed' END AS outcome FROM m""",
)
def c10(spark, sf):
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("line_no") % 5)
    lines = doc_lines(spark, sf).withColumn("stage", stage)
    kw = {"general": ("heron",), "browser": (" was ",)}
    outcome = P.stage_outcome(F.col("doc_id") % 13 == 0, F.col("doc_id") % 17 == 0, F.col("line_no") % 3, "line", "stage", **kw)
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), P.infra_markers("line", "stage", **kw).alias("infra"), outcome.alias("outcome"))


@query(
    "c14_event_oracle",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    a AS (SELECT user_id, min(rn) AS p1 FROM e WHERE event_type = 'view' GROUP BY 1), b AS (SELECT e.user_id, min(rn) AS p2 FROM e JOIN a USING (user_id) WHERE event_type = 'click' AND rn > p1 GROUP BY 1),
    c AS (SELECT e.user_id, min(rn) AS p3 FROM e JOIN b USING (user_id) WHERE event_type = 'purchase' AND rn > p2 GROUP BY 1),
    s AS (SELECT user_id, count(*) AS observations, min_by(ts, rn) AS first_ts, max_by(ts, rn) FILTER (event_type = 'purchase') AS last_ts, max_by(event_type, rn) AS final_type FROM e GROUP BY 1),
    j AS (SELECT s.user_id, observations, CASE WHEN p3 IS NOT NULL THEN 3 WHEN p2 IS NOT NULL THEN 2 WHEN p1 IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS matched,
      greatest(0, floor(epoch_us(last_ts) / 1000)::BIGINT - floor(epoch_us(first_ts) / 1000)::BIGINT) AS elapsed_ms, final_type = 'purchase' AS state_passed FROM s LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id))
    SELECT user_id, observations, matched, elapsed_ms, matched = 3 AS sequence_passed, coalesce(elapsed_ms <= 2419200000, false) AS time_passed, state_passed,
      (matched = 3 AND coalesce(elapsed_ms <= 2419200000, false) AND state_passed) AS passed FROM j""",
)
def c14(spark, sf):
    out = O.event_oracle(
        table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", "ts", ("view", "click", "purchase"), 28 * 86400 * 1000, {"event_type": "purchase"}
    )
    return out.withColumn("matched", F.col("matched").cast("bigint"))
