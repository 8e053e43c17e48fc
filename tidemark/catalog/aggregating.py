"""Aggregates A1-A27 bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.predicates import ACTIVE_SQL, EXPRESSION_SQL, TODO_SQL, TYPES_SQL, expression_lines, typed_lines
from tidemark.catalog.registry import CODE_SQL, LINES_SQL, code_lines, doc_lines, query, table
from tidemark.operators import aggregates as A, facts, lines as L, rules as R
from tidemark.operators.windows import enclosing

# Line items as action rows: file = part, test = order.
ACTIONS_SQL = """actions AS (
  SELECT l_partkey AS file, l_orderkey AS test, (l_linenumber = 7 AND l_quantity < 4) AS in_setup,
         CASE l_returnflag WHEN 'A' THEN 'Semantic' WHEN 'N' THEN 'SyntaxFallback' ELSE 'Unsupported' END AS confidence,
         CASE WHEN l_linestatus = 'O' THEN 'TestId' WHEN l_tax > 0.01 THEN 'Unresolved' END AS target_kind, l_returnflag = 'R' AS is_unsupported,
         l_suppkey AS project, l_quantity FROM lineitem),
todos AS (SELECT l_partkey AS file, count(*) FILTER (l_discount > 0.08) AS todo, count(*) FILTER (l_discount = 0.1) AS empty_after FROM lineitem GROUP BY 1),
per_test AS (SELECT file, test, in_setup, count(*) FILTER (confidence = 'Semantic') AS semantic, count(*) FILTER (confidence = 'SyntaxFallback') AS fallback,
    count(*) FILTER (is_unsupported) AS unsupported, count(*) FILTER (target_kind <> 'Unresolved') AS mapped, count(*) FILTER (target_kind = 'Unresolved') AS unmapped FROM actions GROUP BY 1, 2, 3),
per_file AS (SELECT file, count(*) FILTER (NOT in_setup) AS total_tests, count(*) FILTER (NOT in_setup AND unsupported = 0) AS clean, bool_or(in_setup AND unsupported > 0) AS setup_bad,
    sum(semantic)::BIGINT AS semantic, sum(fallback)::BIGINT AS fallback, sum(unsupported)::BIGINT AS unsupported, sum(mapped)::BIGINT AS mapped, sum(unmapped)::BIGINT AS unmapped FROM per_test GROUP BY 1),
file_reports AS (SELECT file, total_tests, CASE WHEN setup_bad THEN 0 ELSE greatest(0, clean - coalesce(empty_after, 0)) END::BIGINT AS converted_tests,
    semantic, fallback, unsupported, mapped, unmapped, coalesce(todo, 0) AS todo FROM per_file LEFT JOIN todos USING (file)),
runs AS (SELECT p_brand AS run, count(*) AS files, sum(total_tests)::BIGINT AS total_tests, sum(converted_tests)::BIGINT AS converted_tests, sum(semantic)::BIGINT AS semantic, sum(fallback)::BIGINT AS fallback,
    sum(unsupported)::BIGINT AS unsupported, sum(mapped)::BIGINT AS mapped, sum(unmapped)::BIGINT AS unmapped, sum(todo)::BIGINT AS todo,
    count(*) FILTER (todo > 0 OR unmapped > 0 OR unsupported > 0) AS files_with_warnings FROM file_reports JOIN part ON file = p_partkey GROUP BY 1)"""


def action_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("test"), ((F.col("l_linenumber") == 7) & (F.col("l_quantity") < 4)).alias("in_setup"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'Semantic' WHEN 'N' THEN 'SyntaxFallback' ELSE 'Unsupported' END").alias("confidence"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'TestId' WHEN l_tax > 0.01 THEN 'Unresolved' END").alias("target_kind"),
        (F.col("l_returnflag") == "R").alias("is_unsupported"),
    )


def file_reports(spark, sf):
    todos = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(
        F.count_if(F.col("l_discount") > 0.08).alias("todo"), F.count_if(F.col("l_discount") == 0.1).alias("empty_after")
    )
    return A.file_report(action_rows(spark, sf), ["file"], todos)


def runs(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("run"))
    return A.run_summary(file_reports(spark, sf).join(part, "file"), ["run"])


@query("a01_file_report", f"WITH {ACTIONS_SQL} SELECT * FROM file_reports")
def a01(spark, sf):
    return file_reports(spark, sf)


@query("a02_run_summary", f"WITH {ACTIONS_SQL} SELECT * FROM runs")
def a02(spark, sf):
    return runs(spark, sf)


LEVEL_SQL = """leveled AS (SELECT run, CASE WHEN mapped + unmapped = 0 THEN 100.0 ELSE round_even(mapped * 100.0::DOUBLE / (mapped + unmapped), 2) END::DOUBLE AS coverage,
      round_even(todo * 1.0::DOUBLE / greatest(total_tests, 1), 2)::DOUBLE AS todo_per_test, round_even(unsupported * 1.0::DOUBLE / greatest(total_tests, 1), 2)::DOUBLE AS unsupported_per_test, * EXCLUDE (run) FROM runs),
    quality AS (SELECT *, CASE WHEN unsupported = 0 AND unmapped = 0 AND todo = 0 THEN 'clean' WHEN coverage >= 90 AND unsupported_per_test <= 0.10 AND todo_per_test <= 0.25 THEN 'near_ready'
      WHEN coverage >= 70 THEN 'needs_profile_iteration' ELSE 'needs_discovery' END AS level FROM leveled)"""


@query("a03_quality_level", f"WITH {ACTIONS_SQL}, {LEVEL_SQL} SELECT run, coverage, todo_per_test, unsupported_per_test, level FROM quality")
def a03(spark, sf):
    return A.quality_level(runs(spark, sf)).select("run", "coverage", "todo_per_test", "unsupported_per_test", "level")


@query(
    "a04_count_with_example",
    f"""WITH {TODO_SQL} SELECT code, count(*) AS n, min(doc_id * 1000000 + line_no) // 1000000 AS example_doc_id, (min(doc_id * 1000000 + line_no) % 1000000)::BIGINT AS example_line_no,
        min_by(message, doc_id * 1000000 + line_no) AS example_message FROM todos GROUP BY code""",
)
def a04(spark, sf):
    todos = L.extract_todos(code_lines(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))
    return A.count_with_example(todos, ["code"], ["doc_id", "line_no", "message"])


@query(
    "a05_occurrences",
    "SELECT l_suppkey, l_returnflag, sum(l_quantity)::DOUBLE AS occurrences, count(DISTINCT l_orderkey) AS files, min(l_orderkey) AS example_file FROM lineitem GROUP BY ALL",
)
def a05(spark, sf):
    return A.occurrences(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_orderkey", "l_quantity")


@query(
    "a06_is_parameterized",
    "SELECT l_partkey, l_suppkey, count(*) AS calls, count(DISTINCT l_quantity) > 1 AS parameterized, min(l_quantity) AS example FROM lineitem GROUP BY ALL",
)
def a06(spark, sf):
    return A.is_parameterized(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "l_quantity")


# Two rules an item: its whole text and its first 2 to 8 words.
REUSE_SQL = """rules AS (SELECT 'full-' || item_id AS rule_id, 'layer' || (item_id % 5) AS layer, text AS key FROM benchmark
      UNION ALL SELECT 'part-' || item_id, 'layer' || (item_id % 5), array_to_string(string_split(text, ' ')[1:(2 + item_id % 7)], ' ') FROM benchmark),
    hits AS (SELECT DISTINCT rule_id FROM rules, documents WHERE contains(text, key)),
    agg AS (SELECT layer, count(*) AS rules, count(h.rule_id) AS matched FROM rules r LEFT JOIN hits h USING (rule_id) GROUP BY layer)"""


def reuse_tables(spark, sf):
    from tidemark.operators.literals import literal_hits

    b, k = table(spark, sf, "benchmark"), F.col("item_id")
    words = F.array_join(F.slice(F.split("text", " ", -1), F.lit(1), (k % 7 + 2).cast("int")), " ")
    rule = lambda kind, key: b.select(F.concat(F.lit(kind + "-"), k.cast("string")).alias("rule_id"), F.concat(F.lit("layer"), (k % 5).cast("string")).alias("layer"), key.alias("key"))
    rules = rule("full", F.col("text")).unionAll(rule("part", words))
    return rules, literal_hits(table(spark, sf, "documents"), "doc_id", "text", rules, "rule_id", "key")


@query(
    "a07_reuse_ratio",
    f"""WITH {REUSE_SQL} SELECT layer, rules, matched, round_even(100.0::DOUBLE * matched / rules, 1)::DOUBLE AS score,
       CASE WHEN round_even(100.0::DOUBLE * matched / rules, 1) >= 70 THEN 'high-reuse' WHEN round_even(100.0::DOUBLE * matched / rules, 1) >= 40 THEN 'partial-reuse' WHEN matched > 0 THEN 'low-reuse' ELSE 'no-signal' END AS verdict FROM agg""",
)
def a07(spark, sf):
    rules, hits = reuse_tables(spark, sf)
    return A.reuse_ratio(rules, hits, ["layer"], "rule_id")


@query(
    "a08_expression_frequency",
    f"""WITH {EXPRESSION_SQL} SELECT expression, count(*) AS n, min(doc_id * 1000000 + line_no) // 1000000 AS example_doc_id, (min(doc_id * 1000000 + line_no) % 1000000)::BIGINT AS example_line_no
    FROM expr WHERE split_part(expression, '.', 1) NOT IN ('this','base','Task','DateTime','TimeSpan','String','Math','Guid','System','Console') AND NOT contains(expression, 'Should') AND NOT contains(expression, 'Assert') GROUP BY 1""",
)
def a08(spark, sf):
    ex = facts.extract_expressions(expression_lines(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))
    return A.count_with_example(ex, ["expression"], ["doc_id", "line_no"])


# Event types as failure categories.
EVENT_CATEGORY_SQL = "CASE event_type WHEN 'error' THEN 'environment/flaky-infra' WHEN 'click' THEN 'locator-not-found' WHEN 'view' THEN 'timeout-wait-state' WHEN 'signup' THEN 'strict-mode-violation' ELSE 'other' END"


def failure_obs(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id"), F.to_date("ts").alias("day"), F.expr(EVENT_CATEGORY_SQL).alias("category"))


GROUPS_SQL = f"""g AS (SELECT user_id, {EVENT_CATEGORY_SQL} AS category, count(*) AS n FROM events GROUP BY 1, 2),
    sv AS (SELECT *, CASE category WHEN 'environment/flaky-infra' THEN 'error' WHEN 'other' THEN 'info' ELSE 'warning' END AS severity,
       CASE category WHEN 'environment/flaky-infra' THEN 3 WHEN 'other' THEN 1 ELSE 2 END AS w,
       CASE category WHEN 'environment/flaky-infra' THEN 'environment-auth-gap' WHEN 'locator-not-found' THEN 'selector-evidence-gap' WHEN 'strict-mode-violation' THEN 'selector-evidence-gap'
         WHEN 'timeout-wait-state' THEN 'wait-or-product-state-gap' ELSE 'unclassified-runtime-gap' END AS root_cause FROM g)"""


@query(
    "a09_failure_groups",
    f"""WITH {GROUPS_SQL} SELECT user_id, root_cause, sum(n)::BIGINT AS n, max_by(severity, w * 1000000 + n) AS severity, string_agg(category, ',' ORDER BY category) AS categories FROM sv GROUP BY 1, 2""",
)
def a09(spark, sf):
    causes = A.failure_groups(failure_obs(spark, sf), ["user_id"])[1]
    return causes.select("user_id", "root_cause", "n", "severity", F.array_join("categories", ",").alias("categories"))


@query(
    "a10_readiness",
    f"""WITH {GROUPS_SQL}, s AS (SELECT user_id, least(greatest(100 - sum(w * least(n, 10) * 4) - CASE WHEN bool_or(category = 'environment/flaky-infra') THEN 25 ELSE 0 END - CASE WHEN user_id % 2 = 0 THEN 15 ELSE 0 END - CASE WHEN user_id % 3 = 0 THEN 5 ELSE 0 END, 0), 100)::BIGINT AS score FROM sv GROUP BY user_id)
    SELECT user_id, score, CASE WHEN score >= 85 THEN 'ready' WHEN score >= 65 THEN 'nearly-ready' WHEN score >= 40 THEN 'needs-targeted-fixes' ELSE 'blocked' END AS level FROM s""",
)
def a10(spark, sf):
    groups = A.failure_groups(failure_obs(spark, sf), ["user_id"])[0]
    return A.readiness(groups, ["user_id"], F.col("user_id") % 2, F.col("user_id") % 3)


HELPER_SQL = """h AS (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || (user_id % 20) AS name,
      CASE user_id % 4 WHEN 0 THEN 'ReadOnlyProbe' WHEN 1 THEN 'SafeWaitElide' WHEN 2 THEN 'AssertionHelper' ELSE CASE WHEN value > 30 THEN 'RequiredSideEffect' ELSE 'UnknownUnsafe' END END AS semantics,
      CASE WHEN value > 40 THEN 'medium' WHEN value < 2 THEN 'unknown' ELSE 'low' END AS risk, (event_id % 100) / 100.0::DOUBLE AS confidence,
      ['e' || (event_id % 13), 'f' || (event_id % 3)] AS evidence FROM events)"""


def helpers(spark, sf):
    e = table(spark, sf, "events")
    st = lambda c: c.cast("string")
    k = F.col("event_id")
    return e.select(
        F.concat(F.when(k % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), st(F.col("user_id") % 20)).alias("name"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 'ReadOnlyProbe' WHEN 1 THEN 'SafeWaitElide' WHEN 2 THEN 'AssertionHelper' ELSE CASE WHEN value > 30 THEN 'RequiredSideEffect' ELSE 'UnknownUnsafe' END END").alias("semantics"),
        F.expr("CASE WHEN value > 40 THEN 'medium' WHEN value < 2 THEN 'unknown' ELSE 'low' END").alias("risk"), ((k % 100) / F.lit(100.0)).alias("confidence"),
        F.array(F.concat(F.lit("e"), st(k % 13)), F.concat(F.lit("f"), st(k % 3))).alias("evidence"),
    )


@query(
    "a11_helper_families",
    f"""WITH {HELPER_SQL}, fam AS (SELECT lower(name) AS k, min(name) AS name, count(*) AS occurrences, round_even(avg(confidence), 2)::DOUBLE AS confidence,
       min(list_position(['RequiredSideEffect','ProjectWaitHelper','AssertionHelper','UnknownUnsafe','ReadOnlyProbe','SafeWaitElide'], semantics)) AS s, min(list_position(['high','medium','unknown','low'], risk)) AS r FROM h GROUP BY 1),
     ev AS (SELECT k, label, c, row_number() OVER (PARTITION BY k ORDER BY c DESC, label) AS rn FROM (SELECT lower(name) AS k, label, count(*) AS c FROM (SELECT name, unnest(evidence) AS label FROM h) GROUP BY 1, 2))
    SELECT name, occurrences, confidence, ['RequiredSideEffect','ProjectWaitHelper','AssertionHelper','UnknownUnsafe','ReadOnlyProbe','SafeWaitElide'][s] AS semantics, ['high','medium','unknown','low'][r] AS risk,
      (SELECT string_agg(label || ' (' || c || ')', '; ' ORDER BY rn) FROM ev WHERE ev.k = fam.k) AS top_evidence FROM fam""",
)
def a11(spark, sf):
    return A.helper_families(helpers(spark, sf)).withColumn("top_evidence", F.array_join("top_evidence", "; "))


@query(
    "a12_helper_semantics",
    r"""WITH b AS (SELECT doc_id, source AS method, text AS body, contains(lower(text), 'tion') AS side, contains(lower(text), 'keit') OR contains(lower(text), 'eaux') AS wait, contains(lower(text), 'heron') AS sel, contains(lower(text), 'with') AS ro, contains(lower(text), 'der ') AS asr FROM documents)
    SELECT doc_id, CASE WHEN side THEN 'RequiredSideEffect' WHEN wait THEN 'ProjectWaitHelper' WHEN ro AND NOT asr THEN 'ReadOnlyProbe' WHEN asr THEN 'AssertionHelper' ELSE 'UnknownUnsafe' END AS semantics,
      (CASE WHEN side THEN CASE WHEN sel THEN 0.88 ELSE 0.74 END WHEN wait THEN 0.68 WHEN ro AND NOT asr THEN 0.76 WHEN asr THEN 0.64 ELSE 0.35 END)::DOUBLE AS confidence,
      CASE WHEN side THEN 'high' WHEN wait THEN 'medium' WHEN ro AND NOT asr THEN 'low' WHEN asr THEN 'medium' ELSE 'unknown' END AS risk FROM b""",
)
def a12(spark, sf):
    from tidemark.plans.helpers import helper_semantics

    rules = {
        "mouse-click": ("tion",), "wait-presence": ("keit", "eaux"), "selenium-find-element": ("heron",), "read-only-probe": ("with",), "assertion": ("der ",),
    }
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("body"))
    return helper_semantics(docs, rules).select("doc_id", "semantics", "confidence", "risk")


@query(
    "a13_base_class_usage",
    f"""WITH {TYPES_SQL}, attr AS (SELECT base_class, string_agg(DISTINCT a, ',' ORDER BY a) AS attributes FROM (SELECT base_class, unnest(string_split(attributes, ',')) AS a FROM types WHERE base_class IS NOT NULL) WHERE a <> '' GROUP BY 1)
    SELECT t.base_class, count(*) AS usage, coalesce(any_value(attr.attributes), '') AS attributes, min(namespace) AS namespace, CASE WHEN count(*) >= 3 THEN 'High' ELSE 'Medium' END AS confidence
    FROM types t LEFT JOIN attr ON attr.base_class = t.base_class WHERE t.base_class IS NOT NULL GROUP BY 1""",
)
def a13(spark, sf):
    types = facts.extract_types(typed_lines(spark, sf), ["doc_id"])
    return A.base_class_usage(types).withColumn("attributes", F.array_join("attributes", ","))


@query(
    "a14_frequency_confidence",
    """SELECT name, sum(n)::BIGINT AS n, CASE WHEN sum(n) >= 10 THEN 'High' WHEN sum(n) >= 3 THEN 'Medium' ELSE 'Low' END AS confidence FROM
       (SELECT a.name, ((length(lower(html)) - length(replace(lower(html), a.name, ''))) // length(a.name)) AS n FROM pages, (VALUES ('class='), ('href='), ('role'), ('itemprop'), ('lang="de"')) a(name)) WHERE n > 0 GROUP BY name""",
)
def a14(spark, sf):
    found = facts.occurrence_facts(table(spark, sf, "pages"), ["page_id"], "attr", ("class=", "href=", "role", "itemprop", 'lang="de"'), "html", fold_case=True)
    return A.frequency_confidence(found, ["name"], "n")


LANG_WEIGHTS = (("en", "the ", 5), ("en", " and ", 3), ("fr", " le ", 5), ("fr", "eaux", 4), ("de", " der ", 5), ("de", "keit", 4), ("es", " el ", 5), ("es", "ción", 3))


@query(
    "a15_detect_source",
    "WITH w(label, needle, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in LANG_WEIGHTS)
    + """), s AS (SELECT source, label, sum(weight)::BIGINT AS score FROM documents, w WHERE contains(text, needle) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, label) AS rn, coalesce(lead(score) OVER (PARTITION BY source ORDER BY score DESC, label), 0) AS runner_up FROM s)
    SELECT source, label AS best, score, runner_up, CASE WHEN score < 30 THEN 'unknown' WHEN score - runner_up < 12 THEN 'ambiguous' ELSE label END AS detected FROM r WHERE rn = 1""",
)
def a15(spark, sf):
    from tidemark.plans.portfolio import signal_scores

    scores = signal_scores(table(spark, sf, "documents"), ["source"], LANG_WEIGHTS)
    return R.detect_best(scores, ["source"], "label", "score")


@query(
    "a16_status_counts",
    """SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'P') AS "n_P" FROM orders GROUP BY 1""",
)
def a16(spark, sf):
    return A.status_counts(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ("O", "F", "P"))


FINDING_SQL = """f AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'migration' WHEN 1 THEN 'project-verify' ELSE 'semantic-oracle' END AS stage, ['D' || (p_size % 4)] AS diagnostics, CASE WHEN p_size % 5 = 0 THEN ['event'] ELSE [] END AS semantics,
    [p_type, p_brand] AS features, ['c' || (p_size % 2), 'c' || (p_partkey % 5)] AS components, CASE p_partkey % 7 WHEN 0 THEN 'MigratorFailure' WHEN 1 THEN 'Regression' ELSE 'SourceInvalid' END AS actual_status,
    CASE WHEN p_partkey % 9 = 0 THEN 'ManualReview' ELSE 'AutoFixEligible' END AS disposition, CASE WHEN p_partkey % 11 = 0 THEN 'ProjectFixture' WHEN p_partkey % 2 = 0 THEN 'SavedSeed' ELSE 'UnitTest' END AS regression_level FROM part),
  k AS (SELECT *, 'stage=' || stage || '|diag=' || array_to_string(diagnostics, ',') || '|semantic=' || coalesce(array_to_string(semantics, ','), '') || '|features=' ||
      array_to_string(list_sort(list_distinct(list_transform(features, lambda x: CASE x WHEN 'LARGE' THEN 'large-family' WHEN 'MEDIUM' THEN 'large-family' WHEN 'ECONOMY' THEN 'cheap' ELSE lower(x) END))), ',') AS fingerprint FROM f),
  clusters AS (SELECT fingerprint, 'cluster-' || left(sha256(fingerprint), 8) AS cluster_id, min(stage) AS stage, count(*) AS findings,
      array_to_string(list_sort(list_distinct(flatten(list(features)))), ',') AS features, array_to_string(list_sort(list_distinct(flatten(list(components)))), ',') AS components,
      CASE WHEN bool_or(actual_status IN ('MigratorFailure', 'NonDeterministic')) THEN 'high' WHEN bool_or(actual_status = 'Regression') THEN 'medium' ELSE 'low' END AS severity,
      CASE WHEN bool_or(regression_level = 'ProjectFixture') THEN 'ProjectFixture' WHEN bool_and(regression_level = 'SavedSeed') THEN 'SavedSeed' ELSE 'UnitTest' END AS regression_level,
      CASE WHEN bool_and(disposition = 'AutoFixEligible') AND len(list_distinct(flatten(list(components)))) <= 3 THEN 'AutoFixEligible' ELSE 'ManualReview' END AS disposition FROM k GROUP BY fingerprint)"""


def findings(spark, sf):
    st = lambda c: c.cast("string")
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("id"), F.expr("CASE p_size % 3 WHEN 0 THEN 'migration' WHEN 1 THEN 'project-verify' ELSE 'semantic-oracle' END").alias("stage"),
        F.array(F.concat(F.lit("D"), st(size % 4))).alias("diagnostics"), F.when(size % 5 == 0, F.array(F.lit("event"))).otherwise(F.array().cast("array<string>")).alias("semantics"),
        F.array("p_type", "p_brand").alias("features"), F.array(F.concat(F.lit("c"), st(size % 2)), F.concat(F.lit("c"), st(key % 5))).alias("components"),
        F.expr("CASE p_partkey % 7 WHEN 0 THEN 'MigratorFailure' WHEN 1 THEN 'Regression' ELSE 'SourceInvalid' END").alias("actual_status"),
        F.expr("CASE WHEN p_partkey % 9 = 0 THEN 'ManualReview' ELSE 'AutoFixEligible' END").alias("disposition"),
        F.expr("CASE WHEN p_partkey % 11 = 0 THEN 'ProjectFixture' WHEN p_partkey % 2 = 0 THEN 'SavedSeed' ELSE 'UnitTest' END").alias("regression_level"),
    )


PART_FAMILIES = {"large-family": ("LARGE", "MEDIUM"), "cheap": ("ECONOMY",)}


@query("a17_issue_clusters", f"WITH {FINDING_SQL} SELECT * FROM clusters")
def a17(spark, sf):
    clusters = A.issue_clusters(findings(spark, sf), PART_FAMILIES)[0]
    return clusters.withColumns({"features": F.array_join("features", ","), "components": F.array_join("components", ",")})


EXIT_STATUS_SQL = "CASE o_orderkey % 97 WHEN 0 THEN 'MigratorFailure' WHEN 1 THEN 'Regression' WHEN 2 THEN 'NonDeterministic' WHEN 3 THEN 'PassWithWarnings' ELSE 'Pass' END"


@query(
    "a18_suite_exit_code",
    f"""WITH r AS (SELECT o_custkey, {EXIT_STATUS_SQL} AS s FROM orders), p AS (SELECT o_custkey, min(CASE WHEN s <> 'Pass' THEN CASE s WHEN 'MigratorFailure' THEN 0 WHEN 'Regression' THEN 1 WHEN 'NonDeterministic' THEN 4 ELSE 5 END END) AS p, count(*) FILTER (s <> 'Pass') AS unexpected FROM r GROUP BY 1)
    SELECT o_custkey, unexpected, CASE p WHEN 0 THEN 11 WHEN 1 THEN 10 WHEN 4 THEN 14 WHEN 5 THEN 10 ELSE 0 END::BIGINT AS exit_code FROM p""",
)
def a18(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.expr(EXIT_STATUS_SQL).alias("actual_status"), F.lit("Pass").alias("expected_status"))
    return A.suite_exit_code(o, ["o_custkey"]).withColumn("exit_code", F.col("exit_code").cast("bigint"))


@query(
    "a19_merge_metrics",
    """WITH a AS (SELECT l_suppkey, l_returnflag AS metric, max(l_linenumber * 10 + l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), b AS (SELECT l_suppkey, l_returnflag AS metric, max(l_linenumber * 10 + l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R' GROUP BY 1, 2)
    SELECT l_suppkey, metric, coalesce(b.v, 0)::DOUBLE AS before, coalesce(a.v, 0)::DOUBLE AS after, (coalesce(a.v, 0) - coalesce(b.v, 0))::DOUBLE AS delta FROM a FULL JOIN b USING (l_suppkey, metric)""",
)
def a19(spark, sf):
    m = table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", F.col("l_returnflag").alias("metric"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("value"))
    return A.merge_metrics(m.where("l_linestatus = 'O'"), m.where("l_linestatus = 'F' AND metric <> 'R'"), ["l_suppkey"])


@query(
    "a20_duplicate_keys",
    """WITH k AS (SELECT c_mktsegment, 'n' || c_nationkey AS key, c_custkey FROM customer WHERE c_nationkey <> 0), f AS (SELECT *, min(c_custkey) OVER (PARTITION BY c_mktsegment, key) AS first_position FROM k)
    SELECT c_mktsegment, key, c_custkey AS position, first_position FROM f WHERE c_custkey > first_position""",
)
def a20(spark, sf):
    key = F.when(F.col("c_nationkey") == 0, F.lit("  ")).otherwise(F.concat(F.lit(" n"), F.col("c_nationkey").cast("string")))
    return A.duplicate_keys(table(spark, sf, "customer").select("c_mktsegment", key.alias("key"), "c_custkey"), ["c_mktsegment"], "key", "c_custkey")


@query(
    "a21_section_sizes",
    """SELECT o_orderpriority, count(*) FILTER (o_orderkey % 17 <> 3) AS before, count(*) FILTER (o_orderkey % 13 <> 5) AS after, count(*) FILTER (o_orderkey % 13 <> 5) - count(*) FILTER (o_orderkey % 17 <> 3) AS change FROM orders GROUP BY 1""",
)
def a21(spark, sf):
    o = table(spark, sf, "orders")
    return A.section_sizes(o.where("o_orderkey % 17 <> 3"), o.where("o_orderkey % 13 <> 5"), "o_orderpriority")


DOMAINS = {"o_orderstatus": ("O", "F", "P", "X"), "o_orderpriority": ("1-URGENT", "2-HIGH", "6-NONE"), "weekday": tuple(str(i) for i in range(0, 9))}


@query(
    "a22_missing_pairs",
    """WITH o AS (SELECT o_orderstatus, o_orderpriority, (o_custkey % 8)::VARCHAR AS weekday FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') AND NOT (o_orderstatus = 'F' AND o_custkey % 8 = 4)),
    grid AS (SELECT 'o_orderstatus' AS dim_a, s AS value_a, 'o_orderpriority' AS dim_b, p AS value_b FROM (VALUES ('O'),('F'),('P'),('X')) a(s), (VALUES ('1-URGENT'),('2-HIGH'),('6-NONE')) b(p)
      UNION ALL SELECT 'o_orderstatus', s, 'weekday', w::VARCHAR FROM (VALUES ('O'),('F'),('P'),('X')) a(s), range(9) r(w) UNION ALL SELECT 'o_orderpriority', p, 'weekday', w::VARCHAR FROM (VALUES ('1-URGENT'),('2-HIGH'),('6-NONE')) b(p), range(9) r(w)),
    seen AS (SELECT DISTINCT 'o_orderstatus', o_orderstatus, 'o_orderpriority', o_orderpriority FROM o UNION SELECT DISTINCT 'o_orderstatus', o_orderstatus, 'weekday', weekday FROM o UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority, 'weekday', weekday FROM o)
    SELECT * FROM grid EXCEPT SELECT * FROM seen""",
)
def a22(spark, sf):
    o = table(spark, sf, "orders").where("NOT (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') AND NOT (o_orderstatus = 'F' AND o_custkey % 8 = 4)")
    return A.missing_pairs(o.select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 8).alias("weekday")), DOMAINS)


WORD_CLUSTERS = (("the", r"\b[Tt]he \w+"), ("of", r"\bof \w+"), ("der", r"\bder \w+"), ("caps", r"^\w+"))


@query(
    "a23_pattern_clusters",
    rf"""WITH {LINES_SQL}, h AS (SELECT 'the' AS category, regexp_extract(line, '\b[Tt]he \w+', 0) AS text FROM lines UNION ALL SELECT 'of', regexp_extract(line, '\bof \w+', 0) FROM lines
       UNION ALL SELECT 'der', regexp_extract(line, '\bder \w+', 0) FROM lines UNION ALL SELECT 'caps', regexp_extract(line, '^\w+', 0) FROM lines),
    c AS (SELECT category, text, count(*) AS occurrences FROM h WHERE text <> '' GROUP BY 1, 2)
    SELECT category, text, occurrences FROM c ORDER BY occurrences DESC, category, text""",
)
def a23(spark, sf):
    return A.pattern_clusters(doc_lines(spark, sf), patterns=WORD_CLUSTERS)


ROOT_RULES = (("blocked-symbol", r"unresolved symbol (\w+)", 1), ("source-only", r"source-only identifier (\w+)", 1))


@query(
    "a24_root_causes",
    rf"""WITH {TODO_SQL}, k AS (SELECT doc_id, line_no, CASE WHEN regexp_extract(message, 'unresolved symbol (\w+)', 1) <> '' THEN 'blocked-symbol:' || regexp_extract(message, 'unresolved symbol (\w+)', 1)
        WHEN regexp_extract(message, 'source-only identifier (\w+)', 1) <> '' THEN 'source-only:' || regexp_extract(message, 'source-only identifier (\w+)', 1) ELSE code END AS group_key FROM todos)
    SELECT group_key, count(*) AS n, min(doc_id) AS example_file, (min(doc_id * 1000000 + line_no) % 1000000)::BIGINT AS example_line, array_to_string(list_sort(list(DISTINCT doc_id))[1:5], ',') AS files FROM k GROUP BY 1""",
)
def a24(spark, sf):
    todos = L.extract_todos(code_lines(spark, sf)).withColumnRenamed("doc_id", "file").withColumn("line_no", F.col("line_no").cast("bigint"))
    out = A.root_causes(todos, ROOT_RULES)
    return out.drop("file_count").withColumn("files", F.array_join(F.transform("files", lambda x: x.cast("string")), ","))


HEADER_SQL = r"nullif(regexp_extract(line, 'Task (\w+)\(\)', 1), '')"


@query(
    "a25_method_stats",
    rf"""WITH {CODE_SQL}, t AS (SELECT *, last_value({HEADER_SQL} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS test FROM code),
    s AS (SELECT doc_id, test, count(*) AS lines, count(*) FILTER ({ACTIVE_SQL}) AS active_lines, count(*) FILTER (contains(line, 'TODO')) AS todo_lines, count(*) FILTER (contains(line, 'await ')) AS awaits,
      count(*) FILTER (contains(line, 'Assert') OR contains(line, 'Expect') OR contains(line, 'Should')) AS assertions, count(*) FILTER (contains(line, 'ocator(') OR contains(line, 'GetBy') OR contains(line, 'getBy')) AS locators FROM t WHERE test IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, CASE WHEN active_lines + todo_lines = 0 THEN 0 ELSE round_even(active_lines / (active_lines + todo_lines), 2) END::DOUBLE AS active_ratio FROM s)
    SELECT *, CASE WHEN todo_lines = 0 AND assertions > 0 THEN 5 WHEN todo_lines = 0 AND active_lines > 0 THEN 4 WHEN active_ratio >= 0.5 THEN 3 WHEN active_lines > 0 THEN 2 ELSE 1 END::BIGINT AS level FROM r""",
)
def a25(spark, sf):
    header = F.nullif(F.regexp_extract("line", r"Task (\w+)\(\)", 1), F.lit(""))
    tests = enclosing(code_lines(spark, sf), ["doc_id"], header, max_back=None)
    return A.method_stats(tests, ["doc_id"]).withColumn("level", F.col("level").cast("bigint"))


@query(
    "a26_review_status",
    f"""WITH {CODE_SQL}, r AS (SELECT doc_id, count(*) FILTER (contains(lower(line), 'todo')) AS todo, count(*) FILTER ({ACTIVE_SQL}) AS active,
       count(*) FILTER (contains(line, 'Assert') OR contains(line, 'Expect') OR contains(line, 'Should')) AS assertions, count(*) FILTER (contains(line, 'ocator(') OR contains(line, 'GetBy') OR contains(line, 'getBy')) AS locators FROM code GROUP BY 1)
    SELECT *, CASE WHEN todo = 0 THEN 'review-ready' WHEN todo <= 3 THEN 'targeted-review' ELSE 'needs-migration-work' END AS status FROM r""",
)
def a26(spark, sf):
    return A.review_status(code_lines(spark, sf), ["doc_id"])


@query(
    "a27_evidence_manifest",
    r"""WITH m AS (SELECT doc_id, lang AS kind, sha256(regexp_replace(text, '[\w.]+@[\w.]+', '<mail>', 'g')) AS sha256, octet_length(encode(regexp_replace(text, '[\w.]+@[\w.]+', '<mail>', 'g')))::BIGINT AS size_bytes,
        CASE WHEN regexp_matches(text, '[\w.]+@[\w.]+') THEN 'redacted' ELSE 'none' END AS redaction FROM documents)
    SELECT kind, count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, count(*) FILTER (redaction = 'redacted') AS redacted, array_to_string(list_sort(list(doc_id))[1:10], ',') AS examples, min(sha256) AS first_sha FROM m GROUP BY kind""",
)
def a27(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("kind"), "text")
    m = A.evidence_manifest(docs, "doc_id", "text", F.regexp_replace("text", r"[\w.]+@[\w.]+", "<mail>"))
    kinds = A.manifest_kinds(m, "kind", "doc_id")
    extra = m.groupBy("kind").agg(F.count_if(F.col("redaction") == "redacted").alias("redacted"), F.min("sha256").alias("first_sha"))
    return kinds.join(extra, "kind").withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


