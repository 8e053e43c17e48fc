"""Quality and proposal plans bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.aggregating import ACTIONS_SQL, LEVEL_SQL, runs
from tidemark.catalog.predicates import TODO_SQL
from tidemark.catalog.ranking import BOARD_SQL
from tidemark.catalog.registry import LINES_SQL, code_lines, doc_lines, query, table
from tidemark.operators import aggregates as A, lines as L
from tidemark.plans import proposals as P, quality as Q


@query(
    "c01_quality_dashboard",
    f"""WITH {TODO_SQL}, {BOARD_SQL}, {ACTIONS_SQL.replace("todos AS (", "line_todos AS (").replace("LEFT JOIN todos", "LEFT JOIN line_todos")}, {LEVEL_SQL}
    SELECT 'summary' AS part, run AS key, level AS value, coverage AS amount FROM quality
    UNION ALL SELECT 'guardrail', 'unsafe-suppression', CASE WHEN (SELECT count(*) FROM codes WHERE subject = 'EMPTY_TEST_AFTER_SUPPRESSION') > 0 THEN 'attention_required' ELSE 'pass' END, 0
    UNION ALL SELECT 'guardrail', 'pom-helper-recovery', 'pass', 0 UNION ALL SELECT 'guardrail', 'selector-evidence', 'attention_required', 0
    UNION ALL SELECT 'ticket', id, priority || ' ' || category || ' ' || subject, occurrences FROM (SELECT * FROM board ORDER BY priority, occurrences DESC, id LIMIT 15)""",
)
def c01(spark, sf):
    li = table(spark, sf, "lineitem")
    count = lambda df, prefix, col: df.groupBy(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    todos = A.count_with_example(L.extract_todos(code_lines(spark, sf)), ["code"], ["doc_id", "line_no"])
    d = Q.quality_dashboard(
        runs(spark, sf), todos, count(li.where("l_returnflag = 'R'"), "supp-", "l_suppkey"), count(li.where("l_linestatus = 'F'"), "part-", "l_partkey")
    )
    row = lambda df, part, key, value, amount: df.select(F.lit(part).alias("part"), key.alias("key"), value.alias("value"), amount.cast("double").alias("amount"))
    ticket = F.concat_ws(" ", "priority", "category", "subject")
    return (
        row(d["summary"], "summary", F.col("run"), F.col("level"), F.col("coverage"))
        .unionByName(row(d["guardrails"], "guardrail", F.col("guardrail"), F.col("status"), F.lit(0)))
        .unionByName(row(d["tickets"], "ticket", F.col("id"), ticket, F.col("occurrences")))
    )


# Line items joined with their parts as unmapped expressions and unsupported calls.
PROPOSAL_SQL = """j AS (SELECT 'page.' || replace(p_name, ' ', '.') || CASE p_partkey % 8 WHEN 0 THEN '.Items.ElementAt(' || p_size || ')' WHEN 1 THEN '.Pagination.Forward' ELSE '' END AS expr,
     'page.' || replace(p_name, ' ', '') || '.' || CASE p_partkey % 5 WHEN 0 THEN 'Open<' || p_type || '>' ELSE p_type END || '(' || CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE p_size::VARCHAR || ',' || p_brand END || ')' AS call,
     'f/' || l_suppkey || '.cs' AS file, l_quantity::BIGINT AS q, l_linestatus, l_returnflag, l_tax, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
   unmapped AS (SELECT expr AS source_expr, file, sum(q)::BIGINT AS usages FROM j WHERE l_linestatus = 'F' GROUP BY ALL),
   unsupported AS (SELECT call AS text, file, count(*) AS cnt FROM j WHERE l_returnflag = 'R' GROUP BY ALL),
   issues AS (SELECT file, CASE WHEN l_tax = 0 THEN 'Todo' WHEN l_tax = 0.01 THEN 'ScopeConflict' WHEN l_tax = 0.02 THEN 'PlaceholderLeftover' ELSE 'Other' END AS category FROM j),
   rules AS (SELECT DISTINCT 'page.' || replace(p_name, ' ', '.') AS key FROM part WHERE p_size = 1 UNION SELECT DISTINCT 'page.' || replace(p_name, ' ', '') || '.' || p_type FROM part WHERE p_size = 2),
   b AS (SELECT *, CASE WHEN regexp_extract(text, '(\\w+(?:\\.\\w+)*?)\\.(\\w+)\\((.*)\\)', 2) = '' THEN text ELSE regexp_extract(text, '(\\w+(?:\\.\\w+)*?)\\.(\\w+)\\((.*)\\)', 1) || '.' || regexp_extract(text, '(\\w+(?:\\.\\w+)*?)\\.(\\w+)\\((.*)\\)', 2) END AS base,
       regexp_extract(text, '^(.*)\\((.*)\\)', 2) AS args FROM unsupported),
   m AS (SELECT base, sum(cnt)::BIGINT AS occurrences, count(DISTINCT file) AS files, min(text) AS first, count(DISTINCT text) > 1 AS varied, count(DISTINCT args) > 1 AS args_vary FROM b WHERE base NOT IN (SELECT key FROM rules) GROUP BY base),
   p AS (
     SELECT 'UiTarget' AS kind, source_expr AS key, sum(usages)::BIGINT AS occurrences, count(DISTINCT file) AS files, false AS blocker, 'often' AS conf FROM unmapped
       WHERE NOT contains(source_expr, '.ElementAt(') AND NOT contains(source_expr, '.Items.Count') AND NOT contains(source_expr, '.Pagination.') AND source_expr NOT IN (SELECT key FROM rules) GROUP BY 2
     UNION ALL SELECT 'ParameterizedMethodMapping', CASE WHEN args_vary THEN regexp_extract(first, '^(.*)\\((.*)\\)', 1) || '(' || array_to_string(list_transform(range(0, len(string_split(regexp_extract(first, '^(.*)\\((.*)\\)', 2), ','))), lambda i: '{arg' || i || '}'), ', ') || ')' ELSE first END, occurrences, files, false, 'Medium' FROM m WHERE varied
     UNION ALL SELECT 'MethodMapping', base, occurrences, files, false, 'often' FROM m WHERE NOT varied
     UNION ALL SELECT 'TableMapping', substr(source_expr, 1, strpos(source_expr, '.Items') - 1), sum(usages)::BIGINT, count(DISTINCT file), true, 'Medium' FROM unmapped WHERE contains(source_expr, '.ElementAt(') AND substr(source_expr, 1, strpos(source_expr, '.Items') - 1) NOT IN (SELECT key FROM rules) GROUP BY 2
     UNION ALL SELECT 'PaginationMapping', source_expr, usages, 1, true, 'Medium' FROM unmapped WHERE contains(source_expr, '.Pagination.')
     UNION ALL SELECT 'ProfileScope', regexp_extract(file, '[^/]*$'), count(*), 1, false, 'Medium' FROM issues WHERE contains(category, 'Scope') GROUP BY file
     UNION ALL SELECT 'QualityGate', 'FailOnPlaceholderLeftovers', count(*) FILTER (category = 'PlaceholderLeftover'), count(DISTINCT file), true, 'High' FROM issues HAVING count(*) FILTER (category = 'PlaceholderLeftover') > 0
     UNION ALL SELECT 'QualityGate', 'MaxTodoComments', count(*) FILTER (category = 'Todo'), count(DISTINCT file), false, 'High' FROM issues HAVING count(*) FILTER (category = 'Todo') > 50
     UNION ALL SELECT 'ManualMigration', regexp_extract(text, '(\\w+(?:\\.\\w+)*?)\\.(\\w+(?:<[^>]*>)?)', 0), sum(cnt)::BIGINT, count(DISTINCT file), false, 'Low' FROM unsupported WHERE contains(text, '.Open<') GROUP BY 2),
   s AS (SELECT *, (occurrences * 2 + files * 5) * CASE WHEN blocker THEN 3 ELSE 1 END + CASE WHEN occurrences >= 10 THEN 20 WHEN occurrences >= 5 THEN 10 WHEN occurrences >= 3 THEN 5 ELSE 0 END AS score FROM p)"""


@query(
    "c02_propose_mappings",
    f"""WITH {PROPOSAL_SQL} SELECT kind, key, occurrences, files, score, CASE WHEN score >= 30 THEN 'High' WHEN score >= 10 THEN 'Medium' ELSE 'Low' END AS priority,
        CASE conf WHEN 'often' THEN CASE WHEN occurrences >= 3 THEN 'High' ELSE 'Medium' END ELSE conf END AS confidence FROM s""",
)
def c02(spark, sf):
    p = table(spark, sf, "part")
    st = lambda c: F.col(c).cast("string")
    name = lambda sep: F.concat(F.lit("page."), F.replace(F.col("p_name"), F.lit(" "), F.lit(sep)))
    k = F.col("p_partkey")
    expr = F.concat(name("."), F.when(k % 8 == 0, F.concat(F.lit(".Items.ElementAt("), st("p_size"), F.lit(")"))).when(k % 8 == 1, F.lit(".Pagination.Forward")).otherwise(F.lit("")))
    method = F.when(k % 5 == 0, F.concat(F.lit("Open<"), F.col("p_type"), F.lit(">"))).otherwise(F.col("p_type"))
    args = F.when(k % 3 == 0, F.lit("1")).otherwise(F.concat(st("p_size"), F.lit(","), F.col("p_brand")))
    call = F.concat(name(""), F.lit("."), method, F.lit("("), args, F.lit(")"))
    j = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == k).select(
        expr.alias("source_expr"), call.alias("text"), F.concat(F.lit("f/"), st("l_suppkey"), F.lit(".cs")).alias("file"), F.col("l_quantity").cast("bigint").alias("q"),
        "l_linestatus", "l_returnflag", "l_tax", "p_size",
    )
    unmapped = j.where("l_linestatus = 'F'").groupBy("source_expr", "file").agg(F.sum("q").alias("usages"))
    unsupported = j.where("l_returnflag = 'R'").groupBy("text", "file").agg(F.count(F.lit(1)).alias("cnt"))
    category = F.expr("CASE WHEN l_tax = 0 THEN 'Todo' WHEN l_tax = 0.01 THEN 'ScopeConflict' WHEN l_tax = 0.02 THEN 'PlaceholderLeftover' ELSE 'Other' END")
    issues = j.select("file", category.alias("category"), F.lit("Warning").alias("severity"), F.lit("").alias("message"))
    rules = p.where("p_size = 1").select(name(".").alias("key")).union(p.where("p_size = 2").select(F.concat(name(""), F.lit("."), F.col("p_type")))).distinct()
    return P.propose_mappings(unmapped, unsupported, issues, rules)


@query(
    "c07_evaluate_budget",
    """WITH a AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS todo, count(*) FILTER (l_linestatus = 'F') AS unmapped, count(*) FILTER (l_discount > 0.05) AS unsupported, count(*) FILTER (l_tax > 0.04) AS warnings FROM lineitem GROUP BY 1)
    SELECT l_orderkey, concat_ws(',', CASE WHEN todo > o_custkey % 3 THEN 'todo' END, CASE WHEN unmapped > 2 THEN 'unmapped' END, CASE WHEN unsupported > 1 THEN 'unsupported' END, CASE WHEN warnings > 3 THEN 'warnings' END) AS issues,
      NOT (todo > o_custkey % 3 OR unmapped > 2 OR unsupported > 1 OR warnings > 3) AS passed FROM a JOIN orders ON l_orderkey = o_orderkey""",
)
def c07(spark, sf):
    actual = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("todo"), F.count_if(F.col("l_linestatus") == "F").alias("unmapped"),
        F.count_if(F.col("l_discount") > 0.05).alias("unsupported"), F.count_if(F.col("l_tax") > 0.04).alias("warnings"),
    )
    budget = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 3).alias("todo"), F.lit(2).alias("unmapped"), F.lit(1).alias("unsupported"), F.lit(3).alias("warnings")
    )
    return Q.evaluate_budget(actual, budget, ["l_orderkey"]).select("l_orderkey", F.array_join("issues", ",").alias("issues"), "passed")


GATE_SQL = """r AS (SELECT l_orderkey AS id, count(*) FILTER (l_quantity = 50 AND l_returnflag = 'R') AS syntax, count(*) FILTER (l_quantity > 49 AND l_linestatus = 'F') AS config_errors, count(*) FILTER (l_tax = 0.08 AND l_discount = 0.1) AS page_todo,
     count(*) FILTER (l_returnflag = 'A') AS todo, count(*) FILTER (l_linestatus = 'F') AS unmapped, count(*) FILTER (l_discount < 0.02) AS unsupported, count(*) FILTER (l_discount = 0.1) AS raw, count(*) FILTER (l_tax = 0.07 AND l_quantity < 3) AS scope_warnings,
     count(*) FILTER (l_tax = 0.06 AND l_quantity < 5) AS placeholders, count(*) FILTER (l_tax = 0.05 AND l_quantity < 5) AS literals, count(*) FILTER (l_quantity = 1 AND l_tax > 0.05) AS leaks, count(*) FILTER (l_extendedprice < 2000) AS preservation_errors FROM lineitem GROUP BY 1),
   g AS (SELECT *, CASE WHEN id % 2 = 0 THEN 3 END AS max_todo, CASE WHEN id % 3 = 0 THEN 4 END AS max_unmapped, CASE WHEN id % 5 = 0 THEN false END AS fail_on_syntax, 2 AS max_unsupported FROM r)"""


@query(
    "c08_quality_gate",
    f"""WITH {GATE_SQL} SELECT id, greatest(CASE WHEN coalesce(fail_on_syntax, true) AND syntax > 0 THEN 3 ELSE 0 END, CASE WHEN config_errors > 0 OR scope_warnings > 0 OR leaks > 0 THEN 2 ELSE 0 END,
       CASE WHEN page_todo > 0 OR todo > coalesce(max_todo, 0) OR unsupported > max_unsupported OR unmapped > coalesce(max_unmapped, 0) OR raw > 0 OR placeholders > 0 OR literals > 0 OR preservation_errors > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code,
       concat_ws(',', CASE WHEN coalesce(fail_on_syntax, true) AND syntax > 0 THEN 'syntax' END, CASE WHEN config_errors > 0 THEN 'config' END, CASE WHEN page_todo > 0 THEN 'page-todo' END, CASE WHEN todo > coalesce(max_todo, 0) THEN 'todo' END,
         CASE WHEN unsupported > max_unsupported THEN 'unsupported' END, CASE WHEN unmapped > coalesce(max_unmapped, 0) THEN 'unmapped' END, CASE WHEN raw > 0 THEN 'raw' END, CASE WHEN scope_warnings > 0 THEN 'scope' END,
         CASE WHEN placeholders > 0 THEN 'placeholders' END, CASE WHEN literals > 0 THEN 'literals' END, CASE WHEN leaks > 0 THEN 'leaks' END, CASE WHEN preservation_errors > 0 THEN 'preservation' END) AS failed_gates FROM g""",
)
def c08(spark, sf):
    ci = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        ci("l_quantity = 50 AND l_returnflag = 'R'", "syntax"), ci("l_quantity > 49 AND l_linestatus = 'F'", "config_errors"), ci("l_tax = 0.08D AND l_discount = 0.1D", "page_todo"),
        ci("l_returnflag = 'A'", "todo"), ci("l_linestatus = 'F'", "unmapped"), ci("l_discount < 0.02D", "unsupported"), ci("l_discount = 0.1D", "raw"),
        ci("l_tax = 0.07D AND l_quantity < 3", "scope_warnings"), ci("l_tax = 0.06D AND l_quantity < 5", "placeholders"), ci("l_tax = 0.05D AND l_quantity < 5", "literals"),
        ci("l_quantity = 1 AND l_tax > 0.05D", "leaks"), ci("l_extendedprice < 2000", "preservation_errors"),
    )
    null = lambda t: F.lit(None).cast(t)
    gated = r.withColumns(
        {
            "max_todo": F.when(F.col("id") % 2 == 0, 3), "max_unmapped": F.when(F.col("id") % 3 == 0, 4), "fail_on_syntax": F.when(F.col("id") % 5 == 0, False), "max_unsupported": F.lit(2),
            "max_raw": null("int"), "fail_on_page_todo": null("boolean"), "fail_on_placeholders": null("boolean"), "fail_on_literals": null("boolean"), "fail_on_leaks": null("boolean"),
        }
    )
    return Q.quality_gate(gated).select("id", F.col("exit_code").cast("bigint").alias("exit_code"), F.array_join("failed_gates", ",").alias("failed_gates"))


PRESERVE_SQL = """src AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag <> 'R') AS b, count(*) FILTER (l_linestatus = 'O') AS a, count(*) AS c FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1),
    tgt AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'A') AS b, count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.02) AS a, count(*) FILTER (l_tax > 0) AS c FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1)"""


@query(
    "c20_preservation_check",
    f"""WITH {PRESERVE_SQL} SELECT id, 'MissingTargetTest' AS category FROM src WHERE id NOT IN (SELECT id FROM tgt) UNION ALL SELECT id, 'UnexpectedTargetTest' FROM tgt WHERE id NOT IN (SELECT id FROM src)
    UNION ALL SELECT id, 'VacuumTest' FROM src JOIN tgt USING (id) WHERE src.b > 0 AND tgt.b = 0 UNION ALL SELECT id, 'AssertionLoss' FROM src JOIN tgt USING (id) WHERE src.a > 0 AND tgt.a < src.a UNION ALL SELECT id, 'TestCaseLoss' FROM src JOIN tgt USING (id) WHERE tgt.c < src.c
    UNION ALL SELECT -1, 'VacuumSetUp'""",
)
def c20(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda df, b, a, c: df.groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.expr(b)).alias("behavior"), F.count_if(F.expr(a)).alias("assertions"), F.count_if(F.expr(c)).alias("cases"))
    src = side(li.where("l_orderkey % 9 <> 0"), "l_returnflag <> 'R'", "l_linestatus = 'O'", "true")
    tgt = side(li.where("l_orderkey % 11 <> 0"), "l_returnflag = 'A'", "l_linestatus = 'O' AND l_discount > 0.02", "l_tax > 0")
    setup = lambda b: li.agg(F.count_if(b).alias("behavior")).select(F.lit(-1).cast("bigint").alias("id"), "behavior", F.lit(0).alias("assertions"), F.lit(0).alias("cases"))
    return Q.preservation_check(src, tgt, ["id"], setup(F.col("l_quantity") > 0), setup(F.col("l_quantity") < 0))


HOLE_SQL = LINES_SQL + """,
holes AS (SELECT doc_id, line_no, CASE (doc_id + line_no) % 6 WHEN 0 THEN 'Open({name}, "' || replace(line, '"', '') || '");' WHEN 1 THEN 'var s = $"x {name} ' || replace(line, '"', '') || '";' WHEN 2 THEN '// {name} ' || line
   WHEN 3 THEN 'Fill("value", "' || replace(line, '"', '') || '"); // line ' || line_no WHEN 4 THEN 'Do(''name'', {value}, $"' || replace(line, '"', '') || '");' ELSE line END AS line FROM lines)"""


def hole_lines(spark, sf):
    x = F.replace(F.col("line"), F.lit('"'), F.lit(""))
    pick = (F.col("doc_id") + F.col("line_no")) % 6
    c = lambda *p: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in p])
    line = (
        F.when(pick == 0, c('Open({name}, "', x, '");')).when(pick == 1, c('var s = $"x {name} ', x, '";')).when(pick == 2, c("// {name} ", F.col("line")))
        .when(pick == 3, c('Fill("value", "', x, '"); // line ', F.col("line_no").cast("string"))).when(pick == 4, c("Do('name', {value}, $\"", x, '");')).otherwise(F.col("line"))
    )
    return doc_lines(spark, sf).select("doc_id", "line_no", line.alias("line"))


@query(
    "c21_placeholder_leftovers",
    f"""WITH {HOLE_SQL} SELECT doc_id, line_no::BIGINT AS line_no, '{{name}}' AS finding FROM holes WHERE (doc_id + line_no) % 6 = 0
    UNION ALL SELECT doc_id, line_no, '{{value}}' FROM holes WHERE (doc_id + line_no) % 6 = 4
    UNION ALL SELECT doc_id, line_no, '"value"' FROM holes WHERE NOT starts_with(trim(line), '//') AND NOT contains(line, '$') AND contains(line, '"value"')
    UNION ALL SELECT doc_id, line_no, '''name''' FROM holes WHERE NOT starts_with(trim(line), '//') AND NOT contains(line, '$') AND contains(line, '''name''')""",
)
def c21(spark, sf):
    lines = hole_lines(spark, sf)
    left = Q.placeholder_leftovers(lines, ["name", "value"]).select("doc_id", "line_no", F.concat(F.lit("{"), F.col("placeholder"), F.lit("}")).alias("finding"))
    lit = Q.suspicious_literals(lines, ["name", "value"]).select("doc_id", "line_no", F.col("literal").alias("finding"))
    return left.unionByName(lit).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "c38_perf_regression",
    """WITH c AS (SELECT l_partkey, sum(l_quantity * 10)::BIGINT AS d, count(*) * 20 AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity * 10)::BIGINT AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    j AS (SELECT l_partkey, c.d, c.m, CASE WHEN b.d > 0 THEN round_even(c.d / b.d, 2) END AS ratio, CASE WHEN p_size > 10 THEN 4500 END AS soft, CASE WHEN p_size > 10 THEN 6000 END AS hard FROM c LEFT JOIN b USING (l_partkey) LEFT JOIN part ON l_partkey = p_partkey)
    SELECT l_partkey, ratio::DOUBLE AS ratio, CASE WHEN coalesce(d > hard OR m > 600, false) AND hard IS NOT NULL THEN 'hard-limit' WHEN coalesce(ratio > 1.35, false) THEN 'regression' WHEN coalesce(d > soft OR m > 400, false) AND soft IS NOT NULL THEN 'soft-limit' ELSE 'ok' END AS verdict FROM j""",
)
def c38(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda status: li.where(F.col("l_linestatus") == status).groupBy("l_partkey").agg(F.sum(F.col("l_quantity") * 10).cast("bigint").alias("duration_ms"), (F.count(F.lit(1)) * 20).alias("memory_mb"))
    budgets = table(spark, sf, "part").where("p_size > 10").select(
        F.col("p_partkey").alias("l_partkey"), F.lit(4500).alias("soft_ms"), F.lit(6000).alias("hard_ms"), F.lit(400).alias("soft_mb"), F.lit(600).alias("hard_mb")
    )
    return Q.perf_regression(side("O"), side("F"), budgets, "l_partkey").select("l_partkey", "ratio", "verdict")


