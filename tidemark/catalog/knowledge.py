"""Memory, research, review, pilot and board plans bound to tables; user rule tables and tree flattening."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.predicates import ACTIVE_SQL, TODO_SQL
from tidemark.catalog.ranking import PILOT_SIGNALS, PILOT_SQL, SCORE_SQL, slice_sql, tags_sql
from tidemark.catalog.registry import CODE_SQL, LINES_SQL, code_lines, doc_lines, query, table
from tidemark.functions import predicates as P
from tidemark.operators import aggregates as A, lines as L, rules as R
from tidemark.operators.trees import flatten_actions
from tidemark.operators.windows import enclosing
from tidemark.plans import delivery as D, memory as M
from tidemark.sources.artifacts import parse_ledger

REVIEW_SQL = f"""r AS (SELECT source, doc_id, count(*) FILTER (contains(lower(line), 'todo')) AS todo, count(*) FILTER ({ACTIVE_SQL}) AS active FROM code GROUP BY 1, 2),
   t AS (SELECT source, sum(todo)::BIGINT AS todo FROM r GROUP BY 1), rep AS (SELECT source, count(*) FILTER (doc_id % 97 = 0) AS syntax, count(*) FILTER (doc_id % 7 = 0) AS unsupported FROM documents GROUP BY 1),
   art AS (SELECT source, bool_or(doc_id % 50 = 0) AS sel, bool_or(doc_id % 50 = 1) AS man FROM documents GROUP BY 1),
   f AS (SELECT source, todo, syntax, unsupported, sel, man FROM t JOIN rep USING (source) JOIN art USING (source)),
   risks AS (SELECT source, 'blocker' AS severity, 'syntax-errors' AS risk FROM f WHERE syntax > 0 UNION ALL SELECT source, 'high', 'remaining-todos' FROM f WHERE todo > 20 UNION ALL SELECT source, 'medium', 'remaining-todos' FROM f WHERE todo > 0 AND todo <= 20
     UNION ALL SELECT source, 'medium', 'unsupported-actions' FROM f WHERE unsupported > 0 UNION ALL SELECT source, 'medium', 'missing-selector-evidence' FROM f WHERE NOT sel UNION ALL SELECT source, 'low', 'missing-evidence-manifest' FROM f WHERE NOT man)"""


def review(spark, sf):
    docs = table(spark, sf, "documents")
    k = F.col("doc_id")
    reported = docs.groupBy("source").agg(F.count_if(k % 97 == 0).alias("syntax"), F.count_if(k % 7 == 0).alias("unsupported"), F.lit(0).alias("unmapped"))
    arts = docs.select("source", F.when(k % 50 == 0, F.lit("selector-evidence")).when(k % 50 == 1, F.lit("evidence-manifest")).otherwise(F.lit("other")).alias("kind"))
    return D.pr_pack(code_lines(spark, sf), ["doc_id"], ["source"], arts, reported)


@query(
    "c33_pr_pack",
    f"""WITH {CODE_SQL}, {REVIEW_SQL} SELECT source, CASE min(list_position(['blocker', 'high', 'medium', 'low'], severity)) WHEN 1 THEN 'blocked' WHEN 2 THEN 'needs-fixes' WHEN 3 THEN 'review-with-risks' ELSE 'ready-for-review' END AS status,
        count(*) AS risks, string_agg(severity || ':' || risk, ',' ORDER BY severity, risk) AS details FROM risks GROUP BY 1""",
)
def c33(spark, sf):
    r = review(spark, sf)
    details = r["risks"].groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "severity", "risk"))), ",").alias("details"))
    return r["status"].join(details, "source")


# Conversations as a ledger: every seventh line is cut.
MEMORY_TYPE = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("status", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))])


def ledger_entries(spark, sf):
    k = F.col("conv_id") * 3 + F.col("turn")
    doc = F.to_json(
        F.struct(
            F.when(k % 5 == 0, F.lit("")).otherwise(k.cast("string")).alias("id"), F.expr("CASE (conv_id + turn) % 3 WHEN 0 THEN 'selector' WHEN 1 THEN 'decision' ELSE 'warning' END").alias("kind"), F.col("text"),
            F.when(k % 11 == 0, F.lit("Deprecated")).otherwise(F.lit("active")).alias("status"), F.when(k % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
        )
    )
    rows = table(spark, sf, "conversations").select(F.concat_ws("/", "role", "conv_id").alias("file"), F.col("turn").alias("line_no"), k.alias("k"), doc.alias("j"))
    lines = rows.select("file", "line_no", "k", F.when(F.col("k") % 7 == 0, F.expr("substring(j, 1, length(j) - 4)")).otherwise(F.col("j")).alias("line"))
    return parse_ledger(lines, "line", MEMORY_TYPE).withColumn("is_active", F.col("k") % 3 != 0)


@query(
    "c34_memory_doctor",
    """WITH e AS (SELECT role || '/' || conv_id AS file, turn, conv_id * 3 + turn AS k, text, (conv_id + turn) % 3 AS kd FROM conversations)
    SELECT file, turn AS line_no, 'malformed-line' AS "check" FROM e WHERE k % 7 = 0 UNION ALL SELECT file, turn, 'missing-field' FROM e WHERE k % 7 <> 0 AND (k % 5 = 0 OR trim(text) = '')
    UNION ALL SELECT file, turn, 'active-assertion-suppression' FROM e WHERE k % 7 <> 0 AND k % 3 <> 0 AND (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND contains(lower(text), 'on') AND NOT contains(lower(text), 'with')
    UNION ALL SELECT file, turn, 'deprecated-active' FROM e WHERE k % 7 <> 0 AND k % 3 <> 0 AND k % 11 = 0 UNION ALL SELECT file, turn, 'selector-without-evidence' FROM e WHERE k % 7 <> 0 AND kd = 0 AND k % 2 <> 0""",
)
def c34(spark, sf):
    return M.doctor(ledger_entries(spark, sf), unsafe=P.unsafe_suppression("text", ("the", "der"), ("on",), ("with",)))


@query(
    "c35_memory_recall",
    """WITH t AS (SELECT item_id, text AS path FROM benchmark UNION ALL SELECT item_id, array_to_string(string_split(text, ' ')[3:5], ' ') FROM benchmark), e AS (SELECT conv_id, turn, conv_id + turn AS k, text, turn = 0 AND conv_id % 9 = 0 AS g FROM conversations)
    SELECT DISTINCT item_id AS target_id, conv_id, turn, (CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END)::BIGINT AS priority FROM t, e WHERE NOT g AND contains(lower(text), lower(path)) UNION ALL SELECT NULL, conv_id, turn, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END FROM e WHERE g""",
)
def c35(spark, sf):
    entries = table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("entry_id"), F.expr("CASE (conv_id + turn) % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'preference' ELSE 'note' END").alias("kind"), "text", F.lit("").alias("scope"),
        ((F.col("turn") == 0) & (F.col("conv_id") % 9 == 0)).alias("is_global"),
    )
    words = F.array_join(F.slice(F.split("text", " ", -1), 3, 3), " ")
    targets = table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.explode(F.array(F.col("text"), words)).alias("path"))
    return M.recall(entries, targets).select("target_id", "entry_id.conv_id", "entry_id.turn", F.col("priority").cast("bigint").alias("priority"))


@query(
    "c35_recall_receipts",
    "SELECT lower(role) || '/' || (conv_id % 25) AS file_key, max((conv_id, turn))[1] AS recorded_conv, max((conv_id, turn))[2] AS matched FROM conversations GROUP BY 1",
)
def c35b(spark, sf):
    name = F.concat(F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")), F.when(F.col("turn") % 3 == 0, F.lit("\\")).otherwise(F.lit("/")), (F.col("conv_id") % 25).cast("string"))
    r = table(spark, sf, "conversations").select(name.alias("file"), F.struct("conv_id", "turn").alias("recorded_at"), F.col("turn").alias("matched"))
    return M.recall_receipts(r).select(F.col("_key").alias("file_key"), F.col("recorded_at.conv_id").alias("recorded_conv"), "matched")


@query(
    "c36_research_clusters",
    rf"""WITH {CODE_SQL}, h AS (SELECT 'todoClusters' AS category, trim(regexp_extract(line, '(?i)\bTODO\b.*', 0)) AS text FROM code), c AS (SELECT category, text, count(*) AS occurrences FROM h WHERE text <> '' GROUP BY 1, 2)
    SELECT category, text, occurrences FROM c ORDER BY occurrences DESC, category, text""",
)
def c36(spark, sf):
    return A.pattern_clusters(code_lines(spark, sf))


@query(
    "c37_runbook_candidates",
    f"""WITH {PILOT_SQL}, s AS (SELECT source || '/' || doc_id AS path, tests, locators, line_count, {SCORE_SQL} AS pilot_score FROM sig WHERE tests > 0 AND locators > 0) SELECT path, tests, locators, line_count, pilot_score FROM s ORDER BY pilot_score DESC, line_count, path LIMIT 10""",
)
def c37(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return D.runbook_candidates(docs, "path", 10, PILOT_SIGNALS).select("path", "tests", "locators", "line_count", "pilot_score")


PILOT_CATS = (("page-object", r"(?i)license|copyright"), ("table-filter", r"\bof the\b"), ("waits", " was "), ("custom-helper", None))


@query(
    "c37_pilot_candidates",
    r"""SELECT doc_id, greatest(1, len(regexp_extract_all(text, '\b[Tt]he\b')))::BIGINT AS tests,
        (10 * (CASE WHEN len(regexp_extract_all(text, ' on ')) <= 3 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '\bof the\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, ' was ') THEN 1 ELSE 0 END
          + CASE WHEN len(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9_]*)\s*\(', 1)) > 0 THEN 1 ELSE 0 END) + len(regexp_extract_all(text, 'tion')) + len(regexp_extract_all(text, ' der ')))::BIGINT AS score FROM documents""",
)
def c37b(spark, sf):
    out = D.pilot_candidates(table(spark, sf, "documents"), "source", "text", r"\b[Tt]he\b", ("tion", " der "), PILOT_CATS, ("simple-smoke", " on ", 3))
    return out.select("doc_id", "tests", "score")


@query(
    "c37_pilot_select",
    r"WITH cand AS (SELECT source, doc_id::VARCHAR AS file, greatest(1, len(regexp_extract_all(text, '\b[Tt]he\b')))::BIGINT AS tests, (10 * len(categories) + len(regexp_extract_all(text, 'tion')) + len(regexp_extract_all(text, ' der ')))::BIGINT AS score, categories FROM (SELECT *, "
    + tags_sql(" on ", " was ") + " AS categories FROM documents)),\n    " + slice_sql(P.CATEGORY_ORDER, 15),
)
def c37c(spark, sf):
    """Covering slice per project over the candidates."""
    cand = D.pilot_candidates(table(spark, sf, "documents").withColumn("file", F.col("doc_id").cast("string")), "source", "text", r"\b[Tt]he\b", ("tion", " der "), PILOT_CATS, ("simple-smoke", " on ", 3))
    return D.pilot_select(cand.select("source", "file", "tests", "score", "categories"), ["source"], P.CATEGORY_ORDER, 15)


ROOT_RULES = (("blocked-symbol", r"unresolved symbol (\w+)", 1), ("source-only", r"source-only identifier (\w+)", 1))


@query(
    "c39_explain_todos",
    rf"""WITH {TODO_SQL}, k AS (SELECT source, doc_id, line_no, CASE WHEN regexp_extract(message, 'unresolved symbol (\w+)', 1) <> '' THEN 'blocked-symbol:' || regexp_extract(message, 'unresolved symbol (\w+)', 1)
        WHEN regexp_extract(message, 'source-only identifier (\w+)', 1) <> '' THEN 'source-only:' || regexp_extract(message, 'source-only identifier (\w+)', 1) ELSE code END AS group_key FROM todos),
    g AS (SELECT source, group_key, count(*) AS n, count(DISTINCT doc_id) AS file_count FROM k GROUP BY 1, 2)
    SELECT source, group_key, n, file_count, n * 2 + file_count * 5 + CASE WHEN n >= 10 THEN 20 WHEN n >= 5 THEN 10 WHEN n >= 3 THEN 5 ELSE 0 END AS impact FROM g""",
)
def c39a(spark, sf):
    todos = L.extract_todos(code_lines(spark, sf)).withColumnRenamed("doc_id", "file")
    return D.explain_todos(todos, ROOT_RULES, ["source"]).select("source", "group_key", "n", "file_count", "impact")


HEADER_SQL = r"nullif(regexp_extract(line, 'Task (\w+)\(\)', 1), '')"
TEST_SQL = CODE_SQL + rf""",
t AS (SELECT *, last_value({HEADER_SQL} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS test FROM code),
s AS (SELECT doc_id, test, count(*) FILTER ({ACTIVE_SQL}) AS active_lines, count(*) FILTER (contains(line, 'TODO')) AS todo_lines, count(*) FILTER (contains(line, 'Assert') OR contains(line, 'Expect') OR contains(line, 'Should')) AS assertions FROM t WHERE test IS NOT NULL GROUP BY ALL),
stats AS (SELECT *, CASE WHEN todo_lines = 0 AND assertions > 0 THEN 5 WHEN todo_lines = 0 AND active_lines > 0 THEN 4 WHEN ratio >= 0.5 THEN 3 WHEN active_lines > 0 THEN 2 ELSE 1 END AS level FROM
   (SELECT *, CASE WHEN active_lines + todo_lines = 0 THEN 0 ELSE round_even(active_lines / (active_lines + todo_lines), 2) END::DOUBLE AS ratio FROM s))"""


def tests_of(spark, sf):
    header = F.nullif(F.regexp_extract("line", r"Task (\w+)\(\)", 1), F.lit(""))
    return enclosing(code_lines(spark, sf), ["doc_id"], header, max_back=None)


@query(
    "c39_migration_board",
    f"""WITH {TEST_SQL}, e AS (SELECT doc_id, count(*) AS compile_errors FROM code WHERE contains(line, 'Page.TODO_') GROUP BY 1)
    SELECT doc_id, count(*) AS tests, sum(todo_lines)::BIGINT AS todo_lines, CASE WHEN sum(active_lines) + sum(todo_lines) = 0 THEN 0 ELSE round_even(sum(active_lines) / (sum(active_lines) + sum(todo_lines)), 2) END::DOUBLE AS active_ratio, coalesce(any_value(compile_errors), 0) AS compile_errors,
      max(level)::BIGINT AS best_level FROM stats LEFT JOIN e USING (doc_id) GROUP BY doc_id""",
)
def c39b(spark, sf):
    errors = code_lines(spark, sf).where(F.contains("line", F.lit("Page.TODO_"))).select("doc_id")
    out = D.migration_board(A.method_stats(tests_of(spark, sf), ["doc_id"]), errors, ["doc_id"])
    return out.drop("best_test").withColumn("best_level", F.col("best_level").cast("bigint"))


@query(
    "c39_smoke_plan",
    f"""WITH {TEST_SQL} SELECT doc_id, test, level::BIGINT AS level, assertions FROM stats WHERE level >= 3 AND doc_id NOT IN (SELECT doc_id FROM code WHERE contains(line, 'Page.TODO_')) ORDER BY level DESC, assertions DESC, ratio DESC, test, doc_id""",
)
def c39c(spark, sf):
    errors = code_lines(spark, sf).where(F.contains("line", F.lit("Page.TODO_"))).select("doc_id")
    return D.smoke_plan(tests_of(spark, sf), errors, ["doc_id"]).select("doc_id", "test", F.col("level").cast("bigint").alias("level"), "assertions")


@query(
    "c39_config_diff",
    """WITH a AS (SELECT p_type AS section, 'k' || p_partkey AS key, p_brand AS canon FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_type AS section, 'k' || p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_brand END AS canon FROM part WHERE p_partkey % 11 <> 0)
    SELECT coalesce(b.section, a.section) AS section, coalesce(b.key, a.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.section = b.section AND a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.canon <> b.canon""",
)
def c39d(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    side = lambda df, canon: df.select(F.col("p_type").alias("section"), F.concat(F.lit("k"), k.cast("string")).alias("key"), canon.alias("canon"))
    return D.config_diff(side(p.where(k % 9 != 0), F.col("p_brand")), side(p.where(k % 11 != 0), F.when(k % 7 == 0, F.col("p_name")).otherwise(F.col("p_brand"))))


@query(
    "c39_guard",
    """WITH m AS (SELECT l_suppkey, l_linestatus, count(*) FILTER (l_returnflag = 'R') AS todo, count(*) FILTER (l_tax = 0) AS unmapped, count(*) FILTER (l_discount > 0.08) AS unsupported, count(*) FILTER (l_quantity = 1) AS syntax, count(*) FILTER (l_quantity > 48) AS suppressed FROM lineitem GROUP BY 1, 2)
    SELECT a.l_suppkey, concat_ws(',', CASE WHEN a.todo > b.todo THEN 'todo' END, CASE WHEN a.unmapped > b.unmapped THEN 'unmapped' END, CASE WHEN a.unsupported > b.unsupported THEN 'unsupported' END, CASE WHEN a.syntax > b.syntax THEN 'syntax' END, CASE WHEN a.suppressed > b.suppressed THEN 'suppressed' END) AS failed,
      CASE WHEN a.todo > b.todo OR a.unmapped > b.unmapped OR a.unsupported > b.unsupported OR a.syntax > b.syntax OR a.suppressed > b.suppressed THEN 'FAIL' ELSE 'PASS' END AS status FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.l_linestatus = 'O' AND b.l_linestatus = 'F'""",
)
def c39e(spark, sf):
    ci = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    m = lambda status: table(spark, sf, "lineitem").where(F.col("l_linestatus") == status).groupBy("l_suppkey").agg(
        ci("l_returnflag = 'R'", "todo"), ci("l_tax = 0", "unmapped"), ci("l_discount > 0.08D", "unsupported"), ci("l_quantity = 1", "syntax"), ci("l_quantity > 48", "suppressed")
    )
    return D.guard(m("F"), m("O"), ["l_suppkey"]).select("l_suppkey", F.array_join("failed", ",").alias("failed"), "status")


# --- rule tables of users and trees --------------------------------------------------------------------------

USER_RULES = (("article", r" (?:the|der|le|el) ", 1), ("ending", r"[a-z](?:tion|keit|ment)[ .,]", 5), ("capital", r"^[A-Z][a-z]+", 3), ("number", r"\d{3}", 5))


@query(
    "ud1_user_rules",
    "WITH " + LINES_SQL + ", r(rule, pattern, priority) AS (VALUES " + ", ".join(f"('{a}', '{p}', {n})" for a, p, n in USER_RULES) + """), m AS (SELECT doc_id, line_no, rule, priority FROM lines, r WHERE regexp_matches(line, pattern)), t AS (SELECT doc_id, line_no, max(priority) AS priority FROM m GROUP BY 1, 2)
    SELECT doc_id, line_no::BIGINT AS line_no, priority::BIGINT AS priority, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' ELSE min(rule) END AS rule, count(*) AS candidates FROM t JOIN m USING (doc_id, line_no, priority) GROUP BY ALL""",
)
def ud1(spark, sf):
    m = R.all_rules(doc_lines(spark, sf).select("doc_id", "line_no", "line"), USER_RULES)
    out = R.best_rule(m, ["doc_id", "line_no"])
    return out.withColumns({"line_no": F.col("line_no").cast("bigint"), "priority": F.col("priority").cast("bigint")})


@query(
    "ud4_flatten_actions",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders)
    SELECT o_orderkey, '0' AS path, 'if' AS kind, 'cond' AS expr, true AS is_container FROM o UNION ALL SELECT o_orderkey, '0.0', 'click', o_orderstatus, false FROM o UNION ALL SELECT o_orderkey, '0.1', 'foreach', 'rows', true FROM o UNION ALL SELECT o_orderkey, '0.1.0', 'fill', o_orderpriority, false FROM o
    UNION ALL SELECT o_orderkey, '0.2', 'wait', o_custkey::VARCHAR, false FROM o WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, '1', 'assert', o_orderpriority, false FROM o""",
)
def ud4(spark, sf):
    o = table(spark, sf, "orders")
    leaf = lambda kind, c: F.concat(F.lit(f'{{"kind":"{kind}","expr":"'), c.cast("string"), F.lit('"}'))
    other = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(',"else":['), leaf("wait", F.col("o_custkey")), F.lit("]"))).otherwise(F.lit(""))
    tree = F.concat(
        F.lit('[{"kind":"if","expr":"cond","then":['), leaf("click", F.col("o_orderstatus")), F.lit(',{"kind":"foreach","expr":"rows","body":['), leaf("fill", F.col("o_orderpriority")), F.lit("]}]"), other,
        F.lit("},"), leaf("assert", F.col("o_orderpriority")), F.lit("]"),
    )
    out = flatten_actions(o.select("o_orderkey", tree.alias("actions")), "actions", ["o_orderkey"])
    return out.select("o_orderkey", F.array_join(F.transform("action_path", lambda x: x.cast("string")), ".").alias("path"), "kind", "expr", "is_container")
