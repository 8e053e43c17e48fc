"""Rankings T1-T7 bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.predicates import TODO_SQL
from tidemark.catalog.registry import code_lines, query, table
from tidemark.functions import predicates as P
from tidemark.operators import aggregates as A, lines as L, ranking as T


@query("t01_top_k", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 75")
def t01(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return T.top_k(li, 75, F.col("l_extendedprice").desc(), "l_orderkey", "l_partkey")


BOARD_SQL = """parts AS (SELECT 'part-' || l_partkey AS subject, count(*) AS occurrences FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), sups AS (SELECT 'supp-' || l_suppkey AS subject, count(*) AS occurrences FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    codes AS (SELECT code AS subject, count(*) AS occurrences FROM todos GROUP BY 1),
    lead AS (SELECT 0 AS src, 'unmapped-target' AS category, * FROM (SELECT * FROM parts ORDER BY occurrences DESC, subject LIMIT 5) UNION ALL SELECT 1, 'unsupported-action', * FROM (SELECT * FROM sups ORDER BY occurrences DESC, subject LIMIT 5)
      UNION ALL SELECT 2, 'todo-category', * FROM (SELECT * FROM codes ORDER BY occurrences DESC, subject LIMIT 5)),
    board AS (SELECT category, subject, occurrences, printf('MQ-%03d', row_number() OVER (ORDER BY src, occurrences DESC, subject)) AS id,
      CASE WHEN occurrences >= 25 THEN 'P0' WHEN occurrences >= 10 THEN 'P1' WHEN occurrences >= 3 THEN 'P2' ELSE 'P3' END AS priority FROM lead)"""


def board_sources(spark, sf):
    li = table(spark, sf, "lineitem")
    count = lambda df, prefix, col: df.groupBy(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    todos = A.count_with_example(L.extract_todos(code_lines(spark, sf)), ["code"], ["doc_id", "line_no"])
    return [
        ("unmapped-target", count(li.where("l_linestatus = 'F'"), "part-", "l_partkey"), "subject", "n"),
        ("unsupported-action", count(li.where("l_returnflag = 'R'"), "supp-", "l_suppkey"), "subject", "n"),
        ("todo-category", todos, "code", "n"),
    ]


@query("t02_ticket_board", f"WITH {TODO_SQL}, {BOARD_SQL} SELECT id, category, subject, occurrences, priority FROM board ORDER BY priority, occurrences DESC, id LIMIT 15")
def t02(spark, sf):
    return T.ticket_board(board_sources(spark, sf)).select("id", "category", "subject", "occurrences", "priority")


@query(
    "t03_top_k_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 8",
)
def t03(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_extendedprice")
    return T.top_k_per(li, ["l_suppkey"], 8, F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "t04_order_by_rank",
    "SELECT o_orderpriority, n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END DESC, n DESC, o_orderpriority) AS position FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)",
)
def t04(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    ranks = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}
    from pyspark.sql import Window

    w = Window.orderBy(T.rank_of("o_orderpriority", ranks).desc(), F.col("n").desc(), "o_orderpriority")
    return T.order_by_rank(counts.withColumn("position", F.row_number().over(w).cast("bigint")), "o_orderpriority", ranks, F.col("n").desc())


@query(
    "t05_impact_score",
    """WITH o AS (SELECT l_partkey, l_returnflag, count(*) AS occurrences, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1, 2),
    s AS (SELECT *, (occurrences * 2 + files * 5) * CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END + CASE WHEN occurrences >= 10 THEN 20 WHEN occurrences >= 5 THEN 10 WHEN occurrences >= 3 THEN 5 ELSE 0 END AS score FROM o)
    SELECT l_partkey, l_returnflag, occurrences, files, score, CASE WHEN score >= 30 THEN 'High' WHEN score >= 10 THEN 'Medium' ELSE 'Low' END AS priority FROM s""",
)
def t05(spark, sf):
    occ = A.occurrences(table(spark, sf, "lineitem"), ["l_partkey", "l_returnflag"], "l_suppkey").drop("example_file")
    return T.impact_score(occ, "occurrences", "files", F.col("l_returnflag") == "R")


PILOT_SIGNALS = {"tests": r"[Tt]he ", "locators": " on ", "xpaths": r"[0-9]{3}", "assertions": " is ", "waits": " was ", "helpers": " by ", "poms": " for ", "dynamics": r"[A-Z][a-z]+tion"}
PILOT_SQL = (
    "sig AS (SELECT doc_id, source, text, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {n}" for n, p in PILOT_SIGNALS.items())
    + ", CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count FROM documents)"
)
SCORE_SQL = """greatest(0, tests * 8 + locators * 5 + assertions * 4 + waits * 3 - least(30, dynamics * 4) - greatest(0, line_count - 250) // 20 + CASE WHEN line_count > 0 AND line_count <= 160 THEN 8 ELSE 0 END
       - CASE WHEN xpaths > 0 THEN least(12, xpaths * 2) ELSE 0 END)::BIGINT"""


@query(
    "t06_rank_pilots",
    f"""WITH {PILOT_SQL}, s AS (SELECT 'doc-' || doc_id AS path, line_count, {SCORE_SQL} AS pilot_score FROM sig WHERE tests > 0 AND locators > 0)
    SELECT path, line_count, pilot_score FROM s ORDER BY pilot_score DESC, line_count, path LIMIT 5""",
)
def t06(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), "text")
    return T.rank_pilots(P.signal_counts(docs, PILOT_SIGNALS), "path").select("path", "line_count", "pilot_score")


HELPERS_SQL = r"len(list_filter(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9_]*)\s*\(', 1), lambda x: lower(x) NOT IN ('assert','by','wait','thread'))) > 0"


def tags_sql(simple, waits):
    return rf"""list_filter([CASE WHEN len(regexp_extract_all(text, '{simple}')) <= 3 THEN 'simple-smoke' END, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'page-object' END,
      CASE WHEN regexp_matches(text, '\bof the\b') THEN 'table-filter' END, CASE WHEN regexp_matches(text, '{waits}') THEN 'waits' END, CASE WHEN {HELPERS_SQL} THEN 'custom-helper' END, CASE WHEN contains(source, 'base') THEN 'base-fixture' END], lambda x: x IS NOT NULL)"""


def slice_sql(categories, budget):
    """The greedy slice over ``cand(source, file, tests, score, categories)``: one step a category, then the fill."""
    best = "ORDER BY abs(c.tests - 1), -c.score, c.file"
    parts = [f"s0 AS (SELECT source, []::VARCHAR[] AS chosen, 0::BIGINT AS spent, {max(1, budget)}::BIGINT AS rem, false AS done FROM cand GROUP BY source)"]
    for i, category in enumerate(categories, start=1):
        parts.append(
            f"""b{i} AS (SELECT c.source, first(c.file {best}) AS file, first(c.tests {best}) AS tests FROM cand c JOIN s{i - 1} s USING (source) WHERE NOT s.done AND list_contains(c.categories, '{category}') AND NOT list_contains(s.chosen, c.file) GROUP BY c.source),
    o{i} AS (SELECT s.*, b.file, b.tests, b.file IS NOT NULL AND NOT (len(s.chosen) > 0 AND s.spent + b.tests > {budget + 2}) AS ok FROM s{i - 1} s LEFT JOIN b{i} b USING (source)),
    s{i} AS (SELECT source, CASE WHEN ok THEN list_append(chosen, file) ELSE chosen END AS chosen, spent + CASE WHEN ok THEN tests ELSE 0 END AS spent, rem - CASE WHEN ok THEN tests ELSE 0 END AS rem, done OR (ok AND rem - tests <= 0) AS done FROM o{i})""")
    last = f"s{len(categories)}"
    parts.append(f"fill AS (SELECT c.*, {last}.spent + coalesce(sum(c.tests) OVER (PARTITION BY c.source ORDER BY c.score DESC, c.file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cand c JOIN {last} USING (source) WHERE NOT list_contains(chosen, c.file))")
    return ",\n    ".join(parts) + f"""
    SELECT c.source, c.file, c.tests, c.score FROM cand c JOIN {last} USING (source) WHERE list_contains(chosen, c.file) UNION ALL SELECT source, file, tests, score FROM fill WHERE before < {budget}"""


@query(
    "t07_covering_slice",
    f"WITH {PILOT_SQL}, cand AS (SELECT source, 'doc-' || doc_id AS file, least(greatest(tests % 9, 1), 25)::BIGINT AS tests, {SCORE_SQL} AS score, " + tags_sql("FindElement|By\\.", "\\bwas\\b") + " AS categories FROM sig),\n    " + slice_sql(P.CATEGORY_ORDER, 20),
)
def t07(spark, sf):
    """Greedy choice per project."""
    docs = P.signal_counts(table(spark, sf, "documents").withColumn("path", F.col("source")), PILOT_SIGNALS)
    cats = P.tag_categories(docs, (("page-object", r"(?i)license|copyright"), ("table-filter", r"\bof the\b"), ("waits", r"\bwas\b"), ("custom-helper", None)))
    rows = cats.select(
        "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.least(F.greatest(F.col("tests") % 9, F.lit(1)), F.lit(25)).cast("bigint").alias("tests"),
        T.pilot_score().alias("score"), "categories",
    )
    return T.covering_slice(rows, ["source"], P.CATEGORY_ORDER, 20)
