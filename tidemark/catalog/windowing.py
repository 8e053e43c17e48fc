"""Ordered operators W1-W15 bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import CODE_SQL, LINES_SQL, code_lines, doc_lines, query, table
from tidemark.operators import rules as R, windows as W

EVENT_KEYS = ["user_id"]
EVENT_ORDER = ["ts", "event_id"]
def day():
    return F.to_date("ts")


def event_rows(spark, sf):
    return table(spark, sf, "events")


@query(
    "w01_last_wins",
    """SELECT o_custkey, o_orderpriority, min(o_orderkey) AS position, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, max_by(o_totalprice, o_orderkey) AS o_totalprice
       FROM orders GROUP BY 1, 2""",
)
def w01(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", "o_totalprice")
    return W.last_wins(o, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query(
    "w02_ordered_merge",
    """WITH e AS (SELECT o_orderkey, o_custkey AS k, o_orderstatus AS canon, o_orderpriority = '5-LOW' AS danger, o_orderkey % 20 = 0 AS base FROM orders),
    win AS (SELECT k, min_by(canon, CASE WHEN base THEN 0 ELSE 100000000 END + o_orderkey) AS c, min(CASE WHEN base THEN 0 ELSE 100000000 END + o_orderkey) AS o FROM e WHERE NOT danger GROUP BY k)
    SELECT o_orderkey, CASE WHEN danger THEN 'dangerous' WHEN o = 100000000 + o_orderkey THEN 'applied' WHEN c = canon THEN 'duplicate' ELSE 'conflict' END AS status FROM e LEFT JOIN win USING (k) WHERE NOT base""",
)
def w02(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("canon"), "o_orderpriority")
    out = W.ordered_merge(o, ["k"], "canon", "o_orderkey", F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 20 == 0)
    return out.select("o_orderkey", "status")


@query(
    "w03_internal_conflicts",
    """WITH k AS (SELECT c_custkey, lower(c_mktsegment) AS seg, c_nationkey, min(c_custkey) OVER w AS first_ord, first_value(c_nationkey % 3) OVER w AS f FROM customer WINDOW w AS (PARTITION BY c_mktsegment, floor(c_acctbal)::BIGINT % 40 ORDER BY c_custkey))
    SELECT c_custkey, first_ord FROM k WHERE f <> c_nationkey % 3""",
)
def w03(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"),
        (F.floor("c_acctbal").cast("bigint") % 40).cast("string").alias("slot"), (F.col("c_nationkey") % 3).alias("canon"),
    )
    return W.internal_conflicts(c, ["segment", "slot"], "canon", "c_custkey").select("c_custkey", "first_ord")


@query(
    "w04_redeclarations",
    """WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scope_no FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY user_id, scope_no, event_type ORDER BY ts, event_id) AS rn FROM s WHERE event_type <> 'signup')
    SELECT event_id, scope_no::BIGINT AS scope_no, event_type AS name FROM d WHERE rn > 1""",
)
def w04(spark, sf):
    name = F.when(F.col("event_type") != "signup", F.col("event_type"))
    out = W.redeclarations(event_rows(spark, sf), EVENT_KEYS, F.col("event_type") == "signup", name, EVENT_ORDER, day())
    return out.select("event_id", F.col("scope_no").cast("bigint").alias("scope_no"), "name")


@query(
    "w04_redeclared_locals",
    f"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, regexp_extract(line, '[A-Za-z]', 0) AS l, line FROM lines), t AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN '  public void ' || l || '()' ELSE ' var ' || l || ' = "' || line || '";' END AS line FROM c),
    s AS (SELECT *, sum(CASE WHEN starts_with(trim(line), 'public ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS scope_no,
        CASE WHEN starts_with(trim(line), 'var ') AND contains(line, '=') THEN trim(regexp_extract(trim(line), '^var\\s([^=]*)=', 1)) END AS name FROM t),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scope_no, name ORDER BY line_no) AS rn FROM s WHERE name IS NOT NULL)
    SELECT doc_id, line_no::BIGINT AS line_no, name FROM d WHERE rn > 1""",
)
def w04b(spark, sf):
    letter = F.regexp_extract("line", "[A-Za-z]", 0)
    text = F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("  public void "), letter, F.lit("()"))).otherwise(
        F.concat(F.lit(" var "), letter, F.lit(' = "'), F.col("line"), F.lit('";'))
    )
    lines = doc_lines(spark, sf).select("doc_id", "line_no", text.alias("line"))
    out = W.redeclarations(lines, ["doc_id"], W.member_header("line"), W.declared_name("line"), ["line_no"])
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "name")


HEADER_SQL = r"nullif(regexp_extract(line, 'Task (\w+)\(\)', 1), '')"


@query(
    "w05_enclosing_test",
    f"""WITH {CODE_SQL} SELECT doc_id, line_no::BIGINT AS line_no, last_value({HEADER_SQL} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS test FROM code""",
)
def w05(spark, sf):
    header = F.nullif(F.regexp_extract("line", r"Task (\w+)\(\)", 1), F.lit(""))
    out = W.enclosing(code_lines(spark, sf), ["doc_id"], header)
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "test")


@query(
    "w06_snippets",
    f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, line, string_agg(rtrim(line), chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS snippet FROM lines)
    SELECT doc_id, line_no::BIGINT AS line_no, snippet FROM s WHERE contains(line, 'the')""",
)
def w06(spark, sf):
    out = W.snippets(doc_lines(spark, sf), ["doc_id"]).where(F.contains("line", F.lit("the")))
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "snippet")


STREAK_SQL = """SELECT *, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events"""


@query(
    "w07_no_progress_streak",
    f"""WITH i AS ({STREAK_SQL}) SELECT event_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i""",
)
def w07(spark, sf):
    return W.no_progress_streak(event_rows(spark, sf), EVENT_KEYS, EVENT_ORDER, "event_type", day(), "view").select("event_id", "streak")


@query(
    "w08_revisited",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) > 1 AS is_cycle FROM events""",
)
def w08(spark, sf):
    return W.revisited(event_rows(spark, sf), EVENT_KEYS, "props", EVENT_ORDER).select("event_id", "is_cycle")


def ledger(spark, sf):
    """Hash-chained ledgers, one per user and day (a handful of entries each), with a few defects put in.

    Entries build on one another, so a chain is folded over its own short array.
    """
    e = event_rows(spark, sf).withColumn("chain", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    days = e.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "props"))).alias("evs"))
    entry = lambda acc, x: F.struct(
        (acc["sequence"] + 1).alias("sequence"), x["event_id"].alias("event_id"), acc["entry_sha"].alias("previous_entry_sha"), F.sha2(x["props"], 256).alias("state_sha"),
        F.base64(x["props"].cast("binary")).alias("state_base64"),
        W.entry_sha(acc["sequence"] + 1, acc["entry_sha"], F.sha2(x["props"], 256), F.base64(x["props"].cast("binary"))).alias("entry_sha"),
    )
    start = F.struct(
        F.lit(0).alias("sequence"), F.lit(0).cast("bigint").alias("event_id"), F.lit("").alias("previous_entry_sha"), F.lit("").alias("state_sha"), F.lit("").alias("state_base64"),
        F.lit("").alias("entry_sha"),
    )
    seed = F.struct(start.alias("last"), F.array().cast("array<struct<sequence:int,event_id:bigint,previous_entry_sha:string,state_sha:string,state_base64:string,entry_sha:string>>").alias("all"))
    chained = F.aggregate("evs", seed, lambda acc, x: F.struct(entry(acc["last"], x).alias("last"), F.concat(acc["all"], F.array(entry(acc["last"], x))).alias("all")), lambda acc: acc["all"])
    entries = days.select("chain", F.explode(chained).alias("e")).select("chain", "e.*")
    anchor = days.select("chain", F.element_at(chained, -1).alias("h")).select("chain", "h.sequence", "h.entry_sha", "h.state_sha")
    broken = entries.where(F.col("event_id") % 53 != 0).withColumn(
        "state_base64", F.when(F.col("event_id") % 41 == 0, F.base64(F.lit('{"k": -1}').cast("binary"))).otherwise(F.col("state_base64"))
    )
    return broken, anchor


@query(
    "w09_verify_chain",
    """WITH e AS (SELECT event_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS chain, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS seq,
         lead(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS next_id, lag(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS prev_id FROM events),
    kept AS (SELECT * FROM e WHERE event_id % 53 <> 0), chains AS (SELECT DISTINCT chain FROM e), heads AS (SELECT chain, max(seq) AS seq FROM e GROUP BY 1), kept_heads AS (SELECT chain, max(seq) AS seq FROM kept GROUP BY 1)
    SELECT chain, seq::BIGINT AS sequence, 'ENTRY_HASH_MISMATCH' AS violation FROM kept WHERE event_id % 41 = 0 UNION ALL SELECT chain, seq, 'STATE_HASH_MISMATCH' FROM kept WHERE event_id % 41 = 0
    UNION ALL SELECT chain, seq, 'PREDECESSOR_MISSING' FROM kept WHERE seq > 1 AND prev_id % 53 = 0
    UNION ALL SELECT h.chain, CASE WHEN k.seq IS NULL THEN h.seq ELSE k.seq END, CASE WHEN k.seq IS NULL THEN 'ENTRY_NOT_FOUND' ELSE 'HEAD_MISMATCH' END FROM heads h LEFT JOIN kept_heads k USING (chain) WHERE k.seq IS NULL OR k.seq <> h.seq""",
)
def w09(spark, sf):
    entries, anchor = ledger(spark, sf)
    return W.verify_chain(entries, anchor).withColumn("sequence", F.col("sequence").cast("bigint"))


@query(
    "w10_latest_by_key",
    "SELECT lower(role) || (conv_id % 30) AS key, max((conv_id, turn))[1] AS conv_id, max((conv_id, turn))[2] AS turn, md5(max_by(text, (conv_id, turn))) AS body FROM conversations GROUP BY 1",
)
def w10(spark, sf):
    name = F.concat(F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")), (F.col("conv_id") % 30).cast("string"))
    rows = table(spark, sf, "conversations").select(name.alias("name"), F.struct("conv_id", "turn").alias("at"), "text")
    return W.latest_by_key(rows, F.lower("name"), "at").select(F.col("_key").alias("key"), "at.conv_id", "at.turn", F.md5("text").alias("body"))


@query(
    "w11_batches",
    """WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events) SELECT event_id, cycle, (cycle - 1) // 5 + 1 AS batch, (cycle - 1) % 5 + 1 AS in_batch FROM n""",
)
def w11(spark, sf):
    return W.batches(event_rows(spark, sf), EVENT_KEYS, EVENT_ORDER, day()).select("event_id", "cycle", "batch", "in_batch")


@query(
    "w12_run_trend",
    """WITH r AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, round(sum(o_totalprice))::BIGINT AS total FROM orders GROUP BY 1, 2)
    SELECT o_orderpriority, month, orders, total, orders - lag(orders) OVER w AS orders_delta, total - lag(total) OVER w AS total_delta FROM r WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)""",
)
def w12(spark, sf):
    # Prices are added as decimals: totals on a half round up whatever the order of the rows.
    r = table(spark, sf, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(28,6)"))).cast("bigint").alias("total")
    )
    return W.run_trend(r, ["o_orderpriority"], "month", ["orders", "total"])


@query(
    "w13_family_reference",
    "SELECT p_brand, min_by(p_partkey, CASE WHEN p_size < 4 THEN 0 ELSE 100000000 END + p_partkey) AS reference, min_by(p_size, CASE WHEN p_size < 4 THEN 0 ELSE 100000000 END + p_partkey)::BIGINT AS size FROM part GROUP BY 1",
)
def w13(spark, sf):
    out = W.family_reference(table(spark, sf, "part"), ["p_brand"], F.col("p_size") < 4, "p_partkey")
    return out.select("p_brand", F.col("reference.p_partkey").alias("reference"), F.col("reference.p_size").cast("bigint").alias("size"))


PART_RULES = (("round", "o", 1), ("colour", "^(red|blue|green)", 3), ("long", "......", 2), ("metal", "(bolt|gear|ring)", 3))


@query(
    "w14_best_rule",
    """WITH r(rule, pattern, priority) AS (VALUES ('round', 'o', 1), ('colour', '^(red|blue|green)', 3), ('long', '......', 2), ('metal', '(bolt|gear|ring)', 3)), m AS (SELECT p_partkey, rule, priority FROM part, r WHERE regexp_matches(p_name, pattern)),
    t AS (SELECT p_partkey, max(priority) AS priority FROM m GROUP BY 1)
    SELECT p_partkey, t.priority::BIGINT AS priority, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS' ELSE min(rule) END AS rule, count(*) AS candidates FROM t JOIN m USING (p_partkey, priority) GROUP BY 1, 2""",
)
def w14(spark, sf):
    m = R.all_rules(table(spark, sf, "part").select("p_partkey", "p_name"), PART_RULES, "p_name")
    return R.best_rule(m, ["p_partkey"]).withColumn("priority", F.col("priority").cast("bigint"))


@query(
    "w15_failing_stage",
    "SELECT l_orderkey, min_by(l_shipdate::VARCHAR, l_linenumber) AS stage, min(l_linenumber)::BIGINT AS stage_ord FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1",
)
def w15(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("ship"))
    out = W.failing_stage(li, ["l_orderkey"], "l_linenumber", F.lit(True), "ship")
    return out.withColumn("stage_ord", F.col("stage_ord").cast("bigint"))
