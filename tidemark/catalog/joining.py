"""Joins J1-J23 and set operations U1-U5 bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import LINES_SQL, doc_lines, query, table
from tidemark.catalog.predicates import TYPES_SQL, typed_lines
from tidemark.operators import joins as J, literals, sets
from tidemark.operators.facts import extract_types

# A second side of the orders: every 17th key is gone, every 13th has another status,
# and keys divisible by 19 come back under a new id.
SECOND_SQL = """second AS (
  SELECT CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority
  FROM orders WHERE o_orderkey % 17 <> 0)"""


def second_orders(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderkey") % 17 != 0)
    return o.select(
        F.when(F.col("o_orderkey") % 19 == 0, F.col("o_orderkey") + 10000000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey",
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", "o_orderpriority",
    )


@query(
    "j01_outer_diff",
    f"""WITH {SECOND_SQL} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS id, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'both' END AS side,
        a.o_orderstatus AS old_status, b.o_orderstatus AS new_status FROM orders a FULL JOIN second b USING (o_orderkey)""",
)
def j01(spark, sf):
    name = F.concat(F.lit("Order-"), F.col("o_orderkey").cast("string")).alias("id")
    base = table(spark, sf, "orders").select(name, "o_orderkey", "o_orderstatus")
    cur = second_orders(spark, sf).select(F.upper(name).alias("id"), "o_orderkey", "o_orderstatus")
    out = J.outer_diff(base, cur, "id")
    return out.select(
        F.coalesce("base.o_orderkey", "cur.o_orderkey").alias("id"), "side", F.col("base.o_orderstatus").alias("old_status"), F.col("cur.o_orderstatus").alias("new_status")
    )


@query(
    "j02_tree_diff",
    """SELECT a.doc_id, sha256(a.text) AS left_sha, CASE WHEN a.doc_id % 11 <> 0 THEN sha256(a.text || '!') END AS right_sha,
        CASE WHEN a.doc_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS difference FROM documents a WHERE doc_id % 11 = 0 OR doc_id % 7 = 0""",
)
def j02(spark, sf):
    docs = table(spark, sf, "documents")
    a = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    b = docs.where(F.col("doc_id") % 11 != 0).select(
        "doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha")
    )
    return J.tree_diff(a, b, "doc_id", "sha")


@query(
    "j03_opened_closed",
    f"""WITH {SECOND_SQL} SELECT o_orderkey, 'closed' AS change FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM second)
        UNION ALL SELECT o_orderkey, 'opened' FROM second WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def j03(spark, sf):
    return J.opened_closed(table(spark, sf, "orders"), second_orders(spark, sf), ["o_orderkey"])


@query(
    "j04_drop_mapped",
    """SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25 OR p_type = 'PROMO') GROUP BY 1""",
)
def j04(spark, sf):
    rules = table(spark, sf, "part").where((F.col("p_size") < 25) | (F.col("p_type") == "PROMO")).select(F.col("p_partkey").alias("l_partkey"))
    left = J.drop_mapped(table(spark, sf, "lineitem").select("l_partkey"), rules, "l_partkey")
    return left.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j05_check_candidates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'invalid' WHEN o_custkey % 5 = 0 THEN 'exhausted' ELSE 'ready' END AS verdict FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def j05(spark, sf):
    o = table(spark, sf, "orders")
    selected = o.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    available = o.where(F.col("o_orderstatus") == "O").select("o_orderkey")
    exhausted = o.where(F.col("o_custkey") % 5 == 0).select("o_orderkey")
    return J.check_candidates(selected, available, exhausted, ["o_orderkey"])


IDENTITY_SQL = """s AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey = 3),
    t AS (SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"""


def identity_sides(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    s = c.select(F.col("c_custkey").alias("id")).unionAll(c.where("c_nationkey = 3").select("c_custkey"))
    t = o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return s, t


@query(
    "j06_pair_identities",
    f"""WITH {IDENTITY_SQL}, k AS (SELECT id, sum(s)::BIGINT AS sc, sum(t)::BIGINT AS tc FROM (SELECT id, 1 AS s, 0 AS t FROM s UNION ALL SELECT id, 0, 1 FROM t) GROUP BY id)
    SELECT id, sc AS source_count, tc AS target_count, 'DuplicateSourceTestIdentity' AS category FROM k WHERE sc > 1
    UNION ALL SELECT id, sc, tc, 'DuplicateTargetTestIdentity' FROM k WHERE tc > 1 UNION ALL SELECT id, sc, tc, 'MissingTargetTest' FROM k WHERE sc = 1 AND tc = 0
    UNION ALL SELECT id, sc, tc, 'UnexpectedTargetTest' FROM k WHERE tc = 1 AND sc = 0 UNION ALL SELECT id, sc, tc, 'paired' FROM k WHERE sc = 1 AND tc = 1""",
)
def j06(spark, sf):
    pairs, issues = J.pair_identities(*identity_sides(spark, sf), ["id"])
    one = F.lit(1).cast("bigint")
    return issues.unionByName(pairs.select("id", one.alias("source_count"), one.alias("target_count"), F.lit("paired").alias("category")))


@query(
    "j07_loss_checks",
    """WITH s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS b, count(*) FILTER (l_linestatus = 'O') AS a, count(*) AS c FROM lineitem GROUP BY 1),
    t AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS b, count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.02) AS a, count(*) FILTER (l_tax > 0) AS c FROM lineitem GROUP BY 1),
    j AS (SELECT l_orderkey, s.b AS sb, s.a AS sa, s.c AS sc, t.b AS tb, t.a AS ta, t.c AS tc FROM s JOIN t USING (l_orderkey))
    SELECT l_orderkey, 'VacuumTest' AS category FROM j WHERE sb > 0 AND tb = 0 UNION ALL SELECT l_orderkey, 'AssertionLoss' FROM j WHERE sa > 0 AND ta < sa
    UNION ALL SELECT l_orderkey, 'TestCaseLoss' FROM j WHERE tc < sc""",
)
def j07(spark, sf):
    li = table(spark, sf, "lineitem")
    side = lambda b, a, c: li.groupBy("l_orderkey").agg(F.count_if(b).alias("behavior"), F.count_if(a).alias("assertions"), F.count_if(c).alias("cases"))
    src = side(F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", F.lit(True))
    tgt = side(F.col("l_returnflag") == "A", (F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.02), F.col("l_tax") > 0)
    return J.loss_checks(src, tgt, ["l_orderkey"])


# Rule keys: whole benchmark passages, their first three words, one word, and pieces of words.
RULE_KEYS_SQL = """rule_keys AS (
  SELECT 'full-' || item_id AS rule_id, text AS key FROM benchmark
  UNION ALL SELECT 'three-' || item_id, array_to_string(string_split(text, ' ')[2:4], ' ') FROM benchmark
  UNION ALL SELECT 'word-' || item_id, ' ' || string_split(text, ' ')[5] || ' ' FROM benchmark
  UNION ALL SELECT 'piece-' || item_id, left(string_split(text, ' ')[7], 3) FROM benchmark
  UNION ALL SELECT 'edge-' || item_id, right(string_split(text, ' ')[3], 2) || ' ' || left(string_split(text, ' ')[4], 2) FROM benchmark)"""


def rule_keys(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("w", F.split("text", " ", -1))
    w = lambda i: F.get("w", F.lit(i))
    part = lambda kind, key: b.select(F.concat(F.lit(kind + "-"), F.col("item_id").cast("string")).alias("rule_id"), key.alias("key"))
    return (
        part("full", F.col("text")).unionAll(part("three", F.array_join(F.slice("w", 2, 3), " ")))
        .unionAll(part("word", F.concat(F.lit(" "), w(4), F.lit(" ")))).unionAll(part("piece", F.left(w(6), F.lit(3))))
        .unionAll(part("edge", F.concat(F.right(w(2), F.lit(2)), F.lit(" "), F.left(w(3), F.lit(2)))))
    ).where(F.length("key") > 0)


@query(
    "j08_rule_hits",
    f"""WITH {RULE_KEYS_SQL} SELECT rule_id, doc_id, ((length(text) - length(replace(text, key, ''))) // length(key))::BIGINT AS hits,
        (length(substr(text, 1, strpos(text, key) - 1)) - length(replace(substr(text, 1, strpos(text, key) - 1), chr(10), '')) + 1)::BIGINT AS first_line
        FROM documents, rule_keys WHERE length(key) > 0 AND contains(text, key)""",
)
def j08(spark, sf):
    return literals.literal_hits(table(spark, sf, "documents"), "doc_id", "text", rule_keys(spark, sf), "rule_id", "key")


@query(
    "j08_identifier_hits",
    r"""WITH k AS (SELECT item_id, regexp_extract(text, '^\S+\s+(\w+)', 1) AS key FROM benchmark)
    SELECT item_id, doc_id, len(m)::BIGINT AS hits FROM (SELECT item_id, doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda t: t = key) AS m FROM documents, k WHERE contains(text, key) AND key <> '') WHERE len(m) > 0""",
)
def j08b(spark, sf):
    keys = table(spark, sf, "benchmark").select("item_id", F.regexp_extract("text", r"^\S+\s+(\w+)", 1).alias("key")).where("key <> ''")
    return literals.identifier_hits(table(spark, sf, "documents"), "doc_id", "text", keys, "item_id", "key").select("item_id", "doc_id", "hits")


@query(
    "j08_placeholder_hits",
    r"""WITH k AS (SELECT item_id, string_split(text, ' ')[2] || ' ' || string_split(text, ' ')[3] AS a, string_split(text, ' ')[4] AS b FROM benchmark)
    SELECT item_id, doc_id, len(regexp_extract_all(text, '(?s)' || regexp_replace(a, '([\\.\[\]{}()*+?^$|#\-])', '\\\1', 'g') || ' .+? ' || regexp_replace(b, '([\\.\[\]{}()*+?^$|#\-])', '\\\1', 'g') || ' '))::BIGINT AS hits
    FROM documents, k WHERE contains(text, a) AND len(regexp_extract_all(text, '(?s)' || regexp_replace(a, '([\\.\[\]{}()*+?^$|#\-])', '\\\1', 'g') || ' .+? ' || regexp_replace(b, '([\\.\[\]{}()*+?^$|#\-])', '\\\1', 'g') || ' ')) > 0""",
)
def j08c(spark, sf):
    w = F.split("text", " ", -1)
    key = F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(2)), F.lit("{x}"), F.get(w, F.lit(3)), F.lit(""))
    keys = table(spark, sf, "benchmark").select("item_id", key.alias("key"))
    return literals.placeholder_hits(table(spark, sf, "documents"), "doc_id", "text", keys, "item_id", "key").select("item_id", "doc_id", "hits")


COVER_SQL = """expr AS (SELECT DISTINCT lower(replace(p_type, ' ', '')) || '.' || replace(p_name, ' ', '.') AS expression FROM part),
rules AS (
  SELECT CASE p_partkey % 6 WHEN 0 THEN 'UiTargets' WHEN 1 THEN 'Tables' WHEN 2 THEN 'Pagination' WHEN 3 THEN 'Methods' WHEN 4 THEN 'ParameterizedMethods' ELSE 'Scoped UiTargets' END AS section,
         CASE p_partkey % 6 WHEN 3 THEN lower(p_type) || '.' || replace(p_name, ' ', '.') || '(' || p_size || ')' WHEN 4 THEN 'x.' || lower(p_type) || '.' || replace(p_name, ' ', '.') || 'Row({a})'
              ELSE lower(p_type) || '.' || replace(p_name, ' ', '.') END AS key
  FROM part)"""


def cover_tables(spark, sf):
    p = table(spark, sf, "part")
    e = F.concat(F.lower("p_type"), F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
    section = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'UiTargets' WHEN 1 THEN 'Tables' WHEN 2 THEN 'Pagination' WHEN 3 THEN 'Methods' WHEN 4 THEN 'ParameterizedMethods' ELSE 'Scoped UiTargets' END")
    key = F.when(F.col("p_partkey") % 6 == 3, F.concat(e, F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).when(
        F.col("p_partkey") % 6 == 4, F.concat(F.lit("x."), e, F.lit("Row({a})"))
    ).otherwise(e)
    return p.select(e.alias("expression")).distinct(), p.select(section.alias("section"), key.alias("key"))


@query(
    "j09_coverage",
    f"""WITH {COVER_SQL}, hit AS (
      SELECT expression, 1 AS o, section FROM expr JOIN rules ON key = expression AND section = 'UiTargets' UNION ALL SELECT expression, 2, section FROM expr JOIN rules ON key = expression AND section = 'Tables'
      UNION ALL SELECT expression, 3, section FROM expr JOIN rules ON key = expression AND section = 'Pagination'
      UNION ALL SELECT expression, 4, section FROM expr JOIN rules ON section = 'Methods' AND (key = expression OR starts_with(key, expression || '('))
      UNION ALL SELECT expression, 5, section FROM expr JOIN rules ON section = 'ParameterizedMethods' AND (string_split(key, '(')[1] = expression OR contains(key, expression))
      UNION ALL SELECT expression, 6, section FROM expr JOIN rules ON key = expression AND section = 'Scoped UiTargets')
    SELECT e.expression, coalesce(min_by(h.section, h.o), '') AS covered_by FROM expr e LEFT JOIN hit h USING (expression) GROUP BY e.expression""",
)
def j09(spark, sf):
    return J.coverage(*cover_tables(spark, sf)).select("expression", "covered_by")


EVIDENCE_SQL = """src AS (SELECT s_suppkey AS ord, 'page.n' || s_nationkey AS source_expr, CASE WHEN s_suppkey % 4 = 0 THEN 'xpath=' || n_name ELSE n_name || '-' || (s_suppkey % 3) END AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cfg AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 5 = 0 THEN 'page.n' || c_nationkey ELSE 'page.x' || c_custkey END AS source_expr, '"' || lower(n_name) || '-' || (c_custkey % 7) || '"' AS target FROM customer JOIN nation ON c_nationkey = n_nationkey),
gen AS (SELECT c_custkey AS ord, n_name || '-' || (c_custkey % 9) AS target, 'Page.GetByTestId("' || n_name || '-' || (c_custkey % 9) || '")' AS locator FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def evidence_sides(spark, sf):
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    st = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    k = F.col("c_custkey")
    src = s.select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("page.n"), st("s_nationkey")).alias("source_expr"), F.lit("Id").alias("kind"),
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("xpath="), F.col("n_name"))).otherwise(F.concat("n_name", F.lit("-"), st(F.col("s_suppkey") % 3))).alias("value"),
    )
    cfg = c.select(
        k.alias("ord"), F.when(k % 5 == 0, F.concat(F.lit("page.n"), st("c_nationkey"))).otherwise(F.concat(F.lit("page.x"), st(k))).alias("source_expr"),
        F.concat(F.lit('"'), F.lower("n_name"), F.lit("-"), st(k % 7), F.lit('"')).alias("target"), F.when(k % 11 == 0, F.lit("RawExpression")).otherwise("TestId").alias("target_kind"),
        F.when(k % 13 == 0, F.lit("Nth")).alias("match_mode"), F.lit("global").alias("scope"),
    )
    value = F.concat("n_name", F.lit("-"), st(k % 9))
    gen = c.select(k.alias("ord"), F.concat(F.lit('Page.GetByTestId("'), value, F.lit('")')).alias("locator"), value.alias("target"))
    return src, cfg, gen


EVIDENCE_NORM = "nullif(replace(lower(trim({0}, '\"''')), 'xpath=', ''), '')"


def _n(x):
    return EVIDENCE_NORM.format(x)


MATCH_SQL = f"""WITH {EVIDENCE_SQL},
d1 AS (SELECT s.ord, s.source_expr, s.value,
         (SELECT min(c.ord) FROM cfg c WHERE {_n('c.source_expr')} = {_n('s.source_expr')} OR {_n('c.target')} = {_n('s.value')}) AS cfg_ord FROM src s),
d1g AS (SELECT d1.*, c.target AS cfg_target, coalesce((SELECT min(g.ord) FROM gen g WHERE {_n('g.target')} = {_n('c.target')}), (SELECT min(g.ord) FROM gen g WHERE {_n('g.target')} = {_n('d1.value')})) AS gen_ord
        FROM d1 LEFT JOIN cfg c ON c.ord = d1.cfg_ord),
d2 AS (SELECT c.ord AS cfg_ord, c.source_expr, c.target, (SELECT min(s.ord) FROM src s WHERE {_n('s.source_expr')} = {_n('c.source_expr')} OR {_n('s.value')} = {_n('c.target')}) AS src_ord FROM cfg c),
d2g AS (SELECT d2.*, s.value, s.source_expr AS s_expr, coalesce((SELECT min(g.ord) FROM gen g WHERE {_n('g.target')} = {_n('d2.target')}), (SELECT min(g.ord) FROM gen g WHERE {_n('g.target')} = {_n('s.value')})) AS gen_ord
        FROM d2 LEFT JOIN src s ON s.ord = d2.src_ord),
d3 AS (SELECT g.ord AS gen_ord, g.target, (SELECT min(s.ord) FROM src s WHERE {_n('s.value')} = {_n('g.target')}) AS src_ord,
         (SELECT min(c.ord) FROM cfg c WHERE {_n('c.target')} = {_n('g.target')} OR contains(lower(g.locator), lower(c.target))) AS cfg_ord FROM gen g),
items AS (
  SELECT 1 AS driver, ord AS row_ord, ord AS src_ord, cfg_ord, gen_ord FROM d1g
  UNION ALL SELECT 2, cfg_ord, src_ord, cfg_ord, gen_ord FROM d2g UNION ALL SELECT 3, gen_ord, src_ord, cfg_ord, gen_ord FROM d3),
full_items AS (
  SELECT i.*, coalesce(s.source_expr, c.source_expr, g.target) AS source_expr,
    lower(coalesce(s.source_expr, c.source_expr, g.target) || '|' || coalesce(s.value, '') || '|' || coalesce(c.target, '') || '|' || coalesce(g.locator, '')) AS stable_key
  FROM items i LEFT JOIN src s ON s.ord = i.src_ord LEFT JOIN cfg c ON c.ord = i.cfg_ord LEFT JOIN gen g ON g.ord = i.gen_ord),
kept AS (SELECT * FROM full_items WHERE driver = 1 UNION ALL
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY stable_key ORDER BY driver, row_ord) AS rn FROM full_items WHERE driver > 1 AND stable_key NOT IN (SELECT stable_key FROM full_items WHERE driver = 1)) WHERE rn = 1)"""


@query("j10_match_evidence", MATCH_SQL + " SELECT driver, row_ord, source_expr, src_ord, cfg_ord, gen_ord FROM kept")
def j10(spark, sf):
    out = J.match_evidence(*evidence_sides(spark, sf))
    return out.select(
        "driver", F.col("ord").alias("row_ord"), "source_expr", F.col("source.ord").alias("src_ord"), F.col("config.ord").alias("cfg_ord"), F.col("generated.ord").alias("gen_ord")
    )


@query(
    "j11_resolve_rules",
    """WITH r AS (SELECT p_name AS k, CASE WHEN p_size % 3 = 0 THEN p_type END AS scope, p_brand AS target, p_partkey AS layer_ord FROM part),
    sc AS (SELECT scope, k, max_by(target, layer_ord) AS t FROM r WHERE scope IS NOT NULL GROUP BY 1, 2), gl AS (SELECT k, max_by(target, layer_ord) AS t FROM r WHERE scope IS NULL GROUP BY 1)
    SELECT p_partkey, coalesce(sc.t, gl.t) AS target, CASE WHEN sc.t IS NOT NULL THEN 'scope' WHEN gl.t IS NOT NULL THEN 'global' ELSE 'none' END AS origin
    FROM part LEFT JOIN sc ON sc.scope = p_type AND sc.k = p_name LEFT JOIN gl ON gl.k = p_name""",
)
def j11(spark, sf):
    p = table(spark, sf, "part")
    rules = p.select(
        F.col("p_name").alias("key"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("scope"), F.col("p_brand").alias("target"), F.col("p_partkey").alias("layer_ord")
    )
    actions = p.select("p_partkey", F.col("p_name").alias("key"), F.col("p_type").alias("scope"))
    return J.resolve_rules(actions, rules, "key").select("p_partkey", "target", "origin")


DOTS_SQL = "replace(replace(regexp_replace(url, '^https?://', ''), '/', '.'), '?', '.')"


@query(
    "j12_longest_prefix",
    f"""WITH e AS (SELECT page_id, {DOTS_SQL} AS expr FROM pages),
    r AS (SELECT DISTINCT array_to_string(string_split(expr, '.')[1:(1 + page_id % 4)], '.') AS key FROM e WHERE page_id % 3 = 0)
    SELECT page_id, max_by(key, length(key)) AS matched_key, upper(max_by(key, length(key))) AS target FROM e LEFT JOIN r ON starts_with(expr, key || '.') GROUP BY page_id""",
)
def j12(spark, sf):
    expr = F.replace(F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(".")), F.lit("?"), F.lit("."))
    e = table(spark, sf, "pages").select("page_id", expr.alias("expr"))
    key = F.array_join(F.slice(F.split("expr", "\\.", -1), F.lit(1), (F.col("page_id") % 4 + 1).cast("int")), ".")
    rules = e.where(F.col("page_id") % 3 == 0).select(key.alias("key")).distinct().withColumn("target", F.upper("key"))
    return J.longest_prefix(e, rules, "expr", "key", "target").select("page_id", "matched_key", "target")


SCOPES = {"blog": ["http*://blog.*/**"], "english": ["**/en/*"], "html": ["*.html"], "german": ["**/de/**"]}


@query(
    "j13_assign_scope",
    r"""WITH m AS (SELECT DISTINCT url, list_filter([CASE WHEN regexp_matches(url, '(?i)^(?:.*/)?http[^/]*://blog\.[^/]*/.*$') THEN 'blog' END, CASE WHEN regexp_matches(url, '(?i)^(?:.*/)?en/[^/]*$') THEN 'english' END,
         CASE WHEN regexp_matches(url, '(?i)^(?:.*/)?de/.*$') THEN 'german' END, CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '(?i)\.html$') THEN 'html' END], lambda x: x IS NOT NULL) AS s FROM pages)
    SELECT url, CASE WHEN len(s) = 1 THEN s[1] END AS scope, CASE WHEN len(s) > 1 THEN array_to_string(s, ',') END AS conflict FROM m""",
)
def j13(spark, sf):
    ok, bad = J.assign_scope(table(spark, sf, "pages").select(F.col("url").alias("path")), SCOPES)
    none = F.lit(None).cast("string")
    return ok.select(F.col("path").alias("url"), "scope", none.alias("conflict")).unionByName(
        bad.select(F.col("path").alias("url"), none.alias("scope"), F.array_join("scopes", ",").alias("conflict"))
    )


@query(
    "j14_variants_with_run",
    "SELECT n_nationkey, r_name, r_regionkey IS NULL AS missing FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2",
)
def j14(spark, sf):
    variants = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("REG"), F.col("n_regionkey").cast("string")).alias("id"))
    run = table(spark, sf, "region").where("r_regionkey <> 2").select(F.concat(F.lit("reg"), F.col("r_regionkey").cast("string")).alias("id"), "r_name")
    return J.variants_with_run(variants, run, "id").select("n_nationkey", F.col("run.r_name").alias("r_name"), "missing")


CONTRACT_SQL = """b AS (SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE md5(p_name) END AS h FROM part WHERE p_partkey % 29 <> 0),
    r AS (SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN md5(p_brand) ELSE upper(md5(p_name)) END AS h FROM part WHERE p_partkey % 37 <> 0)"""


def contract_sides(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    sid = F.concat(F.lit("part-"), k.cast("string")).alias("id")
    base = p.where(k % 29 != 0).select(sid, F.when(k % 23 == 0, F.lit("")).otherwise(F.md5("p_name")).alias("contract_hash"))
    run = p.where(k % 37 != 0).select(
        F.upper(sid).alias("id"), F.when(k % 31 == 0, F.lit(None).cast("string")).when(k % 10 == 0, F.md5("p_brand")).otherwise(F.upper(F.md5("p_name"))).alias("contract_hash")
    )
    return run, base


@query(
    "j15_contract_changes",
    f"""WITH {CONTRACT_SQL}, j AS (SELECT CASE WHEN r.p_partkey IS NULL THEN 'part-' || b.p_partkey ELSE 'PART-' || r.p_partkey END AS id,
       CASE WHEN r.p_partkey IS NULL THEN 'missing-from-run' WHEN b.p_partkey IS NULL THEN 'not-in-baseline' WHEN b.h = '' THEN 'baseline-without-hash' WHEN r.h IS NULL THEN 'run-without-hash'
            WHEN lower(b.h) <> lower(r.h) THEN 'contract-changed' END AS reason FROM r FULL JOIN b USING (p_partkey))
    SELECT id, reason FROM j WHERE reason IS NOT NULL""",
)
def j15(spark, sf):
    return J.contract_changes(*contract_sides(spark, sf))


PART_FAMILIES = {"large-family": ("LARGE", "MEDIUM"), "cheap": ("ECONOMY",)}


@query(
    "j16_feature_family",
    "SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'large-family' WHEN 'MEDIUM' THEN 'large-family' WHEN 'ECONOMY' THEN 'cheap' ELSE lower(p_type) END AS family FROM part",
)
def j16(spark, sf):
    return J.feature_family(table(spark, sf, "part"), "p_type", PART_FAMILIES).select("p_partkey", "family")


@query(
    "j17_paths_in_evidence",
    "SELECT item_id, doc_id FROM benchmark b, documents d WHERE contains(lower(replace(d.text, ' ', '/')), lower(replace(b.text, ' ', '/')))",
)
def j17(spark, sf):
    """Passages as paths: slashes in the known paths, both slashes in the texts."""
    known = table(spark, sf, "benchmark").select("item_id", F.translate("text", " ", "/").alias("path"))
    spelled = F.when(F.col("doc_id") % 2 == 0, F.translate("text", " ", "\\")).otherwise(F.translate("text", " ", "/"))
    docs = table(spark, sf, "documents").select("doc_id", spelled.alias("text"))
    return literals.paths_in_texts(docs, "doc_id", "text", known, "item_id", "path").select("item_id", "doc_id")


FAILURE_LINK_SQL = r"""WITH obs AS (SELECT doc_id AS obs, CASE WHEN doc_id % 4 = 0 THEN 'T' || (doc_id + 1000) ELSE text END AS words,
      CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || '   at Run() in C:\build\gen\c' || (doc_id % 97) || '\turn' || (doc_id % 6) || '.cs:line ' || (doc_id % 40 + 1) ELSE text END AS snippet FROM documents),
    gen AS (SELECT conv_id, turn, (conv_id, turn) AS file, 'gen/c' || conv_id || '/turn' || turn || '.cs' AS path, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]{3,}') || turn AS name,
      'using x;' || chr(10) || replace(text, chr(10), chr(10) || 'b(); // Original: b // line ' || (turn * 10) || chr(10)) || chr(10) || 'c(); // Original: c // line ' || (conv_id + 1000) AS body FROM conversations),
    rep AS (SELECT page_id AS report, html || CASE page_id % 3 WHEN 0 THEN chr(10) || 'Source file: `src/p' || page_id || '.cs`' WHEN 1 THEN '{"sourceFile": "src/q' || page_id || '.cs"}' ELSE '' END
      || CASE WHEN page_id % 5 = 0 THEN ' turn' || (page_id % 3) || '.cs' ELSE '' END AS body FROM pages),
    sourced AS (SELECT *, coalesce(nullif(trim(regexp_extract(body, '(?i)Source file:[ \t]*`?([^`\r\n]+\.cs)`?', 1)), ''), nullif(trim(regexp_extract(body, '(?i)"sourceFile(?:Path)?"\s*:\s*"([^"]+\.cs)"', 1)), '')) AS source_file FROM rep),
    reports AS (SELECT * FROM sourced WHERE source_file IS NOT NULL),
    framed AS (SELECT * FROM (SELECT obs, trim(regexp_extract(snippet, '(?i)\s+in\s+([^\r\n]+?\.cs):line\s+(\d+)', 1)) AS frame, TRY_CAST(regexp_extract(snippet, '(?i)\s+in\s+([^\r\n]+?\.cs):line\s+(\d+)', 2) AS BIGINT) AS line FROM obs) WHERE frame <> ''),
    by_frame AS (SELECT obs, any_value(line) AS line, any_value(frame) AS frame, min(g.file) AS file FROM framed LEFT JOIN gen g ON ends_with(lower(replace(frame, '\', '/')), '/' || g.path) GROUP BY obs),
    words AS (SELECT obs, tok FROM (SELECT DISTINCT obs, lower(unnest(regexp_extract_all(words, '[A-Za-z_][A-Za-z0-9_]{3,}'))) AS tok FROM obs) WHERE tok NOT IN ('failed', 'passed', 'test', 'name', 'error')),
    gen_words AS (SELECT DISTINCT file, lower(unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]{3,}'))) AS tok FROM gen),
    firsts AS (SELECT tok, min((file, stage)) AS best FROM (
      SELECT tok, file, 'token' AS stage FROM gen_words UNION ALL SELECT tok, file, 'name' FROM (SELECT DISTINCT tok FROM words) JOIN gen ON contains(lower(name), tok)) GROUP BY tok),
    by_word AS (SELECT obs, min(best) AS best FROM words JOIN firsts USING (tok) WHERE obs NOT IN (SELECT obs FROM framed) GROUP BY obs),
    base AS (SELECT obs, 'frame' AS stage, b.file, coalesce(path, frame) AS generated_path, line FROM by_frame b LEFT JOIN gen USING (file)
      UNION ALL SELECT obs, best[2], best[1], path, NULL FROM by_word JOIN gen ON gen.file = best[1]),
    bases AS (SELECT obs, lower(regexp_extract(replace(generated_path, '\', '/'), '[^/]*$')) AS b FROM base),
    rep_words AS (SELECT tok, min(report) AS report FROM (SELECT report, lower(unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]{3,}'))) AS tok FROM reports) GROUP BY tok),
    rep_bases AS (SELECT b, min(report) AS report FROM (SELECT DISTINCT b FROM bases) JOIN reports ON contains(lower(body), b) GROUP BY b),
    picked AS (SELECT obs, min(report) AS report FROM (SELECT obs, report FROM words JOIN rep_words USING (tok) UNION ALL SELECT obs, report FROM bases JOIN rep_bases USING (b)) GROUP BY obs),
    marks AS (SELECT file, line_no, TRY_CAST(nullif(regexp_extract(l, '(?i)//\s*Original:.*//\s*line\s+(\d+)', 1), '') AS BIGINT) AS mark FROM
      (SELECT file, unnest(ls) AS l, generate_subscripts(ls, 1) AS line_no FROM (SELECT file, string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM gen))),
    whole AS (SELECT o.obs, b.stage, b.file, b.generated_path, b.line, p.report, r.source_file FROM obs o LEFT JOIN base b USING (obs) LEFT JOIN picked p USING (obs) LEFT JOIN reports r USING (report)),
    near AS (SELECT w.obs, max_by(mark, line_no) FILTER (WHERE line_no <= w.line) AS at_or_above, min_by(mark, line_no) AS first_mark FROM whole w JOIN marks m USING (file) WHERE mark IS NOT NULL AND report IS NULL GROUP BY w.obs)
    SELECT obs, stage, file[1] AS conv_id, file[2] AS turn, generated_path, line AS generated_line, report, source_file, coalesce(at_or_above, first_mark) AS source_line
    FROM whole LEFT JOIN near USING (obs) WHERE generated_path IS NOT NULL OR source_file IS NOT NULL"""


@query("j18_link_failures", FAILURE_LINK_SQL)
def j18(spark, sf):
    """Documents as failures (a quarter with a stack frame and a test name), turns as generated files, pages as reports."""
    from tidemark.operators.linking import link_failures

    st = lambda c: c.cast("string")
    d, c, t, p = F.col("doc_id"), F.col("conv_id"), F.col("turn"), F.col("page_id")
    frame = F.concat(F.col("text"), F.lit("\n   at Run() in C:\\build\\gen\\c"), st(d % 97), F.lit("\\turn"), st(d % 6), F.lit(".cs:line "), st(d % 40 + 1))
    obs = table(spark, sf, "documents").select(d.alias("obs"), F.when(d % 4 == 0, F.concat(F.lit("T"), st(d + 1000))).otherwise(F.col("text")).alias("words"), F.when(d % 4 == 0, frame).otherwise(F.col("text")).alias("snippet"))
    marked = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\nb(); // Original: b // line "), st(t * 10), F.lit("\n")))
    generated = table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("file"), F.concat(F.lit("gen/c"), st(c), F.lit("/turn"), st(t), F.lit(".cs")).alias("path"),
        F.concat(F.regexp_extract("text", r"[A-Za-z_][A-Za-z0-9_]{3,}", 0), st(t)).alias("name"),
        F.concat(F.lit("using x;\n"), marked, F.lit("\nc(); // Original: c // line "), st(c + 1000)).alias("text"))
    source = F.when(p % 3 == 0, F.concat(F.lit("\nSource file: `src/p"), st(p), F.lit(".cs`"))).when(p % 3 == 1, F.concat(F.lit('{"sourceFile": "src/q'), st(p), F.lit('.cs"}'))).otherwise("")
    reports = table(spark, sf, "pages").select(p.alias("report"), F.concat("html", source, F.when(p % 5 == 0, F.concat(F.lit(" turn"), st(p % 3), F.lit(".cs"))).otherwise("")).alias("text"))
    out = link_failures(obs, generated, reports)
    return out.select("obs", "stage", "file.conv_id", "file.turn", "generated_path", "generated_line", "report", "source_file", "source_line")


@query(
    "j20_score_profiles",
    """WITH sig AS (SELECT n_nationkey, n_regionkey, n_name FROM nation), prof AS (SELECT r_regionkey, r_name FROM region)
    SELECT n_nationkey, r_name AS profile, (100 - CASE WHEN length(n_name) % 2 <> length(r_name) % 2 THEN 20 ELSE 0 END)::BIGINT AS score FROM sig JOIN prof ON n_regionkey = r_regionkey
    UNION ALL SELECT n_nationkey, NULL, 55 FROM sig""",
)
def j20(spark, sf):
    """Profiles of a project's region are scored by an equi join; one row stands for all others."""
    from tidemark.operators.linking import score_catalogue

    catalogue = table(spark, sf, "region").select("r_regionkey", "r_name")
    projects = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name")
    penalties = [(20, lambda p: F.length("n_name") % 2 != F.length(p["r_name"]) % 2)]
    out = score_catalogue(projects, catalogue, (F.col("n_regionkey"), F.col("r_regionkey")), 45, penalties)
    return out.select("n_nationkey", F.col("profile.r_name").alias("profile"), F.col("score").cast("bigint").alias("score"))


@query(
    "j21_base_class_attributes",
    f"""WITH {TYPES_SQL}, named AS (SELECT doc_id, line_no, class_name, replace(base_class, 'Base', 'w') AS base_class, attributes FROM types),
    bases AS (SELECT left(class_name, 0) || 'w' || left(class_name, 1) AS base_class, min(attributes) AS inherited FROM types WHERE base_class IS NULL GROUP BY 1)
    SELECT n.doc_id, n.line_no::BIGINT AS line_no, n.class_name, array_to_string(list_sort(list_distinct(list_concat(
        CASE WHEN n.attributes = '' THEN [] ELSE string_split(n.attributes, ',') END, CASE WHEN coalesce(b.inherited, '') = '' THEN [] ELSE string_split(b.inherited, ',') END))), ',') AS all_attributes
    FROM named n LEFT JOIN bases b USING (base_class)""",
)
def j21(spark, sf):
    types = extract_types(typed_lines(spark, sf), ["doc_id"])
    # Group classes by their first letter, so that bases are found inside the corpus.
    named = types.withColumns(
        {
            "label": F.col("class_name"),
            "attr_text": F.array_join("attributes", ","),
            "base_class": F.replace(F.col("base_class"), F.lit("Base"), F.lit("w")),
        }
    )
    bases = named.where(F.col("base_class").isNull()).withColumn("class_name", F.concat(F.lit("w"), F.left("label", F.lit(1))))
    smallest = bases.groupBy("class_name").agg(F.min_by("attributes", "attr_text").alias("attributes")).select(
        "class_name", "attributes", F.lit(None).cast("string").alias("base_class"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("line_no"), F.lit("").alias("label")
    )
    every = named.select("class_name", "attributes", F.coalesce("base_class", F.lit("-")).alias("base_class"), "doc_id", "line_no", "label").unionByName(smallest)
    out = J.base_class_attributes(every).where(F.col("doc_id").isNotNull())
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("label").alias("class_name"), F.array_join("all_attributes", ",").alias("all_attributes"))


@query(
    "j22_resolve_calls",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unresolved' WHEN c_custkey IS NOT NULL THEN 'in-source' ELSE 'external' END AS state,
        (o_orderstatus <> 'P' AND c_custkey IS NOT NULL) AS in_source FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 20""",
)
def j22(spark, sf):
    calls = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("callee"), (F.col("o_orderstatus") != "P").alias("resolved"))
    methods = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("symbol"))
    return J.resolve_calls(calls, methods).select("o_orderkey", "state", "in_source")


@query(
    "j23_memory_recall_matches",
    """WITH targets AS (SELECT item_id, text AS path FROM benchmark)
    SELECT item_id, doc_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END::BIGINT AS priority FROM targets, documents WHERE contains(lower(text), lower(path))""",
)
def j23(spark, sf):
    from tidemark.plans.memory import recall

    entries = table(spark, sf, "documents").select(
        F.col("doc_id").alias("entry_id"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'antipattern' WHEN 1 THEN 'warning' WHEN 2 THEN 'constraint' ELSE 'decision' END").alias("kind"),
        F.col("text"), F.lit("").alias("scope"), F.lit(False).alias("is_global"),
    )
    targets = table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("path"))
    out = recall(entries, targets)
    return out.select(F.col("target_id").alias("item_id"), F.col("entry_id").alias("doc_id"), F.col("priority").cast("bigint").alias("priority"))


# --- sets -------------------------------------------------------------------------------------------


@query(
    "u01_ordered_union",
    "SELECT 0 AS source_ord, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 1, s_nationkey, count(*) FROM supplier GROUP BY ALL",
)
def u01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return sets.ordered_union(c, s).groupBy("source_ord", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u02_array_delta",
    """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), '|') AS added,
        array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), '|') AS removed
       FROM (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(replace(text, ' the ', ' der '), ' ') AS b FROM conversations)""",
)
def u02(spark, sf):
    b = F.replace(F.col("text"), F.lit(" the "), F.lit(" der "))
    conv = table(spark, sf, "conversations").select("conv_id", "turn", sets.array_delta(F.split("text", " ", -1), F.split(b, " ", -1)).alias("d"))
    return conv.select("conv_id", "turn", F.array_join("d.added", "|").alias("added"), F.array_join("d.removed", "|").alias("removed"))


@query(
    "u03_row_delta",
    "SELECT DISTINCT p_name, p_brand FROM part WHERE p_size > 30 EXCEPT SELECT p_name, p_brand FROM part WHERE p_size <= 30",
)
def u03(spark, sf):
    p = table(spark, sf, "part")
    return sets.row_delta(p.where("p_size <= 30"), p.where("p_size > 30"), ["p_name", "p_brand"])


@query("u04_metric_names", "SELECT p_type AS metric FROM part UNION SELECT upper(event_type) FROM events")
def u04(spark, sf):
    return sets.metric_names(
        table(spark, sf, "part").select(F.col("p_type").alias("metric")), table(spark, sf, "events").select(F.upper("event_type").alias("metric")), "metric"
    )


@query(
    "u05_distinct_trimmed",
    f"""WITH {LINES_SQL} SELECT source, trim(v) AS word, min((doc_id, line_no))[1] AS doc_id, min((doc_id, line_no))[2]::BIGINT AS line_no FROM (SELECT source, doc_id, line_no, ' ' || regexp_extract(line, '[A-Za-z]*', 0) || '  ' AS v FROM lines)
        WHERE trim(v) <> '' GROUP BY 1, 2""",
)
def u05(spark, sf):
    v = F.concat(F.lit(" "), F.regexp_extract("line", "[A-Za-z]*", 0), F.lit("  "))
    lines = doc_lines(spark, sf).select("source", v.alias("word"), F.struct("doc_id", "line_no").alias("ord"))
    found = sets.distinct_trimmed(lines, "word", "ord", ["source"])
    return found.select("source", "word", "position.doc_id", F.col("position.line_no").cast("bigint").alias("line_no"))
