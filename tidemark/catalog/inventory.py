"""Helper and target inventories and call-graph statistics bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.predicates import TYPES_SQL, typed_lines
from tidemark.catalog.registry import query, table
from tidemark.plans import helpers as H, inventory as I

BODY_RULES = {"mouse-click": ("tion",), "wait-presence": ("keit", "eaux"), "selenium-find-element": ("heron",), "read-only-probe": ("with",), "assertion": ("der ",)}


@query(
    "c29_helper_inventory",
    r"""WITH b AS (SELECT source AS name, contains(lower(text), 'tion') AS side, contains(lower(text), 'keit') OR contains(lower(text), 'eaux') AS wait, contains(lower(text), 'heron') AS sel, contains(lower(text), 'with') AS ro, contains(lower(text), 'der ') AS asr FROM documents),
    s AS (SELECT name, CASE WHEN side THEN 1 WHEN wait THEN 2 WHEN ro AND NOT asr THEN 5 WHEN asr THEN 3 ELSE 4 END AS p, CASE WHEN side THEN 1 WHEN wait THEN 2 WHEN ro AND NOT asr THEN 4 WHEN asr THEN 2 ELSE 3 END AS r,
      (CASE WHEN side THEN CASE WHEN sel THEN 0.88 ELSE 0.74 END WHEN wait THEN 0.68 WHEN ro AND NOT asr THEN 0.76 WHEN asr THEN 0.64 ELSE 0.35 END)::DOUBLE AS confidence FROM b)
    SELECT name, count(*) AS occurrences, round(avg(confidence), 1)::DOUBLE AS confidence, ['RequiredSideEffect','ProjectWaitHelper','AssertionHelper','UnknownUnsafe','ReadOnlyProbe','SafeWaitElide'][min(p)] AS semantics, ['high','medium','unknown','low'][min(r)] AS risk FROM s GROUP BY name""",
)
def c29(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("text").alias("body"))
    out = H.helper_inventory(docs, BODY_RULES)
    return out.select("name", "occurrences", F.round("confidence", 1).alias("confidence"), "semantics", "risk")


ATTRS = ("class=", "href=", "charset=", "role")


@query(
    "c30_target_inventory",
    f"""WITH {TYPES_SQL}, fw AS (SELECT count(*) AS n FROM typed WHERE contains(line, '[Test]')), att AS (SELECT a.name, sum((length(lower(html)) - length(replace(lower(html), a.name, ''))) // length(a.name))::BIGINT AS n FROM pages, (VALUES ('class='), ('href='), ('charset='), ('role')) a(name) WHERE contains(lower(html), a.name) GROUP BY 1)
    SELECT 'framework' AS kind, 'NUnit' AS name, n, CASE WHEN n >= 3 THEN 'High' ELSE 'Medium' END AS confidence FROM fw
    UNION ALL SELECT 'base-class', base_class, count(*), CASE WHEN count(*) >= 3 THEN 'High' ELSE 'Medium' END FROM types WHERE base_class IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'namespace', namespace, count(*), '-' FROM types WHERE namespace <> '' GROUP BY 2 UNION ALL SELECT 'locator-attribute', name, n, CASE WHEN n >= 10 THEN 'High' WHEN n >= 3 THEN 'Medium' ELSE 'Low' END FROM att""",
)
def c30(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    out = I.target_inventory(pages, typed_lines(spark, sf), ["doc_id"], "text", ATTRS)
    return out.where(F.col("kind").isin("framework", "base-class", "namespace", "locator-attribute"))


@query(
    "c41_call_graph_stats",
    """WITH e AS (SELECT o_orderpriority, o_custkey AS callee, o_orderstatus <> 'P' AS resolved, o_orderkey % 3 = 0 AS awaited, c_custkey IS NOT NULL AS src FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 20),
    c AS (SELECT o_orderpriority, callee, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT o_orderpriority, count(*) AS calls, count(*) FILTER (resolved) AS resolved, count(*) FILTER (resolved AND src) AS in_source, count(*) FILTER (awaited) AS awaited, count(DISTINCT callee) AS callees,
      round_even(count(*) FILTER (resolved) * 1.0::DOUBLE / count(*), 4)::DOUBLE AS resolved_ratio, round_even(count(*) FILTER (resolved AND src) * 1.0::DOUBLE / count(*), 4)::DOUBLE AS in_source_ratio,
      (SELECT max_by(callee, n * 1000000 + callee) FROM c WHERE c.o_orderpriority = e.o_orderpriority) AS top_callee, (SELECT max(n) FROM c WHERE c.o_orderpriority = e.o_orderpriority) AS top_fan_in FROM e GROUP BY 1""",
)
def c41(spark, sf):
    calls = table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_orderkey").alias("caller"), F.col("o_custkey").alias("callee"), (F.col("o_orderstatus") != "P").alias("resolved"), (F.col("o_orderkey") % 3 == 0).alias("awaited")
    )
    methods = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("symbol"))
    return I.call_graph_stats(calls, methods, ["o_orderpriority"])


LEAF = "sha256(octet_length(encode(p))::VARCHAR || ':' || p || ':0:')"


@query(
    "c41_index_digest",
    f"""WITH l AS (SELECT o_orderpriority, {LEAF} AS leaf FROM (SELECT o_orderpriority, o_orderkey || '>' || o_custkey AS p FROM orders))
    SELECT o_orderpriority, count(*) AS files, sha256(concat_ws(',', count(*)::VARCHAR, {", ".join(f"sum(('0x' || substr(leaf, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))})) AS digest FROM l GROUP BY 1""",
)
def c41b(spark, sf):
    return I.index_digest(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey", "o_custkey"])
