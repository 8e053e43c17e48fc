"""Configuration plans bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, table
from tidemark.plans import configs as C
from tidemark.session import spread

CUSTOMER_RULES_SQL = """r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'UiTargets' WHEN 1 THEN 'Methods' ELSE 'ParameterizedMethods' END AS section, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'k' || c_nationkey || '(' || '{a' || (c_custkey % 4) || '})' END AS key,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS target, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'Odd' ELSE 'TestId' END AS kind, CASE WHEN c_custkey % 13 = 0 THEN 'Nth' WHEN c_custkey % 17 = 0 THEN 'Last' END AS mode,
    CASE WHEN c_custkey % 2 = 0 THEN 1 END AS idx, CASE WHEN c_custkey % 4 = 0 THEN [] ELSE ['do {a' || (c_custkey % 5) || '} {result} {arg0}'] END AS st FROM customer)"""


@query(
    "c22_validate_rules",
    f"""WITH {CUSTOMER_RULES_SQL} SELECT section, c_custkey AS position, 'missing-key' AS violation FROM r WHERE key = ''
    UNION ALL SELECT section, c_custkey, 'missing-target' FROM r WHERE section = 'UiTargets' AND target = '' UNION ALL SELECT section, c_custkey, 'missing-kind' FROM r WHERE section = 'UiTargets' AND kind = ''
    UNION ALL SELECT section, c_custkey, 'unsupported-kind' FROM r WHERE section = 'UiTargets' AND kind = 'Odd' UNION ALL SELECT section, c_custkey, 'unknown-match' FROM r WHERE section = 'UiTargets' AND mode = 'Last'
    UNION ALL SELECT section, c_custkey, 'nth-without-index' FROM r WHERE section = 'UiTargets' AND mode = 'Nth' AND idx IS NULL
    UNION ALL SELECT section, c_custkey, 'no-statements' FROM r WHERE section <> 'UiTargets' AND key <> '' AND len(st) = 0 AND target = '' UNION ALL SELECT section, c_custkey, 'statements-and-target' FROM r WHERE section = 'ParameterizedMethods' AND len(st) > 0 AND target <> ''
    UNION ALL SELECT section, c_custkey, 'unknown-placeholder' FROM r WHERE section = 'ParameterizedMethods' AND len(st) > 0 AND (key = '' OR c_custkey % 4 <> c_custkey % 5)
    UNION ALL SELECT section, c_custkey, 'duplicate-key' FROM (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY c_custkey) AS rn FROM r WHERE key <> '') WHERE rn > 1""",
)
def c22(spark, sf):
    k = F.col("c_custkey")
    st = lambda c: c.cast("string")
    rules = table(spark, sf, "customer").select(
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'UiTargets' WHEN 1 THEN 'Methods' ELSE 'ParameterizedMethods' END").alias("section"), k.alias("ord"),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.concat(F.lit("k"), st(F.col("c_nationkey")), F.lit("({a"), st(k % 4), F.lit("})"))).alias("key"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("target"), F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit("Odd")).otherwise(F.lit("TestId")).alias("target_kind"),
        F.when(k % 13 == 0, F.lit("Nth")).when(k % 17 == 0, F.lit("Last")).alias("match_mode"), F.when(k % 2 == 0, 1).alias("idx"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("do {a"), st(k % 5), F.lit("} {result} {arg0}")))).alias("statements"),
    )
    return C.validate_rules(rules)


SHAPE = {"$": (("schemaVersion", "id", "tags", "source", "project", "qualityBudget"), ("seed",)), "$.project": (("files",), ("references",)), "$.qualityBudget": ((), ("todoMax",))}


@query(
    "c23_validate_contracts",
    """WITH e AS (SELECT event_id AS k, event_type, (props::JSON->>'k')::BIGINT AS n FROM events)
    SELECT k, 'SCHEMA_TYPE_INVALID' AS code, '$' AS detail FROM e WHERE k % 101 = 0
    UNION ALL SELECT k, 'SCHEMA_PROPERTY_UNKNOWN', '$.extra' FROM e WHERE k % 101 <> 0 AND k % 7 = 0 UNION ALL SELECT k, 'SCHEMA_PROPERTY_REQUIRED', '$.tags' FROM e WHERE k % 101 <> 0 AND k % 11 = 0
    UNION ALL SELECT k, 'SCHEMA_PROPERTY_UNKNOWN', '$.project.odd' FROM e WHERE k % 101 <> 0 AND k % 13 = 0 UNION ALL SELECT k, 'SCHEMA_TYPE_INVALID', '$.qualityBudget' FROM e WHERE k % 101 <> 0 AND k % 17 = 0
    UNION ALL SELECT k, 'SCHEMA_VERSION_UNSUPPORTED', '' FROM e WHERE k % 101 <> 0 AND k % 19 = 0 UNION ALL SELECT k, 'SCENARIO_ID_INVALID', '' FROM e WHERE k % 101 <> 0 AND k % 23 = 0
    UNION ALL SELECT k, 'QUALITY_BUDGET_NEGATIVE', '' FROM e WHERE k % 101 <> 0 AND k % 17 <> 0 AND n < 50 UNION ALL SELECT k, 'DUPLICATE_PROJECT_PATH', '' FROM e WHERE k % 101 <> 0 AND k % 29 = 0
    UNION ALL SELECT k, 'PROJECT_PATH_EMPTY', '' FROM e WHERE k % 101 <> 0 AND k % 31 = 0 UNION ALL SELECT k, 'PROJECT_PATH_ABSOLUTE', '' FROM e WHERE k % 101 <> 0 AND k % 37 = 0
    UNION ALL SELECT k, 'PROJECT_PATH_ESCAPES_SCENARIO', '' FROM e WHERE k % 101 <> 0 AND k % 41 = 0 UNION ALL SELECT k, 'MIGRATION_FILE_NOT_IN_PROJECT', event_type || '.cs' FROM e WHERE k % 101 <> 0 AND k % 3 = 0
    UNION ALL SELECT k, 'MIGRATION_FILES_MISSING', '' FROM e WHERE k % 101 <> 0 AND k % 43 = 0 AND k % 3 <> 0""",
)
def c23(spark, sf):
    e = spread(table(spark, sf, "events"), tasks_a_core=4)
    k = F.col("event_id")
    part = lambda cond, text: F.when(cond, F.lit(text)).otherwise(F.lit(""))
    files = F.concat(
        F.lit('["A.cs"'), part(k % 29 == 0, ',"a.CS"'), part(k % 31 == 0, ',"  "'), part(k % 37 == 0, ',"C:/x.cs"'), part(k % 41 == 0, ',"d/../../x.cs"'), F.lit(',"d/../y.cs"]')
    )
    migration = F.when(k % 3 == 0, F.concat(F.lit('["A.CS","'), F.col("event_type"), F.lit('.cs"]'))).when(k % 43 == 0, F.lit("[]")).otherwise(F.lit('["a.cs"]'))
    doc = F.concat(
        F.lit('{"schemaVersion":"'), F.when(k % 19 == 0, F.lit("scenario/v2")).otherwise(F.lit("scenario/v1")), F.lit('","id":"'), F.when(k % 23 == 0, F.lit("-Bad")).otherwise(F.concat(F.lit("ev-"), k.cast("string"))),
        F.lit('",'), F.when(k % 11 == 0, F.lit("")).otherwise(F.lit('"tags":["x"],')), part(k % 7 == 0, '"extra":1,'), F.lit('"source":{"migrationFiles":'), migration, F.lit('},"project":{"files":'), files,
        part(k % 13 == 0, ',"odd":2'), F.lit('},"qualityBudget":'), F.when(k % 17 == 0, F.lit("5")).otherwise(F.concat(F.lit('{"todoMax":'), (F.get_json_object("props", "$.k").cast("bigint") - 50).cast("string"), F.lit("}"))), F.lit("}"),
    )
    contracts = e.select(k.alias("k"), F.when(k % 101 == 0, F.lit("[1]")).otherwise(doc).alias("doc"))
    return C.validate_contracts(contracts, "doc", ["k"], SHAPE)


@query(
    "c24_merge_layers",
    """SELECT o_orderpriority AS section, 'k' || (o_custkey % 50) AS key, min(o_orderkey) AS position, max(o_orderkey) AS ord, max_by(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_custkey % 50 <> 7 GROUP BY 1, 2""",
)
def c24(spark, sf):
    key = F.when(F.col("o_custkey") % 50 == 7, F.lit("  ")).otherwise(F.concat(F.lit("k"), (F.col("o_custkey") % 50).cast("string")))
    rules = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("section"), key.alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("value"))
    return C.merge_layers(rules)


@query(
    "c24_merge_scalars",
    """SELECT o_custkey, max_by(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS name, max_by(o_totalprice > 200000, o_orderkey) FILTER (o_orderkey % 4 = 0) AS flag FROM orders GROUP BY 1""",
)
def c24b(spark, sf):
    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select("o_custkey", k.alias("layer"), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("name"), F.when(k % 4 == 0, F.col("o_totalprice") > 200000).alias("flag"))
    return C.merge_scalars(s, ["o_custkey"], "layer", ["name", "flag"])


@query(
    "c24_merge_lists",
    """SELECT o_custkey, trim(v) AS value, min(o_orderkey) AS position FROM (SELECT o_custkey, o_orderkey, ' ' || o_orderpriority AS v FROM orders UNION ALL SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderstatus || ' ' END FROM orders)
    WHERE trim(v) <> '' GROUP BY 1, 2""",
)
def c24c(spark, sf):
    k = F.col("o_orderkey")
    listed = F.array(F.concat(F.lit(" "), F.col("o_orderpriority")), F.when(k % 3 == 0, F.lit("  ")).otherwise(F.concat("o_orderstatus", F.lit(" "))))
    values = table(spark, sf, "orders").select("o_custkey", k, F.explode(listed).alias("value"))
    return C.merge_lists(values, ["o_custkey"], "value", "o_orderkey")


@query(
    "c25_delta_safety",
    """WITH d AS (SELECT 'delta-' || o_orderkey AS delta_file, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Dangerous' WHEN 2 THEN 'deprecated' WHEN 3 THEN ' ' ELSE 'reviewed' END AS trust FROM orders)
    SELECT delta_file, 'dangerous-delta-safety:assertionSuppressionAllowed' AS finding FROM d WHERE k % 7 = 0 UNION ALL SELECT delta_file, 'dangerous-delta-safety:overSuppressionAllowed' FROM d WHERE k % 2 = 0
    UNION ALL SELECT delta_file, 'dangerous-delta-safety:autoPromotionAllowed' FROM d WHERE k % 11 = 0 UNION ALL SELECT delta_file, 'trust-missing' FROM d WHERE trust IS NULL OR trust = ' '
    UNION ALL SELECT delta_file, 'unsafe-delta-trust' FROM d WHERE lower(trust) IN ('dangerous', 'deprecated')""",
)
def c25c(spark, sf):
    k = F.col("o_orderkey")
    trust = F.when(k % 5 == 1, "Dangerous").when(k % 5 == 2, "deprecated").when(k % 5 == 3, " ").when(k % 5 == 4, "reviewed")
    switches = F.create_map(F.lit("assertionSuppressionAllowed"), k % 7 == 0, F.lit("overSuppressionAllowed"), k % 2 == 0, F.lit("other"), F.lit(True))
    switches = F.when(k % 11 == 0, F.map_concat(switches, F.create_map(F.lit("autoPromotionAllowed"), F.lit(True)))).otherwise(switches)
    return C.delta_safety(table(spark, sf, "orders").select(F.concat(F.lit("delta-"), k.cast("string")).alias("delta_file"), trust.alias("trust"), switches.alias("safety")))


@query(
    "c25_merge_deltas",
    """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'SuppressedMethodPatterns' ELSE 'Methods' END AS section, o_custkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'Assert.' || o_orderstatus ELSE o_orderstatus END AS canon, o_orderkey % 20 = 1 AS base FROM orders),
    d AS (SELECT *, section = 'SuppressedMethodPatterns' AND starts_with(canon, 'Assert') AS danger, CASE WHEN base THEN 0 ELSE 100000000 END + o_orderkey AS o FROM e),
    win AS (SELECT section, k, min_by(canon, o) AS c, min(o) AS o FROM d WHERE NOT danger GROUP BY 1, 2)
    SELECT o_orderkey, CASE WHEN danger THEN 'dangerous' WHEN win.o = d.o THEN 'applied' WHEN c = canon THEN 'duplicate' ELSE 'conflict' END AS status FROM d LEFT JOIN win USING (section, k) WHERE NOT base""",
)
def c25(spark, sf):
    return C.merge_deltas(delta_entries(spark, sf)).select(F.col("ord").alias("o_orderkey"), "status")


def delta_entries(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, F.lit("KEY")).otherwise(F.lit("key")), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select(
        F.when(k % 4 == 0, F.lit("SuppressedMethodPatterns")).otherwise(F.lit("Methods")).alias("section"), name.alias("key"),
        F.when(k % 6 == 0, F.concat(F.lit("Assert."), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus")).alias("canon"), k.alias("ord"), (k % 20 == 1).alias("is_base"), F.lit("d").alias("delta_file"),
    )


@query(
    "c25_validate_merge",
    """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'SuppressedMethodPatterns' ELSE 'Methods' END AS section, o_custkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'Assert.' || o_orderstatus ELSE o_orderstatus END AS canon FROM orders),
    f AS (SELECT *, first_value(canon) OVER (PARTITION BY section, k ORDER BY o_orderkey) AS c FROM e)
    SELECT 'candidate-internal-conflict' AS problem, section, count(*) AS n FROM f WHERE c <> canon GROUP BY ALL UNION ALL SELECT 'assertion-suppression', section, count(*) FROM e WHERE section = 'SuppressedMethodPatterns' AND starts_with(canon, 'Assert') GROUP BY ALL
    UNION ALL SELECT 'candidate-removed-base-entry', 'Gone', 1""",
)
def c25b(spark, sf):
    cand = delta_entries(spark, sf)
    base = cand.select("section").union(cand.select(F.lit("Gone").alias("section")).distinct())
    return C.validate_merge(base, cand).groupBy("problem", "section").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c26_apply_policy",
    """WITH r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Methods' WHEN 1 THEN 'ParameterizedMethods' ELSE 'UiTargets' END AS section, p_partkey % 2 = 0 AS review, CASE p_partkey % 4 WHEN 0 THEN 'conservative' WHEN 1 THEN 'aggressive' ELSE 'balanced' END AS policy FROM part)
    SELECT p_partkey, CASE WHEN section <> 'UiTargets' AND policy = 'conservative' THEN true WHEN section <> 'UiTargets' AND policy = 'aggressive' THEN false ELSE review END AS requires_review,
      CASE WHEN section <> 'UiTargets' AND policy <> 'balanced' THEN 'GenerationPolicy=' || policy END AS policy_note FROM r""",
)
def c26(spark, sf):
    k = F.col("p_partkey")
    rules = table(spark, sf, "part").select(
        k, F.expr("CASE p_size % 3 WHEN 0 THEN 'Methods' WHEN 1 THEN 'ParameterizedMethods' ELSE 'UiTargets' END").alias("section"), (k % 2 == 0).alias("requires_review"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN ' Conservative' WHEN 1 THEN 'AGGRESSIVE' WHEN 2 THEN 'odd' ELSE 'balanced' END").alias("policy"),
    )
    return C.apply_policy(rules, F.col("policy")).select("p_partkey", "requires_review", "policy_note")
