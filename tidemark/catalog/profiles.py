"""Profile plans bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.aggregating import LANG_WEIGHTS
from tidemark.catalog.predicates import EXPRESSION_SQL, expression_lines
from tidemark.catalog.registry import query, table
from tidemark.functions.predicates import signal_counts
from tidemark.plans import portfolio, profiles as P

# An item is one rule on its whole text and, unless it is a single identifier, one on some of its words.
RX = lambda c: rf"regexp_replace({c}, '([\\.\[\]{{}}()*+?^$|#\-])', '\\\1', 'g')"
PROFILE_SQL = EXPRESSION_SQL + rf""",
items AS (SELECT item_id, 'layer' || (item_id % 4) AS layer, CASE item_id % 3 WHEN 0 THEN 'UiTargets' WHEN 1 THEN 'TargetKnownIdentifiers' ELSE 'ParameterizedMethods' END AS section, string_split(text, ' ') AS w, text FROM benchmark),
rules AS (SELECT 'full-' || item_id AS rule_id, layer, section, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_extract(w[4], '\w+', 0) ELSE array_to_string(w[1:len(w) - 2], ' ') || ' {{x}} ' || w[-1] END AS key FROM items
   UNION ALL SELECT 'part-' || item_id, layer, section, CASE item_id % 3 WHEN 0 THEN array_to_string(w[1:(2 + item_id % 7)], ' ') ELSE w[2] || ' ' || w[3] || ' {{x}} ' || w[4] || ' ' END FROM items WHERE item_id % 3 <> 1),
hit AS (
  SELECT rule_id, doc_id, ((length(text) - length(replace(text, key, ''))) // length(key))::BIGINT AS hits FROM documents, rules WHERE section = 'UiTargets' AND contains(text, key)
  UNION ALL SELECT rule_id, doc_id, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda t: t = key)) FROM documents, rules WHERE section = 'TargetKnownIdentifiers' AND contains(text, key)
  UNION ALL SELECT rule_id, doc_id, len(regexp_extract_all(text, '(?s)' || {RX("string_split(key, '{x}')[1]")} || '.+?' || {RX("string_split(key, '{x}')[2]")})) FROM documents, rules WHERE section = 'ParameterizedMethods' AND contains(text, string_split(key, '{{x}}')[1])),
used AS (SELECT rule_id, sum(hits)::BIGINT AS hits FROM hit WHERE hits > 0 GROUP BY 1),
layers AS (SELECT layer, count(*) AS rules, count(used.rule_id) AS matched, coalesce(sum(hits), 0)::BIGINT AS hits FROM rules LEFT JOIN used USING (rule_id) GROUP BY layer),
sig AS (SELECT expression, count(*) AS n FROM expr WHERE split_part(expression, '.', 1) NOT IN ('this','base','Task','DateTime','TimeSpan','String','Math','Guid','System','Console') AND NOT contains(expression, 'Should') AND NOT contains(expression, 'Assert') GROUP BY 1)"""


@query(
    "c03_profile_match",
    f"""WITH {PROFILE_SQL} SELECT 'layer' AS part, layer AS key, rules AS n, round_even(100.0::DOUBLE * matched / rules, 1)::DOUBLE AS score, hits FROM layers
    UNION ALL SELECT 'gap', expression, n, 0, 0 FROM sig""",
)
def c03(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("w", F.split("text", " ", -1))
    k = F.col("item_id")
    w = lambda i: F.get("w", F.lit(i))
    full = (
        F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.regexp_extract(w(3), r"\w+", 0))
        .otherwise(F.concat(F.array_join(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), " "), F.lit(" {x} "), F.element_at("w", -1)))
    )
    part = F.when(k % 3 == 0, F.array_join(F.slice("w", F.lit(1), (k % 7 + 2).cast("int")), " ")).otherwise(F.concat(w(1), F.lit(" "), w(2), F.lit(" {x} "), w(3), F.lit(" ")))
    rule = lambda items, kind, key: items.select(
        F.concat(F.lit(kind + "-"), k.cast("string")).alias("rule_id"), F.concat(F.lit("layer"), (k % 4).cast("string")).alias("layer"),
        F.expr("CASE item_id % 3 WHEN 0 THEN 'UiTargets' WHEN 1 THEN 'TargetKnownIdentifiers' ELSE 'ParameterizedMethods' END").alias("section"), key.alias("key"),
    )
    rules = rule(b, "full", full).unionAll(rule(b.where(k % 3 != 1), "part", part))
    m = P.profile_match(rules, table(spark, sf, "documents"), expression_lines(spark, sf), "doc_id", "text")
    layers = m["layers"].select(F.lit("layer").alias("part"), F.col("layer").alias("key"), F.col("rules").alias("n"), "score", "hits")
    gaps = m["gaps"].select(F.lit("gap").alias("part"), F.col("expression").alias("key"), "n", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("hits"))
    return layers.unionByName(gaps)


CATALOGUE = (
    ("en-nunit", "en", "nunit", "nunit", ["data-tid"]), ("en-xunit", "en", "xunit", "xunit", []), ("fr-nunit", "fr", "nunit", "nunit", ["data-tid", "starter"]), ("de-any", "de", "unknown", "xunit", ["starter"]), ("es-nunit", "es", "nunit", "nunit", []),
)
CATALOGUE_SQL = "(VALUES " + ", ".join(f"('{i}', '{a}', '{b}', '{c}', {'true' if 'data-tid' in t else 'false'})" for i, a, b, c, t in CATALOGUE) + ") p(id, language, framework, target_framework, tid)"
COUNTED = {"data_tid": r"\b[Tt]he\b", "data_testid": r"\bder\b", "pom": "tion", "helper": "keit", "nunit": "heron", "xunit": r"\bthat\b"}


@query(
    "c27_recommend_profiles",
    """WITH s AS (SELECT source, sum(len(regexp_extract_all(text, '\\b[Tt]he\\b')))::BIGINT AS data_tid, sum(len(regexp_extract_all(text, '\\bder\\b')))::BIGINT AS data_testid, count(*) FILTER (len(regexp_extract_all(text, 'tion')) > 40) AS pom_files,
       count(*) FILTER (len(regexp_extract_all(text, 'keit')) > 20) AS helper_files, sum(len(regexp_extract_all(text, 'heron'))) AS nunit, sum(len(regexp_extract_all(text, '\\bthat\\b'))) AS xunit, min_by(lang, n_chars * 1000000 + doc_id) AS language FROM documents GROUP BY 1),
    f AS (SELECT *, CASE WHEN nunit < 2 THEN 'unknown' WHEN nunit * 8 > xunit THEN 'nunit' ELSE 'xunit' END AS framework, CASE WHEN length(source) = 4 THEN 'nunit' ELSE '' END AS target, CASE WHEN helper_files > 1 THEN 'low' ELSE 'high' END AS confidence FROM s),
    z AS (SELECT source, id, least(greatest(100 - CASE WHEN f.framework = 'unknown' THEN 8 WHEN p.framework <> f.framework THEN 30 ELSE 0 END - CASE WHEN target <> '' AND target <> target_framework THEN 20 ELSE 0 END
       + CASE WHEN data_tid > data_testid THEN CASE WHEN tid THEN 8 ELSE -6 END ELSE CASE WHEN tid THEN -10 ELSE 0 END END - CASE WHEN pom_files >= 3 THEN 8 ELSE 0 END - CASE WHEN helper_files >= 3 THEN 8 ELSE 0 END - CASE WHEN confidence = 'low' THEN 8 ELSE 0 END, 0), 100)::BIGINT AS score FROM f JOIN """
    + CATALOGUE_SQL
    + """ ON p.language = f.language UNION ALL SELECT source, NULL, 55 FROM f) SELECT source, id AS profile_id, score, CASE WHEN score >= 85 THEN 'strong' WHEN score >= 65 THEN 'usable' WHEN score >= 40 THEN 'review-required' ELSE 'poor' END AS level FROM z""",
)
def c27(spark, sf):
    docs = signal_counts(table(spark, sf, "documents"), COUNTED)
    s = docs.groupBy("source").agg(
        F.sum("data_tid").alias("data_tid"), F.sum("data_testid").alias("data_testid"), F.count_if(F.col("pom") > 40).alias("pom_files"), F.count_if(F.col("helper") > 20).alias("helper_files"),
        F.sum("nunit").alias("nunit"), F.sum("xunit").alias("xunit"), F.min_by("lang", F.struct("n_chars", "doc_id")).alias("language"),
    )
    signals = s.withColumns(
        {
            "framework": F.when(F.col("nunit") < 2, F.lit("unknown")).when(F.col("nunit") * 8 > F.col("xunit"), F.lit("nunit")).otherwise(F.lit("xunit")),
            "target": F.when(F.length("source") == 4, F.lit("nunit")).otherwise(F.lit("")), "confidence": F.when(F.col("helper_files") > 1, F.lit("low")).otherwise(F.lit("high")),
        }
    )
    cat = spark.createDataFrame(list(CATALOGUE), "id string, language string, framework string, target_framework string, tags array<string>")
    out = P.recommend_profiles(signals, cat)
    return out.select("source", "profile_id", F.col("score").cast("bigint").alias("score"), "level")


SUPPORT = {"en": "production-ready", "fr": "preview-only", "de": "preview-only"}


@query(
    "c28_framework_portfolio",
    "WITH w(label, needle, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in LANG_WEIGHTS)
    + """), s AS (SELECT source || '/' || lang AS project, label, sum(weight)::BIGINT AS score FROM documents, w WHERE contains(text, needle) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, label) AS rn, coalesce(lead(score) OVER (PARTITION BY project ORDER BY score DESC, label), 0) AS runner_up FROM s),
    d AS (SELECT project, CASE WHEN score < 30 THEN 'unknown' WHEN score - runner_up < 12 THEN 'ambiguous' ELSE label END AS framework, score FROM r WHERE rn = 1),
    e AS (SELECT p.project, coalesce(framework, 'unknown') AS framework, score FROM (SELECT DISTINCT source || '/' || lang AS project FROM documents) p LEFT JOIN d USING (project))
    SELECT framework, CASE framework WHEN 'en' THEN 'production-ready' WHEN 'fr' THEN 'preview-only' WHEN 'de' THEN 'preview-only' ELSE 'manual' END AS readiness, count(*) AS projects, max(score) AS top_score FROM e GROUP BY 1, 2""",
)
def c28(spark, sf):
    project = F.concat("source", F.lit("/"), F.col("lang")).alias("project")
    return portfolio.framework_portfolio(table(spark, sf, "documents").select(project, "text"), ["project"], LANG_WEIGHTS, SUPPORT)


