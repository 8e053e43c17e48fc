"""Evidence plans bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.joining import MATCH_SQL, evidence_sides
from tidemark.catalog.predicates import EXPRESSION_SQL, LOCATOR_SQL, SELECTOR_SQL, expression_lines
from tidemark.catalog.registry import code_lines, query, table
from tidemark.operators.facts import extract_expressions, extract_locators, extract_selectors
from tidemark.plans import evidence as E

NM = lambda x: f"nullif(replace(lower(trim({x}, '\"''')), 'xpath=', ''), '')"


@query(
    "c04_selector_evidence",
    f"""{MATCH_SQL}, t AS (SELECT k.driver, k.row_ord, k.source_expr, s.ord IS NOT NULL AS hs, c.ord IS NOT NULL AS hc, g.ord IS NOT NULL AS hg, s.source_expr AS se, s.value AS sv, c.source_expr AS ce, c.target AS ct, g.target AS gt, g.locator AS gl,
        CASE WHEN c.ord % 11 = 0 THEN 1 ELSE 0 END AS raw, CASE WHEN c.ord % 13 = 0 THEN 1 ELSE 0 END AS nth FROM kept k LEFT JOIN src s ON s.ord = k.src_ord LEFT JOIN cfg c ON c.ord = k.cfg_ord LEFT JOIN gen g ON g.ord = k.gen_ord),
    u AS (SELECT *, raw + nth > 0 AS unsafe, NOT hs AS inferred, coalesce({NM('se')} = {NM('ce')} OR {NM('sv')} = {NM('ct')}, false) AS sc, coalesce({NM('gt')} = {NM('ct')} OR contains(lower(gl), lower(ct)), false) AS cg FROM t),
    z AS (SELECT *, least(greatest(CASE WHEN hs THEN 35 ELSE 0 END + CASE WHEN hc THEN 30 ELSE 0 END + CASE WHEN hg THEN 25 ELSE 0 END + CASE WHEN hs AND hc AND sc THEN 10 ELSE 0 END + CASE WHEN hc AND hg AND cg THEN 10 ELSE 0 END
       - CASE WHEN unsafe THEN 20 ELSE 0 END - CASE WHEN inferred THEN 15 ELSE 0 END, 0), 100)::BIGINT AS score FROM u)
    SELECT driver, row_ord, source_expr, score, inferred, concat_ws(',', CASE WHEN raw = 1 THEN 'raw-target-kind' END, CASE WHEN nth = 1 THEN 'nth-match' END) AS unsafe,
      CASE WHEN NOT hs AND (hc OR hg) THEN 'cannot-prove' WHEN score >= 85 THEN 'high' WHEN score >= 65 THEN 'medium' WHEN score >= 40 THEN 'low' ELSE 'cannot-prove' END AS confidence FROM z""",
)
def c04(spark, sf):
    out = E.selector_evidence(*evidence_sides(spark, sf))
    return out.select("driver", F.col("ord").alias("row_ord"), "source_expr", F.col("score").cast("bigint").alias("score"), "inferred", F.array_join("unsafe", ",").alias("unsafe"), "confidence")


PACK_KINDS_SQL = "CASE WHEN page_id % 5 = 0 THEN 'selector-evidence' WHEN page_id % 5 = 1 THEN 'migration-report' ELSE 'artifact' END"
PACK_SQL = f"""ev AS (SELECT page_id AS ord, url AS path, {PACK_KINDS_SQL} AS kind, html AS text FROM pages),
   cfg AS (SELECT n_nationkey AS ord, '/' || n_name AS source, 'Ad' AS target FROM nation UNION ALL SELECT r_regionkey + 100, '/the', 'AD' FROM region),
   z AS (SELECT ord, path, kind, text, list_distinct(regexp_extract_all(text, 'href="([^"]*)"', 1)) AS s0, list_distinct(regexp_extract_all(text, 'class="([^"]*)"', 1)) AS t0 FROM ev WHERE kind IN ('selector-evidence', 'migration-report')),
   o AS (SELECT ord, path, kind, text, regexp_extract_all(text, 'href="([^"]*)"', 1) AS sa, regexp_extract_all(text, 'class="([^"]*)"', 1) AS ta FROM ev WHERE kind IN ('selector-evidence', 'migration-report')),
   y AS (SELECT ord, path, kind, text, list_filter(sa, lambda x, i: list_position(sa, x) = i) AS s, list_filter(ta, lambda x, i: list_position(ta, x) = i) AS t FROM o),
   x AS (SELECT ord, path, kind, text, s, t, unnest(range(0, greatest(len(s), len(t)))) AS i FROM y WHERE greatest(len(s), len(t)) > 0),
   f AS (SELECT 1 AS tier, ord, i::BIGINT AS pos, coalesce(s[i + 1], 'artifact:' || path) AS source, coalesce(t[i + 1], '<review target locator>') AS target, kind, contains(lower(text), 'heron') AS r FROM x),
   a AS (SELECT 0 AS tier, ord, 0 AS pos, source, target, 'adapter-config' AS kind, 85 AS score, 'review-required' AS safety FROM cfg UNION ALL SELECT tier, ord, pos, source, target, kind, CASE WHEN r OR contains(lower(source), 'heron') OR contains(lower(target), 'heron') THEN 45 ELSE 70 END,
     CASE WHEN r OR contains(lower(source), 'heron') OR contains(lower(target), 'heron') THEN 'manual-only' ELSE 'review-required' END FROM f WHERE trim(source) <> '' AND trim(target) <> ''),
   m AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target) ORDER BY tier, ord, pos) AS rn FROM a) WHERE rn = 1)"""


def pack(spark, sf):
    ev = table(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("path"), F.expr(PACK_KINDS_SQL).alias("kind"), F.col("html").alias("text"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("ord"), F.concat(F.lit("/"), F.col("n_name")).alias("source"), F.lit("Ad").alias("target"))
    r = table(spark, sf, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("ord"), F.lit("/the").alias("source"), F.lit("AD").alias("target"))
    return ev, n.unionByName(r)


PATTERNS = {"kinds": ("selector-evidence", "migration-report"), "source_pattern": r'href="([^"]*)"', "target_pattern": r'class="([^"]*)"', "unproven": ("heron",)}


@query("c31_learned_mappings", f"WITH {PACK_SQL} SELECT tier, ord, pos::BIGINT AS pos, source, target, kind, score::BIGINT AS score, safety FROM m")
def c31(spark, sf):
    ev, cfg = pack(spark, sf)
    out = E.learned_mappings(ev, cfg, **PATTERNS)
    return out.withColumns({"pos": F.col("pos").cast("bigint"), "score": F.col("score").cast("bigint")})


@query(
    "c31_learn_pack",
    f"""WITH {PACK_SQL}, p AS (SELECT kind, value, count(*) AS n FROM (SELECT regexp_extract(q, '(\\w+)="', 1) AS kind, regexp_extract(q, '="([^"]+)"', 1) AS value FROM (SELECT unnest(regexp_extract_all(text, '(\\w+)="([^"]+)"')) AS q FROM ev WHERE kind = 'selector-evidence')) GROUP BY 1, 2),
    pk AS (SELECT min(kind) AS kind, min(value) AS value, sum(n)::BIGINT AS n FROM p GROUP BY lower(kind), lower(value))
    SELECT 'candidate' AS part, source AS key, target, score::BIGINT AS score FROM (SELECT * FROM m WHERE safety <> 'manual-only')
    UNION ALL SELECT 'candidate', kind, value, 75 FROM (SELECT * FROM pk WHERE contains(lower(value), 'utf'))
    UNION ALL SELECT 'finding', 'manual-selector-review', '', 0 UNION ALL SELECT 'finding', 'missing-verify-evidence', '', 0""",
)
def c31b(spark, sf):
    ev, cfg = pack(spark, sf)
    helpers = spark.createDataFrame([], "method string, classification string, score int")
    poms = E.pom_patterns(ev, r'(\w+)="([^"]+)"', ("selector-evidence",), ("utf",))
    out = E.learn_pack(ev, cfg, helpers, r'(\w+)="([^"]+)"', ("selector-evidence",), **PATTERNS)
    cand = E.reusable_candidates(out["mappings"], helpers, poms)
    none = F.lit("")
    return cand.select(F.lit("candidate").alias("part"), "key", "target", F.col("score").cast("bigint").alias("score")).unionByName(
        out["findings"].select(F.lit("finding").alias("part"), F.col("finding").alias("key"), none.alias("target"), F.lit(0).cast("bigint").alias("score"))
    )


@query(
    "c32_author_config",
    """WITH m AS (SELECT DISTINCT p_name AS key FROM part WHERE p_size < 3), u AS (SELECT p_name AS key, count(*) AS n FROM part WHERE p_name NOT IN (SELECT key FROM m) GROUP BY 1), h AS (SELECT p_name || '.' || p_type AS key, count(*) AS n FROM part WHERE p_name || '.' || p_type NOT IN (SELECT key FROM m) GROUP BY 1)
    SELECT 1 AS kind_ord, 'UiTargets' AS area, key, n, 'review-required' AS safety FROM u UNION ALL SELECT 2, 'ParameterizedMethods', key, n, 'manual-only' FROM h""",
)
def c32(spark, sf):
    p = table(spark, sf, "part")
    mapped = p.where("p_size < 3").select(F.col("p_name").alias("key")).distinct()
    return E.author_config(p.select(F.col("p_name").alias("key")), p.select(F.concat("p_name", F.lit("."), "p_type").alias("key")), mapped, F.lit(False))


@query(
    "c40_pom_index",
    f"""WITH {SELECTOR_SQL}, {LOCATOR_SQL[LOCATOR_SQL.index('loc_raw AS'):]}, {EXPRESSION_SQL[EXPRESSION_SQL.index('expr AS'):]},
    s AS (SELECT CASE WHEN assigned <> '' THEN assigned ELSE 'selector:' || kind || ':' || value END AS expression, kind, value FROM selectors)
    SELECT expression, kind AS selector_kind, value AS selector, 'SourcePom' AS origin, CASE WHEN starts_with(expression, 'selector:') THEN 'low' ELSE 'high' END AS confidence, count(*) AS n FROM s GROUP BY 1, 2, 3
    UNION ALL SELECT locator, locator_kind, target, 'TargetPom', CASE WHEN locator_kind = 'GetByTestId' THEN 'medium' ELSE 'low' END, count(*) FROM locators GROUP BY 1, 2, 3
    UNION ALL SELECT expression, 'TestId', regexp_extract(expression, '[^.]*$', 0), 'InferredUsage', 'low', count(*) FROM expr WHERE split_part(expression, '.', 1) NOT IN ('this','base','Task','DateTime','TimeSpan','String','Math','Guid','System','Console')
       AND NOT contains(expression, 'Should') AND NOT contains(expression, 'Assert') AND expression NOT IN (SELECT expression FROM s) GROUP BY 1""",
)
def c40(spark, sf):
    code = code_lines(spark, sf)
    return E.pom_index(extract_selectors(code), extract_locators(code), extract_expressions(expression_lines(spark, sf)))
