"""Scalar functions X1-X25 bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import CODE_SQL, LINES_SQL, code_lines, doc_lines, query, sql_trim, table
from tidemark.functions import hashing, paths, text as X
from tidemark.functions.predicates import normalize_kind
from tidemark.operators.evidence import generated_evidence

T = sql_trim
GUID_SQL = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
ISO_SQL = r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\b"


def norm_sql(expr: str) -> str:
    v = T(f"replace({expr}, chr(92), '/')")
    v = f"regexp_replace({v}, '(?i)/srv/work', '<ROOT>', 'g')"
    v = f"regexp_replace({v}, '(?i)/tmp', '<TEMP>', 'g')"
    v = f"regexp_replace({v}, '{GUID_SQL}', '<GUID>', 'g')"
    v = f"regexp_replace({v}, '{ISO_SQL}', '<TIMESTAMP>', 'g')"
    return T(f"regexp_replace({v}, '\\s+', ' ', 'g')")


NOISY_SQL = r"('\SRV\work\' || source || '  ' || text || ' /tmp/x ' || regexp_replace(md5(doc_id::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || ' at 2024-01-02T03:04:0' || (doc_id % 10) || '.5Z ')"


def noisy():
    guid = F.regexp_replace(F.md5(F.col("doc_id").cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(
        F.lit("\\SRV\\work\\"), F.col("source"), F.lit("  "), F.col("text"), F.lit(" /tmp/x "), guid,
        F.lit(" at 2024-01-02T03:04:0"), (F.col("doc_id") % 10).cast("string"), F.lit(".5Z "),
    )


@query("x01_normalize_text", f"SELECT doc_id, {norm_sql(NOISY_SQL)} AS norm FROM documents")
def x01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(noisy(), ["/srv/work"]).alias("norm"))


@query(
    "x02_normalize_set",
    f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, '. '), lambda v: {norm_sql('v')}),
          lambda v: length(v) > 0))), '|') AS items FROM conversations""",
)
def x02(spark, sf):
    conv = table(spark, sf, "conversations").withColumn("arr", F.split("text", "\\. ", -1))
    return conv.select("conv_id", "turn", F.array_join(X.normalize_set("arr", ["/srv/work"]), "|").alias("items"))


SRC_SQL = r"""(replace(replace(text, '. ', '.   // line 12' || chr(10) || '  '), ', ', ' 2024-05-06T07:08:09Z;' || chr(13) || chr(10) || '// note' || chr(10)))"""


def annotated():
    v = F.replace(F.col("text"), F.lit(". "), F.lit(".   // line 12\n  "))
    return F.replace(v, F.lit(", "), F.lit(" 2024-05-06T07:08:09Z;\r\n// note\n"))


@query(
    "x03_normalize_source",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_transform(
          string_split(replace(replace(src, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda v: {T('v')}),
          lambda v: length(v) > 0 AND NOT starts_with(v, '//')),
          lambda v: regexp_replace(regexp_replace(rtrim(regexp_replace(v, '(?i)\\s*//\\s*line\\s+\\d+\\s*$', '', 'g')), '{ISO_SQL}', '<TIMESTAMP>', 'g'), '{GUID_SQL}', '<GUID>', 'g')),
          lambda v: length(v) > 0), chr(10)) AS norm FROM (SELECT doc_id, {SRC_SQL} AS src FROM documents)""",
)
def x03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_source(annotated()).alias("norm"))


@query(
    "x04_residual_message",
    rf"""WITH {CODE_SQL} SELECT doc_id, line_no::BIGINT AS line_no, lower({T(r"regexp_replace(regexp_replace(regexp_replace(line || ' At  LINE ' || line_no, '\[([A-Z]+)-SOURCE-LINE:\d+\]', '[\1-SOURCE-LINE:*]', 'g'), '(?i)\bat line \d+\b', 'at line *', 'g'), '\s+', ' ', 'g')")}) AS norm FROM code""",
)
def x04(spark, sf):
    lines = code_lines(spark, sf)
    msg = F.concat("line", F.lit(" At  LINE "), F.col("line_no").cast("string"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), X.residual_message(msg).alias("norm"))


HOME_SQL = r"('C:\Users\' || split_part(url, '/', 3) || '\a.cs ' || url || ' /home/' || split_part(url, '/', 4) || '/x and \users\me\y ' || html)"


def homes():
    part = lambda i: F.element_at(F.split("url", "/", -1), i)
    return F.concat(F.lit("C:\\Users\\"), part(3), F.lit("\\a.cs "), F.col("url"), F.lit(" /home/"), part(4), F.lit("/x and \\users\\me\\y "), F.col("html"))


@query(
    "x05_redact_paths",
    rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace({HOME_SQL}, '(?i)[A-Za-z]:\\Users\\[^\\]+', '<USER_HOME>', 'g'),
         '(?i)[/\\]home[/\\][^/\\]+', '<USER_HOME>', 'g'), '(?i)[/\\]Users[/\\][^/\\]+', '<USER_HOME>', 'g') AS redacted FROM pages""",
)
def x05(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.redact_paths(homes()).alias("redacted"))


STMT_SQL = """('open("' || url || '", ''' || url || '''); k = "' || md5(html) || '"; ' || html)"""


@query(
    "x06_redact_urls_secrets",
    rf"""WITH s AS (SELECT page_id, url, {STMT_SQL} AS stmt FROM pages),
    u AS (SELECT *, regexp_replace(stmt, '(?i)(["''])https?://[^"''\s]+["'']', '\1<redacted-url>\1', 'g') AS no_urls FROM s)
    SELECT page_id, regexp_replace(url, '(?i)^(https?:)//[^/]+(.*)$', '\1://<redacted-host>\2') AS masked_url,
      sha256(regexp_replace(no_urls, '(["''])[a-fA-F0-9]{{32,}}["'']', '\1<redacted-secret>\1', 'g')) AS stmt_sha,
      (len(regexp_extract_all(stmt, '(?i)(["''])https?://[^"''\s]+["'']')) + len(regexp_extract_all(no_urls, '(["''])[a-fA-F0-9]{{32,}}["'']')))::BIGINT AS redactions FROM u""",
)
def x06(spark, sf):
    stmt = F.concat(
        F.lit('open("'), F.col("url"), F.lit("\", '"), F.col("url"), F.lit("'); k = \""), F.md5("html"), F.lit('"; '), F.col("html")
    )
    pages = table(spark, sf, "pages").withColumn("stmt", stmt)
    return pages.select(
        "page_id", X.redact_url("url").alias("masked_url"), F.sha2(X.redact_secrets("stmt"), 256).alias("stmt_sha"),
        X.redaction_count("stmt").cast("bigint").alias("redactions"),
    )


@query(
    "x07_safe_path",
    r"""SELECT page_id,
      CASE WHEN starts_with('/srv/' || url, '/srv/https:/') THEN rtrim(substr('/srv/' || url, 13), '/')
           ELSE regexp_extract(rtrim('/srv/' || url, '/'), '[^/]*$', 0) END AS unix_rel,
      CASE WHEN starts_with(lower(replace('C:\Src\' || url, '/', '\')), 'c:\src\http:\') THEN rtrim(substr(replace('C:\Src\' || url, '/', '\'), 14), '\')
           ELSE regexp_extract(rtrim(replace('C:\Src\' || url, '\', '/'), '/'), '[^/]*$', 0) END AS win_rel FROM pages""",
)
def x07(spark, sf):
    unix, win = F.concat(F.lit("/srv/"), F.col("url")), F.concat(F.lit("C:\\Src\\"), F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", paths.safe_path(unix, "/srv/https:").alias("unix_rel"), paths.safe_path(win, "c:/src/http:").alias("win_rel")
    )


@query(
    "x08_short_path",
    """SELECT page_id, CASE WHEN len(p) <= 3 THEN url ELSE array_to_string(p[-3:], '/') END AS short FROM
       (SELECT page_id, url, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)""",
)
def x08(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.short_path("url").alias("short"))


@query(
    "x09_common_root",
    r"""WITH p AS (SELECT split_part(url, '/', 4) AS lang, regexp_replace(url, '/?[^/]*$', '') AS dir FROM pages
          UNION ALL SELECT 'host:' || split_part(url, '/', 3), regexp_replace(url, '/?[^/]*$', '') FROM pages),
    pre AS (SELECT lang, dir, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda i: array_to_string(string_split(dir, '/')[1:i], '/'))) AS prefix FROM p),
    n AS (SELECT lang, count(*) AS total FROM p GROUP BY lang),
    c AS (SELECT lang, lower(prefix) AS prefix, count(*) AS hits FROM pre GROUP BY 1, 2)
    SELECT n.lang, coalesce(rtrim(max_by(c.prefix, length(c.prefix)), '/'), '') || '/' AS root
    FROM n LEFT JOIN c ON c.lang = n.lang AND c.hits = n.total GROUP BY n.lang""",
)
def x09(spark, sf):
    pages = table(spark, sf, "pages")
    part = lambda i: F.element_at(F.split("url", "/", -1), i)
    both = pages.select(part(4).alias("lang"), "url").unionAll(pages.select(F.concat(F.lit("host:"), part(3)), "url"))
    return paths.common_root(both, "url", ["lang"])


CALL_SQL = "('page.' || coalesce(nullif(regexp_extract(line, '[A-Za-z]+', 0), ''), 'x') || '.Do(' || replace(line, ' ', ',') || ')')"


def call_text():
    w = F.coalesce(F.nullif(F.regexp_extract("line", "[A-Za-z]+", 0), F.lit("")), F.lit("x"))
    return F.concat(F.lit("page."), w, F.lit(".Do("), F.replace(F.col("line"), F.lit(" "), F.lit(",")), F.lit(")"))


@query(
    "x10_signatures",
    rf"""WITH {LINES_SQL}, c AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN line ELSE {CALL_SQL} END AS call FROM lines)
    SELECT doc_id, line_no::BIGINT AS line_no, CASE WHEN regexp_extract(call, '(\w+(?:\.\w+)*?)\.(\w+)\((.*)\)', 2) = '' THEN call
       ELSE regexp_extract(call, '(\w+(?:\.\w+)*?)\.(\w+)\((.*)\)', 1) || '.' || regexp_extract(call, '(\w+(?:\.\w+)*?)\.(\w+)\((.*)\)', 2) END AS base, call AS full_sig FROM c""",
)
def x10(spark, sf):
    call = F.when(F.col("line_no") % 5 == 0, F.col("line")).otherwise(call_text())
    out = doc_lines(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), X.signatures(call).alias("s"))
    return out.select("doc_id", "line_no", F.col("s.base").alias("base"), F.col("s.full").alias("full_sig"))


@query(
    "x11_parameterized_pattern",
    rf"""WITH {LINES_SQL}, c AS (SELECT source, regexp_extract({CALL_SQL}, '^(.*)\((.*)\)', 1) AS base, {CALL_SQL} AS call FROM lines),
    g AS (SELECT source, base, min(call) AS first_call, count(DISTINCT regexp_extract(call, '^(.*)\((.*)\)', 2)) AS n_args FROM c GROUP BY ALL)
    SELECT source, base, CASE WHEN n_args <= 1 THEN first_call
       ELSE base || '(' || array_to_string(list_transform(range(0, len(string_split(regexp_extract(first_call, '^(.*)\((.*)\)', 2), ','))), lambda i: '{{arg' || i || '}}'), ', ') || ')' END AS pattern FROM g""",
)
def x11(spark, sf):
    calls = doc_lines(spark, sf).select("source", call_text().alias("call"))
    per = calls.groupBy("source", F.regexp_extract("call", X.CALL, 1).alias("base")).agg(
        F.min("call").alias("first"), F.min(X.call_args("call")).alias("lo"), F.max(X.call_args("call")).alias("hi")
    )
    return per.select("source", "base", X.call_pattern("first", F.col("lo") != F.col("hi")).alias("pattern"))


@query(
    "x12_placeholder_regex",
    r"""SELECT item_id, array_to_string(regexp_split_to_array(regexp_replace('Do({x}, ' || text || ') {name}', '([\\.\[\]()*+?^$|#\-])', '\\\1', 'g'), '\{[A-Za-z_][A-Za-z0-9_]*\}'), '.+?') AS regex FROM benchmark""",
)
def x12(spark, sf):
    pattern = F.concat(F.lit("Do({x}, "), F.col("text"), F.lit(") {name}"))
    return table(spark, sf, "benchmark").select("item_id", X.placeholder_regex_col(pattern).alias("regex"))


@query(
    "x13_table_and_manual",
    rf"""WITH {LINES_SQL}, e AS (SELECT doc_id, line_no, replace(line, '. ', '.Items.') || '.Open<Page>(1)' AS e FROM lines)
    SELECT doc_id, line_no::BIGINT AS line_no, CASE WHEN strpos(e, '.Items') > 1 THEN substr(e, 1, strpos(e, '.Items') - 1) END AS table_base,
       nullif(regexp_extract(e, '(\w+(?:\.\w+)*?)\.(\w+(?:<[^>]*>)?)', 0), '') AS manual FROM e""",
)
def x13(spark, sf):
    e = F.concat(F.replace(F.col("line"), F.lit(". "), F.lit(".Items.")), F.lit(".Open<Page>(1)"))
    return doc_lines(spark, sf).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), X.table_base(e).alias("table_base"), X.manual_pattern(e).alias("manual")
    )


@query(
    "x14_count_hits",
    """SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) // 4)::BIGINT AS hits,
        CASE WHEN strpos(text, 'the ') > 0 THEN length(substr(text, 1, strpos(text, 'the ') - 1)) - length(replace(substr(text, 1, strpos(text, 'the ') - 1), chr(10), '')) + 1 ELSE 0 END::BIGINT AS first_line
       FROM documents""",
)
def x14(spark, sf):
    key = F.lit("the ")
    return table(spark, sf, "documents").select(
        "doc_id", X.count_hits("text", key).cast("bigint").alias("hits"), X.first_hit_line("text", key).cast("bigint").alias("first_line")
    )


@query(
    "x15_values_match",
    f"""WITH v AS (SELECT p_partkey, '  "XPath=' || p_type || '"' AS a, CASE WHEN p_size % 3 = 0 THEN '' ELSE lower(p_type) END AS b FROM part)
    SELECT p_partkey, (length({T('b')}) > 0 AND replace(lower(trim({T('a')}, '"''')), 'xpath=', '') = replace(lower(trim({T('b')}, '"''')), 'xpath=', '')) AS same,
      nullif(replace(lower(trim({T('a')}, '"''')), 'xpath=', ''), '') AS norm FROM v""",
)
def x15(spark, sf):
    a = F.concat(F.lit('  "XPath='), F.col("p_type"), F.lit('"'))
    b = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.lower("p_type"))
    return table(spark, sf, "part").select("p_partkey", X.values_match(a, b).alias("same"), X.match_value(a).alias("norm"))


@query(
    "x16_json_unescape",
    rf"""WITH {LINES_SQL}
    SELECT doc_id, line_no::BIGINT AS line_no, CASE WHEN line_no % 3 = 0 THEN line_raw ELSE line_raw || 'A' || chr(9) END AS plain
    FROM (SELECT doc_id, line_no, line AS line_raw FROM lines)""",
)
def x16(spark, sf):
    line = F.col("line")
    escaped = F.concat(F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\\u0041\\t"))
    j = F.when(F.col("line_no") % 3 == 0, line).otherwise(escaped)
    return doc_lines(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), X.json_unescape(j).alias("plain"))


@query(
    "x17_canonical_sha",
    """SELECT event_id, sha256('{"a":{"k":' || (props::JSON->>'k') || '},"z":[' || user_id || ',"' || event_type || '"]}') AS open_sha,
        sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS typed_sha FROM events""",
)
def x17(spark, sf):
    events = table(spark, sf, "events")
    doc = F.concat(
        F.lit('{ "z": ['), F.col("user_id").cast("string"), F.lit(', "'), F.col("event_type"), F.lit('"], "GeneratedAt": "'),
        F.col("ts").cast("string"), F.lit('", "a": '), F.col("props"), F.lit("}"),
    )
    return events.select(
        "event_id", hashing.canonical_sha(doc).alias("open_sha"), hashing.sha(hashing.canonical_struct(["user_id", "event_type"])).alias("typed_sha")
    )


LEAF_SQL = "sha256(octet_length(encode(p))::VARCHAR || ':' || p || ':' || octet_length(encode(text))::VARCHAR || ':' || text)"


@query(
    "x18_tree_digest",
    f"""WITH l AS (SELECT source, {LEAF_SQL} AS leaf FROM (SELECT source, text, 'doc/' || doc_id AS p FROM documents))
    SELECT source, count(*) AS files, sha256(concat_ws(',', count(*)::VARCHAR, {", ".join(f"sum(('0x' || substr(leaf, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))})) AS digest FROM l GROUP BY source""",
)
def x18(spark, sf):
    docs = table(spark, sf, "documents").select("source", "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    return hashing.tree_digest(docs, ["source"])


@query("x19_short_hash", "SELECT page_id, left(sha256(url), 8) AS id FROM pages")
def x19(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashing.short_hash("url").alias("id"))


@query(
    "x20_case_forms",
    r"""SELECT p_partkey, lower(left(v, 1) || regexp_replace(substr(v, 2), '([A-Z])', '-\1', 'g')) AS kebab, upper(regexp_replace(v, '([^A-Z])([A-Z])', '\1_\2', 'g')) AS screaming
       FROM (SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) || p_brand || p_type AS v FROM part)""",
)
def x20(spark, sf):
    v = F.concat(F.upper(F.left("p_name", F.lit(1))), F.expr("substring(p_name, 2)"), F.col("p_brand"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", X.kebab(v).alias("kebab"), X.screaming_snake(v).alias("screaming"))


@query("x21_clamp", "SELECT c_custkey, least(greatest(floor(c_acctbal / 50)::BIGINT, 0), 100) AS score FROM customer")
def x21(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.clamp(F.floor(F.col("c_acctbal") / 50).cast("bigint")).cast("bigint").alias("score"))


@query(
    "x22_evidence_age",
    """SELECT event_id, greatest(0, floor(s / 3600.0))::BIGINT AS hours, s > 7 * 86400 AS stale, s < 0 AS future
       FROM (SELECT event_id, epoch(TIMESTAMP '2024-01-20 12:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)""",
)
def x22(spark, sf):
    age = X.evidence_age("ts", F.lit("2024-01-20 12:00:00"), 7)
    return table(spark, sf, "events").select("event_id", age.alias("a")).select("event_id", "a.hours", "a.stale", "a.future")


@query(
    "x23_ordered_subsequence",
    r"""WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS ws FROM documents),
    a AS (SELECT doc_id, ws, list_position(ws, 'the') AS i FROM w),
    b AS (SELECT doc_id, ws, i, i + list_position(ws[i + 1:], 'of') AS j FROM a),
    c AS (SELECT doc_id, j + list_position(ws[j + 1:], 'and') AS k, i, j FROM b)
    SELECT doc_id, (i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL) AS in_order FROM c""",
)
def x23(spark, sf):
    expected = F.array(F.lit("the"), F.lit("of"), F.lit("and"))
    return table(spark, sf, "documents").select("doc_id", X.is_ordered_subsequence(expected, F.split(F.lower("text"), " ", -1)).alias("in_order"))


@query(
    "x24_generated_evidence",
    rf"""WITH {CODE_SQL}, act AS (SELECT *, {T('line')} AS t FROM code WHERE length({T('line')}) > 0 AND NOT starts_with({T('line')}, '//')),
    g AS (SELECT doc_id, bool_or(regexp_matches(line, '(?:^|[^A-Za-z0-9_])FindElement(?:[^A-Za-z0-9_]|$)')) AS c0 FROM act GROUP BY doc_id)
    SELECT doc_id, c0 AS contains_0 FROM g""",
)
def x24(spark, sf):
    return generated_evidence(code_lines(spark, sf), ["doc_id"], contains=("FindElement",))


@query(
    "x25_normalize_kind",
    """SELECT conv_id, turn, CASE k WHEN 'lesson' THEN 'final-gate-lesson' WHEN 'anti-pattern' THEN 'antipattern' WHEN 'note' THEN 'user-note' WHEN '' THEN 'user-note'
          WHEN 'decision' THEN 'decision' END AS kind FROM (SELECT conv_id, turn,
          CASE turn % 6 WHEN 0 THEN 'lesson' WHEN 1 THEN 'anti-pattern' WHEN 2 THEN 'note' WHEN 3 THEN '' WHEN 4 THEN 'decision' ELSE role END AS k FROM conversations)""",
)
def x25(spark, sf):
    raw = F.expr("CASE turn % 6 WHEN 0 THEN ' Lesson' WHEN 1 THEN 'ANTI-pattern ' WHEN 2 THEN 'note' WHEN 3 THEN '  ' WHEN 4 THEN 'decision' ELSE role END")
    return table(spark, sf, "conversations").select("conv_id", "turn", normalize_kind(raw).alias("kind"))
