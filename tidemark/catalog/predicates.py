"""Row-level operators P1-P25 bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import CODE_SQL, LINES_SQL, code_lines, doc_lines, query, sql_trim, table
from tidemark.functions import paths, predicates as P
from tidemark.functions.text import source_line
from tidemark.operators import facts, lines as L
from tidemark.operators.statements import extract_actions

TRIM = sql_trim


@query(
    "p01_explode_lines",
    f"""WITH {LINES_SQL}
    SELECT doc_id, count(*) AS n_lines, max(line_no)::BIGINT AS last_line, sum(length(line))::BIGINT AS chars,
           sum(line_no * length(line))::BIGINT AS weighted, count(*) FILTER (line = '') AS empty_lines
    FROM lines GROUP BY doc_id""",
)
def p01(spark, sf):
    return doc_lines(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("line_no").cast("bigint").alias("last_line"),
        F.sum(F.length("line")).alias("chars"),
        F.sum(F.col("line_no") * F.length("line")).alias("weighted"),
        F.count_if(F.col("line") == "").alias("empty_lines"),
    )


ACTIVE_SQL = f"""(length({TRIM('line')}) > 0
    AND NOT (starts_with({TRIM('line')}, '//') OR starts_with({TRIM('line')}, '/*') OR starts_with({TRIM('line')}, '*'))
    AND (ends_with({TRIM('line')}, ';') OR ends_with({TRIM('line')}, '{{') OR ends_with({TRIM('line')}, '}}')
         OR starts_with(lower({TRIM('line')}), 'await ')))"""


@query(
    "p02_active_lines",
    f"""WITH {CODE_SQL}
    SELECT source, count(*) AS n_lines, count(*) FILTER ({ACTIVE_SQL}) AS active_lines FROM code GROUP BY source""",
)
def p02(spark, sf):
    return code_lines(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(L.is_active_line("line")).alias("active_lines")
    )


GLOBS = {"any_html": "*.html", "blog": "http*://blog.*/**", "two_level": "**/en/*", "digit": "**/??", "relative": "en/1*"}
GLOB_SQL = {
    "any_html": r"regexp_matches(regexp_extract(url, '[^/]*$', 0), '(?i)^[^/]*\.html$')",
    "blog": r"regexp_matches(url, '(?i)^(?:.*/)?http[^/]*://blog\.[^/]*/.*$')",
    "two_level": r"regexp_matches(url, '(?i)^(?:.*/)?en/[^/]*$')",
    "digit": r"regexp_matches(url, '(?i)^(?:.*/)?[^/][^/]$')",
    "relative": r"regexp_matches(url, '(?i)^(?:.*/)?en/1[^/]*$')",
}


@query("p03_glob_match", "SELECT page_id, " + ", ".join(f"{e} AS {n}" for n, e in GLOB_SQL.items()) + " FROM pages")
def p03(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[paths.glob_match("url", g).alias(n) for n, g in GLOBS.items()])


NEEDLES = ("THORREOU", "license", "éaux", "qué ")


@query(
    "p04_contains_any",
    "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{n.lower()}')" for n in NEEDLES),
)
def p04(spark, sf):
    return table(spark, sf, "documents").where(P.contains_any("text", NEEDLES)).select("doc_id")


@query(
    "p05_search_all_tokens",
    "SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'src1') "
    "AND contains(lower(concat_ws(' ', source, lang, text)), 'en') AND contains(lower(concat_ws(' ', source, lang, text)), 'heron')",
)
def p05(spark, sf):
    return P.search_all_tokens(table(spark, sf, "documents"), ["source", "lang", "text"], "Src1 EN heron").select("doc_id", "source")


TODO_SQL = CODE_SQL + f""",
todo_raw AS (
  SELECT *, substr(ltrim(line, ' ' || chr(9)), 9) AS body FROM code WHERE starts_with(ltrim(line, ' ' || chr(9)), '// TODO:')
),
todo_msg AS (
  SELECT *, regexp_extract(body, '\\s*\\[[A-Z]+:([A-Z0-9_]+)\\][ \\t]*$', 1) AS explicit_code,
         {TRIM("regexp_replace(body, '\\s*\\[[A-Z]+:([A-Z0-9_]+)\\][ \\t]*$', '')")} AS message
  FROM todo_raw
),
todos AS (
  SELECT doc_id, source, line_no, message,
         CASE WHEN explicit_code <> '' THEN explicit_code
              WHEN contains(lower(message), 'depends on unresolved symbol') THEN 'DEPENDS_ON_UNRESOLVED_SYMBOL'
              WHEN contains(lower(message), 'source-only identifier') THEN 'SOURCE_ONLY_IDENTIFIER'
              WHEN contains(lower(message), 'raw statement') THEN 'RAW_STATEMENT'
              WHEN contains(lower(message), 'mapped method requires manual review') THEN 'MAPPED_METHOD_MANUAL_REVIEW'
              WHEN contains(lower(message), 'map source expression') OR contains(lower(message), 'missing mapping') THEN 'MISSING_MAPPING'
              WHEN contains(lower(message), 'table mapping required') THEN 'TABLE_MAPPING_REQUIRED'
              WHEN contains(lower(message), 'empty after suppression') THEN 'EMPTY_TEST_AFTER_SUPPRESSION'
              ELSE 'UNCATEGORIZED_TODO' END AS code
  FROM todo_msg
)"""


@query("p06_extract_todos", f"WITH {TODO_SQL} SELECT doc_id, line_no::BIGINT AS line_no, code, message FROM todos")
def p06(spark, sf):
    return L.extract_todos(code_lines(spark, sf)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "code", "message")


@query(
    "p06_todo_phrases",
    f"""WITH {LINES_SQL},
    hit AS (SELECT doc_id, line_no, substr(ltrim(line, ' ' || chr(9)), 3) AS m FROM lines WHERE starts_with(ltrim(line, ' ' || chr(9)), 'Th'))
    SELECT CASE WHEN contains(lower(m), 'the') THEN 'A' WHEN contains(lower(m), 'in') THEN 'B' ELSE 'UNCATEGORIZED_TODO' END AS code,
           count(*) AS n FROM hit GROUP BY 1""",
)
def p06b(spark, sf):
    todos = L.extract_todos(doc_lines(spark, sf), marker="Th", code_rules=(("the", "A"), ("in", "B")))
    return todos.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


SOURCE_LINE_SQL = r"""coalesce(nullif(regexp_extract(line, '\[[A-Z]+-SOURCE-LINE:(\d+)\]', 1), ''),
                                 nullif(regexp_extract(line, '(?i)//\s*line\s+(\d+)\b', 1), ''))::BIGINT"""
ISSUES_SQL = CODE_SQL + f""",
scan AS (SELECT *, {TRIM('line')} AS t, {SOURCE_LINE_SQL} AS source_line FROM code),
msg AS (SELECT *, {TRIM('substr(t, 9)')} AS m, starts_with(t, '// TODO:') AS is_todo, starts_with(t, '//') AS is_comment FROM scan),
issues AS (
  SELECT doc_id, source, line_no, source_line, 'Todo' AS category, 'Warning' AS severity, 'TODO comment found: ' || m AS message FROM msg WHERE is_todo
  UNION ALL SELECT doc_id, source, line_no, source_line, 'BlockedSymbolUsage', 'Warning', m FROM msg WHERE is_todo AND contains(lower(m), 'depends on unresolved symbol')
  UNION ALL SELECT doc_id, source, line_no, source_line, 'DownstreamStatementBlocked', 'Warning', m FROM msg WHERE is_todo AND contains(lower(m), 'depends on unresolved symbol')
  UNION ALL SELECT doc_id, source, line_no, source_line, 'SourceOnlyIdentifierUsage', 'Warning', m FROM msg WHERE is_todo AND contains(lower(m), 'uses source-only identifier')
  UNION ALL SELECT doc_id, source, line_no, source_line, 'RawDeclarationVariablesBlocked', 'Info', m FROM msg WHERE is_todo AND contains(lower(m), 'raw statement')
  UNION ALL SELECT doc_id, source, line_no, source_line, 'PageTodo', 'Error', 'Page.TODO_* call found: ' || t FROM msg WHERE NOT is_comment AND contains(t, 'Page.TODO_')
  UNION ALL SELECT doc_id, source, line_no, source_line, 'ActiveTodoLocator', 'Error', 'Active Page.Locator/GetBy... with TODO target found: ' || t
    FROM msg WHERE NOT is_comment AND regexp_matches(t, '(?i)\\bpage\\.(?:Locator|GetBy\\w+)\\s*\\([^;\\r\\n]*"\\s*TODO')
)"""


@query(
    "p07_scan_issue_lines",
    f"WITH {ISSUES_SQL} SELECT doc_id, line_no::BIGINT AS line_no, source_line, category, severity, message FROM issues",
)
def p07(spark, sf):
    return L.scan_issue_lines(code_lines(spark, sf)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("source_line").cast("bigint").alias("source_line"),
        "category", "severity", "message",
    )


@query(
    "p08_source_line",
    f"WITH {CODE_SQL} SELECT doc_id, line_no::BIGINT AS line_no, {SOURCE_LINE_SQL} AS source_line FROM code WHERE {SOURCE_LINE_SQL} IS NOT NULL",
)
def p08(spark, sf):
    out = code_lines(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), source_line("line").cast("bigint").alias("source_line"))
    return out.where(F.col("source_line").isNotNull())


MASK_SQL = r"""array_to_string(list_transform(
    regexp_extract_all(code_text, '//[^\n]*|/\*(?:[^*]*\*+(?:[^/*][^*]*\*+)*/|[\s\S]*)|"[^"\\]*(?:\\+[^\\][^"\\]*)*(?:"|\\*\z)|''[^''\\]*(?:\\+[^\\][^''\\]*)*(?:''|\\*\z)|[^/"'']+|/'),
    lambda t: CASE WHEN regexp_matches(t, '^(?://|/\*|"|'')') THEN regexp_replace(t, '[^\n]', ' ', 'g') ELSE t END), '')"""
CODE_TEXT_SQL = r"""(text || chr(10) || 'var a = "' || replace(text, chr(10), '\"') || '"; // ' || source || chr(10) || '/* ' || text || ' */ page.' || lang || '.Open(a);')"""


def code_text():
    return F.concat(
        F.col("text"), F.lit('\nvar a = "'), F.replace(F.col("text"), F.lit("\n"), F.lit('\\"')), F.lit('"; // '), F.col("source"),
        F.lit("\n/* "), F.col("text"), F.lit(" */ page."), F.col("lang"), F.lit(".Open(a);"),
    )


@query(
    "p09_mask_code",
    f"""SELECT doc_id, length(m)::BIGINT AS chars, (length(m) = length(code_text)) AS same_length,
          length(replace(m, ' ', ''))::BIGINT AS visible, sha256(m) AS masked_sha
        FROM (SELECT doc_id, code_text, {MASK_SQL} AS m FROM (SELECT doc_id, {CODE_TEXT_SQL} AS code_text FROM documents))""",
)
def p09(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", code_text().alias("code_text"))
    m = docs.withColumn("m", facts.mask_code("code_text"))
    return m.select(
        "doc_id", F.length("m").cast("bigint").alias("chars"), (F.length("m") == F.length("code_text")).alias("same_length"),
        F.length(F.replace(F.col("m"), F.lit(" "), F.lit(""))).cast("bigint").alias("visible"), F.sha2("m", 256).alias("masked_sha"),
    )


SELECTOR_SQL = CODE_SQL + r""",
sel_raw AS (
  SELECT doc_id, source, line_no, line, unnest(regexp_extract_all(line, '\bBy\.(Id|CssSelector|XPath|Name|ClassName|TagName|LinkText|PartialLinkText|id|cssSelector|xpath|name|className|tagName|linkText|partialLinkText)\s*\(\s*"([^"\\]*(?:\\.[^"\\]*)*)"\s*\)', 0)) AS m
  FROM code
),
selectors AS (
  SELECT doc_id, source, line_no, 'Id' AS kind, replace(replace(regexp_extract(m, '"([^"\\]*(?:\\.[^"\\]*)*)"', 1), '\"', '"'), '\''', '''') AS value,
         regexp_extract(substr(line, 1, strpos(line, m) - 1), '((?:this\.|self\.|cls\.)?[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)\s*(?:=>|=)\s*[^=]*$', 1) AS assigned
  FROM sel_raw
)"""


@query(
    "p10_extract_selectors",
    f"""WITH {SELECTOR_SQL} SELECT doc_id, line_no::BIGINT AS line_no, kind, value,
        CASE WHEN assigned <> '' THEN assigned ELSE 'selector:' || kind || ':' || value END AS source_expr FROM selectors""",
)
def p10(spark, sf):
    return facts.extract_selectors(code_lines(spark, sf)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "kind", "value", "source_expr"
    )


LOCATOR_SQL = CODE_SQL + r""",
loc_raw AS (
  SELECT doc_id, source, line_no, unnest(regexp_extract_all(line, '\b([Pp]age\.(Locator|GetByTestId|GetByText|GetByRole)\s*\(([^;\n]+)\))', 1)) AS l FROM code
),
loc_args AS (
  SELECT *, regexp_extract(l, '\.(Locator|GetByTestId|GetByText|GetByRole)', 1) AS locator_kind,
         regexp_extract(l, '^[Pp]age\.(?:Locator|GetByTestId|GetByText|GetByRole)\s*\(([^;\n]+)\)$', 1) AS args FROM loc_raw
),
locators AS (
  SELECT doc_id, source, line_no, l AS locator, locator_kind,
    CASE WHEN regexp_extract(args, '"([^"\\]*(?:\\.[^"\\]*)*)"|''([^''\\]*(?:\\.[^''\\]*)*)''', 0) <> ''
         THEN replace(replace(regexp_extract(args, '"([^"\\]*(?:\\.[^"\\]*)*)"|''([^''\\]*(?:\\.[^''\\]*)*)''', 0)[2:-2], '\"', '"'), '\''', '''')
         ELSE trim(args) END AS target
  FROM loc_args
)"""


@query("p11_extract_locators", f"WITH {LOCATOR_SQL} SELECT doc_id, line_no::BIGINT AS line_no, locator, locator_kind, target FROM locators")
def p11(spark, sf):
    return facts.extract_locators(code_lines(spark, sf)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "locator", "locator_kind", "target"
    )


# Statement shapes per language; {x} is the text line with quotes removed, {w} its first word.
SHAPES = {
    "java": (
        'driver.findElement(By.id("{x}")).click();', 'driver.findElement(By.cssSelector("{x}")).sendKeys("{w}");', "driver.findElement({w}Field).clear();",
        'Assert.assertEquals("{x}", driver.findElement(By.id("{w}")).getText());', 'assertTrue(driver.findElement({w}Box).getText().contains("{x}"));',
        'driver.get("https://host/{w}");', 'wait.until(ExpectedConditions.visibilityOfElementLocated(By.xpath("{x}")));',
        'WebElement {w} = driver.findElement(By.name("{x}"));', 'assertThat({w}.getText()).isEqualTo("{x}");', "{w}.click();",
        "LoginPage page = new LoginPage(driver);",
        'assertTrue(driver.findElement(By.className("{w}")).isDisplayed());', 'assertFalse(driver.findElement(By.linkText("{x}")).isDisplayed());', "assertThat({w}.isDisplayed()).isFalse();",
        'assertNotEquals("{x}", {w}.getText());', 'assertThat({w}.getText()).doesNotContain("{x}");', 'assertThat({w}.getText(), is(not(equalTo("{x}"))));',
        'wait.until(ExpectedConditions.invisibilityOfElementLocated(By.partialLinkText("{x}")));', 'wait.until(ExpectedConditions.textToBePresentInElementLocated(By.id("{w}"), "{x}"));',
        "private LoginPage {w};", "{x}",
    ),
    "python": (
        'self.driver.find_element(By.ID, "{x}").click()', 'driver.find_element(By.NAME, "{x}").send_keys("{w}")', 'driver.find_element_by_id("{x}").clear()',
        'assert driver.find_element(By.ID, "{w}").text == "{x}"', 'assert "{x}" in {w}.text', 'driver.get("{x}")',
        'WebDriverWait(driver, 5).until(EC.visibility_of_element_located((By.ID, "{x}")))', 'self.assertEqual("{x}", self.{w}.text)',
        "{w}.click()", 'box = driver.find_element(By.ID, "{x}")', "super().setUp()",
        'self.assertNotIn("{x}", self.{w}.text)', 'assert driver.find_element(By.CSS_SELECTOR, "{w}").text != "{x}"', 'assert "{x}" not in {w}.text', "assert not {w}.is_displayed()",
        'self.assertFalse(driver.find_element_by_xpath("{x}").is_displayed())', 'WebDriverWait(driver, 5).until_not(EC.presence_of_element_located((By.LINK_TEXT, "{x}")))',
        'wait.until(EC.text_to_be_present_in_element((By.NAME, "{w}"), "{x}"))', 'wait.until(EC.invisibility_of_element_located((By.ID, "{x}")))', "{x}",
    ),
    "csharp": (
        'Driver.FindElement(By.Id("{x}")).Click();', 'Driver.FindElement(By.Name("{x}")).SendKeys("{w}");', "page.{w}.Items.ElementAt(0).Text.Get();",
        "page.{w}.Items.Count.Get().Should().Be(3);", "page.{w}.Items.ElementAt(i);", "page.Pagination.Forward();",
        'var page = Navigation.OpenPage<{w}Page>("{x}");', 'Driver.Navigate().GoToUrl("{x}");', 'var e = Driver.FindElement(By.XPath("{x}"));',
        'Assert.That("{x}", Is.Empty);', "Driver.FindElement(By.Id({w} + i));",
        "page.{w}.Items.Count.Get().Should().NotBe(3);", 'Assert.IsFalse("{x}".Contains("{w}"));', 'Driver.FindElement(By.CssSelector("{x}"));', "{x}",
    ),
}


def shaped_lines(spark, sf, language):
    base = doc_lines(spark, sf).select(
        "doc_id", "source", "line_no", F.replace(F.col("line"), F.lit('"'), F.lit("")).alias("x"),
        F.concat(F.lit("w"), F.regexp_extract("line", "[A-Za-z]*", 0)).alias("w"),
    )
    expr = None
    for i, shape in enumerate(SHAPES[language]):
        text = F.replace(F.replace(F.lit(shape), F.lit("{w}"), F.col("w")), F.lit("{x}"), F.col("x"))
        cond = (F.col("doc_id") + F.col("line_no")) % len(SHAPES[language]) == i
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return base.withColumn("line", expr)


def shaped_sql(language):
    n = len(SHAPES[language])
    cases = " ".join(f"WHEN {i} THEN replace(replace('{s}', '{{w}}', w), '{{x}}', x)" for i, s in enumerate(SHAPES[language]))
    return LINES_SQL + f""",
shaped_base AS (SELECT doc_id, source, line_no, replace(line, '"', '') AS x, 'w' || regexp_extract(line, '[A-Za-z]*', 0) AS w FROM lines),
shaped AS (SELECT *, CASE (doc_id + line_no) % {n} {cases} END AS line FROM shaped_base)"""


# What each shape says, written by hand: kind, target and value in SQL over x and w, locator kind, whether it is negated, state.
SAID = {
    "java": (
        ("click-direct", "x", "''", "Id"), ("send-keys-direct", "x", "w", "CssSelector"), ("clear-stored", "w || 'Field'"), ("assert-text-direct", "w", "x", "Id"),
        ("assert-contains-stored", "w || 'Box'", "x"), ("navigation", "'https://host/' || w"), ("wait-direct", "x", "''", "XPath", False, "visible"), ("element-declaration", "x", "''", "Name"),
        ("assert-that-text-variable", "w", "x"), ("click-variable", "w"), ("page-object", "'LoginPage'"),
        ("assert-displayed-direct", "w", "''", "ClassName"), ("assert-displayed-direct", "x", "''", "LinkText", True), ("assert-displayed-variable", "w", "''", "", True),
        ("assert-text-variable", "w", "x", "", True), ("assert-that-contains-variable", "w", "x", "", True), ("assert-that-text-variable", "w", "x", "", True),
        ("wait-direct", "x", "''", "PartialLinkText", True, "visible"), ("wait-direct", "w", "x", "Id", False, "text"), ("page-field", "'LoginPage'", "w"),
    ),
    "python": (
        ("click-direct", "x", "''", "Id"), ("send-keys-direct", "x", "w", "Name"), ("clear-direct", "x", "''", "Id"), ("assert-text-direct", "w", "x", "Id"),
        ("assert-contains-variable", "w", "x"), ("navigation", "x"), ("wait-direct", "x", "''", "Id", False, "visible"), ("assert-text-variable", "'self.' || w", "x"),
        ("click-variable", "w"), ("element-declaration", "x", "''", "Id"), ("setup-super", "''"),
        ("assert-contains-variable", "'self.' || w", "x", "", True), ("assert-text-direct", "w", "x", "CssSelector", True), ("assert-contains-variable", "w", "x", "", True), ("assert-displayed-variable", "w", "''", "", True),
        ("assert-displayed-direct", "x", "''", "XPath", True), ("wait-direct", "x", "''", "LinkText", True, "present"), ("wait-direct", "w", "x", "Name", False, "text"), ("wait-direct", "x", "''", "Id", True, "visible"),
    ),
    "csharp": (
        ("click", "x", "''", "Id"), ("send-keys", "x", "w", "Name"), ("table-row-text", "'0'"), ("table-count", "'Be'", "'3'"), ("table-row", "'i'"),
        ("pagination-forward", "''"), ("open-page", "x"), ("navigation", "x"), ("find-element", "x", "''", "XPath"), ("assertion", "'That'"),
        ("find-element-dynamic", "w || ' + i'", "''", "Id"), ("table-count", "'NotBe'", "'3'", "", True), ("assertion", "'IsFalse'", "''", "", True), ("find-element", "x", "''", "CssSelector"),
    ),
}


def actions_sql(language):
    default = ("", "", "''", "", False, "")
    rows = [(*said, *default[len(said):]) for said in SAID[language]]
    n = len(rows) + 1
    pick = lambda k: f"CASE (doc_id + line_no) % {n} " + " ".join(f"WHEN {i} THEN {k(said)}" for i, said in enumerate(rows)) + " END"
    text = lambda x: f"'{x}'"
    return f"""WITH {shaped_sql(language)}
    SELECT doc_id, line_no::BIGINT AS line_no, {pick(lambda r: text(r[0]))} AS kind, {pick(lambda r: text("SyntaxFallback" if r[0].endswith("dynamic") else "Semantic"))} AS confidence,
      {pick(lambda r: r[1])} AS target, {pick(lambda r: r[2])} AS value, {pick(lambda r: text(r[3]))} AS locator_kind, {pick(lambda r: str(r[4]).lower())} AS negated, {pick(lambda r: text(r[5]))} AS state
    FROM shaped WHERE (doc_id + line_no) % {n} < {n - 1}"""


def _actions(number, language):
    @query(f"p{number}_extract_actions_{language}", actions_sql(language))
    def run(spark, sf):
        return extract_actions(shaped_lines(spark, sf, language), language).select(
            "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "kind", "confidence", "target", "value", "locator_kind", "negated", "state"
        )

    return run


for _n, _lang in ((12, "java"), (13, "python"), (14, "csharp")):
    _actions(_n, _lang)


EXPRESSION_SQL = LINES_SQL + r""",
expr AS (
  SELECT doc_id, source, line_no, unnest(regexp_extract_all(line, '(?:^|[^\p{L}\p{N}_])([a-z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)', 1)) AS expression
  FROM (SELECT doc_id, source, line_no, 'page.' || regexp_extract(line, '[A-Za-z]+', 0) || '.Open(); ' || replace(line, '. ', '.') AS line FROM lines)
)"""


def expression_lines(spark, sf):
    word = F.regexp_extract("line", "[A-Za-z]+", 0)
    return doc_lines(spark, sf).withColumn(
        "line", F.concat(F.lit("page."), word, F.lit(".Open(); "), F.replace(F.col("line"), F.lit(". "), F.lit(".")))
    )


@query(
    "p15_extract_expressions",
    f"""WITH {EXPRESSION_SQL}
    SELECT doc_id, line_no::BIGINT AS line_no, expression FROM expr
    WHERE split_part(expression, '.', 1) NOT IN ('this','base','Task','DateTime','TimeSpan','String','Math','Guid','System','Console')
      AND NOT contains(expression, 'Should') AND NOT contains(expression, 'Assert')""",
)
def p15(spark, sf):
    return facts.extract_expressions(expression_lines(spark, sf)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "expression")


# Every document becomes a small source file: its words name classes, bases, attributes.
TYPE_LINES_SQL = LINES_SQL + """,
words AS (SELECT doc_id, line_no, line, coalesce(nullif(regexp_extract(line, '[A-Za-z]+', 0), ''), 'X') AS w FROM lines),
typed AS (SELECT doc_id, (line_no - 1) * 3 + p AS line_no, CASE p
    WHEN 1 THEN CASE WHEN line_no = 1 THEN 'namespace ' || w || '.Tests' WHEN line_no % 4 = 0 THEN '' ELSE '[' || w || '(1)]' END
    WHEN 2 THEN CASE WHEN line_no % 2 = 0 THEN '[Test]' ELSE '    // ' || line END
    ELSE CASE WHEN line_no % 3 = 0 THEN 'public class ' || w || 'Tests : Base' || left(w, 1) || ', IRun {' ELSE 'class ' || w || 'Page {' END END AS line
  FROM words, (VALUES (1), (2), (3)) v(p))"""


def typed_lines(spark, sf):
    word = F.regexp_extract("line", "[A-Za-z]+", 0)
    w = F.when(word == "", F.lit("X")).otherwise(word)
    n = F.col("line_no")
    parts = F.array(
        F.when(n == 1, F.concat(F.lit("namespace "), w, F.lit(".Tests"))).when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("["), w, F.lit("(1)]"))),
        F.when(n % 2 == 0, F.lit("[Test]")).otherwise(F.concat(F.lit("    // "), F.col("line"))),
        F.when(n % 3 == 0, F.concat(F.lit("public class "), w, F.lit("Tests : Base"), F.left(w, F.lit(1)), F.lit(", IRun {")))
        .otherwise(F.concat(F.lit("class "), w, F.lit("Page {"))),
    )
    return doc_lines(spark, sf).select("doc_id", "source", n.alias("_n"), F.posexplode(parts).alias("_p", "line")).select(
        "doc_id", "source", ((F.col("_n") - 1) * 3 + F.col("_p") + 1).alias("line_no"), "line"
    )


TYPES_SQL = TYPE_LINES_SQL + r""",
type_marks AS (
  SELECT *, regexp_extract(line, 'class (\w+)', 1) AS class_name, nullif(regexp_extract(line, ' : (\w+)', 1), '') AS base_class
  FROM typed WHERE line NOT LIKE '    //%' OR true
),
type_flags AS (
  SELECT *, regexp_matches(line, '^(public )?class \w+') AS is_class, starts_with(line, '[') AS is_attr,
         nullif(regexp_extract(line, '^namespace ([\w.]+)', 1), '') AS ns FROM type_marks
),
attr_run AS (
  SELECT *, sum(CASE WHEN is_attr OR trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no)
            - CASE WHEN is_attr OR trim(line) = '' THEN 0 ELSE 1 END AS run,
         last_value(ns IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS namespace FROM type_flags
),
run_attrs AS (SELECT doc_id, run, string_agg(DISTINCT a, ',' ORDER BY a) AS attrs
  FROM (SELECT doc_id, run, unnest(regexp_extract_all(line, '\[(\w+(?:\([^)]*\))?)\]', 1)) AS a FROM attr_run WHERE is_attr) GROUP BY ALL),
types AS (
  SELECT c.doc_id, c.line_no, c.class_name, c.base_class, coalesce(c.namespace, '') AS namespace, coalesce(r.attrs, '') AS attributes
  FROM attr_run c LEFT JOIN run_attrs r USING (doc_id, run) WHERE c.is_class
)"""


@query(
    "p16_extract_types",
    f"WITH {TYPES_SQL} SELECT doc_id, line_no::BIGINT AS line_no, class_name, base_class, namespace, attributes FROM types",
)
def p16(spark, sf):
    return facts.extract_types(typed_lines(spark, sf), ["doc_id"]).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "class_name", "base_class", "namespace",
        F.array_join("attributes", ",").alias("attributes"),
    )


HTML_ATTRIBUTES = ("class=", "href=", "charset=", "lang=", "role", "aria-label")


@query(
    "p17_target_facts",
    """WITH t AS (SELECT page_id, url, html || chr(10) || 'await page.GotoAsync("' || url || '"); await page.GotoAsync(siteBase); await page.GotoAsync(other); await page.GotoAsync(siteBase);' || chr(10)
        || 'public async Task LoginAs' || page_id || '() { await page.Locator("x").ClickAsync(); } private void Render() {} internal static void WaitForRow() {}' AS text FROM pages)
    SELECT page_id, 'locator-attribute' AS kind, a.name, ((length(lower(text)) - length(replace(lower(text), a.name, ''))) // length(a.name))::BIGINT AS n FROM t, (VALUES """
    + ", ".join(f"('{a}')" for a in HTML_ATTRIBUTES)
    + ") a(name) WHERE contains(lower(text), a.name)"
    + " UNION ALL SELECT page_id, 'locator-method', a.name, ((length(text) - length(replace(text, a.name, ''))) // length(a.name))::BIGINT FROM t, (VALUES " + ", ".join(f"('{a}')" for a in facts.LOCATOR_METHODS)
    + ") a(name) WHERE contains(text, a.name)"
    + " UNION ALL SELECT page_id, 'auth-indicator', a.name, 1 FROM t, (VALUES " + ", ".join(f"('{a}')" for a in facts.AUTH_INDICATORS)
    + ") a(name) WHERE contains(lower(text), lower(a.name))"
    + " UNION ALL SELECT page_id, 'navigation', url, 1 FROM t UNION ALL SELECT page_id, 'navigation-variable', 'siteBase', 2 FROM t"
    + " UNION ALL SELECT page_id, 'helper-method', 'LoginAs' || page_id, 1 FROM t UNION ALL SELECT page_id, 'helper-method', 'WaitForRow', 1 FROM t",
)
def p17(spark, sf):
    code = F.concat(
        F.col("html"), F.lit('\nawait page.GotoAsync("'), F.col("url"), F.lit('"); await page.GotoAsync(siteBase); await page.GotoAsync(other); await page.GotoAsync(siteBase);\npublic async Task LoginAs'),
        F.col("page_id").cast("string"), F.lit('() { await page.Locator("x").ClickAsync(); } private void Render() {} internal static void WaitForRow() {}'))
    files = table(spark, sf, "pages").select("page_id", code.alias("text"))
    return facts.extract_target_facts(files, ["page_id"], "text", HTML_ATTRIBUTES).select("page_id", "kind", "name", "n")


WORD_SIGNALS = {"tests": r"\b[Tt]he\b", "locators": r"on[a-z]*", "xpaths": r"[0-9]+", "assertions": r"\bis\b|\bwas\b"}


@query(
    "p18_signal_counts",
    "SELECT doc_id, "
    + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {n}" for n, p in WORD_SIGNALS.items())
    + ", CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::BIGINT AS line_count FROM documents",
)
def p18(spark, sf):
    return P.signal_counts(table(spark, sf, "documents"), WORD_SIGNALS).select("doc_id", *WORD_SIGNALS, "line_count")


TAGS = (("page-object", r"(?i)license|copyright"), ("table-filter", r"(?i)\bof the\b"), ("custom-helper", None))


@query(
    "p19_tag_categories",
    r"""SELECT doc_id, concat_ws(',', CASE WHEN len(regexp_extract_all(text, '\bthe\b')) <= 3 THEN 'simple-smoke' END,
            CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'page-object' END,
            CASE WHEN regexp_matches(text, '(?i)\bof the\b') THEN 'table-filter' END,
            CASE WHEN len(list_filter(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9_]*)\s*\(', 1), lambda x: lower(x) NOT IN ('assert','by','wait','thread'))) > 0 THEN 'custom-helper' END,
            CASE WHEN contains(source, 'base') THEN 'base-fixture' END) AS categories FROM documents""",
)
def p19(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.col("source"))
    out = P.tag_categories(docs, TAGS, ("simple-smoke", r"\bthe\b", 3))
    return out.select("doc_id", F.array_join("categories", ",").alias("categories"))


PAGE_KINDS = (("utm_source", "selector-evidence"), ("ref=", "helper-inventory"), (".html", "verify"), ("top", "migration-report"))
PAGE_TEXT = (("source-sample", ("tion the", "der ")),)
PAGE_SIGNALS = (("nav", ("<nav>",)), ("ad", ('class="ad"',)), ("list", ("<ul>", "<ol>")))


@query(
    "p20_infer_kind",
    r"""SELECT page_id, CASE WHEN contains(n, 'utm_source') THEN 'selector-evidence' WHEN contains(n, 'ref=') THEN 'helper-inventory'
            WHEN contains(n, '.html') THEN 'verify' WHEN contains(n, 'top') THEN 'migration-report'
            WHEN contains(lower(html), 'tion the') OR contains(lower(html), 'der ') THEN 'source-sample' ELSE 'artifact' END AS kind,
          concat_ws(',', CASE WHEN contains(lower(html), '<nav>') THEN 'nav' END, CASE WHEN contains(lower(html), 'class="ad"') THEN 'ad' END,
            CASE WHEN contains(lower(html), '<ul>') OR contains(lower(html), '<ol>') THEN 'list' END) AS signals
        FROM (SELECT page_id, html, lower(regexp_extract(rtrim(url, '/'), '[^/]*$', 0)) AS n FROM pages)""",
)
def p20(spark, sf):
    out = P.infer_kind(table(spark, sf, "pages"), PAGE_KINDS, PAGE_TEXT, PAGE_SIGNALS, "url", "html")
    return out.select("page_id", "kind", F.array_join("signals", ",").alias("signals"))


@query(
    "p21_unsafe_suppression",
    f"""WITH {LINES_SQL} SELECT doc_id, line_no::BIGINT AS line_no,
        ((contains(lower(line), 'the') OR contains(lower(line), 'der')) AND (contains(lower(line), 'on') OR contains(lower(line), 'ung'))
         AND NOT (contains(lower(line), 'with') OR contains(lower(line), 'nicht'))) AS unsafe FROM lines""",
)
def p21(spark, sf):
    unsafe = P.unsafe_suppression("line", ("the", "der"), ("on", "ung"), ("with", "nicht"))
    return doc_lines(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), unsafe.alias("unsafe"))


@query(
    "p22_dangerous_rule",
    rf"""WITH {CODE_SQL}, r AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 2 = 0 THEN 'SuppressedMethodPatterns' ELSE 'Methods' END AS section FROM code)
    SELECT doc_id, line_no::BIGINT AS line_no,
      CASE WHEN section = 'SuppressedMethodPatterns' AND regexp_matches(line, '(?i)Assert|ClassicAssert|Should\s*\(|FluentAssertions|CollectionAssert') THEN 'assertion-suppression' END AS reason,
      (section = 'SuppressedMethodPatterns' AND regexp_matches(line, '(?i)PageObject|\bPage\b|\*|\.\*')) AS broad FROM r""",
)
def p22(spark, sf):
    rules = code_lines(spark, sf).withColumn("section", F.when(F.col("line_no") % 2 == 0, P.SUPPRESSION_SECTION).otherwise("Methods"))
    return rules.select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), P.dangerous_rule("section", "line").alias("reason"),
        P.broad_rule("section", "line").alias("broad"),
    )


WORD_LEAKS = ((r"(?i)licen[sc]e", "license"), (r"[0-9]{3}-[0-9]{2,4}", "number"), (r"[\w.]+@[\w.]+", "mail"), (r"(?i)the[_\s]?a", "article"))


@query(
    "p23_scan_leaks",
    "SELECT doc_id, finding FROM documents, (VALUES "
    + ", ".join(f"('{p}', '{label}')" for p, label in WORD_LEAKS)
    + ") r(pattern, finding) WHERE regexp_matches(text, pattern)",
)
def p23(spark, sf):
    return P.scan_leaks(table(spark, sf, "documents").select("doc_id", "text"), "text", WORD_LEAKS).select("doc_id", "finding")


SENSITIVE = (("credential", r"(?i)\b(?:licensed|copyright)\b"), ("bearer", r"[0-9]{3}-[0-9]{4}"))


@query(
    "p24_screen_sensitive",
    r"""SELECT doc_id,
          concat_ws(',', CASE WHEN octet_length(encode(text)) > 12000 THEN 'size' END,
               CASE WHEN regexp_matches(text, '(?i)\b(?:licensed|copyright)\b') THEN 'credential' END, CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'bearer' END) AS reasons
        FROM documents""",
)
def p24(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.col("source"))
    return P.screen_sensitive(docs, patterns=SENSITIVE, max_bytes=12000).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "p25_scope_violations",
    """SELECT page_id, url, md5(html) AS sha FROM pages WHERE NOT (starts_with(lower(url), 'https:/') OR lower(url) = 'https:'
          OR starts_with(lower(url), 'http://blog.ththan.example.net/en/') OR lower(url) = 'http://blog.ththan.example.net/en')
        AND page_id % 5 <> 0""",
)
def p25(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"), F.md5("html").alias("sha"))
    baseline = pages.where(F.col("page_id") % 5 == 0)
    out = P.scope_violations(pages, ("https:", "http://blog.ththan.example.net/en"), baseline)
    return out.select("page_id", F.col("path").alias("url"), "sha")

