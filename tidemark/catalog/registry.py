"""The query registry and the table views that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lines import explode_lines
from tidemark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` together with its SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# --- documents as files, lines and generated code ---------------------------------------------

BLANK_CHARS = "' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11) || chr(160)"


def sql_trim(expr: str) -> str:
    return f"trim({expr}, {BLANK_CHARS})"


LINES_SQL = """
lines AS (
  SELECT doc_id, source, lang, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
  FROM (SELECT doc_id, source, lang,
               string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls
        FROM documents)
)"""


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return explode_lines(docs, "text", ["doc_id", "source", "lang"])


# One code-shaped line per text line: the template is chosen by the line number, the
# line itself is the payload, so the whole text runs through the extraction.
CODE_SQL = LINES_SQL + """,
code AS (
  SELECT doc_id, source, lang, line_no, regexp_extract(line, '[A-Za-z]+', 0) AS word,
         CASE (doc_id + line_no) % 12
           WHEN 0 THEN '    // TODO: ' || line || ' [PORT:RAW_STATEMENT]'
           WHEN 1 THEN '    // TODO: depends on unresolved symbol ' || regexp_extract(line, '[A-Za-z]+', 0)
           WHEN 2 THEN '    await Page.GetByTestId("' || line || '").ClickAsync(); // line ' || (line_no * 3)
           WHEN 3 THEN 'var ' || regexp_extract(line, '[A-Za-z]+', 0) || ' = Page.TODO_Find("' || line || '");'
           WHEN 4 THEN 'public async Task ' || regexp_extract(line, '[A-Za-z]+', 0) || '() {'
           WHEN 5 THEN 'await page.Locator("TODO ' || line || '").FillAsync(value);'
           WHEN 6 THEN 'var item = Driver.FindElement(By.Id("' || line || '"));'
           WHEN 7 THEN '    // TODO: uses source-only identifier ' || line || ' [PORT-SOURCE-LINE:' || line_no || ']'
           WHEN 8 THEN 'page.' || regexp_extract(line, '[A-Za-z]+', 0) || '.Open(' || length(line) || ');'
           WHEN 9 THEN 'Assert.AreEqual("' || line || '", page.Title.Text);'
           WHEN 10 THEN '    // TODO: ' || line
           ELSE line END AS line
  FROM lines
)"""


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = doc_lines(spark, sf)
    word = F.regexp_extract("line", "[A-Za-z]+", 0)
    pick = (F.col("doc_id") + F.col("line_no")) % 12
    line, no = F.col("line"), F.col("line_no")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    templates = [
        text("    // TODO: ", line, " [PORT:RAW_STATEMENT]"),
        text("    // TODO: depends on unresolved symbol ", word),
        text('    await Page.GetByTestId("', line, '").ClickAsync(); // line ', no * 3),
        text("var ", word, ' = Page.TODO_Find("', line, '");'),
        text("public async Task ", word, "() {"),
        text('await page.Locator("TODO ', line, '").FillAsync(value);'),
        text('var item = Driver.FindElement(By.Id("', line, '"));'),
        text("    // TODO: uses source-only identifier ", line, " [PORT-SOURCE-LINE:", no, "]"),
        text("page.", word, ".Open(", F.length(line), ");"),
        text('Assert.AreEqual("', line, '", page.Title.Text);'),
        text("    // TODO: ", line),
    ]
    expr = F.when(pick == 0, templates[0])
    for i, t in enumerate(templates[1:], start=1):
        expr = expr.when(pick == i, t)
    return lines.select("doc_id", "source", "lang", "line_no", word.alias("word"), expr.otherwise(line).alias("line"))
