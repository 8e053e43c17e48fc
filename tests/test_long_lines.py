"""Very long lines and texts must not exhaust a task's stack."""

from pyspark.sql import functions as F

from tidemark.operators import facts, lines as L
from tidemark.operators.statements import DIALECTS, extract_actions
from tidemark.plans import failures, quality

LONG = [
    'By.Id("' + "x" * 200_000 + '")', 'Page.Locator("' + "\\\\x" * 60_000 + '")', '"' + '\\"' * 60_000 + '"', "/* " + "* x " * 60_000, "page" + ".a" * 60_000, "$\"" + "{a} " * 60_000 + "{name}\"",
    'driver.findElement(By.id("' + "\\\\n" * 60_000 + '")).click();', "a " * 100_000, "// TODO: " + "y" * 200_000 + " [TAG:X]",
]


def test_long_lines(spark):
    df = spark.createDataFrame(list(enumerate(LONG)), "line_no int, line string").withColumn("path", F.lit("f"))
    assert facts.extract_selectors(df).count() == 2
    assert facts.extract_locators(df).count() == 1
    assert df.select(F.sum(F.length(facts.mask_code("line")))).first()[0] == sum(map(len, LONG))
    assert facts.extract_expressions(df).count() >= 1
    for language in DIALECTS:
        extract_actions(df, language).count()
    assert L.extract_todos(df).count() == 1
    assert L.scan_issue_lines(df).count() >= 1
    assert quality.placeholder_leftovers(df, ["name"]).count() == 0
    failures.classify_failures(df, ["path"]).count()
