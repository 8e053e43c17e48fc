"""Failure classification of log lines, and environment markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import contains_any, contains_any_exact
from tidemark.functions.text import as_col, contains_ci, first_flag, ltrim_all, rtrim_all, trim_all
from tidemark.operators.ordered import with_carried
from tidemark.operators.windows import LINES

# Ordered failure rules. A rule holds when each of its word groups has a
# word in the line (ignoring case); the first rule that holds gives the category.
FAILURE_RULES: Sequence[tuple[str, Sequence[Sequence[str]]]] = (
    ("strict-mode-violation", (("strict mode violation",),)),
    ("locator-not-found", (("locator",), ("resolved to", "did not match", "not found", "waiting for locator"))),
    ("locator-not-found", (("element is not attached", "detached from dom", "element is not visible", "element not visible"),)),
    ("assertion-mismatch", (("expect(",), ("tohave", "tobe", "failed"))),
    ("assertion-mismatch", (("expected",), ("received", "actual", "but was"))),
    ("assertion-mismatch", (("assert.", "xunit.sdk", "nunit.framework.assertionexception"),)),
    ("modal/dialog-state", (("modal", "dialog", "popup", "overlay", "blocked by another element"),)),
    ("frame/shadow-dom", (("frame", "iframe", "shadow", "shadowroot"),)),
    ("navigation-route-missing", (("timeout", "timed out", "exceeded", "waiting for"), ("navigation", "goto", "waitforurl", "url"))),
    ("timeout-wait-state", (("timeout", "timed out", "exceeded", "waiting for"),)),
    ("navigation-route-missing", (("page.goto", "gotoasync", "net::err", "navigation failed", "waitforurl", "404", "route not found"),)),
    ("auth/session-not-ready", (("401", "403", "unauthorized", "forbidden", "login", "auth", "storage state"),)),
    ("environment/flaky-infra", (("500", "502", "503", "504", "internal server error", "bad gateway", "service unavailable"),)),
    ("environment/flaky-infra", (("econnrefused", "enotfound", "connection refused", "socket hang up", "dns", "name or service not known"),)),
    ("test-data-missing", (("test data", "fixture", "setup", "seed", "not seeded", "not found in database"),)),
    ("environment/flaky-infra", (("target closed", "browser has been closed", "context closed", "page closed"),)),
    ("unclassified-runtime-failure", (("error", "exception", "failed"), ("playwright", "nunit", "xunit"))),
)
UNMATCHED = "unclassified-runtime-failure"
TROUBLE_WORDS = ("failed", "error", "timeout")


def failure_category(line: Column | str, rules: Sequence[tuple[str, Sequence[Sequence[str]]]] = FAILURE_RULES, lowered: Column | None = None) -> Column:
    """Category of a log line, null when no rule holds. One CASE: later rules run only when earlier ones fail.

    ``lowered``: the line in lower case, where that is a column already.
    """
    low = F.lower(as_col(line)) if lowered is None else lowered

    def holds(groups):
        cond = F.lit(True)
        for words in groups:
            cond = cond & contains_any_exact(low, [w.lower() for w in words])
        return cond

    return first_flag([(label, holds(groups)) for label, groups in rules])


TEST_CALL = r"(?<![\p{L}\p{N}_])[a-zA-Z_][a-zA-Z0-9_<>]*+\([^)]*\)"


def test_header(line: Column | str) -> Column:
    """A line that names a test, trimmed, else null."""
    t = trim_all(line)
    names = (
        F.contains(t, F.lit(" › ")) | F.startswith(F.lower(t), F.lit("failed ")) | F.startswith(F.lower(t), F.lit("passed "))
        | contains_ci(t, "test name:") | contains_ci(t, "fullname:") | (F.contains(t, F.lit("(")) & F.rlike(t, F.lit(TEST_CALL)))
    )
    return F.when(names, t)


def classify_failures(
    lines: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Sequence[Sequence[str]]]] = FAILURE_RULES, context: bool = True, trouble: Sequence[str] = TROUBLE_WORDS
) -> DataFrame:
    """Observations: category, line, test and snippet; a troubled file without any gets one fallback row.

    Files are cut into slices of ``LINES`` lines, and the lines at the edge of a slice are copied to its neighbour: one shuffle and
    one sort of the lines give test, snippet and the place of the fallback row. What one row a slice carries into it (the
    last test before, whether the file has hits or trouble) comes from an aggregate. Without ``context`` the classification
    is a plain filter with no shuffle of lines at all.
    """
    cut = lines.select(*keys, "line_no", rtrim_all("line").alias("_text"), F.lower("line").alias("_low"))
    marked = cut.select(
        *keys, "line_no", "_text", F.when(F.length("_text") > 0, failure_category("line", rules, F.col("_low"))).alias("category"),
        *([test_header("_text").isNotNull().alias("_head")] if context else []), contains_any_exact("_low", [w.lower() for w in trouble]).alias("_trouble"),
    )
    message = ltrim_all("_text")
    fallback = [F.lit(UNMATCHED).alias("category"), F.lit(None).cast("string").alias("test"), F.lit("failure text without a known pattern").alias("message"), F.lit(None).cast("string").alias("snippet")]
    counts = [F.count("category").alias("_hits"), F.bool_or("_trouble").alias("_trouble")]
    if not context:
        none = F.lit(None).cast("string")
        hits = marked.where(F.col("category").isNotNull()).select(*keys, "line_no", "category", none.alias("test"), message.alias("message"), none.alias("snippet"))
        return hits.unionByName(marked.groupBy(*keys).agg(*counts).where((F.col("_hits") == 0) & F.col("_trouble")).select(*keys, F.lit(1).alias("line_no"), *fallback))
    at, test = F.col("line_no"), F.when(F.col("_head"), message)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy(*keys, F.floor(at / LINES).alias("_bucket")).agg(F.max_by(test, F.when(F.col("_head"), at)).alias("_last"), *counts)
    carried = ends.select(
        *keys, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carry"), F.min("_bucket").over(whole).alias("_first"),
        ((F.sum("_hits").over(whole) == 0) & F.max("_trouble").over(whole)).alias("_unknown"),
    )
    copies = marked.drop("_trouble").withColumn("_bucket", F.explode(F.sequence(F.floor((at - 3) / LINES), F.floor((at + 2) / LINES))))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("line_no")
    seen = copies.withColumns({
        "_own": F.last(test, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "snippet": F.array_join(F.collect_list("_text").over(inside.rowsBetween(-2, 3)), "\n"),
        "_n": F.row_number().over(inside),
    })
    hit = F.col("category").isNotNull()
    found = with_carried(seen.where((F.col("_bucket") == F.floor(at / LINES)) & (hit | (F.col("_n") == 1))), carried, keys)
    of = lambda c, other: F.when(hit, c).otherwise(other)
    own = [F.col("category"), F.coalesce("_own", "_carry"), message, F.col("snippet")]
    return found.where(hit | (F.col("_unknown") & (F.col("_n") == 1) & (F.col("_bucket") == F.col("_first")))).select(
        *keys, of(at, F.lit(1)).alias("line_no"), *[of(c, f).alias(name) for c, f, name in zip(own, fallback, ("category", "test", "message", "snippet"))],
    )


# Texts of a broken environment, in general and of the browser.
GENERAL_MARKERS = (
    "no .net sdks were found", "the command could not be loaded", "a compatible installed .net sdk", "unable to load the service index", "nu1301",
    "cannot connect to proxy", "proxyerror", "name or service not known", "temporary failure in name resolution", "connection timed out",
    "network is unreachable", "no such host is known", "failed to start dotnet process",
)
BROWSER_MARKERS = (
    "unable to obtain driver", "chromedriver executable needs to be available", "cannot find chrome binary", "chrome failed to start",
    "devtoolsactiveport file doesn't exist", "session not created", "selenium manager binary", "error sending request for url",
    "driver location must be a directory", "executable doesn't exist at", "please run the following command to download new browsers",
    "playwright install", "browsertype.launch",
)
GENERAL_STAGES = ("SourceRestore", "SourceBuild", "ProjectVerify", "TargetBuild")
TEST_STAGES = ("SourceTest", "TargetTest")


def infra_markers(
    text: Column | str, stage: Column | str, general: Sequence[str] = GENERAL_MARKERS, browser: Sequence[str] = BROWSER_MARKERS
) -> Column:
    """Environment failure in a stage's output. A test's own text may speak of networks, so test stages look for browser markers only."""
    s = F.col(stage) if isinstance(stage, str) else stage
    return (s.isin(*GENERAL_STAGES) & contains_any(text, general)) | (s.isin(*TEST_STAGES) & contains_any(text, browser))


def stage_outcome(timed_out: Column, start_failed: Column, exit_code: Column, text: Column | str, stage: Column | str, **markers) -> Column:
    """Outcome of a finished stage process, in fixed order."""
    return first_flag(
        [
            ("TimedOut", timed_out), ("InfrastructureFailure", start_failed), ("Passed", exit_code == 0),
            ("InfrastructureFailure", infra_markers(text, stage, **markers)),
        ],
        "Failed",
    )
