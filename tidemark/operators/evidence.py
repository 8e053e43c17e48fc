"""Evidence that generated lines carry what an expectation names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import trim_all
import re

# What makes a line an assertion.
TEXT_ASSERTIONS = ("ToHaveTextAsync", "ToContainTextAsync")
ASSERTIONS = ("Expect(", "Assert.That(", ".Should()")


def _any(line: Column, words: Sequence[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(line, F.lit(w))
    return cond


def quoted(text: str) -> str:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        text = text.replace(plain, escaped)
    return f'"{text}"'


def token_hit(line: Column, token: str, assertions: Sequence[str] = ASSERTIONS) -> Column:
    """Payload-like tokens need an assertion line with the quoted text; identifiers need token boundaries."""
    if token[0].islower() or any(ch.isspace() for ch in token):
        return _any(line, assertions) & F.contains(line, F.lit(quoted(token)))
    return F.rlike(line, F.lit(rf"(?<![A-Za-z0-9_]){re.escape(token)}(?![A-Za-z0-9_])"))


def generated_evidence(
    lines: DataFrame,
    keys: Sequence[str],
    contains: Sequence[str] = (),
    ordered: Sequence[str] = (),
    count: int | None = None,
    ord_col: str = "line_no",
    line_col: str = "line",
    assertions: Sequence[str] = ASSERTIONS,
    text_assertions: Sequence[str] = TEXT_ASSERTIONS,
) -> DataFrame:
    """Checks per file: each token present, ordered texts asserted in order, count asserted.

    Only lines that can matter leave the scan; per file they collapse to booleans and,
    for the ordered texts, to one short array of the lines that name one of them.
    """
    line = F.col(line_col)
    active = lines.where((F.length(trim_all(line)) > 0) & ~F.startswith(trim_all(line), F.lit("//")))
    checks = [F.bool_or(token_hit(line, t, assertions)).alias(f"contains_{i}") for i, t in enumerate(contains)]
    if count is not None:
        checks.append(F.bool_or(F.rlike(line, F.lit(rf"\bToHaveCountAsync\s*\(\s*{count}\s*\)"))).alias("count_asserted"))
    if ordered:
        hits = [F.contains(line, F.lit(quoted(t))) for t in ordered]
        any_hit = _any(line, text_assertions)
        some = hits[0]
        for h in hits[1:]:
            some = some | h
        entry = F.struct(F.col(ord_col).alias("o"), F.array(*hits).alias("h"))
        seq = F.array_sort(F.collect_list(F.when(any_hit & some, entry)))
        reached = F.aggregate(seq, F.lit(0), lambda i, x: i + F.when(F.coalesce(F.get(x["h"], i), F.lit(False)), 1).otherwise(0))
        checks.append(reached.alias("ordered_matched"))
    return active.groupBy(*keys).agg(*checks)
