"""Files to numbered lines, and facts taken from lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import (
    TODO_PREFIX, as_col, contains_ci, first_flag, is_blank, ltrim_all, rtrim_all, source_line, split_lines, trim_all,
)


def explode_lines(df: DataFrame, text_col: str, keys: Sequence[str]) -> DataFrame:
    """One row per line, numbered from 1; CR LF and CR count as LF. Narrow: no shuffle."""
    return df.select(*keys, F.posexplode(split_lines(text_col)).alias("_pos", "line")).select(
        *keys, (F.col("_pos") + 1).alias("line_no"), "line"
    )


def is_active_line(c: Column | str) -> Column:
    """Code that does something: not blank, no comment, ends like a statement or a block, or awaits."""
    t = trim_all(c)
    comment = F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*")) | F.startswith(t, F.lit("*"))
    ends = F.endswith(t, F.lit(";")) | F.endswith(t, F.lit("{")) | F.endswith(t, F.lit("}"))
    return (F.length(t) > 0) & ~comment & (ends | F.startswith(F.lower(t), F.lit("await ")))


# Phrases that give an uncoded TODO its code, first match wins.
TODO_PHRASES = (
    ("depends on unresolved symbol", "DEPENDS_ON_UNRESOLVED_SYMBOL"),
    ("source-only identifier", "SOURCE_ONLY_IDENTIFIER"),
    ("raw statement", "RAW_STATEMENT"),
    ("mapped method requires manual review", "MAPPED_METHOD_MANUAL_REVIEW"),
    ("map source expression", "MISSING_MAPPING"),
    ("missing mapping", "MISSING_MAPPING"),
    ("table mapping required", "TABLE_MAPPING_REQUIRED"),
    ("empty after suppression", "EMPTY_TEST_AFTER_SUPPRESSION"),
)
UNCATEGORIZED = "UNCATEGORIZED_TODO"


def extract_todos(
    lines: DataFrame,
    marker: str = TODO_PREFIX,
    code_rules: Sequence[tuple[str, str]] = TODO_PHRASES,
    line_col: str = "line",
) -> DataFrame:
    """Lines that open with ``marker`` -> ``code`` and ``message``.

    The code is the one in a trailing ``[TAG:CODE]``, else the code of the first
    phrase the message contains, else ``UNCATEGORIZED_TODO``.
    """
    opened = ltrim_all(line_col)
    body = F.substring(opened, len(marker) + 1, 2**31 - 1)
    tag = r"\s*\[[A-Z]+:([A-Z0-9_]+)\][ \t]*$"
    explicit = F.regexp_extract(body, tag, 1)
    message = trim_all(F.regexp_replace(body, tag, ""))
    inferred = first_flag([(code, contains_ci(message, phrase)) for phrase, code in code_rules], UNCATEGORIZED)
    return (
        lines.where(F.startswith(opened, F.lit(marker)))
        .withColumn("code", F.when(explicit != "", explicit).otherwise(inferred))
        .withColumn("message", message)
    )


ACTIVE_TODO_LOCATOR = r'(?i)\bpage\.(?:Locator|GetBy\w+)\s*\([^;\r\n]*"\s*TODO'


def scan_issue_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Every issue a generated line gives; one line may give several.

    The candidates are an array of structs per line, so that the scan stays a
    narrow transformation: filter, explode, no join.
    """
    t = trim_all(line_col)
    todo = F.startswith(t, F.lit(TODO_PREFIX))
    comment = F.startswith(t, F.lit("//"))
    message = trim_all(F.substring(t, len(TODO_PREFIX) + 1, 2**31 - 1))

    def issue(cond: Column, category: str, severity: str, text: Column) -> Column:
        return F.when(cond, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), text.alias("message")))

    blocked = todo & contains_ci(message, "depends on unresolved symbol")
    candidates = F.array(
        issue(todo, "Todo", "Warning", F.concat(F.lit("TODO comment found: "), message)),
        issue(blocked, "BlockedSymbolUsage", "Warning", message),
        issue(blocked, "DownstreamStatementBlocked", "Warning", message),
        issue(todo & contains_ci(message, "uses source-only identifier"), "SourceOnlyIdentifierUsage", "Warning", message),
        issue(todo & contains_ci(message, "raw statement"), "RawDeclarationVariablesBlocked", "Info", message),
        issue(F.contains(t, F.lit("Page.TODO_")) & ~comment, "PageTodo", "Error", F.concat(F.lit("Page.TODO_* call found: "), t)),
        issue(
            ~comment & F.rlike(t, F.lit(ACTIVE_TODO_LOCATOR)),
            "ActiveTodoLocator",
            "Error",
            F.concat(F.lit("Active Page.Locator/GetBy... with TODO target found: "), t),
        ),
    )
    others = [c for c in lines.columns]
    return (
        lines.where(todo | F.contains(t, F.lit("TODO")))
        .select(*others, source_line(line_col).alias("source_line"), F.explode(F.filter(candidates, lambda x: x.isNotNull())).alias("_i"))
        .select(*others, "source_line", "_i.category", "_i.severity", "_i.message")
    )


def with_sample(df: DataFrame, n_chars: int | None = None, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """What detection looks at: the whole text, or its head of ``n_chars``; with ``max_chars`` longer files drop out first."""
    kept = df if max_chars is None else df.where(F.length(text_col) <= max_chars)
    return kept.withColumn("sample", F.col(text_col) if n_chars is None else F.substring(text_col, 1, n_chars))


def snippet_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, rtrim_all), "\n")


def non_blank(lines: DataFrame, line_col: str = "line") -> DataFrame:
    return lines.where(~is_blank(line_col))


__all__ = [
    "explode_lines", "is_active_line", "extract_todos", "scan_issue_lines", "with_sample", "snippet_text", "non_blank",
    "as_col",
]
