"""Mapping proposals from what is unmapped, unsupported and wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import file_name
from tidemark.functions.predicates import contains_any_exact
from tidemark.functions.text import base_signature, call_args, call_pattern, manual_pattern, table_base
from tidemark.operators.aggregates import affected_files
from tidemark.operators.joins import drop_mapped
from tidemark.operators.ranking import impact, priority_of

# Texts that decide which kind of proposal an expression or action leads to.
ROW_ACCESS, PAGING = ".ElementAt(", ".Pagination."
STRUCTURAL = (ROW_ACCESS, ".Items.Count", PAGING)
MANUAL = ("Navigation.", ".Open<", ".ClickAndOpen<")
MANY_TODOS = 50


def _has(c: str, *words: str) -> Column:
    return contains_any_exact(c, words)


def _reduce(df: DataFrame, key: Column, weight: str, extra: list[Column] | None = None) -> DataFrame:
    """Occurrences and affected files per key; files are counted after a per-(key, file) partial sum."""
    per_file = df.groupBy(key.alias("key"), "file").agg(F.sum(weight).alias("_w"), *(extra or []))
    return per_file


def _finish(df: DataFrame, kind: str, blocker: bool, confidence: Column) -> DataFrame:
    scored = df.withColumn("score", impact(F.col("occurrences"), F.col("files"), F.lit(blocker)))
    return scored.select(
        F.lit(kind).alias("kind"), "key", "occurrences", "files", "score", priority_of(F.col("score")).alias("priority"), confidence.alias("confidence")
    )


def _often(n: int = 3) -> Column:
    return F.when(F.col("occurrences") >= n, "High").otherwise("Medium")


def propose_mappings(unmapped: DataFrame, unsupported: DataFrame, issues: DataFrame, rules: DataFrame) -> DataFrame:
    """All proposals as one table with score, priority and confidence.

    unmapped(source_expr, usages, file), unsupported(text, cnt, file), issues(file,
    category, severity, message), rules(key): keys already mapped, global or scoped.
    Each kind is one aggregate over its own rows: no input is scanned per group.
    """
    total = [F.sum("_w").alias("occurrences"), F.count(F.lit(1)).alias("files")]

    plain = unmapped.where(~_has("source_expr", *STRUCTURAL))
    ui = drop_mapped(_reduce(plain, F.col("source_expr"), "usages"), rules, "key").groupBy("key").agg(*total)
    out = _finish(ui, "UiTarget", False, _often())

    calls = unsupported.withColumn("args", call_args("text"))
    span = [F.min("text").alias("first"), F.min("args").alias("lo"), F.max("args").alias("hi"), F.min("text").alias("ft"), F.max("text").alias("lt")]
    per_file = drop_mapped(_reduce(calls, base_signature("text"), "cnt", span), rules, "key")
    methods = per_file.groupBy("key").agg(
        *total, F.min("first").alias("first"), (F.min("ft") != F.max("lt")).alias("varied"), (F.min("lo") != F.max("hi")).alias("args_vary")
    )
    parameterized = methods.where("varied").withColumn("key", call_pattern("first", F.col("args_vary"))).where(F.length(F.trim("key")) > 0)
    out = out.unionByName(_finish(parameterized, "ParameterizedMethodMapping", False, F.lit("Medium")))
    out = out.unionByName(_finish(methods.where("NOT varied"), "MethodMapping", False, _often()))

    rows = unmapped.where(_has("source_expr", ROW_ACCESS)).withColumn("base", table_base("source_expr")).where(F.col("base").isNotNull())
    tables = drop_mapped(_reduce(rows, F.col("base"), "usages"), rules, "key").groupBy("key").agg(*total)
    out = out.unionByName(_finish(tables, "TableMapping", True, F.lit("Medium")))

    # Paging expressions are proposed one by one, each for its own file.
    paging = unmapped.where(_has("source_expr", PAGING)).select(F.col("source_expr").alias("key"), F.col("usages").alias("occurrences"), F.lit(1).cast("bigint").alias("files"))
    out = out.unionByName(_finish(drop_mapped(paging, rules, "key"), "PaginationMapping", True, F.lit("Medium")))

    scoped = issues.where(F.contains("category", F.lit("Scope"))).groupBy("file").agg(F.count(F.lit(1)).alias("occurrences"))
    scopes = scoped.select(file_name("file").alias("key"), "occurrences", F.lit(1).cast("bigint").alias("files"))
    out = out.unionByName(_finish(scopes, "ProfileScope", False, F.lit("Medium")))

    gates = issues.agg(
        F.count_if(F.col("category") == "PlaceholderLeftover").alias("placeholders"), F.count_if(F.col("category") == "Todo").alias("todos"),
        F.count_if(F.col("category") == "Syntax").alias("syntax"), F.count_distinct("file").alias("_files"),
    )
    gate = lambda key, n, files, cond, blocker: _finish(
        gates.where(cond).select(F.lit(key).alias("key"), F.col(n).alias("occurrences"), files.alias("files")), "QualityGate", blocker, F.lit("High")
    )
    out = out.unionByName(gate("FailOnPlaceholderLeftovers", "placeholders", F.col("_files"), F.col("placeholders") > 0, True))
    out = out.unionByName(gate("MaxTodoComments", "todos", F.col("_files"), F.col("todos") > MANY_TODOS, False))
    out = out.unionByName(gate("SyntaxErrors", "syntax", F.lit(1).cast("bigint"), F.col("syntax") > 0, True))

    by_hand = unsupported.where(_has("text", *MANUAL)).withColumn("pattern", manual_pattern("text")).where(F.col("pattern").isNotNull())
    manual = _reduce(by_hand, F.col("pattern"), "cnt").groupBy("key").agg(*total)
    return out.unionByName(_finish(manual, "ManualMigration", False, F.lit("Low")))


def proposal_files(unmapped: DataFrame, unsupported: DataFrame) -> DataFrame:
    """The affected files of UI-target and method proposals as rows."""
    ui = affected_files(unmapped.select(F.col("source_expr").alias("key"), "file"), ["key"], "file")
    return ui.unionByName(affected_files(unsupported.select(base_signature("text").alias("key"), "file"), ["key"], "file"))
