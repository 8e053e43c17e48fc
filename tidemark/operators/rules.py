"""Rule tables as data: all matches, arbitration, weighted detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_rules(lines: DataFrame, rules: Sequence[tuple[str, str, int]], line_col: str = "line") -> DataFrame:
    """Every matching (label, pattern, priority) rule of a line, one row each."""
    hits = F.array(
        *[
            F.when(F.rlike(F.col(line_col), F.lit(p)), F.struct(F.lit(label).alias("rule"), F.lit(prio).alias("priority")))
            for label, p, prio in rules
        ]
    )
    return lines.withColumn("_hit", F.explode(F.filter(hits, lambda x: x.isNotNull()))).select(
        *lines.columns, F.col("_hit.rule").alias("rule"), F.col("_hit.priority").alias("priority")
    )


def best_rule(matches: DataFrame, entity: Sequence[str], rule_col: str = "rule", priority_col: str = "priority") -> DataFrame:
    """Highest-priority rule per entity; two or more at the top are ambiguous.

    An aggregate of (priority, first name, count) instead of a window: it combines
    before the shuffle, so an entity with very many matches stays small.
    """
    per_priority = matches.groupBy(*entity, priority_col).agg(F.count(F.lit(1)).alias("_n"), F.min(rule_col).alias("_rule"))
    top = per_priority.groupBy(*entity).agg(F.max(F.struct(F.col(priority_col).alias("p"), F.col("_n").alias("n"), F.col("_rule").alias("r"))).alias("_t"))
    return top.select(
        *entity,
        F.col("_t.p").alias("priority"),
        F.when(F.col("_t.n") > 1, F.lit("AMBIGUOUS")).otherwise(F.col("_t.r")).alias("rule"),
        F.col("_t.n").alias("candidates"),
    )


def detect_best(
    scores: DataFrame, by: Sequence[str], label_col: str, score_col: str, minimum: int = 30, margin: int = 12
) -> DataFrame:
    """Best label per group when it scores enough and leads the runner-up, else ambiguous or unknown.

    Labels per group are few (one row each), so the window runs over an aggregate.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score_col).desc(), F.col(label_col))
    ranked = scores.withColumns({"_rn": F.row_number().over(w), "runner_up": F.coalesce(F.lead(score_col).over(w), F.lit(0))})
    lead = F.col(score_col) - F.col("runner_up")
    verdict = F.when(F.col(score_col) < minimum, F.lit("unknown")).when(lead < margin, F.lit("ambiguous")).otherwise(F.col(label_col))
    return ranked.where(F.col("_rn") == 1).select(*by, F.col(label_col).alias("best"), F.col(score_col).alias("score"), "runner_up", verdict.alias("detected"))
