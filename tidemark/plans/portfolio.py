"""Framework detection for many projects at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rules import detect_best


def signal_scores(files: DataFrame, by: Sequence[str], weights: Sequence[tuple[str, str, int]], text_col: str = "text") -> DataFrame:
    """Summed weights per project and label: each file adds the weight of every signal its text contains.

    A file's hits become at most one struct per label before anything is shuffled.
    """
    labels = list(dict.fromkeys(label for label, _, _ in weights))
    text = F.col(text_col)
    per_label = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                sum((F.when(F.contains(text, F.lit(needle)), w).otherwise(0) for x, needle, w in weights if x == label), F.lit(0)).alias("score"),
            )
            for label in labels
        ]
    )
    hits = files.select(*by, F.explode(F.filter(per_label, lambda s: s["score"] > 0)).alias("_s")).select(*by, "_s.label", "_s.score")
    return hits.groupBy(*by, "label").agg(F.sum("score").cast("bigint").alias("score"))


def framework_portfolio(
    files: DataFrame, by: Sequence[str], weights: Sequence[tuple[str, str, int]], support: Mapping[str, str], text_col: str = "text", minimum: int = 30, margin: int = 12
) -> DataFrame:
    """Projects per detected framework and its support level; undetected projects count as such."""
    detected = detect_best(signal_scores(files, by, weights, text_col), by, "label", "score", minimum, margin)
    every = files.select(*by).distinct().join(detected.select(*by, "detected", "score"), list(by), "left")
    name = F.coalesce("detected", F.lit("unknown"))
    lookup = F.create_map(*[F.lit(x) for kv in support.items() for x in kv])
    level = F.coalesce(F.try_element_at(lookup, name), F.lit("manual"))
    return every.groupBy(name.alias("framework"), level.alias("readiness")).agg(F.count(F.lit(1)).alias("projects"), F.max("score").alias("top_score"))
