"""Top-k, rank-map ordering, impact scores and the covering slice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import as_col


def top_k(df: DataFrame, k: int | None, *order) -> DataFrame:
    """Global top-k with a full tie-break; each task keeps k rows, no full sort. None: all rows in order."""
    return df.orderBy(*order) if k is None else df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, by: Sequence[str], k: int, *order) -> DataFrame:
    """First k rows per group. The engine limits each group before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_of(c: Column | str, ranks: Mapping[str, int], default: int = 0) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, as_col(c)), F.lit(default))


def order_by_rank(df: DataFrame, col: str, ranks: Mapping[str, int], *then) -> DataFrame:
    """Descending semantic order of a label column, then the given columns."""
    return df.orderBy(rank_of(col, ranks).desc(), *then)


# Weights and thresholds of the impact score.
OCCURRENCE_WEIGHT, FILE_WEIGHT, BLOCKER_FACTOR = 2, 5, 3
BONUSES = ((10, 20), (5, 10), (3, 5))
HIGH_SCORE, MEDIUM_SCORE = 30, 10


def impact(occurrences: Column, files: Column, blocker: Column) -> Column:
    bonus = F.when(occurrences >= BONUSES[0][0], BONUSES[0][1])
    for least, value in BONUSES[1:]:
        bonus = bonus.when(occurrences >= least, value)
    weighted = occurrences * OCCURRENCE_WEIGHT + files * FILE_WEIGHT
    return weighted * F.when(blocker, BLOCKER_FACTOR).otherwise(1) + bonus.otherwise(0)


def priority_of(score: Column) -> Column:
    return F.when(score >= HIGH_SCORE, "High").when(score >= MEDIUM_SCORE, "Medium").otherwise("Low")


def impact_score(df: DataFrame, occ: str, files: str, blocker: Column) -> DataFrame:
    scored = df.withColumn("score", impact(F.col(occ), F.col(files), blocker))
    return scored.withColumn("priority", priority_of(F.col("score")))


# Ticket priorities by number of occurrences, and their rank.
TICKET_LEVELS = ((25, "P0"), (10, "P1"), (3, "P2"))
TICKET_RANK = {"P0": 4, "P1": 3, "P2": 2, "P3": 1}


def ticket_priority(n: Column) -> Column:
    expr = F.when(n >= TICKET_LEVELS[0][0], TICKET_LEVELS[0][1])
    for least, label in TICKET_LEVELS[1:]:
        expr = expr.when(n >= least, label)
    return expr.otherwise("P3")


def ticket_board(sources: Sequence[tuple[str, DataFrame, str, str]], per: int = 5, total: int = 15) -> DataFrame:
    """Tickets of several ranked sources, in source order, then by priority, occurrences and number.

    Each source is (category, frame, key column, count column). Only the per-source
    leaders are numbered, a handful of rows, after the limits.
    """
    parts = None
    for i, (category, df, key, n) in enumerate(sources):
        lead = top_k(df.select(F.lit(i).alias("_src"), F.lit(category).alias("category"), F.col(key).alias("subject"), F.col(n).cast("bigint").alias("occurrences")), per,
                     F.col("occurrences").desc(), F.col("subject"))
        parts = lead if parts is None else parts.unionByName(lead)
    number = F.row_number().over(Window.orderBy("_src", F.col("occurrences").desc(), "subject"))
    board = parts.withColumn("id", F.format_string("MQ-%03d", number)).withColumn("priority", ticket_priority(F.col("occurrences")))
    return board.orderBy(rank_of("priority", TICKET_RANK).desc(), F.col("occurrences").desc(), "id").limit(total).drop("_src")


# Weights of the pilot score over file signals.
PILOT_WEIGHTS = {"tests": 8, "locators": 5, "assertions": 4, "waits": 3}


def pilot_score(counts: Mapping[str, str] | None = None) -> Column:
    """Score of a file from its signal counts: small, test-rich, little dynamic code, few XPath selectors."""
    c = lambda name: F.col((counts or {}).get(name, name))
    lines = c("line_count")
    score = sum((c(name) * w for name, w in PILOT_WEIGHTS.items()), F.lit(0))
    score = score - F.least(F.lit(30), c("dynamics") * 4) - F.floor(F.greatest(F.lit(0), lines - 250) / 20)
    score = score + F.when((lines > 0) & (lines <= 160), 8).otherwise(0)
    score = score - F.when(c("xpaths") > 0, F.least(F.lit(12), c("xpaths") * 2)).otherwise(0)
    return F.greatest(F.lit(0), score).cast("bigint")


def rank_pilots(files: DataFrame, path_col: str, k: int = 5) -> DataFrame:
    """The k best files with tests and locators; when there is none, the k shortest with tests.

    Both candidate lists are limited first; the fallback applies when the first is empty.
    """
    scored = files.withColumn("pilot_score", pilot_score()).where(F.col("tests") > 0)
    best = top_k(scored.where(F.col("locators") > 0), k, F.col("pilot_score").desc(), "line_count", F.lower(F.col(path_col)), path_col).withColumn("tier", F.lit(1))
    short = top_k(scored, k, "line_count", F.lower(F.col(path_col)), path_col).withColumn("tier", F.lit(2))
    both = best.unionByName(short)
    return both.withColumn("_top", F.min("tier").over(Window.partitionBy(F.lit(1)))).where(F.col("tier") == F.col("_top")).drop("_top")


def covering_slice(candidates: DataFrame, by: Sequence[str], categories: Sequence[str], budget: int) -> DataFrame:
    """One pick per category under a test budget, then the best scores until the budget is full.

    candidates(by..., file, tests, score, categories). The choice is greedy and looks at
    no row but the leaders: for a category at most one pick per earlier category can be
    taken already, so its first ``len(categories)`` rows suffice, and the fill takes at
    most ``budget`` rows (each has at least one test) besides those picked. Spark prunes
    to these exactly; the remaining handful per group runs in one small function.
    """
    n = len(categories)
    keyed = candidates.withColumn("_dist", F.abs(F.col("tests") - 1))
    long = keyed.withColumn("_cat", F.explode(F.array_intersect("categories", F.array(*[F.lit(c) for c in categories]))))
    lead = top_k_per(long, [*by, "_cat"], n, "_dist", F.col("score").desc(), "file").drop("rank", "_cat")
    fill = top_k_per(keyed, by, n + budget, F.col("score").desc(), "file").drop("rank")
    pool = lead.unionByName(fill).dropDuplicates([*by, "file"]).drop("_dist")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema.fields if f.name in (*by, "file", "tests", "score")]
    cats, limit, keys = list(categories), budget, list(by)

    def pick(pdf):
        rows = pdf.to_dict("records")
        chosen, used, left = [], set(), max(1, limit)

        def spent():
            return sum(r["tests"] for r in chosen)

        for cat in cats:
            fits = [r for r in rows if cat in list(r["categories"]) and r["file"] not in used]
            if not fits:
                continue
            best = min(fits, key=lambda r: (abs(r["tests"] - 1), -r["score"], r["file"]))
            if chosen and spent() + best["tests"] > limit + 2:
                continue
            chosen.append(best)
            used.add(best["file"])
            left -= best["tests"]
            if left <= 0:
                break
        for r in sorted(rows, key=lambda r: (-r["score"], r["file"])):
            if r["file"] in used:
                continue
            if spent() >= limit:
                break
            chosen.append(r)
            used.add(r["file"])
        ids = [i for i, r in enumerate(rows) if r["file"] in used]
        return pdf.iloc[ids][[*keys, "file", "tests", "score"]]

    return pool.groupBy(*by).applyInPandas(pick, ", ".join(fields))
