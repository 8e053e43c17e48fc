"""Ordered operators W1-W15. Windows run per file or per bucket, aggregates wherever order only picks a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import rtrim_all, trim_all
from tidemark.operators.ordered import bucketed, last_known, row_numbers, running_sum


def last_wins(df: DataFrame, keys: Sequence[str], layer_ord: str) -> DataFrame:
    """Layered merge: each key keeps the row of its last layer at the position of its first."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.where(~_blank_key(keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), layer_ord).alias("_row"), F.min(layer_ord).alias("position"))
    return kept.select(*keys, "position", *[F.col(f"_row.{c}").alias(c) for c in rest])


def _blank_key(keys: Sequence[str]) -> Column:
    cond = F.lit(False)
    for k in keys:
        cond = cond | (F.coalesce(F.length(F.trim(F.col(k).cast("string"))), F.lit(0)) == 0)
    return cond


def ordered_merge(entries: DataFrame, keys: Sequence[str], canon: str, ord_col: str, dangerous: Column, is_base: Column) -> DataFrame:
    """Status of each delta entry: base and first content win, equal is a duplicate, different a conflict.

    The winner per key is a min over the order of the harmless entries; every entry
    meets it in one equi join, which the engine splits when a key is hot.
    """
    rows = entries.withColumns({"_danger": F.coalesce(dangerous, F.lit(False)), "_base": F.coalesce(is_base, F.lit(False))})
    winner = rows.where(~F.col("_danger")).groupBy(*keys).agg(
        F.min(F.struct((~F.col("_base")).alias("nb"), F.col(ord_col).alias("o"), F.col(canon).alias("c"))).alias("_w")
    )
    status = (
        F.when(F.col("_danger"), F.lit("dangerous"))
        .when(F.col("_w.nb") & (F.col("_w.o") == F.col(ord_col)), F.lit("applied"))
        .when(F.col("_w.c").eqNullSafe(F.col(canon)), F.lit("duplicate"))
        .otherwise(F.lit("conflict"))
    )
    return rows.where(~F.col("_base")).join(winner, list(keys), "left").withColumn("status", status).drop("_danger", "_base", "_w")


def internal_conflicts(df: DataFrame, keys: Sequence[str], canon: str, ord_col: str) -> DataFrame:
    """Rows whose content differs from the first row of their key, ignoring case of the key."""
    folded = [F.lower(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*df.columns, *folded)
    first = rows.groupBy(*names).agg(F.min(F.struct(F.col(ord_col).alias("o"), F.col(canon).alias("c"))).alias("_f"))
    return rows.join(first, names).where(~F.col("_f.c").eqNullSafe(F.col(canon))).select(*df.columns, F.col("_f.o").alias("first_ord"))


def redeclarations(
    lines: DataFrame, keys: Sequence[str], is_header: Column, name: Column, order: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Second and later declarations of a name inside the running scope, which each header restarts."""
    rows = lines.withColumns({"_h": F.when(is_header, 1).otherwise(0), "name": name})
    if bucket is None:
        scoped = rows.withColumn("scope_no", F.sum("_h").over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        scoped = running_sum(bucketed(rows, bucket), keys, order, F.col("_h"), "scope_no")
    named = scoped.where(F.col("name").isNotNull())
    first = named.groupBy(*keys, "scope_no", "name").agg(F.min(F.struct(*order)).alias("_first"))
    hit = named.join(first, [*keys, "scope_no", "name"]).where(F.struct(*order) != F.col("_first"))
    return hit.select(*lines.columns, "scope_no", "name")


DECLARED = r"^var\s([^=]*)="


def declared_name(line: Column | str) -> Column:
    t = trim_all(line)
    return F.when(F.startswith(t, F.lit("var ")) & F.contains(t, F.lit("=")), trim_all(F.regexp_extract(t, DECLARED, 1)))


def member_header(line: Column | str) -> Column:
    t = trim_all(line)
    return F.startswith(t, F.lit("public ")) | F.startswith(t, F.lit("private ")) | F.startswith(t, F.lit("protected "))


#: Lines of a file that one task looks at together.
LINES = 1024


def enclosing(lines: DataFrame, keys: Sequence[str], header: Column, max_back: int | None = None, ord_col: str = "line_no", out: str = "test") -> DataFrame:
    """Nearest header at or before each line, with ``max_back`` not farther back than so many lines.

    Files are cut into slices of ``LINES`` lines and the last header of a slice is carried into the next, so one
    long file spreads over tasks.
    """
    held = F.when(F.col("_h").isNotNull(), F.struct(F.col(ord_col).alias("at"), F.col("_h").alias("h")))
    sliced = bucketed(lines.withColumn("_h", header), F.floor(F.col(ord_col) / LINES))
    found = last_known(sliced, keys, [ord_col], held, "_near")
    near = F.col("_near.h") if max_back is None else F.when(F.col(ord_col) - F.col("_near.at") <= max_back, F.col("_near.h"))
    return found.withColumn(out, near).drop("_h", "_near", "_bucket")


def snippets(lines: DataFrame, keys: Sequence[str], before: int = 2, after: int = 3, ord_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """Each line with its surroundings, right-trimmed and joined; ``lines`` are all lines of a file.

    Files are cut into slices of ``LINES`` lines, and the lines at the edge of a slice are copied to its neighbour.
    """
    at = F.col(ord_col)
    copies = lines.withColumn("_slice", F.explode(F.sequence(F.floor((at - after) / LINES), F.floor((at + before) / LINES))))
    w = Window.partitionBy(*keys, "_slice").orderBy(ord_col).rowsBetween(-before, after)
    joined = copies.withColumn("snippet", F.array_join(F.collect_list(rtrim_all(line_col)).over(w), "\n"))
    return joined.where(F.col("_slice") == F.floor(at / LINES)).drop("_slice")


def no_progress_streak(
    evals: DataFrame, chain: Sequence[str], order: Sequence[str], decision: str, bucket: Column, no_progress: str = "REJECT_NO_PROGRESS"
) -> DataFrame:
    """Length of the running streak of no-progress decisions; any other decision resets it to 0.

    Resets number the islands, the streak is the running count minus the count at the
    island's reset. Both running sums are bucketed.
    """
    step = F.when(F.col(decision) == no_progress, 1).otherwise(0)
    rows = running_sum(bucketed(evals, bucket), chain, order, step, "_steps")
    rows = running_sum(rows, chain, order, 1 - step, "_island")
    at_reset = rows.groupBy(*chain, "_island").agg(F.min("_steps").alias("_base"), F.max(1 - step).alias("_has_reset"))
    base = F.when(F.col("_has_reset") == 1, F.col("_base")).otherwise(0)
    return rows.join(at_reset, [*chain, "_island"]).withColumn("streak", F.col("_steps") - base).drop("_steps", "_island", "_base", "_has_reset", "_bucket")


def revisited(evals: DataFrame, chain: Sequence[str], state: str, order: Sequence[str]) -> DataFrame:
    """Whether the state of a row was already seen earlier in its chain; a null state never was."""
    first = evals.groupBy(*chain, state).agg(F.min(F.struct(*order)).alias("_first"))
    return evals.join(first, [*chain, state], "left").withColumn("is_cycle", F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))).drop("_first")


# Format of a ledger entry's hashed material.
ENTRY_SCHEMA = "standard-migration-autonomy-ledger-entry/v1"


def entry_sha(sequence: Column, previous_sha: Column, state_sha: Column, state_base64: Column, schema: str = ENTRY_SCHEMA) -> Column:
    material = F.concat_ws("\n", F.lit(schema), sequence.cast("string"), F.coalesce(previous_sha, F.lit("")), state_sha, state_base64)
    return F.sha2(material, 256)


def verify_chain(entries: DataFrame, anchor: DataFrame, chain: str = "chain") -> DataFrame:
    """Violations of hash-chained ledgers, one row each.

    The predecessor is found by an equi join on (chain, sequence - 1), so a chain of
    any length is checked in parallel. The anchor must name the head entry.
    """
    prev = entries.select(F.col(chain), (F.col("sequence") + 1).alias("sequence"), F.col("entry_sha").alias("_prev_sha"))
    state = F.unbase64("state_base64")
    checks = [
        ("ENTRY_HASH_MISMATCH", entry_sha(F.col("sequence"), F.col("previous_entry_sha"), F.col("state_sha"), F.col("state_base64")) != F.col("entry_sha")),
        ("STATE_HASH_MISMATCH", F.sha2(state, 256) != F.col("state_sha")),
        ("GENESIS_HAS_PREDECESSOR", (F.col("sequence") == 1) & (F.coalesce(F.length("previous_entry_sha"), F.lit(0)) > 0)),
        ("CHAIN_BROKEN", (F.col("sequence") > 1) & (F.coalesce(F.length("previous_entry_sha"), F.lit(0)) == 0)),
        ("PREDECESSOR_MISSING", (F.col("sequence") > 1) & F.col("_prev_sha").isNull()),
        ("PREDECESSOR_MISMATCH", (F.col("sequence") > 1) & (F.col("_prev_sha") != F.col("previous_entry_sha"))),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in checks]), lambda x: x.isNotNull())
    per_entry = entries.join(prev, [chain, "sequence"], "left").select(chain, "sequence", F.explode(found).alias("violation"))
    head = entries.groupBy(chain).agg(F.max(F.struct("sequence", "entry_sha", "state_sha")).alias("_head"))
    a = anchor.select(F.col(chain), F.struct("sequence", "entry_sha", "state_sha").alias("_anchor"))
    per_chain = head.join(a, chain, "full_outer").select(
        chain, F.coalesce("_head.sequence", "_anchor.sequence").alias("sequence"),
        F.when(F.col("_anchor").isNull(), F.lit("ANCHOR_MISSING")).when(F.col("_head").isNull(), F.lit("ENTRY_NOT_FOUND"))
        .when(F.col("_anchor.entry_sha") != F.col("_head.entry_sha"), F.lit("HEAD_MISMATCH"))
        .when(F.col("_anchor.state_sha") != F.col("_head.state_sha"), F.lit("ANCHOR_STATE_MISMATCH")).alias("violation"),
    ).where(F.col("violation").isNotNull())
    return per_entry.unionByName(per_chain)


def latest_by_key(df: DataFrame, key: Column, ts: str) -> DataFrame:
    """Newest row per key (upsert view): a max_by that combines before the shuffle."""
    latest = df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*df.columns), ts).alias("_row"))
    return latest.select("_key", *[F.col(f"_row.{c}").alias(c) for c in df.columns])


def batches(evals: DataFrame, chain: Sequence[str], order: Sequence[str], bucket: Column, budget: int = 5) -> DataFrame:
    """Cycle number in the chain, batch number and position in the batch for a budget per batch."""
    numbered = row_numbers(bucketed(evals, bucket), chain, order, "cycle")
    return numbered.drop("_bucket").withColumns(
        {"batch": (F.floor((F.col("cycle") - 1) / budget) + 1).cast("bigint"), "in_batch": ((F.col("cycle") - 1) % budget + 1).cast("bigint")}
    )


def run_trend(runs: DataFrame, project: Sequence[str], ts: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of sibling runs in time order with the change to the run before. One row per run goes in."""
    w = Window.partitionBy(*project).orderBy(ts)
    return runs.withColumns({f"{m}_delta": F.col(m) - F.lag(m).over(w) for m in metrics})


def family_reference(rows: DataFrame, family: Sequence[str], healthy: Column, ord_col: str) -> DataFrame:
    """Reference row per family: the first healthy one in order, else the first."""
    return rows.groupBy(*family).agg(F.min_by(F.struct(*rows.columns), F.struct(~healthy, F.col(ord_col))).alias("reference"))


def failing_stage(stages: DataFrame, run: Sequence[str], ord_col: str, failed: Column, stage: str) -> DataFrame:
    """First failing stage per run in stage order."""
    return stages.where(failed).groupBy(*run).agg(F.min_by(stage, ord_col).alias("stage"), F.min(ord_col).alias("stage_ord"))
