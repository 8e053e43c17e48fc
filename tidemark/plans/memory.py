"""Project memory: recall for targets, and the health check of its ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import file_name, slashes
from tidemark.functions.predicates import unsafe_suppression
from tidemark.functions.text import is_blank
from tidemark.operators.literals import literal_hits
from tidemark.operators.ranking import rank_of
from tidemark.operators.windows import latest_by_key
from tidemark.sources.artifacts import CORRUPT

# Order in which recalled kinds are shown.
RECALL_PRIORITY = {"antipattern": 0, "warning": 1, "constraint": 2, "decision": 3, "preference": 4}


def recall(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Entries that speak of a target's path or file name, in text or scope, with their priority.

    entries(entry_id, kind, text, scope, is_global), targets(target_id, path). Global
    entries hold for every target alike: they come once, with a null target, instead of
    being multiplied by it.
    """
    local = entries.where(~F.col("is_global"))
    hay = local.select("entry_id", F.concat_ws("\n", slashes("text"), slashes("scope")).alias("_hay"))
    wanted = targets.select("target_id", F.explode(F.array_distinct(F.array(F.trim(slashes("path")), file_name("path")))).alias("_key"))
    keyed = wanted.where(~is_blank("_key")).withColumn("_rule", F.struct("target_id", "_key"))
    hits = literal_hits(hay, "entry_id", "_hay", keyed.select("_rule", "_key"), "_rule", "_key", ignore_case=True)
    matched = hits.select(F.col("_rule.target_id").alias("target_id"), "entry_id").distinct()
    everywhere = entries.where("is_global").select(F.lit(None).cast(matched.schema["target_id"].dataType).alias("target_id"), "entry_id")
    details = entries.select("entry_id", "kind", "text", "scope", rank_of("kind", RECALL_PRIORITY, 5).alias("priority"))
    return matched.unionByName(everywhere).join(details, "entry_id")


def recall_receipts(receipts: DataFrame) -> DataFrame:
    """Latest receipt per file, ignoring case and separator."""
    return latest_by_key(receipts, F.lower(F.trim(slashes("file"))), "recorded_at")


# Kinds that need selector evidence and statuses that end an entry.
REQUIRED_FIELDS = ("id", "kind", "text")
SELECTOR_KINDS = ("selector",)
DEPRECATED = "deprecated"


def doctor(entries: DataFrame, by: Sequence[str] = ("file",), required: Sequence[str] = REQUIRED_FIELDS, unsafe: Column | None = None) -> DataFrame:
    """Findings per entry: malformed line, missing field, unsafe or deprecated entry that is active, selector without evidence."""
    missing = F.lit(False)
    for field in required:
        missing = missing | is_blank(field)
    ok = F.col(CORRUPT).isNull()
    risky = unsafe_suppression("text") if unsafe is None else unsafe
    found = F.array(
        F.when(~ok, F.lit("malformed-line")),
        F.when(ok & missing, F.lit("missing-field")),
        F.when(ok & F.col("is_active") & risky, F.lit("active-assertion-suppression")),
        F.when(ok & F.col("is_active") & (F.lower("status") == DEPRECATED), F.lit("deprecated-active")),
        F.when(ok & F.col("kind").isin(*SELECTOR_KINDS) & (F.coalesce(F.size("evidence"), F.lit(0)) == 0), F.lit("selector-without-evidence")),
    )
    return entries.select(*by, "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("check"))
