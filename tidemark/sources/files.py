"""Source trees and evidence files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import extension, file_name, in_ignored_dir
from tidemark.functions.predicates import EVIDENCE_RULES, evidence_kind

# Folders a source scan leaves out.
IGNORED_DIRS = ("bin", "obj", "migration", ".migration", "generated")


def _pattern(globs: Sequence[str]) -> str:
    return globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"


def scan_tree(spark: SparkSession, root: str, globs: Sequence[str] = ("*",), ignored_dirs: Sequence[str] = IGNORED_DIRS) -> DataFrame:
    """One row per text file below ``root``: path, ext, size_bytes, modified_at, text.

    The glob prunes the listing before anything is read; files are spread over
    tasks by size. Ignored folders drop out on the path alone.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _pattern(globs)).text(root, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size_bytes"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
            F.col("value").alias("text"),
        )
    )
    return files.where(~in_ignored_dir("path", ignored_dirs)).withColumn("ext", extension("path"))


def scan_binaries(spark: SparkSession, root: str, globs: Sequence[str] = ("*",)) -> DataFrame:
    """Path, size and time of every file; the content column is pruned, so no bytes are read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _pattern(globs)).load(root)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    )


def index_evidence(files: DataFrame, rules=EVIDENCE_RULES, path_col: str = "path") -> DataFrame:
    """Evidence files with their kind, from extension and path hints only."""
    return files.withColumn("kind", evidence_kind(path_col, rules)).where(F.col("kind").isNotNull())


def latest_artifacts(files: DataFrame, name_cols: Sequence[str], ts_col: str, path_col: str) -> DataFrame:
    """Newest candidate per name, how many there were, and whether the choice is ambiguous.

    A max over (time, path) combines before the shuffle. Our rule where the source of
    truth is silent: more than one candidate is reported as ambiguous, ties on time go
    to the greatest path.
    """
    return files.groupBy(*name_cols).agg(
        F.max(F.struct(F.col(ts_col).alias("ts"), F.col(path_col).alias("path"))).alias("_m"), F.count(F.lit(1)).alias("candidates")
    ).select(*name_cols, F.col("_m.path").alias("path"), F.col("_m.ts").alias("ts"), "candidates", (F.col("candidates") > 1).alias("ambiguous"))


def catalog(scenarios: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Scenarios with a usable id, and the issues of the corpus: missing ids, duplicates, nothing at all."""
    key = F.lower(F.trim(F.coalesce(F.col(id_col), F.lit(""))))
    keyed = scenarios.withColumn("_key", key)
    per_key = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("example"))
    issues = per_key.where((F.col("_key") == "") | (F.col("n") > 1)).select(
        F.when(F.col("_key") == "", "missing-id").otherwise("duplicate-id").alias("code"), F.col("_key").alias("id"), "n", "example"
    )
    empty = scenarios.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("empty-corpus").alias("code"), F.lit("").alias("id"), "n", F.lit(None).cast("string").alias("example")
    )
    return keyed.where(F.col("_key") != "").drop("_key"), issues.unionByName(empty)


__all__ = ["scan_tree", "scan_binaries", "index_evidence", "latest_artifacts", "catalog", "file_name", "IGNORED_DIRS"]
