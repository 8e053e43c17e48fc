"""Run artefacts as JSON, test results as XML, JSONL ledgers, and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import is_blank

CORRUPT = "_corrupt"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def parse_artifacts(
    df: DataFrame, json_col: str, schema: T.StructType, expected_version: str, version_field: str = "schemaVersion"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a column of JSON artefacts: parsed once, version compared by equality."""
    parsed = df.withColumn(
        "_doc", F.from_json(json_col, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    )
    reason = F.when(F.col("_doc").isNull() | F.col(f"_doc.{CORRUPT}").isNotNull(), F.lit("malformed")).when(
        ~F.coalesce(F.col(f"_doc.{version_field}") == expected_version, F.lit(False)), F.lit("version")
    )
    judged = parsed.withColumn("reason", reason)
    fields = [F.col(f"_doc.{f.name}").alias(f.name) for f in schema.fields]
    keep = [c for c in df.columns if c != json_col]
    return judged.where(F.col("reason").isNull()).select(*keep, *fields), judged.where(F.col("reason").isNotNull()).select(*keep, "reason", json_col)


def read_artifact(
    spark: SparkSession, path: str, schema: T.StructType, expected_version: str, glob: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of JSON artefact files, one document per file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return parse_artifacts(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")), "json", schema, expected_version)


def parse_ledger(lines: DataFrame, line_col: str, schema: T.StructType) -> DataFrame:
    """Ledger entries with ``_corrupt`` holding the raw text of lines that are no JSON of the schema."""
    keep = [c for c in lines.columns if c != line_col]
    parsed = lines.where(~is_blank(line_col)).withColumn(
        "_doc", F.from_json(line_col, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    )
    bad = F.when(F.col("_doc").isNull(), F.col(line_col)).otherwise(F.col(f"_doc.{CORRUPT}"))
    return parsed.select(*keep, *[F.col(f"_doc.{f.name}").alias(f.name) for f in schema.fields], bad.alias(CORRUPT))


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.jsonl") -> DataFrame:
    """Append-only JSONL files with file and 1-based line number; malformed lines are kept.

    Files are read by splits, however long they are. Lines are numbered within a split; one row a split carries
    the number of lines before it.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    inside = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_lines")).select("file", "_block", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    numbered = inside.join(before, ["file", "_block"]).select("file", (F.col("_n") + F.col("_before")).alias("line_no"), "line")
    return parse_ledger(numbered, "line", schema)


def repair_ledger(entries: DataFrame, by: Sequence[str] = ("file",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid, rejected, receipt): malformed lines leave the ledger, the receipt counts both per file."""
    bad = F.col(CORRUPT).isNotNull()
    receipt = entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"), F.max_by("line_no", F.when(bad, F.col("line_no"))).alias("last_bad_line")
    )
    return entries.where(~bad).drop(CORRUPT), entries.where(bad).select(*by, "line_no", CORRUPT), receipt


# Attributes of the counters element and the three outcomes they add up to.
COUNTERS = ("total", "passed", "failed", "error", "timeout", "aborted", "notExecuted", "inconclusive", "notRunnable")
FAILED_COUNTERS = ("failed", "error", "timeout", "aborted")
SKIPPED_COUNTERS = ("notExecuted", "inconclusive", "notRunnable")
_COUNTER_TYPE = T.StructType([T.StructField("_" + c, T.StringType()) for c in COUNTERS])
_RUN_TYPE = T.StructType([T.StructField("ResultSummary", T.StructType([T.StructField("Counters", _COUNTER_TYPE)]))])


def read_trx(df: DataFrame, xml_col: str, expected_col: str) -> DataFrame:
    """Test counters of an XML result; missing or odd numbers count as zero."""
    parsed = df.withColumn("_run", F.from_xml(F.col(xml_col), _RUN_TYPE))
    number = lambda name: F.coalesce(F.col(f"_run.ResultSummary.Counters._{name}").try_cast("int"), F.lit(0))
    total = lambda names: sum((number(n) for n in names[1:]), number(names[0]))
    keep = [c for c in df.columns if c not in (xml_col, expected_col)]
    return parsed.select(
        *keep, number("total").alias("total"), number("passed").alias("passed"), total(FAILED_COUNTERS).alias("failed"),
        total(SKIPPED_COUNTERS).alias("skipped"), F.col(expected_col).alias("expected_passed"),
    )


def write_report(df: DataFrame, path: str, run_col: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Report rows partitioned by run; rows of a run spread over files by size, not forced into one.

    Written again, a run replaces itself and leaves the other runs alone; a report without runs is replaced.
    """
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 5_000_000)
    if run_col:
        writer = writer.partitionBy(run_col)
    writer.format(fmt).save(path)
