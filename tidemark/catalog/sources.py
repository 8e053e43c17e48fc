"""Sources and sinks S1-S10 bound to tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.registry import query, table
from tidemark.operators.lines import with_sample
from tidemark.session import checkpoint_dir
from tidemark.sources import artifacts as A
from tidemark.sources import files as S


def fresh_dir(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s01_scan_tree",
    """SELECT 'source=' || source AS folder, sum(length(text) + 1)::BIGINT AS chars, '.txt' AS ext FROM documents
       WHERE source NOT IN ('src3', 'src4') GROUP BY source""",
)
def s01(spark, sf):
    """The corpus written as a tree of text files, then scanned back without two of its folders."""
    root = fresh_dir(spark, "tree")
    table(spark, sf, "documents").select("text", "source").write.partitionBy("source").text(root)
    files = S.scan_tree(spark, root, ["*.txt", "*.cs"], ["source=src3", "SOURCE=SRC4"])
    return files.groupBy(F.regexp_extract("path", "/(source=[^/]+)/", 1).alias("folder"), "ext").agg(F.sum(F.length("text")).alias("chars"))


@query(
    "s02_bounded_sample",
    "SELECT doc_id, text AS sample FROM documents",
)
def s02(spark, sf):
    return with_sample(table(spark, sf, "documents"), None, "text").select("doc_id", "sample")


ARTIFACT = T.StructType(
    [T.StructField("schemaVersion", T.StringType()), T.StructField("status", T.StringType()), T.StructField("total", T.DoubleType())]
)


@query(
    "s03_read_artifact",
    """SELECT o_orderkey, o_orderstatus AS status, NULL AS reason FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0
       UNION ALL SELECT o_orderkey, NULL, CASE WHEN o_orderkey % 11 = 0 THEN 'malformed' ELSE 'version' END FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""",
)
def s03(spark, sf):
    version = F.when(F.col("o_orderkey") % 7 == 0, "run/v2").otherwise("run/v1")
    doc = F.to_json(F.struct(version.alias("schemaVersion"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")))
    cut = F.when(F.col("o_orderkey") % 11 == 0, F.expr("substring(json, 1, length(json) - 5)")).otherwise(F.col("json"))
    src = table(spark, sf, "orders").select("o_orderkey", doc.alias("json")).select("o_orderkey", cut.alias("json"))
    ok, bad = A.parse_artifacts(src, "json", ARTIFACT, "run/v1")
    return ok.select("o_orderkey", "status", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("o_orderkey", F.lit(None).cast("string").alias("status"), "reason")
    )


@query(
    "s03_artifact_files",
    """SELECT source, CASE WHEN source IN ('src3', 'src5') THEN NULL WHEN source = 'src7' THEN NULL ELSE 'ok' END AS status, CASE WHEN source IN ('src3', 'src5') THEN 'version' WHEN source = 'src7' THEN 'malformed' END AS reason,
         CASE WHEN source IN ('src3', 'src5', 'src7') THEN NULL ELSE sum(n_chars)::DOUBLE END AS total FROM documents GROUP BY source""",
)
def s03_files(spark, sf):
    """One run summary a source, each a JSON file of its own, read back as artefacts."""
    folder = fresh_dir(spark, "artifacts")
    totals = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("total"))
    version = F.when(F.col("source").isin("src3", "src5"), "run/v2").otherwise("run/v1")
    doc = F.to_json(F.struct(version.alias("schemaVersion"), F.lit("ok").alias("status"), "total"))
    text = F.when(F.col("source") == "src7", F.concat(F.lit("["), doc)).otherwise(doc)
    totals.select("source", text.alias("value")).write.partitionBy("source").text(folder)
    ok, bad = A.read_artifact(spark, folder, ARTIFACT, "run/v1", "*.txt")
    named = F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    none = lambda kind: F.lit(None).cast(kind)
    return ok.select(named, "status", none("string").alias("reason"), "total").unionByName(bad.select(named, none("string").alias("status"), "reason", none("double").alias("total")))


PROPS = T.StructType([T.StructField("k", T.LongType())])


def ledger_lines(spark, sf):
    broken = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), broken.alias("line"))


@query(
    "s04_ledger_files",
    """SELECT event_type AS source, count(*) AS lines, count(*) FILTER (event_id % 9 = 0) AS malformed, count(*) * (count(*) + 1) // 2 AS line_sum, coalesce(sum((props::JSON->>'k')::BIGINT) FILTER (event_id % 9 <> 0), 0)::BIGINT AS k_sum FROM events GROUP BY 1""",
)
def s04_files(spark, sf):
    """The events as ledgers on disk, one folder a type and one file a folder, read back by splits."""
    folder = fresh_dir(spark, "ledgers")
    lines = ledger_lines(spark, sf).select(F.col("file").alias("source"), "line")
    lines.repartition(8, "source").write.partitionBy("source").option("compression", "none").text(folder)
    entries = A.read_ledger(spark, folder, PROPS, "*.txt")
    return entries.groupBy(F.regexp_extract("file", "source=([^/]+)/", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("lines"), F.count("_corrupt").alias("malformed"), F.sum("line_no").alias("line_sum"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("k_sum"))


@query(
    "s04_read_ledger",
    """SELECT event_type AS file, event_id AS line_no, CASE WHEN event_id % 9 <> 0 THEN (props::JSON->>'k')::BIGINT END AS k,
          CASE WHEN event_id % 9 = 0 THEN '{' || props END AS corrupt FROM events""",
)
def s04(spark, sf):
    return A.parse_ledger(ledger_lines(spark, sf), "line", PROPS).withColumnRenamed("_corrupt", "corrupt")


@query(
    "s05_repair_ledger",
    """SELECT event_type AS file, count(*) AS lines, count(*) FILTER (event_id % 9 <> 0) AS kept, count(*) FILTER (event_id % 9 = 0) AS dropped,
          max(event_id) FILTER (event_id % 9 = 0) AS last_bad_line FROM events GROUP BY event_type""",
)
def s05(spark, sf):
    return A.repair_ledger(A.parse_ledger(ledger_lines(spark, sf), "line", PROPS))[2]


@query(
    "s06_read_trx",
    """SELECT o_orderkey, (o_orderkey % 50)::BIGINT AS total, (o_orderkey % 40)::BIGINT AS passed, (o_orderkey % 3 + o_orderkey % 5 + 1)::BIGINT AS failed,
          (o_orderkey % 4 + 2)::BIGINT AS skipped, (o_orderkey % 40)::BIGINT AS expected_passed FROM orders""",
)
def s06(spark, sf):
    k = F.col("o_orderkey")
    xml = F.format_string(
        '<TestRun id="%d"><Results/><ResultSummary outcome="Completed"><Counters total="%d" passed="%d" failed="%d" error="%d" timeout="1" '
        'aborted="x" notExecuted="%d" inconclusive="2"/></ResultSummary></TestRun>', k, k % 50, k % 40, k % 3, k % 5, k % 4,
    )
    src = table(spark, sf, "orders").select("o_orderkey", xml.alias("xml"), (k % 40).alias("expected"))
    out = A.read_trx(src, "xml", "expected")
    return out.select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in ("total", "passed", "failed", "skipped", "expected_passed")])


PAGE_EVIDENCE = (("trace", (".html",), ("m.", "blog")), ("feed", (".net", ".com"), ("zzz",)), ("deep", (".html",), ("http",)))


@query(
    "s07_index_evidence",
    """SELECT page_id, CASE WHEN contains(lower(url), 'm.') OR contains(lower(url), 'blog') THEN 'trace' ELSE 'deep' END AS kind FROM pages
       WHERE regexp_extract(lower(rtrim(url, '/')), '(\\.[^./]+)$', 1) = '.html'""".replace("\\\\", "\\"),
)
def s07(spark, sf):
    return S.index_evidence(table(spark, sf, "pages"), PAGE_EVIDENCE, "url").select("page_id", "kind")


@query(
    "s08_latest_artifacts",
    """SELECT role, (conv_id % 40)::BIGINT AS slot, max_by(md5(text), (turn, conv_id)) AS path, max((turn, conv_id))[1] AS newest_turn, max((turn, conv_id))[2] AS newest_conv,
          count(*) AS candidates, count(*) > 1 AS ambiguous FROM conversations GROUP BY 1, 2""",
)
def s08(spark, sf):
    files = table(spark, sf, "conversations").select(
        "role", (F.col("conv_id") % 40).alias("slot"), F.struct("turn", "conv_id").alias("t"), F.md5("text").alias("p")
    )
    found = S.latest_artifacts(files, ["role", "slot"], "t", "p")
    return found.select("*", F.col("ts.turn").alias("newest_turn"), F.col("ts.conv_id").alias("newest_conv")).drop("ts")


@query(
    "s09_catalog",
    """WITH s AS (SELECT CASE WHEN n_chars % 20 = 0 THEN '' ELSE (CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END) || '-' || (n_chars % 100) END AS id FROM documents)
    SELECT CASE WHEN lower(id) = '' THEN 'missing-id' ELSE 'duplicate-id' END AS code, lower(id) AS id, count(*) AS n, min(id) AS example
    FROM s GROUP BY lower(id) HAVING lower(id) = '' OR count(*) > 1""",
)
def s09(spark, sf):
    sid = F.expr("CASE WHEN n_chars % 20 = 0 THEN '' ELSE concat(CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END, '-', n_chars % 100) END")
    return S.catalog(table(spark, sf, "documents").select(sid.alias("id")))[1]


@query(
    "s10_write_report",
    "SELECT o_orderstatus AS run_id, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def s10(spark, sf):
    """Rows written as JSON by run, then read back from the partitioned folder."""
    out = fresh_dir(spark, "report")
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("run_id"), "o_orderkey", "o_totalprice")
    A.write_report(rows, out, "run_id", "json")
    back = spark.read.schema("run_id string, o_orderkey bigint, o_totalprice double").json(out)
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
