"""Target project inventory and call-graph statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import tree_digest
from tidemark.functions.text import half_even
from tidemark.operators.aggregates import frequency_confidence
from tidemark.operators.facts import LOCATOR_ATTRIBUTES, USING_LINE, extract_target_facts, extract_types
from tidemark.operators.joins import resolve_calls

# Test attributes that show a framework.
FRAMEWORK_ATTRIBUTES = {
    "NUnit": ("[TestFixture]", "[Test]", "[SetUp]", "[OneTimeSetUp]", "[TearDown]", "[Parallelizable]", "[TestCase]", "[TestCaseSource]", "[Explicit]"),
    "xUnit": ("[Fact]", "[Theory]", "[Trait]", "[Collection]", "IXunitTestCase", "ITheoryTestDiscoverer"),
    "MSTest": ("[TestMethod]", "[TestInitialize]", "[TestCleanup]", "[ClassInitialize]", "[ClassCleanup]", "[TestClass]"),
}


def framework_evidence(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Evidence lines per framework with a confidence: three make it high."""
    hits = F.filter(
        F.array(*[F.when(F.greatest(*[F.contains("line", F.lit(a)) for a in attrs]), F.lit(name)) for name, attrs in FRAMEWORK_ATTRIBUTES.items()]), lambda x: x.isNotNull()
    )
    found = lines.select(*by, F.explode(hits).alias("name"), F.lit(1).alias("n"))
    return frequency_confidence(found, [*by, "name"], "n", high=3, medium=1)


def target_inventory(files: DataFrame, lines: DataFrame, keys: Sequence[str], text_col: str = "text", attributes: Sequence[str] = LOCATOR_ATTRIBUTES) -> DataFrame:
    """One long table (kind, name, n, confidence): frameworks, base classes, namespaces, usings, locator and authentication signs.

    Each part aggregates on its own small vocabulary; texts are read once per part and
    never shuffled.
    """
    row = lambda df, kind, name, n, conf: df.select(F.lit(kind).alias("kind"), name.alias("name"), n.cast("bigint").alias("n"), conf.alias("confidence"))
    types = extract_types(lines, keys)
    # base classes and namespaces from one pass over the types
    told = types.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in (("base-class", "base_class"), ("namespace", "namespace"))])).alias("t")).select("t.*")
    declared = told.where((F.col("kind") == "base-class") & F.col("name").isNotNull() | (F.length("name") > 0)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    using = lines.select(F.regexp_extract("line", USING_LINE, 1).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    facts = extract_target_facts(files, keys, text_col, attributes)
    freq = frequency_confidence(facts, ["kind", "name"], "n")
    none = F.lit("-")
    parts = [
        row(framework_evidence(lines), "framework", F.col("name"), F.col("n"), F.col("confidence")),
        declared.withColumn("confidence", F.when(F.col("kind") == "namespace", none).when(F.col("n") >= 3, "High").otherwise("Medium")),
        row(using, "using", F.col("name"), F.col("n"), none),
        freq.select("kind", "name", F.col("n").cast("bigint").alias("n"), "confidence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def call_graph_stats(calls: DataFrame, methods: DataFrame, by: Sequence[str]) -> DataFrame:
    """Resolved ratio, in-source share, awaited calls and distinct callees per project.

    calls(by..., caller, callee, resolved, awaited), methods(symbol).
    """
    edges = resolve_calls(calls, methods)
    per_callee = edges.groupBy(*by, "callee").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("r"), F.count_if("in_source").alias("s"), F.count_if("awaited").alias("a")
    )
    agg = per_callee.groupBy(*by).agg(
        F.sum("n").alias("calls"), F.sum("r").alias("resolved"), F.sum("s").alias("in_source"), F.sum("a").alias("awaited"), F.count(F.lit(1)).alias("callees"),
        F.max(F.struct("n", "callee")).alias("_top"),
    )
    ratio = lambda c: half_even(F.col(c) * 1.0 / F.col("calls"), 4)
    return agg.select(
        *by, "calls", "resolved", "in_source", "awaited", "callees", ratio("resolved").alias("resolved_ratio"), ratio("in_source").alias("in_source_ratio"),
        F.col("_top.callee").alias("top_callee"), F.col("_top.n").alias("top_fan_in"),
    )


def index_digest(calls: DataFrame, by: Sequence[str], edge: Sequence[str]) -> DataFrame:
    """Identity of a call index: an order-free digest over its edges."""
    return tree_digest(calls.select(*by, F.concat_ws(">", *[F.col(c).cast("string") for c in edge]).alias("path"), F.lit("").alias("text")), by)
