"""Hand-computed values for the formulas."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, predicates as P, text as X
from tidemark.operators import aggregates as A, lines as L, ranking as T
from tidemark.operators.facts import mask_code
from tidemark.plans import comparing as C, quality as Q, remediation as R
from tidemark.plans.configs import escapes
from tidemark.plans.failures import failure_category, infra_markers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "path,glob,hit",
    [
        ("src/a/Foo.cs", "*.cs", True), ("src/a/Foo.cs", "foo.CS", True), ("src/a/Foo.cs", "a/*.cs", True), ("src/a/b/Foo.cs", "a/*.cs", False),
        ("src/a/b/Foo.cs", "a/**/*.cs", True), ("src/a/Foo.cs", "a/**/*.cs", True), ("C:\\src\\Foo.cs", "C:/src/*.cs", True), ("x/C:/src/Foo.cs", "C:/src/*.cs", False),
        ("src/Foo.cs", "/src/*.cs", False), ("src/Fo.cs", "src/F?.cs", True), ("a+b/x.cs", "a+b/*.cs", True), ("src/a", "", False),
    ],
)
def test_glob(spark, path, glob, hit):
    assert one(spark, paths.glob_match("p", glob), p=path) is hit


@pytest.mark.parametrize(
    "path,base,want",
    [
        ("/repo/src/a.cs", "/repo", "src/a.cs"), ("/other/a.cs", "/repo", "a.cs"), ("C:\\Repo\\src\\a.cs", "c:/repo", "src\\a.cs"), ("/repo/a.cs", None, "a.cs"), ("/repository/a.cs", "/repo", "a.cs"),
    ],
)
def test_safe_path(spark, path, base, want):
    assert one(spark, paths.safe_path("p", base), p=path) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ('a.b("x//y"); // c\nd', 'a.b(      );     \nd'), ("/* a\n b */c", "    \n     c"), ("x = 'it\\'s' + y", "x =         + y"), ('"open\nend', "     \n   "), ("a / b", "a / b"), ("/* open", "       "),
    ],
)
def test_mask_code(spark, text, want):
    assert one(spark, mask_code("t"), t=text) == want


def test_text_functions(spark):
    assert one(spark, X.values_match("a", "b"), a=" 'XPath=//a' ", b="//A") is True
    assert one(spark, X.values_match("a", "b"), a=" ", b=" ") is False
    assert one(spark, X.kebab("a"), a="SourceTestABC") == "source-test-a-b-c"
    assert one(spark, X.screaming_snake("a"), a="PassWithWarningsABC") == "PASS_WITH_WARNINGS_ABC"
    assert one(spark, X.residual_message("a"), a="Bad  thing At line 12 [TAG-SOURCE-LINE:7]") == "bad thing at line * [tag-source-line:*]"
    assert one(spark, X.source_line("a"), a="x(); // line 42") == 42
    assert one(spark, X.parameterized_pattern("a"), a=["p.Do(1, 2)", "p.Do(3,4)"]) == "p.Do({arg0}, {arg1})"
    assert one(spark, X.parameterized_pattern("a"), a=["p.Do(1)", "p.Do(1)"]) == "p.Do(1)"
    assert one(spark, X.redaction_count("a"), a="x(\"https://h/p\", 'deadbeefdeadbeefdeadbeefdeadbeef')") == 2
    assert one(spark, X.half_even("a", 2), a=2.125) == 2.12
    assert one(spark, X.is_ordered_subsequence(F.array(F.lit("a"), F.lit("b")), "s"), s=["b", "a", "x", "b"]) is True
    assert one(spark, X.is_ordered_subsequence(F.array(F.lit("a"), F.lit("b")), "s"), s=["b", "a"]) is False
    assert one(spark, X.json_unescape("a"), a='q\\"\\u0041') == 'q"A'
    assert X.placeholder_regex("Foo({x}, {y_1})") == r"Foo\(.+?,\ .+?\)"


def test_predicates(spark):
    assert one(spark, P.unsafe_suppression("a"), a="Suppress Assert calls") is True
    assert one(spark, P.unsafe_suppression("a"), a="never suppress Assert calls") is False
    assert one(spark, P.dangerous_rule("s", "b"), s="suppressedmethodpatterns", b="Check.Should (") == "assertion-suppression"
    assert one(spark, P.evidence_kind("p"), p="out/test-results/A.PNG") == "screenshot"
    assert one(spark, P.evidence_kind("p"), p="out/a.txt") is None
    assert one(spark, P.allowed_path("p", ["src"]), p="SRC\\a.cs") is True
    assert one(spark, P.allowed_path("p", ["src"]), p="srcs/a.cs") is False
    assert one(spark, escapes(F.col("p")), p="a/../../b") is True
    assert one(spark, escapes(F.col("p")), p="a/../b") is False


@pytest.mark.parametrize(
    "line,category",
    [
        ("Error: strict mode violation: locator", "strict-mode-violation"), ("waiting for locator('#a')", "locator-not-found"), ("expect(x).toHaveText", "assertion-mismatch"), ("Timeout at page.goto", "navigation-route-missing"),
        ("timed out", "timeout-wait-state"), ("HTTP 404", "navigation-route-missing"), ("status 401", "auth/session-not-ready"), ("ECONNREFUSED", "environment/flaky-infra"), ("all fine", None), ("playwright exception", "unclassified-runtime-failure"),
    ],
)
def test_failure_cascade(spark, line, category):
    assert one(spark, failure_category("l"), l=line) == category


def test_infra_markers_respect_the_stage(spark):
    assert one(spark, infra_markers("t", "s"), t="Connection timed out", s="SourceTest") is False
    assert one(spark, infra_markers("t", "s"), t="Connection timed out", s="TargetBuild") is True
    assert one(spark, infra_markers("t", "s"), t="Session not created", s="TargetTest") is True


@pytest.mark.parametrize(
    "counts,level",
    [
        ((9, 1, 0, 2, 10), "near_ready"), ((0, 0, 0, 0, 1), "clean"), ((8, 2, 0, 0, 10), "needs_profile_iteration"), ((1, 9, 0, 0, 10), "needs_discovery"), ((10, 0, 2, 0, 10), "needs_profile_iteration"),
    ],
)
def test_quality_level(spark, counts, level):
    df = spark.createDataFrame([counts], "mapped int, unmapped int, unsupported int, todo int, total_tests int")
    assert A.quality_level(df).first()["level"] == level


def test_impact_and_priority(spark):
    df = spark.createDataFrame([(10, 2, True), (3, 1, False), (1, 1, False)], "occ int, files int, blocker boolean")
    rows = T.impact_score(df, "occ", "files", F.col("blocker")).collect()
    assert [(r["score"], r["priority"]) for r in rows] == [((20 + 10) * 3 + 20, "High"), (6 + 5 + 5, "Medium"), (2 + 5, "Low")]


def test_todo_codes(spark):
    df = spark.createDataFrame(
        [("  // TODO: x [TAG:ROW_X]",), ("// TODO: Raw Statement y",), ("// TODO: other",), ("/// TODO: no",), ("// TODO: missing mapping z  ",)], "line string"
    )
    assert [r["code"] for r in L.extract_todos(df).collect()] == ["ROW_X", "RAW_STATEMENT", "UNCATEGORIZED_TODO", "MISSING_MAPPING"]


def test_gate_exit_codes(spark):
    cols = "syntax page_todo todo unsupported unmapped raw scope_warnings placeholders literals leaks config_errors preservation_errors".split()
    gates = [g for g in Q.GATE_DEFAULTS]
    schema = ", ".join([f"{c} int" for c in cols] + [f"{g} {'int' if g.startswith('max') else 'boolean'}" for g in gates])
    row = lambda **kw: tuple(kw.get(c, 0) for c in cols) + tuple(kw.get(g) for g in gates)
    df = spark.createDataFrame([row(), row(todo=1), row(todo=1, max_todo=1), row(leaks=1, todo=5), row(syntax=1, config_errors=1), row(syntax=1, fail_on_syntax=False), row(preservation_errors=1)], schema)
    assert [r["exit_code"] for r in Q.quality_gate(df).collect()] == [0, 1, 0, 2, 3, 0, 1]


def test_suite_exit_codes(spark):
    df = spark.createDataFrame([("a", "Pass", "Pass"), ("b", "Pass", "SourceInvalid"), ("b", "Pass", "Regression"), ("c", "Pass", "PassWithWarnings")], "s string, expected_status string, actual_status string")
    assert {r["s"]: r["exit_code"] for r in A.suite_exit_code(df, ["s"]).collect()} == {"a": 0, "b": 10, "c": 10}


def test_duration_rule_needs_both_limits(spark):
    base = dict(id="x", expected_status="Pass", actual_status="Pass", contract_hash="h", todo=0, unmapped=0, unsupported=0, warnings=0, source_passed=1, source_expected=1, target_passed=1, target_expected=1, quality_passed=True,
                oracle_passed=True, diagnostics=["d"], checks=["c"], semantic_hash="s")
    def kind(before, after):
        mk = lambda ms: spark.createDataFrame([{**base, "duration_ms": ms}])
        return C.snapshot_diff(mk(before), mk(after)).first()["kind"]

    assert kind(1000, 1900) == "Unchanged"
    assert kind(10000, 11500) == "Unchanged"
    assert kind(4000, 5100) == "Regressed"
    assert kind(5100, 4000) == "Improved"


def test_residual_identity_moves_with_the_source_line(spark):
    schema = "run string, ord int, category string, severity string, message string, source_file string, source_line int, generated_file string, generated_line int"
    rows = [("r", 1, "Todo", "Warning", "m at line 3", "a.cs", 5, "g.cs", 9), ("r", 2, "todo", "Warning", "M  at line 8", "a.cs", 5, "g.cs", 77), ("r", 3, "Todo", "Info", "m at line 3", "a.cs", 6, "g.cs", 9), ("r", 4, "PageTodo", "", "m", None, None, "g.cs", 9)]
    out = R.residual_inventory(spark.createDataFrame(rows, schema), ["run"]).collect()
    assert len(out) == 3
    merged = [r for r in out if r["issues"] == 2][0]
    assert merged["generated_line"] == 77 and not merged["progress_bearing"]
    assert [r["progress_bearing"] for r in out if r["category"] == "PageTodo"] == [True]


def test_case_forms_take_whole_names(spark, tmp_path):
    from tidemark.catalog.scalars import x20

    spark.createDataFrame([(1, "a" * 150 + " z", "B", "C")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert x20(spark, str(tmp_path)).first().screaming == "A" * 150 + " Z_BC"
