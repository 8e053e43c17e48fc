"""Failures linked to generated files and sources in stages; lookups that repeated rows must not multiply."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators.linking import NO_TEST_TOKENS, link_failures, origin_lines, resolve_frames
from tidemark.operators.facts import extract_types
from tidemark.operators.ordered import bucketed, last_known
from tidemark.operators.trees import flatten_actions
from tidemark.operators.windows import enclosing, snippets

GENERATED = [
    (1, "gen/pages/LoginPage.cs", "LoginPage", "using x;\nOpen(); // Original: open() // line 12\nClick();\nFill(); // Original: fill() // line 30"),
    (2, "gen/tests/CheckoutTests.cs", "CheckoutTests", "class CheckoutTests { void PaysByCard() {} }\n// Original: a // line 7"),
    (3, "other/tests/CheckoutTests.cs", "CheckoutTests", None),
    (4, "gen/Empty.cs", "Empty", ""),
]
REPORTS = [(1, "run of LoginPage.cs, no source"), (2, "LoginPage.cs\nSource file: `src/Login.cs`"), (3, '{"test": "PaysByCard", "sourceFilePath": "src/Pay.cs"}'), (4, "Source file: src/Other.cs"), (5, None)]
OBS = [
    (10, "Failed Test", "boom\n   at A() in C:\\build\\gen\\pages\\LoginPage.cs:line 3\n  at B() in gen/Empty.cs:line 1"),
    (11, "PaysByCard failed", "no frame"),
    (12, "nothing known here", None),
    (13, None, "x in tests/CheckoutTests.cs:line 9"),
    (14, "error", "at C() in /else/Unknown.cs:line 5"),
    (15, "Empty error", " in gen/Empty.cs:line 99999999999"),
    (16, "", ""),
]


def tables(spark):
    return (
        spark.createDataFrame(OBS, "obs int, words string, snippet string"), spark.createDataFrame(GENERATED, "file int, path string, name string, text string"),
        spark.createDataFrame(REPORTS, "report int, text string"))


def test_links_in_stages(spark):
    """Also with repeated rows, and 300 more files of a name: neither multiplies a link or changes it."""
    obs, generated, reports = tables(spark)
    more = spark.range(100, 400).select(F.col("id").cast("int").alias("file"), F.concat(F.lit("p"), "id", F.lit("/CheckoutTests.cs")).alias("path"), F.lit("CheckoutTests").alias("name"), F.lit("PaysByCard").alias("text"))
    rows = link_failures(obs.unionByName(obs), generated.unionByName(generated.limit(2)).unionByName(more), reports.unionByName(reports)).collect()
    got = {r.obs: tuple(r)[1:] for r in rows}
    assert len(rows) == len(got) and got == {
        10: ("frame", 1, "gen/pages/LoginPage.cs", 3, 2, "src/Login.cs", None),
        11: ("token", 2, "gen/tests/CheckoutTests.cs", None, 3, "src/Pay.cs", None),
        13: ("frame", 2, "gen/tests/CheckoutTests.cs", 9, None, None, 7),
        14: ("frame", None, "/else/Unknown.cs", 5, None, None, None),
        15: ("name", 4, "gen/Empty.cs", None, None, None, None),
    }


def test_origin_is_the_nearest_mark_above(spark):
    _, generated, _ = tables(spark)
    asked = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4, 50, None)] + [(3, 1)], "file int, line int")
    assert {r.line: r.source_line for r in origin_lines(asked, generated).collect()} == {1: 12, 2: 12, 3: 12, 4: 30, 50: 30, None: 12}
    assert {r.source_line for r in origin_lines(asked, generated, nearest=False).collect()} == {12}


def test_no_files_leave_the_frames(spark):
    obs, generated, reports = tables(spark)
    assert {r.obs for r in link_failures(obs, generated.limit(0), reports.limit(0)).collect()} == {10, 13, 14}


@pytest.mark.parametrize("depth", [None, 2])
def test_frames_against_brute_force(spark, depth):
    parts = ["a", "B", "c", "x.cs", "y.cs"]
    paths = sorted({"/".join(parts[(i * k) % 4] for k in range(1, n + 1)) + "/" + parts[3 + i % 2] for i in range(7) for n in range(4)})
    frames = ["C:\\r\\" + p.replace("/", "\\").upper() for p in paths[:9]] + ["./x.cs", "b/y.cs", "q/y.cs", "none.cs"]
    cut = lambda p: [s for s in re.split(r"[\\/]", p.lower()) if s not in ("", ".")]

    def best(frame):
        f, found = cut(frame), []
        for i, p in enumerate(paths):
            s = cut(p)
            n = min(len(f), len(s), depth or 99)
            if f[-n:] == s[-n:] and (n == len(f) or n == len(s) or n == depth):
                found.append((-n, i))
        return min(found)[1] if found else None

    known = spark.createDataFrame(list(enumerate(paths)), "file int, path string")
    got = {r.frame: r.file for r in resolve_frames(spark.createDataFrame([(f,) for f in frames], "frame string"), known, depth).collect()}
    assert got == {f: best(f) for f in frames if best(f) is not None}


def test_last_known_across_buckets(spark):
    rows = [("k", i, i if i % 37 == 5 else None) for i in range(300)] + [("other", 5, None)]
    df = bucketed(spark.createDataFrame(rows, "key string, at int, mark int").repartition(4), F.floor(F.col("at") / 16))
    got = {(r["key"], r["at"]): r["near"] for r in last_known(df, ["key"], ["at"], F.col("mark"), "near").collect()}
    assert got == {(k, i): max((j for j in range(5, i + 1, 37)), default=None) if k == "k" else None for k, i, _ in rows}


def test_lookups_do_not_multiply(spark):
    calls = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "a", False)], "id int, callee string, resolved boolean")
    methods = spark.createDataFrame([("a",), ("a",)], "symbol string")
    assert sorted((r.id, r.state) for r in J.resolve_calls(calls, methods).collect()) == [(1, "in-source"), (2, "external"), (3, "unresolved")]
    variants = spark.createDataFrame([("V1",), ("v2",)], "id string")
    run = spark.createDataFrame([("v1", 3), ("V1", 2)], "id string, n int")
    assert sorted((r.id, r.missing, r.run and r.run.n) for r in J.variants_with_run(variants, run, "id").collect()) == [("V1", False, 2), ("v2", True, None)]
    side = "k int, behavior int, assertions int, cases int"
    src = spark.createDataFrame([(1, 2, 2, 1), (2, 1, 1, 1), (2, 1, 1, 1)], side)
    tgt = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 0, 0)], side)
    assert sorted(r.category for r in J.loss_checks(src, tgt, ["k"]).collect()) == ["AssertionLoss", "VacuumTest"]
    base = spark.createDataFrame([(0, "s", "z"), (1, "s", "a")], "at int, id string, contract_hash string")
    got = lambda **o: [(r.id, r.reason) for r in J.contract_changes(base.where("at = 0"), base, **o).collect()]
    assert got(ord_col="at") == [] and got() == [("s", "contract-changed")]


def test_long_files_are_sliced(spark):
    texts = {n: f"line {n} " for n in range(1, 2601)}
    rows = [(f, n, t) for f in ("one", None) for n, t in texts.items()]
    lines = spark.createDataFrame(rows, "file string, line_no int, line string").repartition(5)
    got = {(r.file, r.line_no): r.snippet for r in snippets(lines, ["file"]).collect()}
    assert got == {(f, n): "\n".join(texts[k].rstrip() for k in range(n - 2, n + 4) if k in texts) for f, n, _ in rows}
    head = F.when(F.col("line_no") % 700 == 20, F.col("line_no"))
    for back in (None, 18):
        near = {(r.file, r.line_no): r.test for r in enclosing(lines, ["file"], head, back).collect()}
        want = lambda n: max((k for k in range(20, n + 1, 700) if back is None or n - k <= back), default=None)  # noqa: B023, E731
        assert near == {(f, n): want(n) for f, n, _ in rows}


def test_types_of_a_long_file(spark):
    text = ["namespace A.B"] + ["x();"] * 1500 + ["[One]", "", "[Two]", "class C : Base {"] + ["y();"] * 1021 + ["[Three]", "class D"]
    lines = spark.createDataFrame([(i + 1, t) for i, t in enumerate(text)], "line_no int, line string").withColumn("file", F.lit(None).cast("string"))
    got = [(r.class_name, r.base_class, r.namespace, r.attributes) for r in extract_types(lines, ["file"]).orderBy("line_no").collect()]
    assert got == [("C", "Base", "A.B", ["One", "Two"]), ("D", None, "A.B", ["Three"])]


def test_malformed_action_trees_become_rows(spark):
    docs = [(1, '[{"kind":"a","then":[{"kind":"b"}]}]'), (2, "{bad"), (3, '{"kind":"a"}'), (4, '[{"kind":"a","body":[3]}]'), (5, '[{"kind":"a","else":"x"}]'), (6, None), (7, "")]
    got = sorted((r.id, r.kind, list(r.action_path)) for r in flatten_actions(spark.createDataFrame(docs, "id int, j string"), "j", ["id"]).collect())
    assert got == [(1, "a", [0]), (1, "b", [0, 0]), *[(i, "malformed", []) for i in (2, 3, 4, 5)]]


def test_stop_words():
    assert NO_TEST_TOKENS == ("failed", "passed", "test", "name", "error")


def test_names_offer_their_own_parts(spark):
    """Names are looked up by the words they may hold, first file of each, and never compared with the words of the tests."""
    from tidemark.operators.linking import _first_by_token

    rows = [(2, "LoginPage", "x"), (1, "9abcd é_Pages", None), (3, "LoginPage", "login"), (0, None, "pages")]
    got = {r.token: (r.first.file, r.first.stage) for r in _first_by_token(spark.createDataFrame(rows, "file int, name string, text string")).collect()}
    assert got["abcd"] == (1, "name") and got["_pages"] == (1, "name") and got["pages"] == (0, "token") and got["inpa"] == (2, "name") and got["login"] == (2, "name")
    assert "9abcd" not in got and "log" not in got and len([t for t in got if t.startswith("l")]) == 6
