"""What must hold whatever the partitioning: brute force, skew, order, duplicates."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import tree_digest
from tidemark.operators import ordered as O, windows as W
from tidemark.operators.joins import match_evidence
from tidemark.operators.literals import identifier_hits, literal_hits, placeholder_hits
from tidemark.operators.ranking import covering_slice

TEXTS = [
    "page.Login(user);\npage.LoginForm.Open(1)", "the Login page (v2) => done", "a.b.c d_e-f  g", "éa.béc ünder x", "aaaa aaa aa a", "x+y=z; x + y = z", "", "no match here", "Open(1, 2) Open(3)\nOpen(x)", "tab\tsep", "über.Login",
]
KEYS = ["Login", "page.Login", "(v2)", "=>", "a.b", "b.c d", "aa", "a", "x+y", " + ", "Open(", "e-f", "éa.b", "\t", "LoginForm.Open", "page (v2) => done", "gin f", "ogi", ".", "zzz", "n(1)\n", "d_e"]


def frames(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    rules = spark.createDataFrame(list(enumerate(KEYS)), "rid long, key string")
    return texts, rules


@pytest.mark.parametrize("fold", [False, True])
def test_literal_hits_equal_brute_force(spark, fold):
    f = (lambda s: s.lower()) if fold else (lambda s: s)
    want = {(r, i, f(t).count(f(k)), f(t)[: f(t).find(f(k))].count("\n") + 1) for r, k in enumerate(KEYS) for i, t in enumerate(TEXTS) if f(k) in f(t)}
    texts, rules = frames(spark)
    got = literal_hits(texts, "id", "text", rules, "rid", "key", fold)
    assert {tuple(r) for r in got.select("rid", "id", "hits", "first_line").collect()} == want


def test_literal_hits_of_repeated_texts_and_shared_keys(spark):
    """Every row of a text gives its own hits once, in texts that share an id and for rules that share a key."""
    texts = spark.createDataFrame([(1, "a.b c d e"), (1, "a.b c d e"), (1, "none"), (2, None)], "id long, text string")
    rules = spark.createDataFrame([(i, k) for i, k in enumerate(["b c d e", "a.b", " c ", "on", "on", "", None])], "rid long, key string")
    want = sorted([(0, 1), (1, 1), (2, 1)] * 2 + [(3, 1), (4, 1)])
    for narrow in (True, False):
        got = literal_hits(texts, "id", "text", rules, "rid", "key", narrow=narrow).where("hits = 1 AND first_line = 1")
        assert sorted((r.rid, r.id) for r in got.collect()) == want


def test_identifier_hits_equal_brute_force(spark):
    words = ["Login", "a", "d_e", "Open", "x"]
    texts, _ = frames(spark)
    rules = spark.createDataFrame(list(enumerate(words)), "rid long, key string")
    want = set()
    for r, w in enumerate(words):
        for i, t in enumerate(TEXTS):
            hits = list(re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", t))
            if hits:
                want.add((r, i, len(hits), t[: hits[0].start()].count("\n") + 1))
    got = identifier_hits(texts, "id", "text", rules, "rid", "key")
    assert {tuple(r) for r in got.select("rid", "id", "hits", "first_line").collect()} == want


def test_placeholder_hits_equal_brute_force(spark):
    patterns = ["Open({x})", "page.{m}(", "{a} => done"]
    texts, _ = frames(spark)
    rules = spark.createDataFrame(list(enumerate(patterns)), "rid long, key string")
    want = set()
    for r, p in enumerate(patterns):
        rx = re.compile(".+?".join(re.escape(x) for x in re.split(r"\{[A-Za-z_]\w*\}", p)), re.S)
        want |= {(r, i, len(rx.findall(t))) for i, t in enumerate(TEXTS) if rx.search(t)}
    got = placeholder_hits(texts, "id", "text", rules, "rid", "key")
    assert {tuple(r) for r in got.select("rid", "id", "hits").collect()} == want


def skewed(spark, n=3000):
    rnd = random.Random(7)
    rows = [(1 if rnd.random() < 0.6 else rnd.randint(2, 20), i, rnd.choice(["view", "click", "buy"]), rnd.randint(0, 9)) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k long, t long, kind string, h long")


def test_bucketed_state_equals_plain_windows(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t")
    b = O.bucketed(df, F.floor(F.col("t") / 100))
    got = O.running_sum(b, ["k"], ["t"], F.col("h"), "s").select("t", "s")
    assert sorted(got.collect()) == sorted(df.select("t", F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect())
    prev = O.previous(b, ["k"], ["t"], ["h"], "p").select("t", F.col("p.h"))
    key = lambda r: r[0]
    assert sorted(prev.collect(), key=key) == sorted(df.select("t", F.lag("h").over(w)).collect(), key=key)


def test_streak_equals_the_loop(spark):
    df = skewed(spark)
    got = {r["t"]: r["streak"] for r in W.no_progress_streak(df, ["k"], ["t"], "kind", F.floor(F.col("t") / 250), "view").collect()}
    state, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        state[r["k"]] = state.get(r["k"], 0) + 1 if r["kind"] == "view" else 0
        want[r["t"]] = state[r["k"]]
    assert got == want


def test_ordered_merge_equals_the_loop(spark):
    df = skewed(spark).withColumn("canon", F.col("h").cast("string"))
    out = W.ordered_merge(df, ["k"], "canon", "t", F.col("kind") == "buy", F.col("t") < 20)
    got = {r["t"]: r["status"] for r in out.collect()}
    first, want = {}, {}
    rows = sorted(df.collect(), key=lambda r: r["t"])
    for r in rows:
        if r["t"] < 20 and r["kind"] != "buy":
            first.setdefault(r["k"], r["canon"])
    for r in rows:
        if r["t"] < 20:
            continue
        if r["kind"] == "buy":
            want[r["t"]] = "dangerous"
        elif r["k"] not in first:
            first[r["k"]] = r["canon"]
            want[r["t"]] = "applied"
        else:
            want[r["t"]] = "duplicate" if first[r["k"]] == r["canon"] else "conflict"
    assert got == want


def test_tree_digest_ignores_order_and_sees_changes(spark):
    rows = [("g", f"p{i}", f"text {i}") for i in range(200)]
    d = lambda r, n: tree_digest(spark.createDataFrame(r, "g string, path string, text string").repartition(n), ["g"]).first()["digest"]
    base = d(rows, 1)
    assert d(rows[::-1], 7) == base
    assert d([*rows[:-1], ("g", "p199", "text x")], 3) != base
    assert d([*rows[:-2], ("g", "p198", "text 199"), ("g", "p199", "text 198")], 3) != base


def test_covering_slice_equals_the_unpruned_loop(spark):
    rnd = random.Random(3)
    cats, budget = ["a", "b", "c"], 9
    rows = [(g, f"f{i:03}", rnd.randint(1, 6), rnd.randint(0, 40), rnd.sample(cats, rnd.randint(0, 3))) for g in ("x", "y") for i in range(80)]
    df = spark.createDataFrame(rows, "g string, file string, tests long, score long, categories array<string>")
    got = {(r["g"], r["file"]) for r in covering_slice(df, ["g"], cats, budget).collect()}
    want = set()
    for g in ("x", "y"):
        pool = [r for r in rows if r[0] == g]
        chosen, left = [], budget
        for c in cats:
            fits = [r for r in pool if c in r[4] and r not in chosen]
            if not fits:
                continue
            best = min(fits, key=lambda r: (abs(r[2] - 1), -r[3], r[1]))
            if chosen and sum(r[2] for r in chosen) + best[2] > budget + 2:
                continue
            chosen.append(best)
            left -= best[2]
            if left <= 0:
                break
        for r in sorted(pool, key=lambda r: (-r[3], r[1])):
            if r in chosen:
                continue
            if sum(x[2] for x in chosen) >= budget:
                break
            chosen.append(r)
        want |= {(g, r[1]) for r in chosen}
    assert got == want


def test_evidence_match_ignores_row_order(spark):
    src = [(i, f"page.n{i % 5}", "Id", f"v{i % 7}") for i in range(60)]
    cfg = [(i, f"page.n{i % 9}", f'"V{i % 4}"', "TestId", None, "global") for i in range(40)]
    gen = [(i, f'Page.GetByTestId("v{i % 6}")', f"v{i % 6}") for i in range(30)]
    def run(n, seed):
        rnd = random.Random(seed)
        mk = lambda rows, schema: spark.createDataFrame(rnd.sample(rows, len(rows)), schema).repartition(n)
        out = match_evidence(
            mk(src, "ord long, source_expr string, kind string, value string"),
            mk(cfg, "ord long, source_expr string, target string, target_kind string, match_mode string, scope string"),
            mk(gen, "ord long, locator string, target string"),
        )
        return sorted(tuple(str(x) for x in r) for r in out.collect())

    assert run(1, 1) == run(5, 2)


def test_identifiers_of_several_tokens(spark):
    import re

    keys = ["Foo.Bar", "a[0]", "List<Page>", "Foo", "x$y", r"p\Eq", "a b"]
    texts = ["Foo.Bar Foo.Bars aFoo.Bar (Foo.Bar)\nFoo", "a[0] ba[0] a[0]b\na[0]", "new List<Page>() List<Pages>", "x$y $x$y", r"p\Eq", "a  b", "", "a b.a b"]
    rules = spark.createDataFrame(list(enumerate(keys)), "rid int, key string")
    got = {(r.rid, r.id): (r.hits, r.first_line) for r in identifier_hits(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", rules, "rid", "key").collect()}
    want = {}
    for k, key in enumerate(keys):
        for i, text in enumerate(texts):
            found = list(re.finditer(rf"(?<!\w){re.escape(key)}(?!\w)", text))
            if found:
                want[k, i] = (len(found), text[: found[0].start()].count("\n") + 1)
    assert got == want


def test_totals_on_a_half_round_up(spark, tmp_path):
    """1000 tenths and a half are 100.5; added as doubles they stay below it."""
    from tidemark.catalog import load

    rows = [(i, 0.1, "1-URGENT") for i in range(1000)] + [(1000, 0.5, "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string").withColumn("o_orderdate", F.lit("1995-03-01").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = load()[0]["w12_run_trend"](spark, str(tmp_path)).collect()
    assert [(r.month, r.orders, r.total) for r in got] == [("1995-03", 1001, 101)]


def test_items_are_searched_whole_and_in_part(spark, tmp_path):
    """A text that holds only some words of an item is found beside one that holds it whole."""
    from tidemark.catalog import load

    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(i, f"{item} {i}") for i in (0, 2)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    said = [f"<{item} 0>", "<one two three>", "<two three or four >"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(said)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 1, "user", f"<{item} 0>"), (1, 2, "user", "<Three four five>"), (1, 3, "user", "three, four five")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: load()[0][name](spark, str(tmp_path)).collect()
    assert {r.layer: (r.rules, r.matched) for r in run("a07_reuse_ratio")} == {"layer0": (2, 2), "layer2": (2, 1)}
    assert {r.key: (r.n, r.hits) for r in run("c03_profile_match") if r.part == "layer"} == {"layer0": (2, 3), "layer2": (2, 1)}
    assert sorted((r.target_id, r.turn) for r in run("c35_memory_recall")) == [(0, 1), (0, 2), (2, 1), (2, 2)]


def test_contracts_are_parsed_once_and_in_many_tasks(spark):
    from tidemark.catalog import load
    from tidemark.plans.configs import validate_contracts

    shape = {"$": (("id", "project"), ()), "$.project": (("files",), ()), "$.project.ms": ((), ("nullable",))}
    good = '{"schemaVersion":"scenario/v1","id":"abc","source":{"migrationFiles":["a.cs"]},"project":{"files":["A.cs","x/../b.cs"],"ms":{"odd":1}}}'
    rows = spark.createDataFrame([(1, good), (2, "[1]"), (3, None), (4, '{"id":"abc","project":7}')], "k long, doc string")
    out = validate_contracts(rows, "doc", ["k"], shape)
    want = {(1, "SCHEMA_PROPERTY_UNKNOWN", f"$.{n}") for n in ("schemaVersion", "source")} | {(1, "SCHEMA_PROPERTY_UNKNOWN", "$.project.ms"), (1, "SCHEMA_PROPERTY_UNKNOWN", "$.project.ms.odd")}
    want |= {(2, "SCHEMA_TYPE_INVALID", "$"), (3, "SCHEMA_TYPE_INVALID", "$"), (4, "SCHEMA_TYPE_INVALID", "$.project")}
    want |= {(4, c, "") for c in ("SCHEMA_VERSION_UNSUPPORTED", "PROJECT_FILES_MISSING", "MIGRATION_FILES_MISSING")}
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object(_doc" not in plan and plan.count("json_tuple(doc") == 1
    query = load()[0]["c23_validate_contracts"](spark, "/root/testdata/sf0.01")
    assert query.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_runs_are_dealt_to_more_tasks_where_there_are_more_rows(spark, monkeypatch):
    """Stage rows are shuffled once, by their run, and no task is given more of them because the table is larger."""
    from tidemark import session
    from tidemark.catalog.comparing import status_runs

    monkeypatch.setattr(session, "TASK_ROWS", 200)
    runs = status_runs(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)] == [-(-rows // 200)]


def test_coverage_reads_expressions_once_when_it_runs(spark, monkeypatch):
    """Building the plan looks at no expression: patterns offer all their anchors."""
    from tidemark.operators import joins, literals

    monkeypatch.setattr(literals, "_wanted", lambda anchored: pytest.fail("looked at the expressions"))
    rules = spark.createDataFrame([("ParameterizedMethods", "x.page.Login.Row({a})"), ("UiTargets", "a.b")], "section string, key string")
    expressions = spark.createDataFrame([("page.Login",), ("a.b",), ("a.c",), ("ge.Lo",)], "expression string")
    got = {r.expression: r.covered_by for r in joins.coverage(expressions, rules).collect()}
    assert got == {"page.Login": "ParameterizedMethods", "a.b": "UiTargets", "a.c": "", "ge.Lo": "ParameterizedMethods"}


def test_target_inventory_derives_types_once(spark):
    from tidemark.operators.facts import extract_types
    from tidemark.plans.inventory import target_inventory

    rows = [(1, 1, "namespace A;"), (1, 2, "class X : Base {"), (2, 1, "class Y : Base {"), (2, 2, "[Test]"), (3, 1, "class Z : Base")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    out = target_inventory(lines.select("doc_id", F.col("line").alias("text")), lines, ["doc_id"])
    windows = lambda df: len(re.findall(r"\bWindow \[", df._jdf.queryExecution().optimizedPlan().toString()))
    assert windows(out) == windows(extract_types(lines, ["doc_id"]).select("base_class", "namespace"))
    got = {(r.kind, r.name): (r.n, r.confidence) for r in out.collect()}
    assert got["base-class", "Base"] == (3, "High") and got["namespace", "A"] == (1, "-")
