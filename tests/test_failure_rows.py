"""Failure rows of long, repeated and nameless files against a replay, from two readings of the lines (F15)."""

import pytest

from tidemark.plans.failures import classify_failures

LONG = {1: "Failed Entry()  ", 3: "page Timeout exceeded", 1023: "ok", 1024: " 502 bad ", 1025: None, 1500: "   ", 2100: "Passed Other", 2101: "login page", 2600: "x"}
FILES = {
    "long": [(n, LONG.get(n, f"{"abcdefg"[n % 7]} \t")) for n in range(1, 2601)], None: [(n, "fixture lost" if n == 1030 else "ok") for n in range(1, 1100)],
    "trouble": [(n, "step failed" if n == 1900 else "quiet") for n in range(5, 2000)], "twice": [(1, "an error"), (1, "an error"), (2, None)], "quiet": [(1, "fine"), (2, None)], "blank": [(1, None)],
}
WORDS = {"Timeout": "timeout-wait-state", "502": "environment/flaky-infra", "login": "auth/session-not-ready", "fixture": "test-data-missing"}


def replay(rows, context):
    blanks, out, test = " \t\r\n\f\x0b\xa0", [], None
    for i, (n, line) in enumerate(rows):
        text = (line or "").strip(blanks)
        test = text if text.startswith(("Failed ", "Passed ")) else test
        label = next((c for w, c in WORDS.items() if w in text), None)
        if label:
            near = [x.rstrip(blanks) for _, x in rows[max(0, i - 2) : i + 4] if x is not None]
            out.append((n, label, *((test if context else None), text, "\n".join(near) if context else None)))
    if not out and any(w in (x or "") for _, x in rows for w in ("failed", "error", "timeout")):
        out.append((1, "unclassified-runtime-failure", None, "failure text without a known pattern", None))
    return out


@pytest.mark.parametrize("context", [True, False])
def test_rows_equal_a_replay(spark, context):
    rows = [(f, n, x) for f, lines in FILES.items() for n, x in lines]
    got = classify_failures(spark.createDataFrame(rows, "file string, line_no int, line string").repartition(5), ["file"], context=context)
    want = [(f, *r) for f, lines in FILES.items() for r in replay(lines, context)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and {w[0] for w in want} == {"long", None, "trouble", "twice"}


def test_lines_are_read_twice_at_most(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x")], "file string, line_no int, line string").write.parquet(str(tmp_path / "lines"))
    plan = classify_failures(spark.read.parquet(str(tmp_path / "lines")), ["file"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2
