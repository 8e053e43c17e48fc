"""Streams over several files and out-of-order input against their batch twins."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.windows import batches, no_progress_streak, revisited
from tidemark.plans.observations import dom_failures, event_oracle, sequence_reached
from tidemark.streaming import feeds as S


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("feed")
    rnd = random.Random(5)
    rows = [(i, 1_700_000_000_000 + i * 60_000 + rnd.randint(0, 50_000), 1 if rnd.random() < 0.5 else rnd.randint(2, 9), rnd.choice(["view", "click", "purchase", "other"]), str(rnd.randint(0, 30))) for i in range(600)]
    for part in range(3):
        chunk = rows[part * 200 : (part + 1) * 200]
        rnd.shuffle(chunk)
        df = spark.createDataFrame(chunk, "id long, ms long, chain long, kind string, hash string").withColumn("at", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(str(root))
    return str(root)


def stream(spark, feed):
    batch = spark.read.parquet(feed)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(feed), batch


def test_oracle_completes_the_same_sessions(spark, feed):
    s, batch = stream(spark, feed)
    out = S.run_available(S.stream_event_oracle(s, "chain", "kind", "at", "id", ("view", "click", "purchase"), "10 minutes", 10**9)).where("outcome = 'completed'")
    newest = batch.where("kind <> 'other'").agg(F.max("ms")).first()[0]
    seen = batch.where(F.col("ms") <= newest - 600_000)
    want = sequence_reached(seen, "chain", ["ms", "id"], "kind", ("view", "click", "purchase")).where("matched = 3")
    assert {r["session"] for r in out.collect()} == {r["chain"] for r in want.collect()}


def test_failure_windows_are_final(spark, feed):
    s, batch = stream(spark, feed)
    line = F.when(F.col("kind") == "view", "Timeout exceeded").when(F.col("kind") == "click", "strict mode violation").otherwise("ok")
    out = S.run_available(S.failure_counts(s.withColumn("line", line), "at", "line", "30 minutes", "5 minutes")).collect()
    twin = batch.where("kind IN ('view', 'click')").groupBy((F.floor(F.col("ms") / 1_800_000) * 1800).alias("w"), "kind").count().collect()
    names = {"view": "timeout-wait-state", "click": "strict-mode-violation"}
    want = {(r["w"], names[r["kind"]]): r["count"] for r in twin}
    assert out and all(want[(r["window_start"], r["category"])] == r["n"] for r in out)


def history(s):
    return S.remediation_history(s, "chain", "kind", "hash", "at", "id", "10 minutes", no_progress="view", accept="purchase", cycle_found="other")


def test_history_matches_the_batch_operators(spark, feed):
    s, batch = stream(spark, feed)
    out = {r["row_id"]: (r["streak"], r["is_cycle"], r["batch"], r["in_batch"]) for r in S.with_rocksdb(spark, lambda: S.run_available(history(s))).collect()}
    batch = batch.where(F.col("ms") <= batch.agg(F.max("ms")).first()[0] - 600_000)
    streak = no_progress_streak(batch, ["chain"], ["ms", "id"], "kind", F.floor(F.col("ms") / 3_600_000), "view").select("id", "streak")
    cyc = revisited(batch, ["chain"], "hash", ["ms", "id"]).select("id", "is_cycle")
    parts = batches(batch, ["chain"], ["ms", "id"], F.floor(F.col("ms") / 3_600_000)).select("id", "batch", "in_batch")
    want = {r["id"]: (r["streak"], r["is_cycle"], r["batch"], r["in_batch"]) for r in streak.join(cyc, "id").join(parts, "id").collect()}
    assert out == want


def test_revisits_keep_rows_without_a_state(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a")], "chain long, id long, hash string")
    assert {r["id"]: r["is_cycle"] for r in revisited(rows, ["chain"], "hash", ["id"]).collect()} == {1: False, 2: False, 3: False, 4: True}


MINUTE = 60_000


def late_parts(rows, delay, parts, seed):
    """``rows`` (of id, chain, ms, ...) dealt to ``parts`` arrivals, each later than its turn by less than the delay."""
    rnd = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r[2] + rnd.random() * 0.9 * delay)
    size = -(-len(arrival) // parts)
    return [arrival[i : i + size] for i in range(0, len(arrival), size)]


def append(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are taken in the order of their times


def test_history_takes_late_evaluations_in_order_and_survives_a_restart(spark, tmp_path):
    """Exhausted ids, stops, batches and revisits against a replay, over late rows, null fields and a second run."""
    rnd, letters = random.Random(11), "abcd"
    ids = lambda n: rnd.sample(letters, rnd.randint(0, n)) if rnd.random() < 0.9 else None
    decisions = ["REJECT_NO_PROGRESS"] * 6 + ["ACCEPT", "ACCEPT", "REJECT_CYCLE", "REJECT_REGRESSION", None]
    rows = [(i, rnd.choice([1, 1, 2, 3]), 1_700_000_000_000 + i // 2 * MINUTE, rnd.choice(decisions), rnd.choice([None, *map(str, range(40))]), ids(2), ids(4)) for i in range(240)]
    schema, root, folder = "id long, chain long, ms long, decision string, hash string, tried array<string>, open array<string>", str(tmp_path / "out"), str(tmp_path / "in")

    def run():
        s, _ = stream(spark, folder)
        return S.with_rocksdb(spark, lambda: S.run_available(S.remediation_history(s, "chain", "decision", "hash", "at", "id", "10 minutes", "tried", "open"), root))

    parts = late_parts(rows, 10 * MINUTE, 5, 3)
    for part in parts[:3]:
        append(spark, part, schema, folder)
    before = run().count()
    for part in parts[3:]:
        append(spark, part, schema, folder)
    got = run().collect()
    assert 0 < before < len(got)
    passed, state, want = max(r[2] for r in rows) - 10 * MINUTE, {}, {}
    for i, chain, ms, decision, digest, tried, left in sorted(rows, key=lambda r: (r[2], r[0])):
        if ms > passed:
            continue
        n, streak, gone, seen = state.get(chain, (0, 0, set(), set()))
        n, streak, tried, left = n + 1, streak + 1 if decision == "REJECT_NO_PROGRESS" else 0, set(tried or ()), set(left or ())
        gone = gone & left if decision == "ACCEPT" else gone | tried if decision == "REJECT_NO_PROGRESS" else gone
        stop = "REMEDIATION_CYCLE_DETECTED" if decision == "REJECT_CYCLE" else None
        if decision == "REJECT_NO_PROGRESS" and tried and left and not left - gone:
            stop = "REMEDIATION_RESIDUAL_CANDIDATES_EXHAUSTED"
        want[i] = (chain, n, (n + 4) // 5, (n - 1) % 5 + 1, n % 5 == 0 and stop is None, streak, digest in seen, sorted(gone), stop)
        state[chain] = (n, streak, gone, seen | ({digest} - {None}))
    assert {r["row_id"]: tuple(r[c] for c in ("chain", "cycle", "batch", "in_batch", "rollover", "streak", "is_cycle", "exhausted", "stop_reason")) for r in got} == want
    assert len(got) == len(want) and {"REMEDIATION_CYCLE_DETECTED", "REMEDIATION_RESIDUAL_CANDIDATES_EXHAUSTED"} <= {w[-1] for w in want.values()}


def test_semantic_oracle_equals_the_batch_oracle_per_session(spark, tmp_path):
    """Sessions by silence over late rows and a restart: sequence, time budget and the checks of the last observation."""
    rnd, at, rows = random.Random(7), 1_700_000_000_000, []
    for i in range(200):
        at += rnd.choice([1, 2, 5, 40]) * MINUTE if rnd.random() < 0.9 else 0
        rows.append((i, rnd.choice([1, 1, 2, 3]), at, rnd.choice(["view", "click", "purchase", "other", None]), rnd.choice([None, [], ["dom-text:#a"]])))
    schema, root, folder, hold = "id long, chain long, ms long, kind string, failed array<string>", str(tmp_path / "out"), str(tmp_path / "in"), 60 * MINUTE

    def run():
        s, _ = stream(spark, folder)
        return S.with_rocksdb(spark, lambda: S.run_available(S.stream_semantic_oracle(s, "chain", "kind", "at", "id", "failed", ("view", "click", "purchase"), 90 * MINUTE, "10 minutes", hold), root))

    parts = late_parts(rows, 10 * MINUTE, 4, 5)
    for part in parts[:2]:
        append(spark, part, schema, folder)
    run()
    for part in parts[2:]:
        append(spark, part, schema, folder)
    got = run().collect()
    passed, made, last = max(r[2] for r in rows) - 10 * MINUTE, [], {}
    for r in sorted((r for r in rows if r[2] <= passed), key=lambda r: (r[2], r[0])):
        if r[1] in last and r[2] <= last[r[1]][-1][2] + hold:
            last[r[1]].append(r)
        else:
            last[r[1]] = [r]
            made.append(last[r[1]])
    closed = [(s[0][1], s[0][2], r) for s in made if s[-1][2] + hold <= passed for r in s]
    twin = spark.createDataFrame([(f"{c}-{first}", *r) for c, first, r in closed], f"session string, {schema}").withColumns({"at": F.timestamp_millis("ms"), "clean": F.size(F.coalesce("failed", F.array())) == 0})
    names = ["observations", "matched", "elapsed_ms", "sequence_passed", "time_passed", "state_passed", "passed"]
    want = {r["session"]: tuple(r[n] for n in names) for r in event_oracle(twin, "session", ["ms", "id"], "kind", "at", ("view", "click", "purchase"), 90 * MINUTE, {"clean": True}).collect()}
    assert {f"{r['session']}-{r['first_us'] // 1000}": tuple(r[n] for n in names) for r in got} == want
    assert len(got) == len(want) and {True, False} == {w[3] for w in want.values()} == {w[5] for w in want.values()}


def test_dom_failures(spark):
    dom = "map('a', struct('x' AS text, '' AS value, true AS visible, true AS enabled, false AS checked))"
    checks = [("#a", {"text": "x", "visible": False}), ("#a", {"checked": False, "value": "v"}), ("#b", {"text": "x"}), ("div", {}), ("#", {})]
    found = spark.range(1).select(dom_failures(F.expr(dom), checks), dom_failures(F.lit(None).cast("map<string, struct<text: string>>"), [("#a", {"text": "x"})]), dom_failures(F.expr(dom), [])).first()
    assert found[0] == ["dom-visible:#a", "dom-value:#a", "dom-element:#b", "dom-selector:div", "dom-selector:#"] and found[1] == ["dom-element:#a"] and found[2] == []


def test_ledger_folds_keep_the_view(spark, tmp_path):
    """Five batches, a fold after every second, a restart, a batch replayed behind the mark and a fold broken off."""
    folder, root, schema = str(tmp_path / "in"), str(tmp_path / "ledger"), T.StructType([T.StructField("k", T.LongType())])
    want = {}
    for part in range(5):
        rows = [(key, 10 * part + key % 2, '{"k": %d}' % (100 * part + key) if key != 4 else "{oops") for key in range(part, part + 6)]
        want |= {key: 100 * part + key for key, _, _ in rows if key != 4}
        spark.createDataFrame(rows, "key long, no long, line string").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
        if part in (2, 4):
            feed = spark.readStream.schema("key long, no long, line string").option("maxFilesPerTrigger", 1).parquet(folder)
            S.ingest_ledger(feed, "line", schema, "key", "no", root, fold_every=2)
            assert {r["key"]: r["k"] for r in S.latest_view(spark, root, "key").collect()} == want
    assert sorted(r[0] for r in spark.read.parquet(f"{root}/folded").collect()) == [-1, 1, 3]
    spark.read.parquet(f"{root}/latest/batch_id=0").withColumn("ts", F.lit(10**6).cast("long")).write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(f"{root}/latest/batch_id=0")
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(f"{root}/generations/upto=4")
    S.fold_latest(spark, root, "key", 2)
    assert {r["key"]: r["k"] for r in S.latest_view(spark, root, "key").collect()} == want
    S.fold_latest(spark, root, "key", 4)
    assert {r["key"]: r["k"] for r in S.latest_view(spark, root, "key").collect()} == want


def test_observation_defaults_and_rejects(spark):
    rows = [(1, '{"event":"click","sequence":0,"dom":{"#a":{"text":"x"}}}', 7), (1, "{bad", 8), (1, '{"event":" "}', 9)]
    parsed = S.parse_observations(spark.createDataFrame(rows, "s long, payload string, arrival long"), "payload", "s", "arrival").collect()
    assert [r["reason"] for r in parsed] == [None, "malformed", "event-missing"]
    assert parsed[0]["sequence"] == 7
    dom = parsed[0]["dom"]["#a"]
    assert (dom["text"], dom["value"], dom["visible"], dom["enabled"], dom["checked"]) == ("x", "", False, True, False)


def test_oracle_takes_late_events_in_their_order(spark, tmp_path):
    """Events out of order across micro-batches, within the delay; silent sessions time out; repeated completions do not count."""
    start, minute = 1_700_000_000_000, 60_000
    files = [
        [(1, 1, 2, "click"), (2, 1, 1, "view"), (3, 2, 1, "view"), (4, 2, 5, "purchase")],
        [(5, 1, 3, "purchase"), (6, 2, 3, "click"), (7, 3, 4, "view")],
        [(8, 1, 30, "view"), (9, 1, 31, "click"), (10, 1, 32, "purchase"), (11, 4, 40, "view")],
        [(12, 5, 300, "view")], [(13, 5, 600, "view")],
    ]
    for rows in files:
        made = spark.createDataFrame([(i, c, start + m * minute, k) for i, c, m, k in rows], "id long, chain long, ms long, kind string")
        made.withColumn("at", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)  # files are taken in the order of their times
    out = S.run_available(S.stream_event_oracle(stream(spark, str(tmp_path))[0], "chain", "kind", "at", "id", ("view", "click", "purchase"), "10 minutes", 120 * minute)).collect()
    assert sorted((r.session, r.matched, r.elapsed_ms, r.outcome) for r in out) == [(1, 3, 2.0 * minute, "completed"), (2, 3, 4.0 * minute, "completed"), (3, 1, None, "timed-out"), (4, 1, None, "timed-out")]
