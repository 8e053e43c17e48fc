"""Streaming operators ST1-ST5."""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.text import is_blank
from tidemark.plans.failures import FAILURE_RULES, failure_category
from tidemark.session import checkpoint_dir
from tidemark.sources.artifacts import CORRUPT, parse_ledger


def utc(ts: Column | str) -> Column:
    """A zoneless timestamp as the UTC instant of the same wall clock, whatever the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.expr("timestamp'1970-01-01 00:00:00 UTC'") + (c.cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def run_available(stream: DataFrame, out: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is there now into a file sink next to its checkpoint, and read it back."""
    spark = stream.sparkSession
    root = out or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def event_stream(spark: SparkSession, folder: str, glob: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


# --- ST1: observations ------------------------------------------------------------------------------------

OBSERVATION = T.StructType(
    [
        T.StructField("event", T.StringType()), T.StructField("path", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("observedAtUtc", T.TimestampType()),
        T.StructField("dom", T.MapType(T.StringType(), T.StructType([*[T.StructField(n, T.StringType()) for n in ("text", "value")], *[T.StructField(n, T.BooleanType()) for n in ("visible", "enabled", "checked")]]))), T.StructField(CORRUPT, T.StringType()),
    ]
)


def parse_observations(feed: DataFrame, payload: str, session: str, arrival: str) -> DataFrame:
    """Typed observations with a reject reason. Works on batch and stream alike.

    The browser's sequence orders rows when it is positive, else the arrival number;
    missing element flags default to hidden, enabled and unchecked.
    """
    doc = F.from_json(payload, OBSERVATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = feed.withColumn("_o", doc)
    malformed = F.col("_o").isNull() | F.col(f"_o.{CORRUPT}").isNotNull()
    reason = F.when(malformed, F.lit("malformed")).when(is_blank("_o.event"), F.lit("event-missing"))
    state = F.transform_values(
        F.col("_o.dom"),
        lambda _, v: F.struct(
            F.coalesce(v["text"], F.lit("")).alias("text"), F.coalesce(v["value"], F.lit("")).alias("value"), F.coalesce(v["visible"], F.lit(False)).alias("visible"),
            F.coalesce(v["enabled"], F.lit(True)).alias("enabled"), F.coalesce(v["checked"], F.lit(False)).alias("checked"),
        ),
    )
    return rows.select(
        *[c for c in feed.columns if c != payload], F.col("_o.event").alias("event"), F.coalesce("_o.path", F.lit("")).alias("path"),
        F.when(F.col("_o.sequence") > 0, F.col("_o.sequence")).otherwise(F.col(arrival)).alias("sequence"), F.col("_o.observedAtUtc").alias("observed_at"), state.alias("dom"), reason.alias("reason"),
    )


def accepted_observations(parsed: DataFrame, session: str, delay: str) -> DataFrame:
    """Accepted observations once per (session, sequence); duplicates within the delay drop out."""
    ok = parsed.where(F.col("reason").isNull())
    return ok.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark([session, "sequence"])


# --- rows of a key in event order --------------------------------------------------------------------------


#: State keys of a stream; each holds the chains or sessions of one bucket.
BUCKETS = 1024
#: Rows that are written or given out at once.
CHUNK = 10_000


class InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of (``us``, ``ord``) however they arrive.

    Rows wait in a list state until the watermark has passed them, so the buffer is bounded by the delay; a timer wakes
    when the first of them is due. Keys share a state key with the others of their bucket: what waits there is read and
    written at once as JSON, while each key's own state is probed alone (``read`` and ``write``, by key and part). A subclass
    names its further columns in ``fields`` and takes what is ready. Needs the RocksDB state store.
    """

    fields: Sequence[str]
    out: Sequence[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "rows string")
        self._wakes = handle.getValueState("wakes", "due string")
        self._own = handle.getMapState("own", "key long, part long", "held string")

    def read(self, key: int | None, part: int = 0):
        held = self._own.getValue((key, part))
        return None if held is None else json.loads(held[0])

    def write(self, key: int | None, held, part: int = 0) -> None:
        self._own.updateValue((key, part), (json.dumps(held),))

    def drop(self, key: int | None, part: int = 0) -> None:
        self._own.removeKey((key, part))

    def take(self, key: int | None, ready: list[list], passed_us: int, result: list[tuple]) -> int | None:
        """Adds the output of ``ready`` to ``result``; returns the time at which the key wants to be woken, if any."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        names = ["key", "us", "ord", *self.fields]
        arrived = [[r.get(n) for n in names] for batch in rows for r in json.loads(f"[{','.join(batch['row'])}]")]
        yield from self._advance(arrived, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, arrived: list[list], passed: int) -> Iterator:
        import pandas as pd

        queue = sorted([r for (rows,) in self._waiting.get() for r in json.loads(rows)] + arrived, key=lambda r: r[1:3])
        cut = bisect_right(queue, passed * 1000, key=lambda r: r[1])
        texts = lambda rows: [(json.dumps(rows[i : i + CHUNK]),) for i in range(0, len(rows), CHUNK)]
        if not cut:
            if arrived:
                self._waiting.appendList(texts(arrived))
        elif queue[cut:]:
            self._waiting.put(texts(queue[cut:]))
        else:
            self._waiting.clear()
        held = self._wakes.get()
        before = dict(json.loads(held[0])) if held else {}
        wakes, ready = dict(before), {key: [] for key, us in before.items() if us <= passed * 1000}
        for key, *row in queue[:cut]:
            ready.setdefault(key, []).append(row)
        result: list[tuple] = []
        frame = lambda rows: pd.DataFrame(rows, columns=list(self.out), dtype=object)
        for key, rows in ready.items():
            wakes[key] = self.take(key, rows, passed * 1000, result)
            while len(result) >= CHUNK:
                yield frame(result[:CHUNK])
                del result[:CHUNK]
        wakes = {key: us for key, us in wakes.items() if us is not None}
        if wakes != before:
            self._wakes.update((json.dumps(list(wakes.items())),))
        due = [*wakes.values(), *(r[1] for r in queue[cut : cut + 1])]
        if due:
            at = -(-min(due) // 1000)
            self._handle.registerTimer(at - 1 if at - 1 > passed else at)
        if result:
            yield frame(result)

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, ts: str, order: str, delay: str, taker: InOrder, out: str, buckets: int, **fields: Column) -> DataFrame:
    """Rows dealt to ``buckets`` by their key, a long, and taken in order; rows without a time or an order are not taken."""
    cols = [c.alias(n) for n, c in fields.items()]
    timed = rows.select(F.col(key).cast("bigint").alias("key"), *cols, F.col(ts).alias("at"), F.col(order).cast("bigint").alias("ord")).withWatermark("at", delay)
    known = timed.where(F.col("at").isNotNull() & F.col("ord").isNotNull())
    row = F.to_json(F.struct("key", F.unix_micros("at").alias("us"), "ord", *fields))
    dealt = known.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "at", row.alias("row"))
    return dealt.groupBy("bucket").transformWithStateInPandas(taker, out, "append", "EventTime")


# --- ST2: event oracle ------------------------------------------------------------------------------------


def stream_event_oracle(events: DataFrame, session: str, event: str, ts: str, order: str, expected: Sequence[str], delay: str, timeout_ms: int) -> DataFrame:
    """One row per session when its events completed the expected sequence or it timed out.

    Only expected events reach the state. They wait there until the watermark has passed them, so they advance the
    oracle in event order however they arrive; the wait bounds the buffer by the delay. A session that is
    silent for the time-out reports and leaves. A completed one keeps a mark for as long, so that its late
    events do not start it again, and then leaves too.
    """
    steps, hold = tuple(expected), timeout_ms
    rows = events.where(F.col(event).isin(*steps)).withWatermark(ts, delay).select(
        F.col(session).alias("session"), F.col(event).alias("event"), F.col(ts).alias("at"), F.unix_millis(ts).alias("ms"), F.col(order).alias("ord")
    )

    def advance(key, batches, state):
        import pandas as pd

        pos, first, last, waiting = state.get if state.exists else (0, -1, -1, [])
        passed = state.getCurrentWatermarkMs()
        out = lambda elapsed, outcome: pd.DataFrame({"session": [key[0]], "matched": [pos], "elapsed_ms": [elapsed], "outcome": [outcome]})
        if pos == len(steps):
            if state.hasTimedOut:
                state.remove()
            else:
                state.setTimeoutTimestamp(max(last, passed) + hold)
            return
        buffer = [tuple(w) for w in waiting]
        if not state.hasTimedOut:
            for batch in batches:
                buffer += zip(batch["ms"].tolist(), batch["ord"].tolist(), batch["event"].map(steps.index).tolist())
        buffer.sort()
        ready = [r for r in buffer if r[0] <= passed]
        for ms, _, step in ready:
            first, last = (ms if first < 0 else first), ms
            pos += step == pos
            if pos == len(steps):
                state.update((pos, first, last, []))
                state.setTimeoutTimestamp(max(last, passed) + hold)
                yield out(float(last - first), "completed")
                return
        later = buffer[len(ready) :]
        if not later and state.hasTimedOut and last >= 0 and last + hold <= passed:
            state.remove()
            yield out(None, "timed-out")
            return
        state.update((pos, first, last, later))
        state.setTimeoutTimestamp(max(later[0][0] if later else last + hold, passed + 1))

    return rows.groupBy("session").applyInPandasWithState(
        advance, "session long, matched int, elapsed_ms double, outcome string", "pos int, first long, last long, waiting array<struct<ms: long, ord: long, step: int>>", "append", "EventTimeTimeout"
    )


class _Sessions(InOrder):
    fields = ("event", "failed")
    out = ("session", "first_us", "observations", "matched", "elapsed_ms", "failed")

    def __init__(self, steps: tuple, hold_us: int) -> None:
        self._steps, self._hold = steps, hold_us

    def take(self, key, ready, passed_us, result):
        steps, at = self._steps, self.read(key)

        def verdict(first, last, n, pos, terminal, failed):
            elapsed = None if terminal is None else float(max(0, terminal // 1000 - first // 1000))
            result.append((key, first, n, pos, elapsed, failed))

        for us, _, event, failed in ready:
            if at is not None and us > at[1] + self._hold:
                verdict(*at)
                at = None
            first, _, n, pos, terminal, _ = at or (us, us, 0, 0, None, [])
            if not steps or event == steps[-1]:
                terminal = us
            if pos < len(steps) and event == steps[pos]:
                pos += 1
            at = (first, us, n + 1, pos, terminal, failed if failed is not None else [])
        if at is not None and at[1] + self._hold <= passed_us:
            verdict(*at)
            at = None
        if at is None:
            self.drop(key)
            return None
        self.write(key, at)
        return at[1] + self._hold


def stream_semantic_oracle(
    observations: DataFrame, session: str, event: str, ts: str, order: str, failures: str, expected: Sequence[str], max_ms: int, delay: str, timeout_ms: int, buckets: int = BUCKETS
) -> DataFrame:
    """The whole event oracle of each session, once it has been silent for ``timeout_ms`` and the watermark has passed that.

    Events in order, time from the first observation to the last one of the last expected event (of all, where none is
    expected), and the failed checks of the final observation (``failures``, see ``plans.observations.dom_failures``). The batch twin
    is ``event_oracle``. State is one row a session and what waits for the watermark; an observation after the
    silence opens a new session of the same id. ``session`` is a long. Sessions lie in ``buckets`` state keys, whose number a
    stream keeps; each has a list of when its open sessions end. Needs the RocksDB state store.
    """
    steps = tuple(expected)
    named = F.when(F.col(event).isin(*steps), F.col(event)) if steps else F.lit(None).cast("string")
    judged = _in_order(
        observations, session, ts, order, delay, _Sessions(steps, timeout_ms * 1000), "session long, first_us long, observations long, matched long, elapsed_ms double, failed array<string>", buckets,
        event=named, failed=F.col(failures),
    )
    out = judged.withColumns({
        "elapsed_ms": F.col("elapsed_ms").cast("bigint"), "sequence_passed": F.col("matched") == len(steps),
        "time_passed": F.coalesce(F.col("elapsed_ms") <= max_ms, F.lit(False)), "state_passed": F.size("failed") == 0,
    })
    return out.withColumn("passed", F.col("sequence_passed") & F.col("time_passed") & F.col("state_passed"))


# --- ST3: failures ----------------------------------------------------------------------------------------


def failure_counts(lines: DataFrame, ts: str, line: str, width: str, delay: str, rules=FAILURE_RULES) -> DataFrame:
    """Failures per tumbling window and category; the classification itself is stateless."""
    marked = lines.withColumn("category", failure_category(line, rules)).where(F.col("category").isNotNull())
    counts = marked.withWatermark(ts, delay).groupBy(F.window(ts, width), "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_seconds("window.start").alias("window_start"), "category", "n")


# --- ST4: remediation history ------------------------------------------------------------------------------


# Reasons a chain stops for.
CYCLE_DETECTED = "REMEDIATION_CYCLE_DETECTED"
EXHAUSTED = "REMEDIATION_RESIDUAL_CANDIDATES_EXHAUSTED"


#: Visited states that a part of a chain's history holds on average, at most.
PART_STATES = 128


class _History(InOrder):
    fields = ("decision", "hash", "candidates", "residuals")
    out = ("chain", "row_id", "cycle", "batch", "in_batch", "rollover", "streak", "is_cycle", "exhausted", "stop_reason")

    def __init__(self, accept: str, no_progress: str, cycle_found: str, budget: int) -> None:
        self._accept, self._stalled, self._looped, self._budget = accept, no_progress, cycle_found, budget

    def take(self, key, ready, passed_us, result):
        cycle, streak, done, n_known, level = self.read(key) or (0, 0, [], 0, 0)
        exhausted, known, grown, budget = set(done), {}, set(), self._budget
        for _, row_id, decision, state, candidates, residuals in ready:
            ids, left = ({i for i in part or () if i and not i.isspace()} for part in (candidates, residuals))
            cycle += 1
            streak = streak + 1 if decision == self._stalled else 0
            seen = False
            if state is not None:
                part = _part(state, level)
                if part not in known:
                    known[part] = set(self.read(key, part) or ())
                seen = state in known[part]
                if not seen:
                    known[part].add(state)
                    grown.add(part)
                    n_known += 1
            if decision == self._accept:
                exhausted &= left
            elif decision == self._stalled:
                exhausted |= ids
            stop = CYCLE_DETECTED if decision == self._looped else EXHAUSTED if decision == self._stalled and ids and left and left <= exhausted else None
            place = (cycle - 1) % budget + 1
            result.append((key, row_id, cycle, (cycle - 1) // budget + 1, place, place == budget and stop is None, streak, seen, sorted(exhausted), stop))
        for part in grown:
            self.write(key, list(known[part]), part)
        while n_known > PART_STATES << level:
            level += 1
            self._halve(key, level)
        self.write(key, (cycle, streak, sorted(exhausted), n_known, level))
        return None

    def _halve(self, key, level: int) -> None:
        """Deal the states of each part of the level before to two parts, one part at a time."""
        for part in range(1, 1 + (1 << level - 1)):
            halves: dict[int, list[str]] = {}
            for state in self.read(key, part) or ():
                halves.setdefault(_part(state, level), []).append(state)
            self.write(key, halves.get(part, []), part)
            self.write(key, halves.get(part + (1 << level - 1), []), part + (1 << level - 1))


def _part(state: str, level: int) -> int:
    """Part of a history of 2 ^ ``level`` parts, from 1, in which a state lies."""
    return 1 + zlib.crc32(state.encode()) % (1 << level)


def remediation_history(
    evals: DataFrame, chain: str, decision: str, state_hash: str, ts: str, order: str, delay: str, candidates: str | None = None, residuals: str | None = None,
    accept: str = "ACCEPT", no_progress: str = "REJECT_NO_PROGRESS", cycle_found: str = "REJECT_CYCLE", budget: int = 5, buckets: int = BUCKETS,
) -> DataFrame:
    """Cycle number, batch of ``budget`` cycles and place in it, no-progress streak, revisit flag, exhausted ids and stop of each evaluation.

    Evaluations are taken in the order of (``ts``, ``order``) across micro-batches: each waits until the watermark has passed
    it. ``candidates`` are the residual ids an evaluation tried, ``residuals`` those open after its decision (after a rejection
    the ones from before). An attempt without progress exhausts its ids; an acceptance keeps of the exhausted ones those still
    open. ``stop_reason``: a cycle, or nothing open that is not exhausted. ``rollover`` closes a batch, unless the chain stops
    there; evaluations after a stop count on.

    ``chain`` is a long. Chains lie in ``buckets`` state keys, whose number a stream keeps. The visited states of a chain lie in
    parts of some ``PART_STATES`` by their hash, twice as many parts whenever they are full: an evaluation reads one part, a
    micro-batch each part once, and no history is loaded whole. A null hash is never a revisit. The batch twins are W7, W8 and W11.
    """
    none = F.lit(None).cast("array<string>")
    out = "chain long, row_id long, cycle long, batch long, in_batch long, rollover boolean, streak long, is_cycle boolean, exhausted array<string>, stop_reason string"
    return _in_order(
        evals, chain, ts, order, delay, _History(accept, no_progress, cycle_found, budget), out, buckets,
        decision=F.col(decision), hash=F.col(state_hash), candidates=F.col(candidates) if candidates else none, residuals=F.col(residuals) if residuals else none,
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession, run):
    """Run a stream with the RocksDB state store and restore the session's setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


# --- ST5: ledgers -----------------------------------------------------------------------------------------


def ingest_ledger(lines: DataFrame, line: str, schema: T.StructType, key: str, ts: str, root: str, fold_every: int | None = None) -> None:
    """Ledger feed into three tables: entries, quarantined lines and the latest entry per key.

    Each micro-batch writes its own partition, overwritten on replay, so a restarted
    batch changes nothing. The latest table holds one row per key and batch; its view is
    a max_by over them (:func:`latest_view`). After every ``fold_every`` batches the parts are folded (:func:`fold_latest`).
    """
    spark = lines.sparkSession
    spark.range(-1, 0).toDF("upto").write.mode("ignore").parquet(f"{root}/folded")

    def sink(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_ledger(batch, line, schema).persist()
        good = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
        put(good, "entries")
        put(parsed.where(F.col(CORRUPT).isNotNull()), "rejects")
        put(good.groupBy(F.col(key)).agg(F.max_by(F.struct(*[c for c in good.columns if c != key]), ts).alias("row"), F.max(ts).alias("ts")), "latest")
        parsed.unpersist()
        if fold_every and (batch_id + 1) % fold_every == 0:
            fold_latest(spark, root, key, batch_id)

    query = lines.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _folded_upto(spark: SparkSession, root: str) -> int:
    return spark.read.schema("upto long").parquet(f"{root}/folded").agg(F.max("upto")).first()[0]


def _latest_parts(spark: SparkSession, root: str, key: str, after: int, upto: int | None = None) -> DataFrame:
    """Newest row per key of generation ``after`` and the batches behind it; of equal times the later batch wins."""
    batch = F.col("batch_id").cast("bigint")
    parts = spark.read.parquet(f"{root}/latest").where(batch > after)
    parts = (parts if upto is None else parts.where(batch <= upto)).withColumn("batch_id", batch)
    if after >= 0:
        parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{root}/generations/upto={after}"))
    at = F.struct("ts", "batch_id")
    return parts.groupBy(key).agg(F.max_by("row", at).alias("row"), F.max(at).alias("at")).select(key, "row", "at.*")


def fold_latest(spark: SparkSession, root: str, key: str, upto: int) -> None:
    """Fold the latest rows of all batches up to ``upto`` into one generation.

    Only the generation before and the batches after it are read. The generation is written whole before its number enters
    the table of marks, one file of one row: readers see the old generation or the new one. A fold broken off before its
    mark is written anew, one that is marked is left alone, and a batch replayed behind the mark is no longer read.
    Folded parts are pruned by their partition; any tool may remove them.
    """
    after = _folded_upto(spark, root)
    if upto <= after:
        return
    _latest_parts(spark, root, key, after, upto).write.mode("overwrite").parquet(f"{root}/generations/upto={upto}")
    spark.range(upto, upto + 1).toDF("upto").coalesce(1).write.mode("append").parquet(f"{root}/folded")


def latest_view(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Newest row per key: the last generation and the batches after it."""
    return _latest_parts(spark, root, key, _folded_upto(spark, root)).select(key, "row.*")
