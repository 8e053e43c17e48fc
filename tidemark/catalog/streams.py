"""Streams ST1-ST5 over the event table, run to what is available; SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.registry import query
from tidemark.catalog.sources import fresh_dir
from tidemark.plans.observations import dom_failures
from tidemark.streaming import feeds as S

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def events(spark, sf):
    return S.event_stream(spark, sf, "events.parquet", EVENTS)


@query(
    "st1_observations",
    """SELECT user_id, count(*) AS accepted, count(DISTINCT event_id) AS sequences, count(*) FILTER (event_type = 'click') AS clicks FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1""",
)
def st1(spark, sf):
    """The feed arrives twice, with malformed payloads and missing events; each observation is accepted once."""
    e = events(spark, sf)
    k = F.col("event_id")
    payload = F.concat(
        F.lit('{"event":"'), F.when(k % 17 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit('","sequence":'), k.cast("string"), F.lit(',"observedAtUtc":"'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('","dom":{"#a":{"text":"x"}}}'),
    )
    feed = e.select("user_id", k.alias("arrival"), F.when(k % 13 == 0, F.lit("{oops")).otherwise(payload).alias("payload"))
    parsed = S.parse_observations(feed.unionAll(feed), "payload", "user_id", "arrival")
    rows = S.accepted_observations(parsed, "user_id", "1 hour").select("user_id", "sequence", "event")
    out = S.run_available(rows)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("accepted"), F.count_distinct("sequence").alias("sequences"), F.count_if(F.col("event") == "click").alias("clicks"))


@query(
    "st2_event_oracle",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000), event_id) AS rn FROM events WHERE event_type IN ('view', 'click', 'purchase')
      AND floor(epoch_us(ts) / 1000) <= (SELECT max(floor(epoch_us(ts) / 1000)) FROM events WHERE event_type IN ('view', 'click', 'purchase')) - 3600000),
    a AS (SELECT user_id, min(rn) AS p1 FROM e WHERE event_type = 'view' GROUP BY 1), b AS (SELECT e.user_id, min(rn) AS p2 FROM e JOIN a USING (user_id) WHERE event_type = 'click' AND rn > p1 GROUP BY 1),
    c AS (SELECT e.user_id, min(rn) AS p3 FROM e JOIN b USING (user_id) WHERE event_type = 'purchase' AND rn > p2 GROUP BY 1)
    SELECT user_id AS session, 3::BIGINT AS matched, 'completed' AS outcome, (max(floor(epoch_us(ts) / 1000)) FILTER (rn = p3) - min(floor(epoch_us(ts) / 1000)))::BIGINT AS elapsed_ms FROM e JOIN c USING (user_id) GROUP BY user_id""",
)
def st2(spark, sf):
    e = events(spark, sf).withColumn("at", S.utc("ts"))
    out = S.run_available(S.stream_event_oracle(e, "user_id", "event_type", "at", "event_id", ("view", "click", "purchase"), "1 hour", 30 * 86400 * 1000))
    return out.select("session", F.col("matched").cast("bigint").alias("matched"), "outcome", F.col("elapsed_ms").cast("bigint").alias("elapsed_ms"))


@query(
    "st2_semantic_oracle",
    """WITH t AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, (props::JSON->>'k')::BIGINT AS k FROM events), m AS (SELECT (max(us) // 1000 - 3600000) * 1000 AS passed FROM t),
    g AS (SELECT *, CASE WHEN us > lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) + 43200000000 THEN 1 ELSE 0 END AS fresh FROM t, m WHERE us <= passed),
    e AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS part, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM g),
    a AS (SELECT user_id, part, min(rn) AS p1 FROM e WHERE event_type = 'view' GROUP BY 1, 2),
    b AS (SELECT user_id, part, min(rn) AS p2 FROM e JOIN a USING (user_id, part) WHERE event_type = 'click' AND rn > p1 GROUP BY 1, 2),
    c AS (SELECT user_id, part, min(rn) AS p3 FROM e JOIN b USING (user_id, part) WHERE event_type = 'purchase' AND rn > p2 GROUP BY 1, 2),
    s AS (SELECT user_id, part, count(*) AS observations, min(us) AS first_us, max(us) AS last_us, max(us) FILTER (event_type = 'purchase') AS end_us, max_by(k, rn) AS k, any_value(passed) AS passed FROM e GROUP BY 1, 2),
    j AS (SELECT s.*, (p1 IS NOT NULL)::BIGINT + (p2 IS NOT NULL)::BIGINT + (p3 IS NOT NULL)::BIGINT AS matched, end_us // 1000 - first_us // 1000 AS elapsed_ms,
      concat_ws(',', CASE WHEN k % 3 <> 0 THEN 'dom-visible:#total' END, CASE WHEN k % 4 <> 0 THEN 'dom-element:#note' WHEN k % 8 <> 0 THEN 'dom-text:#note' END) AS failed
      FROM s LEFT JOIN a USING (user_id, part) LEFT JOIN b USING (user_id, part) LEFT JOIN c USING (user_id, part) WHERE last_us + 43200000000 <= passed)
    SELECT user_id AS session, first_us, observations, matched, elapsed_ms, failed, matched = 3 AS sequence_passed, coalesce(elapsed_ms <= 86400000, false) AS time_passed, failed = '' AS state_passed,
      (matched = 3 AND coalesce(elapsed_ms <= 86400000, false) AND failed = '') AS passed FROM j""",
)
def st2_semantic(spark, sf):
    """Sessions end after twelve hours of silence; the last observation shows a total, and a note whose text is checked."""
    k = F.from_json("props", PROPS)["k"]
    note = F.when(k % 4 == 0, F.concat(F.lit(',"note":{"text":"'), (k % 8).cast("string"), F.lit('"}'))).otherwise("")
    payload = F.concat(
        F.lit('{"event":"'), F.col("event_type"), F.lit('","sequence":'), F.col("event_id").cast("string"), F.lit(',"observedAtUtc":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.lit('","dom":{"total":{"visible":'), (k % 3 == 0).cast("string"), F.lit("}"), note, F.lit("}}"),
    )
    seen = S.parse_observations(events(spark, sf).select("user_id", F.col("event_id").alias("arrival"), payload.alias("payload")), "payload", "user_id", "arrival")
    judged = seen.where(F.col("reason").isNull()).withColumn("failures", dom_failures("dom", [("#total", {"visible": True}), ("#note", {"text": "0"})]))
    stream = S.stream_semantic_oracle(judged, "user_id", "event", "observed_at", "sequence", "failures", ("view", "click", "purchase"), 86400000, "1 hour", 43200000)
    return S.with_rocksdb(spark, lambda: S.run_available(stream)).withColumn("failed", F.array_join("failed", ","))


CATEGORY_SQL = "CASE event_type WHEN 'error' THEN 'strict-mode-violation' WHEN 'click' THEN 'locator-not-found' WHEN 'view' THEN 'timeout-wait-state' END"


@query(
    "st3_failure_counts",
    f"""WITH w AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, {CATEGORY_SQL} AS category FROM events), m AS (SELECT max(ts) AS top FROM events WHERE event_type IN ('error', 'click', 'view'))
    SELECT window_start, category, count(*) AS n FROM w, m WHERE category IS NOT NULL AND window_start + 86400 <= epoch(top - INTERVAL 2 HOUR) GROUP BY ALL""",
)
def st3(spark, sf):
    line = F.expr("CASE event_type WHEN 'error' THEN 'Error: strict mode violation' WHEN 'click' THEN 'locator resolved to hidden' WHEN 'view' THEN 'Timeout exceeded' ELSE 'ok' END")
    e = events(spark, sf).select(S.utc("ts").alias("at"), line.alias("line"))
    return S.run_available(S.failure_counts(e, "at", "line", "1 day", "2 hours"))


@query(
    "st4_remediation_history",
    """WITH t AS (SELECT *, epoch_us(ts) AS us, (props::JSON->>'k')::BIGINT AS k FROM events), p AS (SELECT * FROM t WHERE us <= (SELECT max(us) // 1000 - 3600000 FROM t) * 1000),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS cycle, row_number() OVER (PARTITION BY user_id, props ORDER BY us, event_id) > 1 AS is_cycle,
      sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM p),
    r AS (SELECT i.*, x.id, max(CASE WHEN event_type = 'view' AND k % 5 = x.id THEN cycle END) OVER w AS tried, max(CASE WHEN event_type = 'purchase' AND (k >> x.id) & 1 = 0 THEN cycle END) OVER w AS closed
      FROM i CROSS JOIN (SELECT unnest(range(0, 5)) AS id) x WINDOW w AS (PARTITION BY user_id, x.id ORDER BY cycle ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT event_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (tried > coalesce(closed, 0)), '') AS exhausted,
      count(*) FILTER ((k >> id) & 1 = 1) AS n_open, count(*) FILTER ((k >> id) & 1 = 1 AND NOT coalesce(tried > coalesce(closed, 0), false)) AS n_left FROM r GROUP BY event_id),
    s AS (SELECT i.*, exhausted, CASE WHEN event_type = 'error' THEN 'REMEDIATION_CYCLE_DETECTED' WHEN event_type = 'view' AND n_open > 0 AND n_left = 0 THEN 'REMEDIATION_RESIDUAL_CANDIDATES_EXHAUSTED' END AS stop_reason FROM i JOIN g USING (event_id))
    SELECT user_id AS chain, event_id AS row_id, cycle, (cycle - 1) // 5 + 1 AS batch, (cycle - 1) % 5 + 1 AS in_batch, (cycle % 5 = 0 AND stop_reason IS NULL) AS rollover,
      sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak, is_cycle, exhausted, stop_reason FROM s""",
)
def st4(spark, sf):
    """Views make no progress, purchases are accepted, errors are cycles; five residual ids from the bits of a property."""
    k = F.from_json("props", PROPS)["k"]
    open_ids = F.filter(F.array(*[F.when(F.shiftright(k, i).bitwiseAND(1) == 1, F.lit(str(i))) for i in range(5)]), lambda i: i.isNotNull())
    e = events(spark, sf).withColumns({"at": S.utc("ts"), "tried": F.array((k % 5).cast("string")), "open": open_ids})
    stream = S.remediation_history(e, "user_id", "event_type", "props", "at", "event_id", "1 hour", "tried", "open", "purchase", "view", "error")
    return S.with_rocksdb(spark, lambda: S.run_available(stream)).withColumn("exhausted", F.array_join("exhausted", ","))


PROPS = T.StructType([T.StructField("k", T.LongType())])


@query(
    "st5_ledger_ingest",
    """SELECT 'latest' AS part, user_id AS key, max_by((props::JSON->>'k')::BIGINT, event_id) AS k, max(event_id) AS line_no FROM events WHERE event_id % 9 <> 0 GROUP BY user_id UNION ALL SELECT 'rejects', -1, count(*), max(event_id) FROM events WHERE event_id % 9 = 0""",
)
def st5(spark, sf):
    root = fresh_dir(spark, "ledger")
    lines = events(spark, sf).select("user_id", F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props")).alias("line"))
    S.ingest_ledger(lines, "line", PROPS, "user_id", "line_no", root, fold_every=1)
    latest = S.latest_view(spark, root, "user_id").select(F.lit("latest").alias("part"), F.col("user_id").alias("key"), "k", "line_no")
    rejects = spark.read.parquet(f"{root}/rejects").agg(F.count(F.lit(1)).alias("k"), F.max("line_no").alias("line_no"))
    return latest.unionByName(rejects.select(F.lit("rejects").alias("part"), F.lit(-1).cast("bigint").alias("key"), "k", "line_no"))
