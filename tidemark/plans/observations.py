"""Event oracle over observation feeds: sequence, time budget, final state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_reached(events: DataFrame, session: str, order: Sequence[str], event: str, expected: Sequence[str]) -> DataFrame:
    """How far each session gets through ``expected`` in order: one min-aggregate per step.

    Step i looks for the earliest event of its kind after step i-1. A step is a filter,
    an equi join with one row per session and a partial min, so a session with a third
    of all events is spread over all tasks; nothing is sorted or collected.
    """
    pos = F.struct(*order)
    reached = events.select(session).distinct().withColumn("matched", F.lit(0))
    at = None
    for i, name in enumerate(expected, start=1):
        step = events.where(F.col(event) == name).select(session, pos.alias("_pos"))
        if at is not None:
            step = step.join(at, session).where(F.col("_pos") > F.col("_at"))
        at = step.groupBy(session).agg(F.min("_pos").alias("_at"))
        reached = reached.join(at.select(session, F.lit(i).alias("_i")), session, "left").withColumn("matched", F.coalesce("_i", "matched")).drop("_i")
    return reached


def dom_failures(dom: Column | str, checks: Sequence[tuple[str, Mapping[str, object]]]) -> Column:
    """Checks that the elements of an observation fail, as ``kind:selector``.

    ``dom`` maps element ids to their state (see ``streaming.feeds.parse_observations``); a check is a selector ``#id`` and the
    fields it fixes (text, visible, value, enabled, checked). A selector of another form fails as ``dom-selector``, an id the
    observation lacks as ``dom-element``, and then its fields are not looked at. No observation has no element.
    """
    elements = F.col(dom) if isinstance(dom, str) else dom
    found = []
    for selector, fields in checks:
        if not selector.startswith("#") or len(selector) < 2:
            found.append(F.lit(f"dom-selector:{selector}"))
            continue
        state = F.try_element_at(elements, F.lit(selector[1:]))
        found.append(F.when(state.isNull(), F.lit(f"dom-element:{selector}")))
        found += [F.when(state.isNotNull() & ~F.coalesce(state[name] == want, F.lit(False)), F.lit(f"dom-{name}:{selector}")) for name, want in fields.items()]
    return F.filter(F.array(*found), lambda f: f.isNotNull()) if found else F.array().cast("array<string>")


def event_oracle(
    events: DataFrame, session: str, order: Sequence[str], event: str, ts: str, expected: Sequence[str], max_ms: int, final_state: Mapping[str, object] | None = None
) -> DataFrame:
    """Checks per session: events in order, elapsed time up to the last expected event, fields of the last observation."""
    t = F.col(ts).cast("timestamp")
    finals = [F.max_by(c, F.struct(*order)).alias(f"_final_{c}") for c in (final_state or {})]
    span = events.groupBy(session).agg(
        F.count(F.lit(1)).alias("observations"), F.min_by(t, F.struct(*order)).alias("_first"),
        F.max_by(F.when(F.col(event) == expected[-1], t), F.when(F.col(event) == expected[-1], F.struct(*order))).alias("_terminal"), *finals,
    )
    joined = span.join(sequence_reached(events, session, order, event, expected), session)
    elapsed = F.when(F.col("_terminal").isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.unix_millis("_terminal") - F.unix_millis("_first")))
    state = F.lit(True)
    for c, value in (final_state or {}).items():
        state = state & F.coalesce(F.col(f"_final_{c}") == value, F.lit(False))
    judged = joined.withColumns(
        {"elapsed_ms": elapsed, "sequence_passed": F.col("matched") == len(expected), "state_passed": state}
    ).withColumn("time_passed", F.coalesce(F.col("elapsed_ms") <= max_ms, F.lit(False)))
    return judged.select(
        session, "observations", "matched", "elapsed_ms", "sequence_passed", "time_passed", "state_passed",
        (F.col("sequence_passed") & F.col("time_passed") & F.col("state_passed")).alias("passed"),
    )
