"""The remediation history probes its state by chain and part, not by evaluation (F11), and parts of a history stay small."""

import json
import random

import pandas as pd

from tidemark.streaming import feeds as S


class Calls:
    """State and timers in memory; counts every call."""

    def __init__(self):
        self.n, self.values, self.timers = 0, {}, []

    def _state(self, name, *_):
        return Calls.State(self, name)

    getListState = getValueState = getMapState = _state

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.passed

    class State:
        def __init__(self, calls, name):
            self._calls, self._name = calls, name

        def __getattr__(self, method):
            calls, values, name = self._calls, self._calls.values, self._name

            def call(*args):
                calls.n += 1
                if method == "get":
                    return values.get(name, [] if name == "waiting" else None)
                if method in ("put", "update"):
                    values[name] = args[0]
                elif method == "appendList":
                    values[name] = values.get(name, []) + args[0]
                elif method == "clear":
                    values.pop(name, None)
                elif method == "getValue":
                    return values.get((name, args[0]))
                elif method == "updateValue":
                    values[name, args[0]] = args[1]
                else:
                    raise AssertionError(method)

            return call


def frame(rows):
    return pd.DataFrame({"row": [json.dumps({"key": c, "us": us, "ord": us, "decision": "STALL", "hash": h}) for us, c, h in rows]})


def history(passed):
    calls, taker = Calls(), S._History("ACCEPT", "STALL", "LOOP", 5)
    calls.passed = passed
    taker.init(calls)
    return calls, taker


def test_calls_grow_with_chains_not_with_evaluations():
    rnd = random.Random(3)
    rows = [(us, rnd.choice([1, 2, 3, None]), str(rnd.randint(0, 60))) for us in range(1, 2001)]
    calls, taker = history(0)
    assert not list(taker.handleInputRows((1,), iter([frame(rows)]), calls)) and calls.timers
    calls.passed = 10**9
    out = [r for made in taker.handleExpiredTimer((1,), calls, None) for r in made.itertuples()]
    seen, want = set(), {}
    for us, chain, digest in rows:
        want[us] = (chain, digest) in seen
        seen.add((chain, digest))
    assert {r.row_id: r.is_cycle for r in out} == want and len(out) == len(rows)
    assert calls.n < 50


def test_parts_of_a_long_history_stay_small():
    n = 40 * S.PART_STATES
    rows = [(us, 7, f"state {us % (n // 2)}") for us in range(n)]
    (calls, taker), cycles = history(10**9), {}
    for i in range(0, n, 500):
        for made in taker.handleInputRows((1,), iter([frame(rows[i : i + 500])]), calls):
            cycles |= {r.row_id: r.is_cycle for r in made.itertuples()}
    assert cycles == {us: us >= n // 2 for us in range(n)}
    parts = [json.loads(v[0]) for k, v in calls.values.items() if k[0] == "own" and k[1][1] > 0]
    assert sum(map(len, parts)) == n // 2 and max(map(len, parts)) <= 2 * S.PART_STATES
