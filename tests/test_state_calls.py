"""Calls of the state store and timers: a few for each key and micro-batch, whatever windows it has; large states keep their parts."""

import random
from collections import Counter
from datetime import timedelta

import pandas as pd
import pytest

from millrace.functions.windows import Global, Session, Sliding, Tumbling
from millrace.streaming.processors import _WindowedState
from millrace.streaming.windowed import AtEnd, EveryCount, ListState, Periodic, _Processor, _spans

S = timedelta(seconds=1)


class Variable:
    """A value or map state of one key, which counts its calls and the bytes that are written."""

    def __init__(self, store):
        self.store, self.values = store, {}

    def called(self, value=()):
        self.store.calls += 1
        self.store.written += sum(len(x) for x in value if isinstance(x, (bytes, str)))

    def exists(self):
        self.called()
        return None in self.values

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def clear(self):
        self.removeKey(None)

    def containsKey(self, key):
        self.called()
        return key in self.values

    def getValue(self, key):
        self.called()
        return self.values.get(key)

    def updateValue(self, key, value):
        self.called(value)
        self.values[key] = value

    def removeKey(self, key):
        self.called()
        self.values.pop(key, None)

    def iterator(self):
        self.called()
        return iter(list(self.values.items()))


class Store:
    """One key's state and timers, and what is emitted for it."""

    def __init__(self, processor):
        self.calls, self.written, self.mark, self.timers, self.variables, self.processor = 0, 0, 0, set(), [], processor
        processor.init(self)

    def getValueState(self, *_):
        self.variables.append(Variable(self))
        return self.variables[-1]

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.mark

    def getExpiryTimeInMs(self):
        return self.at

    def emitted(self, parts):
        return [tuple(r) for part in parts for r in part.itertuples(index=False)]

    def batch(self, rows):
        """(seconds, value)s; the parts of a batch come out of order of time."""
        data = pd.DataFrame([(pd.Timestamp(t, unit="s"), v) for t, v in rows], columns=["ts", "v"])
        return self.emitted(self.processor.handleInputRows(("a",), iter([data[i : i + 7] for i in range(0, len(data), 7)]), self))

    def until(self, seconds):
        self.mark, out = seconds * 1000, []
        for self.at in sorted(t for t in self.timers if t <= self.mark):
            out += self.emitted(self.processor.handleExpiredTimer(("a",), self, self))
            self.timers.discard(self.at)
        return out

    def empty(self):
        return not self.timers and not any(v.values for v in self.variables)


def everything():
    return ListState(lambda row: row["v"], lambda all: [(",".join(sorted(map(str, all))),)])


def windowed(windowing, trigger=None, purging=False):
    return Store(_Processor("ts", _spans(windowing), everything, trigger or AtEnd(), False, purging, ["k", "start_ms", "end_ms", "final", "all"]))


def folded(early=None, add=lambda n, row: n + 1, start=0, flush=lambda n: [(n,)]):
    return Store(_WindowedState("ts", 10_000, early, start, add, flush, False, ["k", "start_ms", "end_ms", "final", "n"]))


ROWS = [(10 * w + k, w) for w in range(100) for k in range(5)]


@pytest.mark.parametrize("trigger,windowing,panes", [(AtEnd(), Session(3 * S), 100), (AtEnd(), Sliding(20 * S, 10 * S), 101), (Periodic(2 * S), Tumbling(10 * S), 500)])
def test_calls_do_not_grow_with_windows(trigger, windowing, panes):
    store = windowed(windowing, trigger)
    assert store.batch(ROWS) == [] and len(store.timers) == 1 and store.calls < 10
    assert len(store.until(10_000)) == panes and store.calls < 20 and store.empty()


def test_calls_of_folds_do_not_grow_with_windows():
    store = folded(2_000)
    store.batch(ROWS)
    assert len(store.timers) == 1 and store.calls < 10
    out = store.until(10_000)
    assert Counter(out) == Counter(("a", 10_000 * w, 10_000 * w + 10_000, last, 5) for w in range(100) for last in (False,) * 4 + (True,))
    assert store.calls < 20 and store.empty()


def brute(windowing, rows):
    """Every window of (seconds, value)s that all come in time."""
    windows = {}
    if isinstance(windowing, Session):
        gap, at = windowing.gap // S, []
        for t, v in sorted(rows):
            if at and t < at[-1][1]:
                at[-1] = (at[-1][0], t + gap, [*at[-1][2], v])
            else:
                at.append((t, t + gap, [v]))
        windows = {(s, e): vs for s, e, vs in at}
    else:
        size, step = windowing.size // S, getattr(windowing, "step", windowing.size) // S
        for t, v in rows:
            for s in range(t // step * step - size + step, t + 1, step):
                windows.setdefault((s, s + size), []).append(v)
    return Counter(("a", s * 1000, e * 1000, True, ",".join(sorted(map(str, vs)))) for (s, e), vs in windows.items())


@pytest.mark.parametrize("width", [1, 300, 5_000])
@pytest.mark.parametrize("windowing", [Session(4 * S), Tumbling(50 * S), Sliding(40 * S, 10 * S)])
def test_windows_of_small_and_large_states_over_many_batches(windowing, width):
    dice, store, rows, out = random.Random(width), windowed(windowing), [], []
    for n in range(40):
        new = [(10 * n + dice.randrange(60), f"{dice.randrange(100):0{width}}") for _ in range(dice.randrange(25))]
        rows += new
        out += store.until(10 * n) + store.batch(new)
    out += store.until(10_000)
    assert Counter(out) == brute(windowing, rows) and store.empty()


def test_early_panes_follow_the_watermark():
    for store in (folded(4_000), windowed(Tumbling(10 * S), Periodic(4 * S))):
        store.batch([(11, 1), (21, 1)])
        assert [r[1:4] for r in store.until(15)] == [(10_000, 20_000, False)]
        store.batch([(12, 1), (5, 1), (31, 1)])  # the second is late
        assert [r[1:4] for r in store.until(21)] == [(10_000, 20_000, False), (10_000, 20_000, True)]
        assert [r[1:4] for r in store.until(1_000)] == [(20_000, 30_000, False)] * 2 + [(20_000, 30_000, True)] + [(30_000, 40_000, False)] * 2 + [(30_000, 40_000, True)] and store.empty()


def test_counted_panes_with_and_without_purging():
    for purging in (False, True):
        store = windowed(Tumbling(100 * S), EveryCount(3), purging)
        out = store.batch([(1, "a"), (2, "b")]) + store.batch([(3, "c"), (4, "d")]) + store.until(1_000)
        assert [r[3:] for r in out] == [(False, "a,b,c"), (True, "d" if purging else "a,b,c,d")] and store.empty()


def test_large_states_are_not_written_again():
    """A growing list, a session that grows with each batch too."""
    for windowing in (Global(), Session(10 * S)):
        store = windowed(windowing)
        for n in range(200):
            store.batch([(5 * n, "x" * 1000)])
        assert store.written < 200 * 1000 * 6
        assert len(store.until(10**10)[0][4]) == 200 * 1001 - 1 and store.empty()


def test_folds_of_large_states_do_not_share_their_start():
    store = folded(None, lambda all, row: all.append(row["v"]) or all, [], lambda all: [("".join(all),)])
    for n in range(10):
        store.batch([(1, "x" * 1000), (11, "y"), (21, "z" * 1000 if n == 0 else "")])
    assert [r[4] for r in store.until(1_000)] == ["x" * 10_000, "y" * 10, "z" * 1000] and store.empty()


def test_an_element_meets_only_the_sessions_beside_it():
    spans, met = _spans(Session(3 * S)), []
    merge, spans.merge = spans.merge, lambda windows: met.append(len(windows)) or merge(windows)
    store = Store(_Processor("ts", spans, everything, AtEnd(), False, False, ["k", "start_ms", "end_ms", "final", "all"]))
    store.batch(ROWS[::-1])
    store.batch([(10 * w + 6, w) for w in range(100)])  # each joins the session before it
    assert max(met) <= 3 and [r[1:3] for r in store.until(10_000)] == [(10_000 * w, 10_000 * w + 9_000) for w in range(100)] and store.empty()


def test_each_batch_of_sliding_windows_makes_a_few_calls():
    store = windowed(Sliding(40 * S, 10 * S))
    for n in range(5):
        calls = store.calls
        store.batch([(t + n, v) for t, v in ROWS])
        assert store.calls - calls <= 3 and len(store.timers) == 1
    assert len(store.until(10_000)) == 103 and store.calls < 30 and store.empty()
