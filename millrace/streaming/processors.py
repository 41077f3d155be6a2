"""Stateful processing of streams that Spark's aggregates can't express.

Elements without a key are dropped.  The operators keep their state in the state store, one key at a time, and
never hold more than a key's open windows, of those that are large only one.  They need the RocksDB provider
(``use_rocksdb``).

Each call of the store goes from the Python worker to the JVM and back, for about
a millisecond, and so does each timer: a key makes a few of them in a
micro-batch, however many elements and windows it has (``OpenWindows``).
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.dataset import Dataset
from millrace.streaming.runner import FAR

_EPOCH = datetime(1970, 1, 1)
_FAR_MS = (FAR - _EPOCH) // timedelta(milliseconds=1)
#: Bytes of a state that is kept beside the list of a key's windows.
SMALL = 4096
#: Rows that are emitted together.
ROWS = 1000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _CountWindows(StatefulProcessor):
    """Emits (key, n, total) for every ``size`` values of a key; what is left when time ends is emitted too."""

    def __init__(self, size: int, key: str, value: str, time: str):
        self.size, self.key, self.value, self.time = size, key, value, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, total = self.open.get() if self.open.exists() else (0, 0)
        out = []
        every = pd.concat(list(rows)).sort_values(self.time, kind="stable")
        for v in every[self.value]:
            n, total = n + 1, total + (0 if pd.isna(v) else int(v))
            if n == self.size:
                out.append((key[0], n, total))
                n = total = 0
        if n:
            self.open.update((n, total))
            self.handle.registerTimer(_FAR_MS - 1000)
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "n", "total"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            n, total = self.open.get()
            self.open.clear()
            yield pd.DataFrame([(key[0], n, total)], columns=[self.key, "n", "total"])

    def close(self) -> None:
        pass


def count_windows(ds: Dataset, key: str, value: str, size: int) -> Dataset:
    """(key, n, total): sums of ``value`` over count windows of a stream, in order of time within each micro-batch."""
    use_rocksdb(ds.df.sparkSession)
    schema = StructType().add(ds.df.schema[key]).add("n", "long").add("total", "long")
    rows = ds.df.where(F.col(key).isNotNull()).select(key, value, ds.time)
    return Dataset(rows.groupBy(key).transformWithStateInPandas(_CountWindows(size, key, value, ds.time), schema, "Append", "EventTime"))


class OpenWindows(StatefulProcessor):
    """A key's open windows, in one value of the store, and one timer, at the first time when any of them is due.

    ``known`` has a list for each window, the time when it is due first.  States
    that are not small are in ``large``, under a number.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "windows binary")
        self.large = handle.getMapState("large", "number long", "state binary")

    def load(self) -> None:
        found = self.open.get()
        self.there = found is not None
        self.timer, self.number, self.known = pickle.loads(bytes(found[0])) if found else (None, 0, {})

    def save(self) -> None:
        if self.known:
            due = min(have[0] for have in self.known.values())
            if self.timer is None or due < self.timer:
                if self.timer is not None:
                    self.handle.deleteTimer(self.timer)
                self.handle.registerTimer(due)
                self.timer = due
            self.open.update((pickle.dumps((self.timer, self.number, self.known)),))
        elif self.there:
            self.open.clear()

    def stored(self, number: int) -> bytes:
        return bytes(self.large.getValue((number,))[0])

    def close(self) -> None:
        pass


class _WindowedState(OpenWindows):
    """A user's fold over tumbling windows, with accumulating early panes on an event-time grid.

    Its windows, by their start: (time of the next pane, state as JSON, or null if it is large and stored under the start).
    """

    def __init__(self, time: str, size_ms: int, early_ms: int | None, start: Any, add: Callable, flush: Callable, strict: bool, names: list[str]):
        self.time, self.size, self.early, self.strict, self.names = time, size_ms, early_ms, strict, names
        self.start, self.add, self.flush = json.dumps(start), add, flush

    def _next(self, after: int, start: int) -> int:
        """The first time after ``after`` on the grid inside the window, else its end."""
        end = start + self.size
        return min(max(after, start) // self.early * self.early + self.early, end) if self.early else end

    def _state(self, start: int) -> Any:
        text = self.known[start][1]
        return json.loads(self.stored(start).decode() if text is None else text)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.load()
        states: dict[int, Any] = {}
        for part in rows:
            for row in part.sort_values(self.time, kind="stable").to_dict("records"):
                ms = int(pd.Timestamp(row[self.time]).value // 1_000_000)
                start = ms // self.size * self.size
                if start + self.size <= mark or self.strict and ms < mark:
                    continue  # late
                if start not in states:
                    states[start] = self._state(start) if start in self.known else json.loads(self.start)
                states[start] = self.add(states[start], row)
        for start, state in states.items():
            text = json.dumps(state)
            due, was = self.known.get(start, (self._next(mark, start), ""))
            if len(text) > SMALL:
                self.large.updateValue((start,), (text.encode(),))
                text = None
            elif was is None:
                self.large.removeKey((start,))
            self.known[start] = [due, text]
        self.save()
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.load()
        self.timer = None
        out: list[tuple] = []
        for start in sorted(start for start, have in self.known.items() if have[0] <= mark):
            have, end = self.known[start], start + self.size
            while have[0] < end and have[0] <= mark:
                out += [(key[0], start, end, False, *x) for x in self.flush(self._state(start))]
                have[0] = self._next(have[0], start)
            if end <= mark:
                out += [(key[0], start, end, True, *x) for x in self.flush(self._state(start))]
                if have[1] is None:
                    self.large.removeKey((start,))
                del self.known[start]
            if out and (have[1] is None or len(out) >= ROWS):
                yield pd.DataFrame(out, columns=self.names)
                out = []
        self.save()
        if out:
            yield pd.DataFrame(out, columns=self.names)


def reduce_state_stream(
    ds: Dataset, key: str, size: timedelta, start: Any, add: Callable[[Any, dict], Any], flush: Callable[[Any], list[tuple]], schema: str, early: timedelta | None = None, strict: bool = False
) -> Dataset:
    """(key, start_ms, end_ms, final, columns of ``schema``) over tumbling windows of a stream.

    ``add(state, row)`` gives the new state, a JSON value; ``flush(state)`` gives
    tuples.  With ``early`` a window also emits its state so far, final = false,
    whenever the watermark passes a multiple of that duration inside it.  An
    element is late once its window has closed; if ``strict``, as soon as its own
    time is behind the watermark.
    """
    use_rocksdb(ds.df.sparkSession)
    ms = timedelta(milliseconds=1)
    out = StructType().add(ds.df.schema[key]).add("start_ms", "long").add("end_ms", "long").add("final", "boolean")
    out = StructType(out.fields + StructType.fromDDL(schema).fields)
    processor = _WindowedState(ds.time, size // ms, early // ms if early else None, start, add, flush, strict, out.fieldNames())
    return Dataset(ds.df.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime"))
