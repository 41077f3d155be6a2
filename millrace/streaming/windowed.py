"""A user's own state over any windows of a stream, flushed by triggers.

A window's state is kept as parts, one for each micro-batch that had elements
for it, and the parts are merged (``State.merge``) when the window is flushed.
Small parts lie beside the list of the key's windows, are merged as they become
many, and move to the store by themselves once they are large.  So a state that
is a list is appended to, never read and written again for each element, and no
more than one large window is in memory; windows that meet only join their lists
of parts.

Windowings: ``Tumbling``, ``Sliding``, ``Session`` and ``Global`` of
``millrace.functions.windows``, or one's own: an object with ``windows(row, ms)``,
the (start, end) in milliseconds that an element falls in, and, if its windows
merge, ``merge(windows)``, which gives (merged window, its parts) for each.

Triggers say when a window is flushed before its end; at its end it always is.
Elements are late once their window has closed, or with ``strict`` as soon as
their own time is behind the watermark; elements without a key are dropped.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.dataset import Dataset
from millrace.functions.windows import Global, Session, Sliding, Tumbling, Windowing
from millrace.operators.state import State
from millrace.streaming.processors import _FAR_MS, ROWS, SMALL, OpenWindows, use_rocksdb

_MS = timedelta(milliseconds=1)
#: Bytes of all small parts of a key; beyond them every part moves to the store.
_ALL_SMALL = 1 << 20
Span = tuple[int, int]


class Trigger:
    """When a window is flushed early; the two methods may both be used."""

    def after_element(self, n: int) -> bool:
        """Whether to flush with the window's n-th element."""
        return False

    def next_time(self, after: int, window: Span) -> int | None:
        """The first event time after ``after``, inside the window, at which to flush."""
        return None


class AtEnd(Trigger):
    """No early results."""


class Periodic(Trigger):
    """Whenever the watermark passes a multiple of ``every``."""

    def __init__(self, every: timedelta):
        self.every = every // _MS

    def next_time(self, after: int, window: Span) -> int | None:
        at = max(after, window[0]) // self.every * self.every + self.every
        return at if at < window[1] else None


class EveryCount(Trigger):
    """With every n-th element of a window."""

    def __init__(self, n: int):
        self.n = n

    def after_element(self, n: int) -> bool:
        return n % self.n == 0


class AfterFirst(Trigger):
    """Whenever the first of several triggers says so."""

    def __init__(self, *triggers: Trigger):
        self.triggers = triggers

    def after_element(self, n: int) -> bool:
        return any(t.after_element(n) for t in self.triggers)

    def next_time(self, after: int, window: Span) -> int | None:
        return min((x for t in self.triggers if (x := t.next_time(after, window)) is not None), default=None)


class _Fixed:
    merge = None

    def __init__(self, size: int, step: int):
        self.size, self.step = size, step

    def windows(self, row: dict, ms: int) -> list[Span]:
        last = ms // self.step * self.step
        return [(s, s + self.size) for s in range(last - self.size + self.step, last + 1, self.step)]


class _Sessions:
    def __init__(self, gap: int):
        self.gap = gap

    def windows(self, row: dict, ms: int) -> list[Span]:
        return [(ms, ms + self.gap)]

    def beside(self, w: Span, order: list[Span]) -> list[Span]:
        """Of sorted sessions, none of which overlap, those that ``w`` overlaps."""
        low = high = bisect_left(order, w)
        if low and order[low - 1][1] > w[0]:
            low -= 1
        while high < len(order) and order[high][0] < w[1]:
            high += 1
        return order[low:high]

    def merge(self, windows: list[Span]) -> list[tuple[Span, list[Span]]]:
        out: list[tuple[Span, list[Span]]] = []
        for w in sorted(windows):
            if out and w[0] < out[-1][0][1]:
                (start, end), parts = out[-1]
                out[-1] = ((start, max(end, w[1])), [*parts, w])
            else:
                out.append((w, [w]))
        return out


class _Everything:
    merge = None

    def windows(self, row: dict, ms: int) -> list[Span]:
        return [(0, _FAR_MS - 1000)]


def _spans(windowing: Windowing | Any) -> Any:
    if isinstance(windowing, Tumbling):
        return _Fixed(windowing.size // _MS, windowing.size // _MS)
    if isinstance(windowing, Sliding):
        return _Fixed(windowing.size // _MS, windowing.step // _MS)
    if isinstance(windowing, Session):
        return _Sessions(windowing.gap // _MS)
    return _Everything() if isinstance(windowing, Global) else windowing


class _Processor(OpenWindows):
    """Its windows: (time of the next flush, elements, parts in the store, small parts)."""

    def __init__(self, time: str, spans: Any, state: Callable[[], State], trigger: Trigger, strict: bool, purging: bool, names: list[str]):
        self.time, self.spans, self.state, self.trigger, self.strict, self.purging, self.names = time, spans, state, trigger, strict, purging, names

    def _load(self) -> None:
        self.load()
        self.small = sum(len(x) for have in self.known.values() for x in have[3])

    def _next(self, after: int, w: Span) -> int:
        at = self.trigger.next_time(after, w)
        return w[1] if at is None else at

    def _window(self, w: Span, mark: int) -> list:
        if w not in self.known:
            self.known[w] = [self._next(max(mark, w[0]), w), 0, [], []]
        return self.known[w]

    def _put(self, w: Span, n: int, one: State, mark: int) -> None:
        """Adds a part to a window."""
        have, part = self._window(w, mark), pickle.dumps(one)
        have[1] += n
        have[3].append(part)
        self.small += len(part)
        if self.small > _ALL_SMALL or sum(map(len, have[3])) > SMALL:
            self._settle(have)

    def _settle(self, have: list) -> None:
        """Merges a window's small parts into one, which goes to the store if it is not small."""
        self.small -= sum(map(len, have[3]))
        part = have[3][0] if len(have[3]) == 1 else pickle.dumps(self._merge(have[3]))
        if self.small + len(part) > _ALL_SMALL or len(part) > SMALL // 2:
            self.large.updateValue((self.number,), (part,))
            have[2].append(self.number)
            self.number += 1
            have[3] = []
        else:
            self.small += len(part)
            have[3] = [part]

    def _merge(self, parts: Iterable[bytes]) -> State:
        whole = self.state()
        for part in parts:
            whole.merge(pickle.loads(part))
        return whole

    def _flush(self, key: tuple, w: Span, final: bool) -> list[tuple]:
        have = self.known[w]
        whole = self._merge(x for part in (map(self.stored, have[2]), have[3]) for x in part)
        out = [(key[0], *w, final, *x) for x in whole.flush()]
        whole.close()
        if final or self.purging:
            for k in have[2]:
                self.large.removeKey((k,))
            self.small -= sum(map(len, have[3]))
            have[2:] = [], []
        if final:
            del self.known[w]
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self._load()
        order = sorted(self.known)  # with those that are new, if windows merge
        new: dict[Span, tuple[int, State]] = {}
        out: list[tuple] = []
        for part in rows:
            for row in part.sort_values(self.time, kind="stable").to_dict("records"):
                ms = int(pd.Timestamp(row[self.time]).value // 1_000_000)
                if self.strict and ms < mark:
                    continue
                for w in self.spans.windows(row, ms):
                    if w[1] <= mark:
                        continue
                    if self.spans.merge is not None:
                        w = self._merged(w, order, new, mark)
                    n, one = new.get(w) or (0, self.state())
                    one.add(row)
                    new[w] = n + 1, one
                    if self.trigger.after_element((self.known[w][1] if w in self.known else 0) + n + 1):
                        self._put(w, n + 1, one, mark)
                        del new[w]
                        out += self._flush(key, w, False)
                        if len(out) >= ROWS:
                            yield pd.DataFrame(out, columns=self.names)
                            out = []
        for w, (n, one) in new.items():
            self._put(w, n, one, mark)
        self.save()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def _merged(self, w: Span, order: list[Span], new: dict[Span, tuple[int, State]], mark: int) -> Span:
        """The window that ``w`` becomes part of; those that it joins are moved there."""
        there = self.spans.beside(w, order) if isinstance(self.spans, _Sessions) else order
        for whole, own in self.spans.merge([*(x for x in there if x != w), w]):
            if w not in own:
                continue
            for x in own:
                if x == whole:
                    continue
                if x in self.known:
                    _, n, large, small = self.known.pop(x)
                    have = self._window(whole, mark)
                    have[1] += n
                    have[2] += large
                    have[3] += small
                if x in new:
                    n, one = new.pop(x)
                    if whole in new:
                        new[whole][1].merge(one)
                        new[whole] = new[whole][0] + n, new[whole][1]
                    else:
                        new[whole] = n, one
                at = bisect_left(order, x)
                if order[at : at + 1] == [x]:
                    del order[at]
            w = whole
            break
        at = bisect_left(order, w)
        if order[at : at + 1] != [w]:
            insort(order, w)
        return w

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        out: list[tuple] = []
        self._load()
        self.timer = None
        for w in sorted(w for w, have in self.known.items() if have[0] <= mark):
            have = self.known[w]
            large = bool(have[2])
            while have[0] < w[1] and have[0] <= mark:
                out += self._flush(key, w, False)
                have[0] = self._next(have[0], w)
            if w[1] <= mark:
                out += self._flush(key, w, True)
            if out and (large or len(out) >= ROWS):
                yield pd.DataFrame(out, columns=self.names)
                out = []
        self.save()
        if out:
            yield pd.DataFrame(out, columns=self.names)


def reduce_windows(
    ds: Dataset, key: str, state: Callable[[], State], schema: str, windowing: Windowing | Any, trigger: Trigger | None = None, strict: bool = False, purging: bool = False
) -> Dataset:
    """(key, start_ms, end_ms, final, columns of ``schema``): what a window's state flushes at its end, and early where the trigger says so.

    ``state`` has to be mergeable and to pickle.  With ``purging`` an early flush
    empties the window, without it the results accumulate.
    """
    use_rocksdb(ds.df.sparkSession)
    out = StructType().add(ds.df.schema[key]).add("start_ms", "long").add("end_ms", "long").add("final", "boolean")
    out = StructType(out.fields + StructType.fromDDL(schema).fields)
    processor = _Processor(ds.time, _spans(windowing), state, trigger or AtEnd(), strict, purging, out.fieldNames())
    return Dataset(ds.df.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime"))


class ListState(State):
    """The elements themselves, in order of arrival, for a function of all of them."""

    def __init__(self, each: Callable[[dict], Any], whole: Callable[[list], Iterable[tuple]]):
        self.each, self.whole, self.elements = each, whole, []

    def __getstate__(self) -> list:
        return self.elements  # parts are merged into a state that has the functions

    def __setstate__(self, elements: list) -> None:
        self.elements = elements

    def add(self, element: dict[str, Any]) -> None:
        self.elements.append(self.each(element))

    def merge(self, other: State) -> None:
        self.elements += other.elements

    def flush(self) -> Iterable[tuple]:
        return self.whole(self.elements)
