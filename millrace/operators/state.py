"""reduce_state_by_key: a user's own state for each key and window.

The user gives a ``State``: ``add`` takes an element, ``flush`` gives the results,
``merge`` takes in another state.  Bounded data are dealt by key and window, sorted
by them and by time, and stream through Arrow; a group is never held, only its
state.  Streams: see ``millrace.streaming.processors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.dataset import Dataset, Expr, Named
from millrace.functions.windows import Windowing
from millrace.operators.keyed import _emitted, _keyed


class State:
    """add() each element (a dict of its columns), then flush(), then close()."""

    def add(self, element: dict[str, Any]) -> None:
        raise NotImplementedError

    def flush(self) -> Iterable[tuple]:
        raise NotImplementedError

    def merge(self, other: State) -> None:
        raise NotImplementedError("this state can't be merged")

    def close(self) -> None:
        pass


def reduce_state_by_key(
    ds: Dataset, key: Expr | Named, state: Callable[[], State], schema: str, windowing: Windowing | None = None, order: tuple[str, ...] = ()
) -> Dataset:
    """Keys, the columns of ``schema`` (a row of them for each tuple of flush()), window and time.

    Elements arrive in order of ``order``, else of time.
    """
    if not ds.bounded:
        raise ValueError("unbounded data: use millrace.streaming.processors")
    ds, keys = _keyed(ds, key)
    if windowing is not None:
        ds = windowing.assign(ds, keys)
    df, by, interval = ds.df, list(keys), False
    if ds.window:
        interval = isinstance(df.schema[ds.window].dataType, StructType)
        if interval:
            df = df.withColumns({"__start": F.col(f"{ds.window}.start"), "__end": F.col(f"{ds.window}.end")}).drop(ds.window)
        by += ["__start", "__end"] if interval else [ds.window]
    sort = list(order) or ([ds.time] if ds.time else [])
    out = StructType(df.select(*by).schema.fields + StructType.fromDDL(schema).fields)
    names = out.fieldNames()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, one, found = None, None, []

        def flush() -> None:
            found.extend(now + tuple(x) for x in one.flush())
            one.close()

        for rows in parts:
            for element in rows.to_dict("records"):
                group = tuple(None if pd.isna(element[c]) else element[c] for c in by)
                if one is None or group != now:
                    if one is not None:
                        flush()
                    now, one = group, state()
                one.add(element)
            if found:
                yield pd.DataFrame(found, columns=names)
                found = []
        if one is not None:
            flush()
            yield pd.DataFrame(found, columns=names)

    got = df.repartition(*by).sortWithinPartitions(*by, *sort).mapInPandas(run, out)
    if interval:
        got = got.withColumn(ds.window, F.struct(F.col("__start").alias("start"), F.col("__end").alias("end"))).drop("__start", "__end")
    return _emitted(ds.having(got))
