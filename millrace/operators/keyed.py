"""Keyed reductions, per key and window.

Reducers are aggregate columns (``millrace.functions.reducers`` or any of
Spark's), so combinable ones are combined before the shuffle.  Without a
windowing the attached window of the input is kept as a key: the results of one
windowed operator meet again, window by window, in the next.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from millrace.dataset import Dataset, Expr, Named, column, named
from millrace.functions.windows import Session, Windowing, window_time


def _keyed(ds: Dataset, key: Expr | Named) -> tuple[Dataset, list[str]]:
    keys = named(key, "key")
    df = ds.df
    own = {n: c for n, c in keys.items() if not (n in df.columns and c._jc.equals(F.col(n)._jc))}
    return ds.having(df.withColumns(own)) if own else ds, list(keys)


def _emitted(ds: Dataset) -> Dataset:
    """With the time of what windows emit."""
    at = window_time(ds)
    if at is None:
        return ds.having(ds.df, time=None)
    return ds.having(ds.df.withColumn("ts", at), time="ts")


def reduce_by_key(ds: Dataset, key: Expr | Named, reducers: Mapping[str, Column], windowing: Windowing | None = None) -> Dataset:
    """One row for each key and window: keys, reducers' results, window, time."""
    ds, keys = _keyed(ds, key)
    aggregates = [c.alias(n) for n, c in reducers.items()]
    if isinstance(windowing, Session):
        df = ds.df.groupBy(*keys, windowing.grouping(ds)).agg(*aggregates)
        df = df.withColumn("window", windowing.close()).drop("session_window")
        return _emitted(ds.having(df, window="window", windowing=windowing))
    if windowing is not None:
        ds = windowing.assign(ds, keys)
    by = keys + ([ds.window] if ds.window else [])
    return _emitted(ds.having(ds.df.groupBy(*by).agg(*aggregates) if by else ds.df.agg(*aggregates)))


def reduce_to_many(ds: Dataset, key: Expr | Named, reducer: Column, windowing: Windowing | None = None, name: str = "value") -> Dataset:
    """A reducer whose result is an array: each of its elements is a row."""
    out = reduce_by_key(ds, key, {name: reducer}, windowing)
    return out.having(out.df.withColumn(name, F.explode(name)))


def reduce_groups(ds: Dataset, key: Expr | Named, f: Callable[..., pd.DataFrame], schema: str | StructType, windowing: Windowing | None = None) -> Dataset:
    """Opaque Python code over each group, which has to fit a task's memory; keys and window are up to ``f``'s result."""
    ds, keys = _keyed(ds, key)
    if windowing is not None:
        ds = windowing.assign(ds, keys)
    df = ds.df.groupBy(*keys, *([ds.window] if ds.window else [])).applyInPandas(f, schema)
    return ds.having(df, time=ds.time if ds.time in df.columns else None, window=ds.window if ds.window in df.columns else None)


def count_by_key(ds: Dataset, key: Expr | Named, windowing: Windowing | None = None, name: str = "value") -> Dataset:
    return reduce_by_key(ds, key, {name: F.count(F.lit(1))}, windowing)


def sum_by_key(ds: Dataset, key: Expr | Named, value: Expr | None = None, windowing: Windowing | None = None, name: str = "value") -> Dataset:
    """Sums of longs; without a value each element counts as 1.  Overflow is an error."""
    v = F.lit(1) if value is None else column(value)
    return reduce_by_key(ds, key, {name: F.sum(v.cast("long"))}, windowing)


def top_per_key(ds: Dataset, key: Expr | Named, value: Expr, score: Expr, windowing: Windowing | None = None) -> Dataset:
    """(key, value, score) of the greatest score; null values never win, ties go to the greatest value.

    The maximum of a struct combines on the map side, unlike a ranking window.
    """
    best = F.max(F.struct(column(score).alias("score"), column(value).alias("value")))
    some = ds.having(ds.df.where(column(value).isNotNull()))
    out = reduce_by_key(some, key, {"__best": best}, windowing)
    return out.having(out.df.withColumns({"value": F.col("__best.value"), "score": F.col("__best.score")}).drop("__best"))


def reduce_window(ds: Dataset, reducers: Mapping[str, Column], windowing: Windowing | None = None) -> Dataset:
    """One row for each window that has an element; none for an empty input."""
    if windowing is not None and not isinstance(windowing, Session):
        ds = windowing.assign(ds)
        windowing = None
    if ds.window or windowing is not None:
        return reduce_by_key(ds, {}, reducers, windowing)
    aggregates = [c.alias(n) for n, c in reducers.items()]
    df = ds.df.agg(F.count(F.lit(1)).alias("__n"), *aggregates)
    return ds.having(df.where("__n > 0").drop("__n"), time=None)


def running(ds: Dataset, key: Expr | Named, reducers: Mapping[str, Column], order: list[Expr], windowing: Windowing | None = None) -> Dataset:
    """Every intermediate result of a reduction, in the given order: a row for each element."""
    ds, keys = _keyed(ds, key)
    if windowing is not None:
        ds = windowing.assign(ds, keys)
    by = keys + ([ds.window] if ds.window else [])
    upto = Window.partitionBy(*by).orderBy(*map(column, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = ds.df.select(*keys, *(c.over(upto).alias(n) for n, c in reducers.items()), *([ds.window] if ds.window else []))
    return ds.having(df, time=None)
