"""Element-wise operators: they keep each element's time and window, and never shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.dataset import Dataset, Expr, Named, column, named


def map_elements(ds: Dataset, out: Expr | Named) -> Dataset:
    """One output for each input."""
    cols = named(out, "value")
    return ds.having(ds.df.select(*(c.alias(n) for n, c in cols.items()), *(c for c in ds.carried if c not in cols)))


def flat_map(ds: Dataset, out: Expr, name: str = "value", event_time: Expr | None = None) -> Dataset:
    """An output for each element of an array; null and empty arrays give none.

    ``event_time`` is taken from the input element; its outputs inherit it.
    """
    if event_time is not None:
        ds = assign_event_time(ds, event_time)
    return ds.having(ds.df.select(F.explode(column(out)).alias(name), *(c for c in ds.carried if c != name)))


def map_partitions(ds: Dataset, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> Dataset:
    """Opaque Python code over Arrow batches, 0 to n outputs for each input; the schema has to carry time and window if they are to stay."""
    df = ds.df.mapInPandas(f, schema)
    return ds.having(df, time=ds.time if ds.time in df.columns else None, window=ds.window if ds.window in df.columns else None)


def filter_by(ds: Dataset, condition: Expr) -> Dataset:
    """The elements for which the condition is true; null is not."""
    return ds.having(ds.df.where(condition))


class Halves(NamedTuple):
    positive: Dataset
    negative: Dataset


def split(ds: Dataset, condition: Column) -> Halves:
    """Two outputs that partition the input; a null condition counts as false."""
    true = F.coalesce(condition, F.lit(False))
    return Halves(ds.having(ds.df.where(true)), ds.having(ds.df.where(~true)))


def assign_event_time(ds: Dataset, event_time: Expr, name: str = "ts", delay: str | None = None) -> Dataset:
    """Sets the elements' time: a timestamp, or a long of epoch milliseconds.

    ``delay`` is the watermark's on a stream: a window is late once its end is
    at or below the greatest time seen less the delay.
    """
    t = column(event_time)
    df = ds.df.withColumn(name, t)
    kind = dict(df.dtypes)[name]
    if kind in ("bigint", "int"):
        df = df.withColumn(name, F.timestamp_millis(F.col(name).cast("long")))
    elif kind == "timestamp_ntz" and df.isStreaming:
        df = df.withColumn(name, F.col(name).cast("timestamp"))  # a watermark needs it
    if df.isStreaming and delay is not None:
        df = df.withWatermark(name, delay)
    return ds.having(df, time=name)
