"""Windowings: which windows an element falls in, as columns.

``assign`` adds a struct<start, end> column (for Count a number, for Custom the
user's label) that later groupings use as a further key.  Session windows are
half-open: two elements exactly ``gap`` apart are two sessions, where Spark's
``session_window`` merges them; so its gap is shortened by the clock's
resolution, one microsecond, and the end is moved back by as much.

Early results exist on streams only: ``millrace.streaming.processors``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.dataset import Dataset, Expr, column

WINDOW = "window"
MICRO = timedelta(microseconds=1)


def text_of(d: timedelta) -> str:
    return f"{d // MICRO} microseconds"


def interval(d: timedelta) -> Column:
    return F.expr(f"INTERVAL '{d // MICRO / 1e6:.6f}' SECOND")


@dataclass(frozen=True)
class Windowing:
    #: Windows of one key may merge.
    merging = False
    #: Whether event time is needed.
    timed = True

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        raise NotImplementedError

    def needed(self, ds: Dataset) -> Column:
        if ds.time is None:
            raise ValueError(f"{type(self).__name__} needs event time: assign_event_time() first")
        return F.col(ds.time)


@dataclass(frozen=True)
class Global(Windowing):
    """One window; emitted at the end of the input."""

    timed = False

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        df = ds.df.drop(ds.window) if ds.window else ds.df
        return ds.having(df, window=None, windowing=self)


@dataclass(frozen=True)
class Tumbling(Windowing):
    size: timedelta

    def __post_init__(self) -> None:
        if self.size <= timedelta(0):
            raise ValueError("the window's size must be positive")

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        df = ds.df.withColumn(WINDOW, F.window(self.needed(ds), text_of(self.size)))
        return ds.having(df if ds.window in (None, WINDOW) else df.drop(ds.window), window=WINDOW, windowing=self)


@dataclass(frozen=True)
class Sliding(Windowing):
    size: timedelta
    step: timedelta

    def __post_init__(self) -> None:
        if self.step <= timedelta(0) or self.size % self.step:
            raise ValueError("the window's size must be a multiple of its step")

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        df = ds.df.withColumn(WINDOW, F.window(self.needed(ds), text_of(self.size), text_of(self.step)))
        return ds.having(df if ds.window in (None, WINDOW) else df.drop(ds.window), window=WINDOW, windowing=self)


@dataclass(frozen=True)
class Session(Windowing):
    gap: timedelta
    merging = True

    def __post_init__(self) -> None:
        if self.gap <= MICRO:
            raise ValueError("the gap must be over a microsecond")

    def grouping(self, ds: Dataset) -> Column:
        """For Spark's own aggregates, which merge sessions; close() gives its true end."""
        return F.session_window(self.needed(ds), text_of(self.gap - MICRO))

    @staticmethod
    def close(window: str = "session_window") -> Column:
        return F.struct(F.col(f"{window}.start").alias("start"), (F.col(f"{window}.end") + interval(MICRO)).alias("end"))

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        """Gaps and islands, for whatever is not one of Spark's aggregates; bounded data only."""
        if not ds.bounded:
            raise ValueError("sessions of unbounded data can be aggregated, but not assigned row by row")
        t = self.needed(ds)
        along = Window.partitionBy(*keys).orderBy(t)
        upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        begins = F.when(F.lag(t).over(along).isNull() | (F.lag(t).over(along) + interval(self.gap) <= t), 1).otherwise(0)
        df = ds.df.withColumn("__begins", begins).withColumn("__session", F.sum("__begins").over(upto))
        whole = Window.partitionBy(*keys, "__session")
        span = F.struct(F.min(t).over(whole).alias("start"), (F.max(t).over(whole) + interval(self.gap)).alias("end"))
        df = df.withColumn(WINDOW, span).drop("__begins", "__session")
        return ds.having(df if ds.window in (None, WINDOW) else df.drop(ds.window), window=WINDOW, windowing=self)


@dataclass(frozen=True)
class Intervals(Windowing):
    """Merging windows of one's own: each element brings [start, end), and those of a key that overlap become one.

    ``Session(gap)`` is the case of start = time and end = time + gap.  Windows
    that only touch stay apart.  Bounded data only.
    """

    start: Expr
    end: Expr
    merging = True
    timed = False

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        if not ds.bounded:
            raise ValueError("merging windows of unbounded data: use Session")
        df = ds.df.withColumns({"__from": column(self.start), "__to": column(self.end)})
        along = Window.partitionBy(*keys).orderBy("__from", "__to")
        reached = F.max("__to").over(along.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("__begins", F.when(reached.isNull() | (reached <= F.col("__from")), 1).otherwise(0))
        df = df.withColumn("__island", F.sum("__begins").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        whole = Window.partitionBy(*keys, "__island")
        span = F.struct(F.min("__from").over(whole).alias("start"), F.max("__to").over(whole).alias("end"))
        df = df.withColumn(WINDOW, span).drop("__from", "__to", "__begins", "__island")
        return ds.having(df if ds.window in (None, WINDOW) else df.drop(ds.window), window=WINDOW, windowing=self)


@dataclass(frozen=True)
class Count(Windowing):
    """Every ``size`` elements of a key, in the order of ``by``; what is left at the end is a window too."""

    size: int
    by: tuple[str, ...] = ()
    timed = False

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError("a count window holds one element at least")

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        if not ds.bounded:
            raise ValueError("count windows of unbounded data: use millrace.streaming.count_windows")
        order = list(self.by) or ([ds.time] if ds.time else [])
        if not order:
            raise ValueError("count windows need an order: event time, or Count(size, by=...)")
        keys = list(keys) or [F.lit(0)]
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        df = ds.df.withColumn(WINDOW, F.floor((place - 1) / self.size).cast("long"))
        return ds.having(df if ds.window in (None, WINDOW) else df.drop(ds.window), window=WINDOW, windowing=self)


@dataclass(frozen=True)
class Custom(Windowing):
    """The label of an element's window; an array gives it several windows."""

    label: Expr
    many: bool = False
    timed = False

    def assign(self, ds: Dataset, keys: Sequence[str] = ()) -> Dataset:
        label = F.explode(column(self.label)) if self.many else column(self.label)
        df = ds.df.withColumn("__label", label)
        if ds.window:
            df = df.drop(ds.window)
        return ds.having(df.withColumnRenamed("__label", WINDOW), window=WINDOW, windowing=self)


def window_time(ds: Dataset) -> Column | None:
    """The time of what a window emits: the last instant inside it; null for windows that are not intervals."""
    if ds.window is None or not isinstance(ds.windowing, (Tumbling, Sliding, Session, Intervals)):
        return None
    if not ds.df.schema[ds.window].dataType["end"].dataType.typeName().startswith("timestamp"):
        return None  # intervals of something other than time
    return F.col(f"{ds.window}.end") - interval(MICRO)
