"""Equi-joins: inner, left, right and full, per key and window.

Without a windowing both sides are joined as they are, on the key and, where
both are attached to windows, the window.  With one, each side gets its windows
first.  Sessions merge across both sides: the sides are sessionised together
and then joined on (key, session).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.dataset import Dataset, Expr, column
from millrace.functions.windows import Count, Custom, Global, Session, Windowing, window_time
from millrace.operators.sets import union


#: What a side hinted fits_in_memory may have at most; the rows count where Spark has no estimate.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 100_000
UNKNOWN = 1 << 60


class WindowingRequired(ValueError):
    """A join of windowed inputs has to say how it is windowed itself."""


def validate(left: Windowing | None, right: Windowing | None, own: Windowing | None) -> None:
    """Only inputs in the global window may be joined without a windowing."""
    if own is None and any(w is not None and not isinstance(w, Global) for w in (left, right)):
        raise WindowingRequired("one of the join's inputs is windowed: give the join a windowing")


def fits(df: DataFrame) -> bool:
    """Whether a side is small enough to broadcast: by Spark's estimate, an upper bound for files, or else by counting rows up to the limit."""
    if df.isStreaming:
        return False
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < UNKNOWN:
        return size <= BROADCAST_BYTES
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join(
    left: Dataset,
    right: Dataset,
    on: tuple[Expr, Expr],
    out: Mapping[str, Column],
    how: str = "inner",
    windowing: Windowing | None = None,
    condition: Column | None = None,
    null_safe: bool = False,
    attached: bool = False,
    name: str = "key",
) -> Dataset:
    """(key, out..., window, time) of each pair.

    ``out`` and ``condition`` name the sides' columns as ``l.x`` and ``r.x``; the
    columns of a side that is missing are null.  Null keys never match unless
    ``null_safe``.  ``attached`` joins on the windows that both inputs already
    have.  A side hinted fits_in_memory is broadcast where the join allows it and
    its size, which is checked, does; else Spark picks the strategy.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"no such join: {how}")
    if not attached:
        validate(left.windowing if left.window else None, right.windowing if right.window else None, windowing)
    if not (left.bounded and right.bounded) and windowing is None and not attached:
        raise WindowingRequired("a join of unbounded inputs has to be windowed")
    hints = (left.fits_in_memory, right.fits_in_memory)
    a = left.having(left.df.withColumn("__key", column(on[0])))
    b = right.having(right.df.withColumn("__key", column(on[1])))
    if isinstance(windowing, Session):
        a, b = _sessions(a, b, windowing)
    elif windowing is not None:
        a, b = windowing.assign(a, ["__key"]), windowing.assign(b, ["__key"])
    l, r = a.df.alias("l"), b.df.alias("r")
    if hints[1] and how in ("inner", "left") and fits(b.df):
        r = F.broadcast(r)
    elif hints[0] and how in ("inner", "right") and fits(a.df):
        l = F.broadcast(l)
    same = F.col("l.__key").eqNullSafe(F.col("r.__key")) if null_safe else F.col("l.__key") == F.col("r.__key")
    windowed = a.window is not None and b.window is not None
    if windowed:
        same &= F.col(f"l.{a.window}") == F.col(f"r.{b.window}")
    if condition is not None:
        same &= condition
    joined = l.join(r, same, how)
    window = [F.coalesce(F.col(f"l.{a.window}"), F.col(f"r.{b.window}")).alias("window")] if windowed else []
    df = joined.select(F.coalesce("l.__key", "r.__key").alias(name), *(c.alias(n) for n, c in out.items()), *window)
    result = Dataset(df, window="window" if windowed else None, windowing=a.windowing if windowed else None)
    at = window_time(result)
    if windowed and at is not None and not isinstance(a.windowing, (Count, Custom)):
        return result.having(df.withColumn("ts", at), time="ts")
    return result


def left_join(left: Dataset, right: Dataset, on: tuple[Expr, Expr], out: Mapping[str, Column], **more: object) -> Dataset:
    return join(left, right, on, out, how="left", **more)


def right_join(left: Dataset, right: Dataset, on: tuple[Expr, Expr], out: Mapping[str, Column], **more: object) -> Dataset:
    return join(left, right, on, out, how="right", **more)


def full_join(left: Dataset, right: Dataset, on: tuple[Expr, Expr], out: Mapping[str, Column], **more: object) -> Dataset:
    return join(left, right, on, out, how="full", **more)


def _sessions(a: Dataset, b: Dataset, windowing: Session) -> tuple[Dataset, Dataset]:
    """Both sides with the sessions of their union."""

    def tagged(x: Dataset, side: str) -> Dataset:
        row = F.struct(*(F.col(f"`{c}`") for c in x.payload if c != "__key"), *([F.col(x.time).alias("__at")] if x.time else []))
        other = "r" if side == "l" else "l"
        df = x.df.select("__key", F.col(x.time).alias("__ts"), row.alias(f"__{side}"))
        return Dataset(df.withColumn(f"__{other}", F.lit(None)), time="__ts")

    left, right = tagged(a, "l"), tagged(b, "r")
    kinds = {"__l": left.df.schema["__l"].dataType, "__r": right.df.schema["__r"].dataType}
    left = left.having(left.df.withColumn("__r", F.col("__r").cast(kinds["__r"])).select("__key", "__ts", "__l", "__r"))
    right = right.having(right.df.withColumn("__l", F.col("__l").cast(kinds["__l"])).select("__key", "__ts", "__l", "__r"))
    both = windowing.assign(union(left, right), ["__key"])

    def one(side: str, x: Dataset) -> Dataset:
        df = both.df.where(F.col(f"__{side}").isNotNull()).select("__key", f"__{side}.*", "window")
        return x.having(df.withColumnRenamed("__at", x.time) if x.time else df, window="window", windowing=windowing)

    return one("l", a), one("r", b)
