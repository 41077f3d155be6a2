"""Ready reducers: columns for ``reduce_by_key`` and its kin.

Those built on Spark's aggregates combine on the map side.  ``fold`` is for
functions that have no such aggregate: it gathers a group's values, so it suits
groups that fit a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.dataset import Expr, column


def sum_of(e: Expr, kind: str = "long") -> Column:
    """Overflow is an error here, never a wrapped-around number."""
    return F.sum(column(e).cast(kind))


def count() -> Column:
    return F.count(F.lit(1))


def max_by(value: Expr, score: Expr) -> Column:
    """A value of the greatest score; null values never win, ties go to the greatest value."""
    v, s = column(value), column(score)
    best = F.max(F.when(v.isNotNull(), F.struct(s.alias("s"), v.alias("v"))))
    return best["v"]


def values(e: Expr) -> Column:
    return F.collect_list(column(e))


def sorted_values(e: Expr, descending: bool = False) -> Column:
    return F.sort_array(F.collect_list(column(e)), asc=not descending)


def sorted_by(e: Expr, order: Expr) -> Column:
    """The values of a group, in the order of another expression."""
    pairs = F.sort_array(F.collect_list(F.struct(column(order).alias("o"), column(e).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def value_set(e: Expr) -> Column:
    return F.sort_array(F.collect_set(column(e)))


def fold(e: Expr, start: Column, step: Callable[[Column, Column], Column], order: Expr | None = None) -> Column:
    """A left fold with identity over the group's values."""
    gathered = values(e) if order is None else sorted_by(e, order)
    return F.aggregate(gathered, start, step)


def fold_first(e: Expr, step: Callable[[Column, Column], Column], order: Expr | None = None) -> Column:
    """A left fold from the first value on."""
    gathered = values(e) if order is None else sorted_by(e, order)
    return F.reduce(F.slice(gathered, 2, F.greatest(F.size(gathered), F.lit(1))), F.get(gathered, F.lit(0)), step)


def scan(e: Expr, start: Column, step: Callable[[Column, Column], Column], order: Expr) -> Column:
    """Every intermediate result of a fold, as an array; explode it to emit each."""
    zero = F.struct(start.alias("now"), F.array().cast("array<bigint>").alias("all"))

    def more(acc: Column, v: Column) -> Column:
        now = step(acc["now"], v)
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now.cast("bigint"))).alias("all"))

    return F.aggregate(sorted_by(e, order), zero, more, lambda acc: acc["all"])
