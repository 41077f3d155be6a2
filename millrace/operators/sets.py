"""Union and distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from millrace.dataset import Dataset, Expr, Named, named
from millrace.functions.windows import Windowing


def union(*inputs: Dataset) -> Dataset:
    """The bag of all elements, with their times and windows."""
    if len(inputs) < 2:
        raise ValueError("a union has two inputs at least")
    first = inputs[0]
    if any((x.time, x.window) != (first.time, first.window) for x in inputs[1:]):
        raise ValueError("the inputs' time and window columns must agree")
    return first.having(reduce(DataFrame.unionByName, (x.df for x in inputs)))


def distinct(ds: Dataset, mapped: Expr | Named | None = None, windowing: Windowing | None = None) -> Dataset:
    """The distinct elements, or what they are mapped to, of each window."""
    if windowing is not None:
        ds = windowing.assign(ds)
    cols = named(mapped, "value") if mapped is not None else {c: ds.df[c] for c in ds.payload}
    keys = [c.alias(n) for n, c in cols.items()] + ([ds.df[ds.window]] if ds.window else [])
    picked = ds.df.select(*keys)
    if ds.bounded or ds.window:
        return ds.having(picked.dropDuplicates(), time=None)
    return ds.having(ds.df.select(*keys, *([ds.time] if ds.time else [])).dropDuplicates(list(cols)))
