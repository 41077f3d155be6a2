"""Counters, histograms and timers that run beside a computation.

``observed`` is exact: the figures are aggregates that Spark takes while the
data pass, and are there after the first action.  ``Histogram`` and ``Timer`` are
accumulators for Python functions inside map_partitions and the like; a task
that is tried again may count twice, as with any accumulator.
"""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import Column, Observation, SparkSession

from millrace.dataset import Dataset


def observed(ds: Dataset, name: str, **figures: Column) -> tuple[Dataset, Observation]:
    seen = Observation(name)
    return ds.having(ds.df.observe(seen, *(c.alias(k) for k, c in figures.items()))), seen


class _Sums(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


class Counter:
    def __init__(self, spark: SparkSession):
        self._sum: Accumulator = spark.sparkContext.accumulator(0)

    def increment(self, n: int = 1) -> None:
        self._sum.add(n)

    @property
    def value(self) -> int:
        return self._sum.value


class Histogram:
    """Value to count."""

    def __init__(self, spark: SparkSession):
        self._sums: Accumulator = spark.sparkContext.accumulator({}, _Sums())

    def add(self, value: int, times: int = 1) -> None:
        self._sums.add({value: times})

    @property
    def value(self) -> dict[int, int]:
        return dict(self._sums.value)


class Timer(Histogram):
    """Milliseconds to count."""

    @contextmanager
    def measure(self):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add(int((time.perf_counter() - began) * 1000))
