"""Dataset: a DataFrame plus what windowed dataflow needs to know about it.

``df`` is always a plain DataFrame and may be used as such.  ``time`` names its
event-time column, ``window`` the struct<start, end> column of the window that
its rows are attached to (null: the global window), and ``windowing`` the
windowing that assigned it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = Column | str
Named = Mapping[str, Expr]


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    time: str | None = None
    window: str | None = None
    windowing: Any = None
    fits_in_memory: bool = False

    @property
    def bounded(self) -> bool:
        return not self.df.isStreaming

    @property
    def payload(self) -> list[str]:
        """The columns that are neither time nor window."""
        return [c for c in self.df.columns if c not in (self.time, self.window)]

    @property
    def carried(self) -> list[str]:
        return [c for c in (self.time, self.window) if c]

    def having(self, df: DataFrame, **changes: Any) -> Dataset:
        return replace(self, df=df, fits_in_memory=False, **changes)

    def hinted(self, hint: str) -> Dataset:
        """``fits_in_memory``: joins may broadcast this side.  ``expensive``: computed once for all its consumers."""
        if hint == "fits_in_memory":
            return replace(self, fits_in_memory=True)
        if hint == "expensive":
            return replace(self, df=self.df if self.df.isStreaming else self.df.persist(StorageLevel.MEMORY_AND_DISK))
        raise ValueError(f"unknown hint: {hint}")

    def apply_if(self, condition: bool, then: Callable[[Dataset], Dataset], otherwise: Callable[[Dataset], Dataset] | None = None) -> Dataset:
        if condition:
            return then(self)
        return otherwise(self) if otherwise else self

    def transform(self, f: Callable[[Dataset], Dataset]) -> Dataset:
        return f(self)

    def values(self, *names: str) -> Dataset:
        """Only the named value columns of a keyed result, with time and window."""
        return self.having(self.df.select(*names, *(c for c in self.carried if c not in names)))


def column(e: Expr) -> Column:
    return F.col(e) if isinstance(e, str) else e


def named(e: Expr | Named, default: str) -> dict[str, Column]:
    """One expression under the default name, or several under their own."""
    if isinstance(e, Mapping):
        return {k: column(v) for k, v in e.items()}
    return {default: column(e)}
