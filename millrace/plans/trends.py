"""The trends workload: what is suddenly more frequent than it was.

Counts of each query string over a long sliding window and a short tumbling one
are joined by the hour in which both end; the rank short / (long + smoothness),
scaled by the windows' ratio, is kept above a threshold, and the best string of
each hour wins.

One pass does both counts: the elements are counted by string and short
window, and a long window's count is the sum of its short windows' counts.
That shuffles one row for each string and hour instead of one for each element
and each of its 24 long windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.dataset import Dataset, Expr, column
from millrace.functions.scalars import trend_rank
from millrace.functions.windows import Tumbling
from millrace.operators.keyed import count_by_key


@dataclass(frozen=True)
class Trends:
    long: timedelta = timedelta(hours=24)
    short: timedelta = timedelta(hours=1)
    smoothness: int = 200
    threshold: float = 1.5

    def __post_init__(self) -> None:
        if self.long % self.short:
            raise ValueError("the long window must be a multiple of the short one")

    def ranks(self, ds: Dataset, query: Expr) -> Dataset:
        """(query, end, short_count, long_count, rank) above the threshold, for every short window that has the query."""
        steps = self.long // self.short
        hourly = count_by_key(ds, {"query": column(query)}, Tumbling(self.short), name="n").df
        end = F.unix_micros(F.col("window.end").cast("timestamp"))
        hourly = hourly.select("query", end.alias("end"), "n")
        step = self.short // timedelta(microseconds=1)
        last = Window.partitionBy("query").orderBy("end").rangeBetween(-(steps - 1) * step, 0)
        both = hourly.select("query", "end", F.col("n").alias("short_count"), F.sum("n").over(last).alias("long_count"))
        rank = trend_rank("short_count", "long_count", self.short, self.long, self.smoothness)
        return Dataset(both.withColumn("rank", rank).where(F.col("rank") > self.threshold))

    def top(self, ds: Dataset, query: Expr) -> Dataset:
        """(end, query, rank) of the best string of each short window; ties go to the greatest string."""
        best = F.max(F.struct("rank", "query")).alias("best")
        df = self.ranks(ds, query).df.groupBy("end").agg(best)
        return Dataset(df.select("end", F.col("best.query").alias("query"), F.col("best.rank").alias("rank")))
