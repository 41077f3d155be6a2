"""Sinks: each is a function that takes a dataset to a finished write (bounded) or a running query (unbounded).

Spark's commit protocols make the file sinks all-or-nothing for bounded data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from millrace.dataset import Dataset, Expr, column

Sink = Callable[[Dataset], Any]


def files(path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options: Any) -> Sink:
    """Parquet, ORC, JSON, CSV or any file format of Spark's."""

    def write(ds: Dataset) -> Any:
        if ds.bounded:
            writer = ds.df.write.mode(mode).options(**options)
            return (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
        stream = ds.df.writeStream.format(kind).options(**options).outputMode("append")
        return (stream.partitionBy(*partition_by) if partition_by else stream).start(path)

    return write


def grouped_files(path: str, key: Expr, order: tuple[str, ...], kind: str = "parquet", partitions: int | None = None) -> Sink:
    """All of a key's rows in one file, sorted; what the sink does to its input before it writes."""

    def write(ds: Dataset) -> None:
        k = column(key)
        dealt = ds.df.repartition(partitions, k) if partitions else ds.df.repartition(k)
        dealt.sortWithinPartitions(k, *order).write.format(kind).save(path)

    return write


def ranged_files(path: str, order: tuple[str, ...], partitions: int, kind: str = "parquet", folder_by: tuple[str, ...] = ()) -> Sink:
    """Globally sorted files with disjoint key ranges, as a bulk load wants them."""

    def write(ds: Dataset) -> None:
        writer = ds.df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.format(kind)
        (writer.partitionBy(*folder_by) if folder_by else writer).save(path)

    return write


def text(path: str, separator: str = "\t", lazy: bool = False, **options: Any) -> Sink:
    """A line for each element, its columns joined; ``lazy``: an empty dataset writes nothing."""

    def write(ds: Dataset) -> None:
        if lazy and ds.df.isEmpty():
            return
        line = F.concat_ws(separator, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in ds.payload))
        ds.df.select(line.alias("value")).write.options(**options).text(path)

    return write


def sequence_file(path: str, key: str = "key", value: str = "value", codec: str | None = None) -> Sink:
    def write(ds: Dataset) -> None:
        ds.df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path, codec)

    return write


def hadoop_output(path: str, output_format: str, key_class: str, value_class: str, key: str = "key", value: str = "value", conf: dict[str, str] | None = None) -> Sink:
    def write(ds: Dataset) -> None:
        ds.df.select(key, value).rdd.map(tuple).saveAsNewAPIHadoopFile(path, output_format, key_class, value_class, conf=conf or {})

    return write


def custom(sink: type[DataSource], mode: str = "append", **options: Any) -> Sink:
    """A sink of one's own: a Python DataSource whose writer has write() for each partition, commit() and abort()."""

    def write(ds: Dataset) -> None:
        ds.df.sparkSession.dataSource.register(sink)
        ds.df.write.format(sink.name()).mode(mode).options(**options).save()

    return write


def nothing() -> Sink:
    """Computes and discards."""
    return lambda ds: ds.df.write.format("noop").mode("overwrite").save() if ds.bounded else ds.df.writeStream.format("noop").start()


def stdout(rows: int = 20) -> Sink:
    return lambda ds: ds.df.show(rows, truncate=False) if ds.bounded else ds.df.writeStream.format("console").start()


def kafka(brokers: str, topic: str, **options: Any) -> Sink:
    def write(ds: Dataset) -> Any:
        pairs = ds.df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        writer = (pairs.write if ds.bounded else pairs.writeStream).format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).options(**options)
        return writer.save() if ds.bounded else writer.start()

    return write


@dataclass
class ToList:
    """Collects on the driver; for tests and results known to be small."""

    rows: list = field(default_factory=list)

    def __call__(self, ds: Dataset) -> None:
        self.rows[:] = ds.df.collect()


def mapped(sink: Sink, out: Mapping[str, Column]) -> Sink:
    """The sink, fed with expressions of the elements."""
    return lambda ds: sink(ds.having(ds.df.select(*(c.alias(n) for n, c in out.items()))))


def routed(select: Column, sinks: Mapping[Any, Sink]) -> Sink:
    """Each element to the sink of its key; an element of no known key is an error."""

    def write(ds: Dataset) -> None:
        def each(df: DataFrame, *_: Any) -> None:
            # computed once for the check and all sinks
            keyed = df.withColumn("__to", select).persist(StorageLevel.DISK_ONLY)
            try:
                unknown = keyed.where(~F.coalesce(F.col("__to").isin(*sinks), F.lit(False))).select("__to").take(1)
                if unknown:
                    raise KeyError(f"no sink for {unknown[0][0]!r}")
                for k, sink in sinks.items():
                    sink(ds.having(keyed.where(F.col("__to") == k).drop("__to")))
            finally:
                keyed.unpersist()

        return each(ds.df) if ds.bounded else ds.df.writeStream.foreachBatch(each).start()

    return write
