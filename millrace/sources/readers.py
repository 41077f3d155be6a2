"""Sources.

Columnar files are the default and keep filters and column selection in the
scan.  Avro, Kafka and HBase need connector packages on Spark's class path; the
readers name the package when it is missing.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from millrace.dataset import Dataset, Expr
from millrace.operators.elementwise import assign_event_time
from millrace.sources.shared import shared_folder


class ConnectorMissing(RuntimeError):
    pass


def _needing(package: str, load) -> DataFrame:
    try:
        return load()
    except Exception as problem:
        if "Failed to find" in str(problem) or "DATA_SOURCE_NOT_FOUND" in str(problem) or "Failed to find data source" in str(problem):
            raise ConnectorMissing(f"put {package} on Spark's class path (spark.jars.packages)") from problem
        raise


def dataset(df: DataFrame, event_time: Expr | None = None, delay: str | None = None) -> Dataset:
    """A DataFrame as a dataset; its elements are in the global window."""
    ds = Dataset(df)
    if event_time is None:
        return ds
    name = event_time if isinstance(event_time, str) and event_time in df.columns else "ts"
    return assign_event_time(ds, event_time, name=name, delay=delay)


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: str | StructType, partitions: int = 2) -> Dataset:
    """Rows of the driver, dealt to partitions."""
    return Dataset(spark.createDataFrame(list(rows), schema).repartition(partitions))


def list_stream(spark: SparkSession, batches: Sequence[Iterable[Any]], schema: str | StructType, event_time: Expr | None = None, delay: str | None = None) -> Dataset:
    """Unbounded: the given lists of rows, each a micro-batch of its own, in this order."""
    folder = shared_folder(spark, "list")
    for k, rows in enumerate(batches):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.parquet(f"{folder}/{k:06d}")
        time.sleep(0.002)  # files are read in order of their age
    df = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return dataset(df, event_time, delay)


def custom(spark: SparkSession, source: type[DataSource], stream: bool = False, **options: Any) -> Dataset:
    """A source of one's own: a Python DataSource with partitions and a reader for each, bounded or streaming."""
    spark.dataSource.register(source)
    reader = (spark.readStream if stream else spark.read).format(source.name())
    return Dataset(reader.options(**options).load())


def parquet(spark: SparkSession, path: str, event_time: Expr | None = None) -> Dataset:
    return dataset(spark.read.parquet(path), event_time)


def parquet_stream(spark: SparkSession, *paths: str, event_time: Expr | None = None, delay: str | None = None, files_per_trigger: int | None = None) -> Dataset:
    """Unbounded: files as they appear.  A path may be a folder or a single file."""
    out = None
    for path in paths:
        schema = spark.read.parquet(path).schema
        reader = spark.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        folder, _, name = path.rstrip("/").rpartition("/")
        one = reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)
        out = one if out is None else out.unionByName(one)
    return dataset(out, event_time, delay)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isFile()


def text_lines(spark: SparkSession, path: str) -> Dataset:
    """(value): the lines of text files, compressed ones too."""
    return Dataset(spark.read.text(path))


def text_with_offsets(spark: SparkSession, path: str) -> Dataset:
    """(key, value): byte offset and line; the offset is only known to the Hadoop input format."""
    rdd = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"
    )
    return Dataset(spark.createDataFrame(rdd, "key long, value string"))


def sequence_file(spark: SparkSession, path: str, schema: str) -> Dataset:
    """(key, value) of SequenceFiles of the usual Writables."""
    return Dataset(spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema))


def hadoop_input(spark: SparkSession, path: str, input_format: str, key_class: str, value_class: str, schema: str, conf: dict[str, str] | None = None) -> Dataset:
    """(key, value) of any file input format."""
    rdd = spark.sparkContext.newAPIHadoopFile(path, input_format, key_class, value_class, conf=conf or {})
    return Dataset(spark.createDataFrame(rdd, schema))


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t", header: bool = False) -> Dataset:
    return Dataset(spark.read.schema(schema).csv(path, sep=separator, header=header))


def json_lines(spark: SparkSession, path: str, schema: str) -> Dataset:
    return Dataset(spark.read.schema(schema).json(path))


def orc(spark: SparkSession, path: str) -> Dataset:
    return Dataset(spark.read.orc(path))


def avro(spark: SparkSession, path: str, reader_schema: str | None = None) -> Dataset:
    reader = spark.read.format("avro")
    if reader_schema:
        reader = reader.option("avroSchema", reader_schema)
    return Dataset(_needing("spark-avro", lambda: reader.load(path)))


def kafka(
    spark: SparkSession,
    brokers: str,
    topic: str,
    start_millis: int = -1,
    stop_millis: int | None = None,
    options: dict[str, str] | None = None,
) -> Dataset:
    """(key, value, ts), binary keys and values.

    start_millis: -1 from the committed or latest offset, 0 from the beginning,
    else from that time.  With stop_millis the source is bounded.
    """
    bounded = stop_millis is not None
    reader = (spark.read if bounded else spark.readStream).format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    if start_millis > 0:
        reader = reader.option("startingTimestamp", start_millis)
    elif start_millis == 0 or bounded:
        reader = reader.option("startingOffsets", "earliest")
    if bounded:
        reader = reader.option("endingTimestamp", stop_millis)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    df = _needing("spark-sql-kafka-0-10", lambda: reader.load())
    return Dataset(df.select("key", "value", F.col("timestamp").alias("ts")), time="ts")


def hbase(spark: SparkSession, table: str, quorum: str, columns: Sequence[str] = (), start_row: str | None = None, stop_row: str | None = None) -> Dataset:
    """(row, cells) through HBase's table input format."""
    conf = {"hbase.zookeeper.quorum": quorum, "hbase.mapreduce.inputtable": table}
    if columns:
        conf["hbase.mapreduce.scan.columns"] = " ".join(columns)
    if start_row:
        conf["hbase.mapreduce.scan.row.start"] = start_row
    if stop_row:
        conf["hbase.mapreduce.scan.row.stop"] = stop_row
    try:
        rdd = spark.sparkContext.newAPIHadoopRDD(
            "org.apache.hadoop.hbase.mapreduce.TableInputFormat", "org.apache.hadoop.hbase.io.ImmutableBytesWritable", "org.apache.hadoop.hbase.client.Result", conf=conf
        )
    except Exception as problem:
        raise ConnectorMissing("put hbase-mapreduce on Spark's class path (spark.jars.packages)") from problem
    return Dataset(spark.createDataFrame(rdd.map(lambda kv: (str(kv[0]), str(kv[1]))), "row string, cells string"))
