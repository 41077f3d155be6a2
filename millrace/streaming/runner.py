"""Unbounded datasets that are to end: a run over all that is there now.

Spark emits a window once the watermark has passed it, so the last windows of
an input that ends stay open.  ``ending`` adds one element far in the future,
which closes every window before it; ``run_to_end`` runs the query until its
input is used up and gives what it emitted, without what stems from that
element.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.dataset import Dataset
from millrace.sources.readers import dataset, parquet_stream
from millrace.sources.shared import shared_folder

#: After every real element, and representable everywhere.
FAR = datetime(2200, 1, 1)


def ending(spark: SparkSession, path: str, event_time: str, delay: str = "0 seconds", columns: tuple[str, ...] = (), last: dict[str, object] | None = None) -> Dataset:
    """The Parquet data at ``path`` as a stream that closes its windows.

    The added element is null but for its time and ``last``: it has to pass the
    filters below the window, also those that Spark infers (a join drops null
    keys before it looks at the time).
    """
    df = spark.read.parquet(path)
    names = columns or tuple(df.columns)
    given = {**(last or {}), event_time: FAR}
    end = spark.range(1).select(*(F.lit(given.get(c)).cast(df.schema[c].dataType).alias(c) for c in names))
    at = shared_folder(spark, "ending")
    end.write.parquet(at)
    both = parquet_stream(spark, path).df.select(*names).unionByName(parquet_stream(spark, at).df)
    return dataset(both, event_time, delay)


def run_to_end(ds: Dataset, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What the query emits until its input is used up, as a bounded DataFrame.

    ``folder`` holds output and state.  A run that was broken off goes on from
    there if it is given the same one, and each row is emitted exactly once;
    without it each call starts afresh.
    """
    spark = ds.df.sparkSession
    folder = folder or shared_folder(spark, "run")
    out, state = f"{folder}/emitted", f"{folder}/state"
    df = ds.df
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:  # each batch's rows replace or follow those before: the file sink only appends

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

        query = df.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    got = spark.read.schema(df.schema).parquet(out)
    if ds.window and "end" in str(df.schema[ds.window].dataType.simpleString()):
        got = got.where(F.col(f"{ds.window}.start") < F.lit(FAR))
    return got
