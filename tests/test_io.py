"""Sources, sinks, flows and streams."""

from collections import Counter
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from millrace.functions import reducers as R
from millrace.functions.windows import Tumbling
from millrace.operators.elementwise import filter_by, flat_map
from millrace.operators.keyed import count_by_key, reduce_window
from millrace.plans.flow import Flow, Fluent
from millrace.sources import readers, writers
from millrace.sources.readers import from_rows
from millrace.streaming.processors import reduce_state_stream
from millrace.streaming.runner import ending, run_to_end

S = timedelta(seconds=1)


def test_text(spark, tmp_path):
    rows = from_rows(spark, [("a", 1), (None, 2)], "k string, v int")
    writers.text(str(tmp_path / "t"))(rows)
    assert sorted(r.value for r in readers.text_lines(spark, str(tmp_path / "t")).df.collect()) == ["a\t1", "null\t2"]
    got = readers.text_with_offsets(spark, str(tmp_path / "t")).df.collect()
    assert sorted(r.value for r in got) == ["a\t1", "null\t2"] and {r.key for r in got} == {0}
    writers.text(str(tmp_path / "none"), lazy=True)(from_rows(spark, [], "k string"))
    assert not (tmp_path / "none").exists()


def test_sequence_file(spark, tmp_path):
    path = str(tmp_path / "s")
    writers.sequence_file(path)(from_rows(spark, [("a", 1), ("b", 2)], "key string, value int"))
    assert Counter(map(tuple, readers.sequence_file(spark, path, "key string, value int").df.collect())) == Counter([("a", 1), ("b", 2)])


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_files(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    writers.files(path, kind)(from_rows(spark, [("a", 1), ("b", 2)], "k string, v int"))
    got = {
        "parquet": lambda: readers.parquet(spark, path),
        "orc": lambda: readers.orc(spark, path),
        "json": lambda: readers.json_lines(spark, path, "k string, v int"),
        "csv": lambda: readers.delimited(spark, path, "k string, v int", ","),
    }[kind]()
    assert sorted(map(tuple, got.df.collect())) == [("a", 1), ("b", 2)]


def test_k1_grouped_sink(spark, tmp_path):
    path = str(tmp_path / "g")
    writers.grouped_files(path, F.col("key") % 2, ("count",), partitions=2)(from_rows(spark, [(i, 100 - i) for i in range(20)], "key int, count long"))
    by_file = {}
    for r in spark.read.parquet(path).select("key", "count", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect():
        by_file.setdefault((r.f, r.key % 2), []).append(r["count"])
    assert len({k for _, k in by_file}) == len(by_file) == 2 and all(v == sorted(v) for v in by_file.values())


def test_ranged_sink(spark, tmp_path):
    path = str(tmp_path / "r")
    writers.ranged_files(path, ("k",), 3)(from_rows(spark, [(i * 7 % 50,) for i in range(50)], "k int"))
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(files, files[1:]))


def test_routed_and_mapped(spark):
    even, odd = writers.ToList(), writers.ToList()
    ds = from_rows(spark, [(i,) for i in range(6)], "e int")
    writers.routed(F.col("e") % 2, {0: even, 1: writers.mapped(odd, {"double": F.col("e") * 2})})(ds)
    assert sorted(r.e for r in even.rows) == [0, 2, 4] and sorted(r.double for r in odd.rows) == [2, 6, 10]
    with pytest.raises(KeyError):
        writers.routed(F.col("e"), {0: even})(ds)


def test_flow(spark):
    ds, out = from_rows(spark, [("a b",), ("b",)], "line string"), writers.ToList()
    flow = Flow(spark, "words", {"a.b": "1", "c": "2"})
    Fluent(flow, ds).apply(flat_map, F.split("line", " "), "w").apply(count_by_key, "w").persist(out).execute()
    assert sorted(map(tuple, out.rows)) == [("a", 1), ("b", 2)] and flow.nested("a") == {"b": "1"}
    with pytest.raises(ValueError):
        flow.persist(ds, out)
    with pytest.raises(ValueError):
        Flow(spark).execute()


def test_missing_connectors(spark, tmp_path):
    for load in (lambda: readers.avro(spark, str(tmp_path)), lambda: readers.kafka(spark, "b:1", "t", stop_millis=5), lambda: readers.hbase(spark, "t", "q")):
        with pytest.raises(readers.ConnectorMissing):
            load()


def stream(spark, tmp_path, rows, schema, files=1):
    df = spark.createDataFrame(rows, schema).select("*", F.timestamp_millis("t").alias("ts")).drop("t")
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_h1_counts(spark, tmp_path):
    path = stream(spark, tmp_path, [(e, 1000 * e) for e in range(2000)], "e int, t long")
    out = reduce_window(ending(spark, path, "ts"), {"n": R.count()}, Tumbling(10 * S))
    assert Counter(r.n for r in run_to_end(out).collect()) == Counter({10: 200})


def test_h4_early_panes(spark, tmp_path):
    rows = [(w, 1000) for w in "one two three four two two".split()] + [(w, 4000) for w in "one one one two two three".split()]
    path = stream(spark, tmp_path, rows, "w string, t long")
    e = ending(spark, path, "ts", last={"w": "-"})
    out = run_to_end(reduce_state_stream(e, "w", 10 * S, 0, lambda n, row: n + 1, lambda n: [(n,)], "n long", early=timedelta(milliseconds=1003)))
    got = [(r.w, r.final, r.n) for r in out.collect()]
    assert Counter(x[0::2] for x in got if x[1]) == Counter([("one", 4), ("two", 5), ("three", 2), ("four", 1)])
    assert any(not x[1] for x in got)


COUNT = dict(start=0, add=lambda n, row: n + 1, flush=lambda n: [(n,)], schema="n long")


def listed(spark, rows, schema, delay):
    batches = [[r] for r in rows] + [[(rows[0][0], 10**12)]]
    ds = readers.list_stream(spark, batches, schema)
    df = ds.df.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", delay)
    return ds.having(df, time="ts")


def test_h5_lateness_of_rows(spark):
    rows = [("one", 1), ("one", 2), ("two", 7), ("two", 3), ("two", 1), ("two", 8), ("three", 8)]
    out = run_to_end(reduce_state_stream(listed(spark, rows, "w string, t long", "4 milliseconds"), "w", timedelta(milliseconds=5), strict=True, **COUNT))
    assert Counter((r.w, r.start_ms, r.n) for r in out.collect()) == Counter([("one", 0, 2), ("two", 0, 1), ("two", 5, 2), ("three", 5, 1)])


def test_h3_lateness_of_windows(spark):
    rows = [(e, 1000 * e) for e in range(1999, 1987, -1)]
    ds = listed(spark, rows, "e int, t long", "4 seconds")
    out = reduce_window(ds, {"v": F.sum("e")}, Tumbling(S))
    assert Counter(r.v for r in run_to_end(out).collect() if r.v > 0 and r.window.start.year < 2000) == Counter([1999, 1998, 1997, 1996, 1995])


class Numbers(DataSource):
    @classmethod
    def name(cls):
        return "numbers"

    def schema(self):
        return "n int"

    def reader(self, schema):
        return NumbersReader(int(self.options["upto"]))

    def writer(self, schema, overwrite):
        return NumbersWriter(self.options["path"])


class NumbersReader(DataSourceReader):
    def __init__(self, upto):
        self.upto = upto

    def partitions(self):
        return [InputPartition(k) for k in range(2)]

    def read(self, partition):
        yield from ((i,) for i in range(partition.value, self.upto, 2))


class NumbersWriter(DataSourceWriter):
    def __init__(self, path):
        self.path = path

    def write(self, rows):
        n = WriterCommitMessage()
        n.total = sum(r.n for r in rows)
        return n

    def commit(self, messages):
        Path(self.path).write_text(str(sum(m.total for m in messages if m)))


def test_sources_and_sinks_of_ones_own(spark, tmp_path):
    ds = readers.custom(spark, Numbers, upto="10")
    assert sorted(r.n for r in ds.df.collect()) == list(range(10))
    writers.custom(Numbers, path=str(tmp_path / "sum"))(ds)
    assert (tmp_path / "sum").read_text() == "45"


def test_unbounded_joins_need_windows(spark, tmp_path):
    from millrace.operators.joins import WindowingRequired, join

    path = stream(spark, tmp_path, [(1, 1)], "e int, t long")
    e = readers.parquet_stream(spark, path, event_time="ts", delay="1 second")
    assert not e.bounded
    with pytest.raises(WindowingRequired):
        join(e, e, ("e", "e"), {"x": F.col("l.e")})
    assert not filter_by(e, "e > 0").bounded
