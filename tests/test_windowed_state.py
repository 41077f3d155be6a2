"""State over windows of streams: merging windows, early results, parts that are merged."""

from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from millrace.functions.windows import Global, Session, Tumbling
from millrace.streaming.runner import ending, run_to_end
from millrace.streaming.windowed import AfterFirst, EveryCount, ListState, Periodic, reduce_windows

S = timedelta(seconds=1)


def collected(values):
    yield (",".join(map(str, values)),)


def everything():
    return ListState(lambda row: int(row["v"]), collected)


def stream(spark, tmp_path, rows):
    at = str(tmp_path / "in")
    made = [(w, datetime.fromtimestamp(t, timezone.utc), v) for w, t, v in rows]
    spark.createDataFrame(made, "w string, ts timestamp, v long").coalesce(1).write.parquet(at)
    return ending(spark, at, "ts", last={"w": "end", "v": 0})


def results(out):
    return Counter((r.w, r.start_ms // 1000, r.end_ms // 1000, r.final, r.all) for r in run_to_end(out).where(F.col("w") != "end").collect())


def test_sessions_merge(spark, tmp_path):
    rows = [("a", 100, 1), ("a", 120, 2), ("a", 110, 3), ("a", 129, 4), ("a", 139, 5), ("b", 100, 6)]
    out = reduce_windows(stream(spark, tmp_path, rows), "w", everything, "all string", Session(10 * S))
    assert results(out) == Counter([("a", 100, 110, True, "1"), ("a", 110, 120, True, "3"), ("a", 120, 139, True, "2,4"), ("a", 139, 149, True, "5"), ("b", 100, 110, True, "6")])


def test_early_results_accumulate_or_not(spark, tmp_path):
    rows = [("a", 100 + k, k) for k in range(5)]
    out = reduce_windows(stream(spark, tmp_path / "1", rows), "w", everything, "all string", Tumbling(100 * S), EveryCount(2))
    assert results(out) == Counter([("a", 100, 200, False, "0,1"), ("a", 100, 200, False, "0,1,2,3"), ("a", 100, 200, True, "0,1,2,3,4")])
    out = reduce_windows(stream(spark, tmp_path / "2", rows), "w", everything, "all string", Tumbling(100 * S), EveryCount(2), purging=True)
    assert results(out) == Counter([("a", 100, 200, False, "0,1"), ("a", 100, 200, False, "2,3"), ("a", 100, 200, True, "4")])


def test_the_first_of_several_triggers(spark, tmp_path):
    rows = [("a", 100 + k, k) for k in range(3)]
    out = reduce_windows(stream(spark, tmp_path, rows), "w", everything, "all string", Tumbling(100 * S), AfterFirst(EveryCount(3), Periodic(60 * S)))
    assert results(out) == Counter({("a", 100, 200, False, "0,1,2"): 3, ("a", 100, 200, True, "0,1,2"): 1})


class Blocks:
    """Windows of one's own: blocks of ten seconds, joined where they touch."""

    def windows(self, row, ms):
        return [(ms // 10_000 * 10_000, ms // 10_000 * 10_000 + 10_000)]

    def merge(self, windows):
        out = []
        for w in sorted(windows):
            if out and w[0] <= out[-1][0][1]:
                out[-1] = ((out[-1][0][0], max(out[-1][0][1], w[1])), [*out[-1][1], w])
            else:
                out.append((w, [w]))
        return out


def test_merging_windows_of_ones_own_and_global(spark, tmp_path):
    rows = [("a", 101, 1), ("a", 125, 2), ("a", 112, 3), ("a", 151, 4)]
    out = reduce_windows(stream(spark, tmp_path / "1", rows), "w", everything, "all string", Blocks())
    assert results(out) == Counter([("a", 100, 130, True, "1,3,2"), ("a", 150, 160, True, "4")])
    out = reduce_windows(stream(spark, tmp_path / "2", rows), "w", everything, "all string", Global())
    assert [k[4] for k in results(out)] == ["1,3,2,4"]


def test_a_run_goes_on_in_its_folder(spark, tmp_path):
    e = stream(spark, tmp_path, [("a", 100, 1)])
    out = reduce_windows(e, "w", everything, "all string", Tumbling(10 * S))
    folder = str(tmp_path / "run")
    first = run_to_end(out, folder=folder).count()
    assert run_to_end(out, folder=folder).count() == first
