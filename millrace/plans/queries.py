"""The registered queries of the dataflow operators, each with its oracle SQL.

Windows are given as epoch milliseconds and values in cents, so that results
compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.dataset import Dataset
from millrace.functions import reducers as R
from millrace.functions.scalars import access_log
from millrace.functions.windows import Count, Custom, Global, Intervals, Session, Sliding, Tumbling
from millrace.operators.elementwise import assign_event_time, filter_by, flat_map, map_elements, map_partitions, split
from millrace.operators.joins import full_join, join, left_join, right_join
from millrace.operators.keyed import count_by_key, reduce_by_key, reduce_groups, reduce_to_many, reduce_window, running, sum_by_key, top_per_key
from millrace.operators.sets import distinct, union
from millrace.operators.state import State, reduce_state_by_key
from millrace.plans.trends import Trends
from millrace.sources.readers import parquet
from millrace.streaming.processors import count_windows, reduce_state_stream
from millrace.streaming.runner import ending, run_to_end
from millrace.streaming.windowed import Periodic, reduce_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> Dataset:
    return parquet(spark, f"{d}/events.parquet", "ts")


def cents(c: str = "value") -> Column:
    return F.round(F.col(c) * 100).cast("long")


def ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def flat(ds: Dataset, *cols: str) -> DataFrame:
    return ds.df.select(*cols, ms("window.start").alias("start_ms"), ms("window.end").alias("end_ms"))


@query("SELECT event_id, upper(event_type) AS kind, round(value * 100)::BIGINT AS cents FROM events")
def map_elements_(spark, d):
    return map_elements(events(spark, d), {"event_id": "event_id", "kind": F.upper("event_type"), "cents": cents()}).values("event_id", "kind", "cents").df.drop("ts")


@query("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split_regex(lower(p_name), '\\s+')) AS word FROM part) GROUP BY word")
def flat_map_(spark, d):
    words = flat_map(parquet(spark, f"{d}/part.parquet"), F.split(F.lower("p_name"), r"\s+"), "word")
    return count_by_key(words, {"word": "word"}, name="n").df


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 10")
def filter_(spark, d):
    return filter_by(events(spark, d), (F.col("event_type") == "purchase") & (F.col("value") > 10)).df.select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE coalesce(value > 50, false)")
def split_positive(spark, d):
    return split(events(spark, d), F.col("value") > 50).positive.df.select("event_id")


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def split_negative(spark, d):
    return split(events(spark, d), F.col("value") > 50).negative.df.select("event_id")


@query("SELECT event_id, 2 * length(event_type) AS n FROM events")
def map_partitions_(spark, d):
    def double(parts):
        for rows in parts:
            yield rows[["event_id"]].assign(n=rows["event_type"].str.len() * 2)

    return map_partitions(Dataset(events(spark, d).df.select("event_id", "event_type")), double, "event_id long, n long").df


@query("SELECT ((epoch_us(ts) // 1000) // 3600000) AS hour, count(*)::BIGINT AS n FROM events GROUP BY 1")
def assign_event_time_(spark, d):
    ds = assign_event_time(parquet(spark, f"{d}/events.parquet"), ms("ts"), "at")
    return count_by_key(ds, {"hour": F.floor(F.unix_millis("at") / 3600000).cast("long")}, name="n").df


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_(spark, d):
    a = map_elements(parquet(spark, f"{d}/customer.parquet"), {"nation": "c_nationkey"})
    b = map_elements(parquet(spark, f"{d}/supplier.parquet"), {"nation": "s_nationkey"})
    return union(a, b).df


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_(spark, d):
    return distinct(events(spark, d), {"user_id": "user_id", "event_type": "event_type"}).df


@query("SELECT DISTINCT event_type, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS start_ms, ((epoch_us(ts) // 1000) // 3600000 + 1) * 3600000 AS end_ms FROM events")
def distinct_windowed(spark, d):
    return flat(distinct(events(spark, d), {"event_type": "event_type"}, Tumbling(HOUR)), "event_type")


@query("SELECT l_returnflag AS key, sum(round(l_quantity)::BIGINT)::BIGINT AS qty, max(l_partkey) AS top, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def reduce_by_key_combine(spark, d):
    ds = parquet(spark, f"{d}/lineitem.parquet")
    return reduce_by_key(ds, "l_returnflag", {"qty": R.sum_of(F.round("l_quantity")), "top": F.max("l_partkey"), "n": R.count()}).df


@query("SELECT user_id AS key, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def reduce_by_key_sorted(spark, d):
    out = reduce_by_key(events(spark, d), "user_id", {"ids": R.sorted_values("event_id")}).df
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT key, unnest(list_slice(v, 1, 2)) AS value FROM (SELECT user_id AS key, list(event_id ORDER BY event_id) AS v FROM events GROUP BY 1)")
def reduce_by_key_first_two(spark, d):
    return reduce_to_many(events(spark, d), "user_id", F.slice(R.sorted_values("event_id"), 1, 2)).df


@query("SELECT user_id, count(*)::BIGINT AS n, max(event_id) - min(event_id) AS span FROM events GROUP BY 1")
def reduce_by_key_functor(spark, d):
    def one(rows):
        return rows.groupby("user_id", as_index=False)["event_id"].agg(n="count", span=lambda x: x.max() - x.min())

    small = Dataset(events(spark, d).df.select("user_id", "event_id"))
    return reduce_groups(small, {"user_id": "user_id"}, one, "user_id long, n long, span long").df


@query("SELECT l_suppkey AS key, count(*)::BIGINT AS value FROM lineitem GROUP BY 1")
def count_by_key_(spark, d):
    return count_by_key(parquet(spark, f"{d}/lineitem.parquet"), "l_suppkey").df


@query("SELECT o_custkey AS key, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS value FROM orders GROUP BY 1")
def sum_by_key_(spark, d):
    return sum_by_key(parquet(spark, f"{d}/orders.parquet"), "o_custkey", cents("o_totalprice")).df


@query(
    "SELECT key, value, score FROM (SELECT o_custkey AS key, o_orderkey AS value, round(o_totalprice * 100)::BIGINT AS score, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice * 100)::BIGINT DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"
)
def top_per_key_(spark, d):
    return top_per_key(parquet(spark, f"{d}/orders.parquet"), "o_custkey", "o_orderkey", cents("o_totalprice")).df


@query("SELECT ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS start_ms, ((epoch_us(ts) // 1000) // 86400000 + 1) * 86400000 AS end_ms, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def reduce_window_(spark, d):
    return flat(reduce_window(events(spark, d), {"total": F.sum(cents())}, Tumbling(DAY)), "total")


@query("SELECT count(*)::BIGINT AS n, max(event_id) AS last FROM events HAVING count(*) > 0")
def reduce_window_global(spark, d):
    return reduce_window(events(spark, d), {"n": R.count(), "last": F.max("event_id")}, Global()).df


@query(
    "SELECT user_id AS key, event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total, "
    "count(*) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS n FROM events"
)
def scan_fold(spark, d):
    return running(events(spark, d), "user_id", {"event_id": F.max("event_id"), "total": F.sum(cents()), "n": R.count()}, ["event_id"]).df


@query("SELECT user_id AS key, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS start_ms, ((epoch_us(ts) // 1000) // 3600000 + 1) * 3600000 AS end_ms, count(*)::BIGINT AS value FROM events GROUP BY 1, 2, 3")
def time_window(spark, d):
    return flat(count_by_key(events(spark, d), "user_id", Tumbling(HOUR)), "key", "value")


@query(
    "SELECT event_type AS key, s AS start_ms, s + 86400000 AS end_ms, count(*)::BIGINT AS value FROM "
    "(SELECT event_type, unnest(generate_series(((epoch_us(ts) // 1000) // 21600000 - 3) * 21600000, ((epoch_us(ts) // 1000) // 21600000) * 21600000, 21600000)) AS s FROM events) GROUP BY 1, 2, 3"
)
def sliding_window(spark, d):
    return flat(count_by_key(events(spark, d), "event_type", Sliding(DAY, timedelta(hours=6))), "key", "value")


_SESSIONS = (
    "SELECT user_id, ts, value, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM "
    "(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS b FROM events)"
)


@query(f"SELECT user_id AS key, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) + 21600000 AS end_ms, count(*)::BIGINT AS value FROM ({_SESSIONS}) GROUP BY user_id, s")
def session_window(spark, d):
    return flat(count_by_key(events(spark, d), "user_id", Session(timedelta(hours=6))), "key", "value")


@query(
    f"SELECT user_id AS key, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) + 21600000 AS end_ms, max(round(value * 100)::BIGINT) - min(round(value * 100)::BIGINT) AS spread FROM ({_SESSIONS}) GROUP BY user_id, s"
)
def session_assigned(spark, d):
    ds = Session(timedelta(hours=6)).assign(events(spark, d), ["user_id"])
    return flat(reduce_by_key(ds, "user_id", {"spread": F.max(cents()) - F.min(cents())}), "key", "spread")


@query("SELECT user_id AS key, (r - 1) // 7 AS chunk, count(*)::BIGINT AS n, min(event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1, 2")
def count_window(spark, d):
    out = reduce_by_key(events(spark, d), {"key": "user_id"}, {"n": R.count(), "first": F.min("event_id")}, Count(7, by=("ts", "event_id")))
    return out.df.withColumnRenamed("window", "chunk")


@query("SELECT event_type AS key, user_id % 3 AS label, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def custom_window(spark, d):
    out = reduce_by_key(events(spark, d), "event_type", {"n": R.count()}, Custom(F.col("user_id") % 3))
    return out.df.withColumnRenamed("window", "label")


@query(f"SELECT user_id AS key, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) + 21600000 AS end_ms, count(*)::BIGINT AS n FROM ({_SESSIONS}) GROUP BY user_id, s")
def merging_intervals(spark, d):
    windows = Intervals(F.col("ts"), F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return flat(reduce_by_key(events(spark, d), "user_id", {"n": R.count()}, windows), "key", "n")


@query("SELECT key, list_reduce(list_prepend(7, v), lambda a, x: (a * 31 + x) % 1000003)::BIGINT AS folded, list_reduce(v, lambda a, x: (a * 17 + x) % 999983)::BIGINT AS from_first FROM (SELECT user_id AS key, list(event_id ORDER BY event_id) AS v FROM events GROUP BY 1)")
def fold_values(spark, d):
    folded = R.fold("event_id", F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003, "event_id")
    first = R.fold_first("event_id", lambda a, x: (a * 17 + x) % 999983, "event_id")
    return reduce_by_key(events(spark, d), "user_id", {"folded": folded, "from_first": first}).df


@query("SELECT host, bytes FROM (SELECT 'h' || user_id AS host, event_id AS bytes FROM events)")
def access_log_lines(spark, d):
    line = F.concat(F.lit("h"), F.col("user_id"), F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 '), F.col("event_id"))
    parsed = map_elements(events(spark, d), {"log": access_log(line)}).df
    return parsed.select("log.host", "log.bytes")


@query("SELECT h * 3600000 AS start_ms, (h + 1) * 3600000 AS end_ms, max(n)::BIGINT AS top, count(*)::BIGINT AS keys FROM (SELECT user_id, (epoch_us(ts) // 1000) // 3600000 AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY h")
def attached_window(spark, d):
    hourly = count_by_key(events(spark, d), "user_id", Tumbling(HOUR))
    return flat(reduce_window(hourly, {"top": F.max("value"), "keys": R.count()}), "top", "keys")


@query("SELECT (h * 3600000) // 86400000 * 86400000 AS start_ms, ((h * 3600000) // 86400000 + 1) * 86400000 AS end_ms, max(n)::BIGINT AS busiest FROM (SELECT (epoch_us(ts) // 1000) // 3600000 AS h, count(*) AS n FROM events GROUP BY 1) GROUP BY 1, 2")
def chained_windows(spark, d):
    hourly = reduce_window(events(spark, d), {"n": R.count()}, Tumbling(HOUR))
    return flat(reduce_window(hourly, {"busiest": F.max("n")}, Tumbling(DAY)), "busiest")


def _customers(spark, d) -> tuple[Dataset, Dataset]:
    return parquet(spark, f"{d}/customer.parquet"), parquet(spark, f"{d}/orders.parquet")


def _users(spark, d) -> tuple[Dataset, Dataset]:
    """Suppliers and events, each with keys that the other lacks."""
    return parquet(spark, f"{d}/supplier.parquet"), events(spark, d)


_PAIRS = "SELECT coalesce(c_custkey, o_custkey) AS key, c_name, coalesce(o_orderkey, -1) AS o_orderkey FROM {l} {how} JOIN {r} ON c_custkey = o_custkey"
_USERS = "SELECT coalesce(s_suppkey, user_id) AS key, s_name, coalesce(event_id, -1) AS event_id FROM supplier {how} JOIN events ON s_suppkey = user_id"


def known(c: str) -> Column:
    """A number that may be missing, as -1: some readers of results have no null integers."""
    return F.coalesce(F.col(c), F.lit(-1))


def _out() -> dict[str, Column]:
    return {"c_name": F.col("l.c_name"), "o_orderkey": known("r.o_orderkey")}


def _user_out() -> dict[str, Column]:
    return {"s_name": F.col("l.s_name"), "event_id": known("r.event_id")}


@query(_PAIRS.format(l="customer", how="", r="orders"))
def join_inner(spark, d):
    return join(*_customers(spark, d), ("c_custkey", "o_custkey"), _out()).df


@query(_PAIRS.format(l="customer", how="LEFT", r="orders"))
def join_left(spark, d):
    return left_join(*_customers(spark, d), ("c_custkey", "o_custkey"), _out()).df


@query(_USERS.format(how="RIGHT"))
def join_right(spark, d):
    return right_join(*_users(spark, d), ("s_suppkey", "user_id"), _user_out()).df


@query(_USERS.format(how="FULL"))
def join_full(spark, d):
    return full_join(*_users(spark, d), ("s_suppkey", "user_id"), _user_out()).df


@query("SELECT s_nationkey AS key, s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def join_broadcast_left(spark, d):
    nations = filter_by(parquet(spark, f"{d}/nation.parquet"), "n_regionkey < 3").hinted("fits_in_memory")
    return left_join(parquet(spark, f"{d}/supplier.parquet"), nations, ("s_nationkey", "n_nationkey"), {"s_suppkey": F.col("l.s_suppkey"), "n_name": F.col("r.n_name")}).df


_HALF = "(SELECT *, (epoch_us(ts) // 1000) // 3600000 AS h FROM events WHERE event_type = '{}')"


@query(
    f"SELECT coalesce(a.user_id, b.user_id) AS key, coalesce(a.event_id, -1) AS click, coalesce(b.event_id, -1) AS view, coalesce(a.h, b.h) * 3600000 AS start_ms, (coalesce(a.h, b.h) + 1) * 3600000 AS end_ms "
    f"FROM {_HALF.format('click')} a FULL JOIN {_HALF.format('view')} b ON a.user_id = b.user_id AND a.h = b.h"
)
def join_windowed(spark, d):
    e = events(spark, d)
    a, b = (filter_by(e, F.col("event_type") == t) for t in ("click", "view"))
    return flat(full_join(a, b, ("user_id", "user_id"), {"click": known("l.event_id"), "view": known("r.event_id")}, windowing=Tumbling(HOUR)), "key", "click", "view")


@query(
    "WITH u AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')), "
    "b AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR > ts THEN 0 ELSE 1 END AS b FROM u), "
    "s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM b), "
    "w AS (SELECT *, (epoch_us(min(ts) OVER (PARTITION BY user_id, s)) // 1000) AS start_ms, (epoch_us(max(ts) OVER (PARTITION BY user_id, s)) // 1000) + 7200000 AS end_ms FROM s) "
    "SELECT l.user_id AS key, l.event_id AS click, r.event_id AS purchase, l.start_ms, l.end_ms FROM w l JOIN w r ON l.user_id = r.user_id AND l.s = r.s WHERE l.event_type = 'click' AND r.event_type = 'purchase'"
)
def join_session(spark, d):
    e = events(spark, d)
    a, b = (filter_by(e, F.col("event_type") == t) for t in ("click", "purchase"))
    out = {"click": F.col("l.event_id"), "purchase": F.col("r.event_id")}
    return flat(join(a, b, ("user_id", "user_id"), out, windowing=Session(timedelta(hours=2))), "key", "click", "purchase")


class _Range(State):
    def __init__(self):
        self.low = self.high = None
        self.n = 0

    def add(self, element):
        v = round(element["cents"])
        self.n += 1
        self.low = v if self.low is None else min(self.low, v)
        self.high = v if self.high is None else max(self.high, v)

    def merge(self, other):
        if other.n:
            self.n += other.n
            self.low = other.low if self.low is None else min(self.low, other.low)
            self.high = other.high if self.high is None else max(self.high, other.high)

    def flush(self):
        yield self.n, self.low, self.high


@query(
    "SELECT user_id AS key, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS start_ms, ((epoch_us(ts) // 1000) // 86400000 + 1) * 86400000 AS end_ms, count(*)::BIGINT AS n, "
    "min(round(value * 100)::BIGINT) AS low, max(round(value * 100)::BIGINT) AS high FROM events GROUP BY 1, 2, 3"
)
def reduce_state_by_key_(spark, d):
    ds = map_elements(events(spark, d), {"user_id": "user_id", "cents": cents()})
    return flat(reduce_state_by_key(ds, "user_id", _Range, "n long, low long, high long", Tumbling(DAY)), "key", "n", "low", "high")


@query("SELECT epoch_us(to_timestamp(0)) AS zero, max(end_us)::BIGINT AS last FROM (SELECT ((epoch_us(ts) // 1000) // 3600000 + 1) * 3600000000 AS end_us FROM events)")
def output_time(spark, d):
    hourly = reduce_window(events(spark, d), {"n": R.count()}, Tumbling(HOUR))
    last = F.max(F.unix_micros(F.col("ts").cast("timestamp"))) + 1
    return hourly.df.agg(F.lit(0).cast("long").alias("zero"), last.alias("last"))


_TRENDS = (
    "WITH h AS (SELECT event_type AS query, ((epoch_us(ts) // 1000) // 3600000 + 1) * 3600000000 AS \"end\", count(*) AS n FROM events GROUP BY 1, 2), "
    "b AS (SELECT a.query, a.\"end\", a.n AS short_count, (SELECT sum(x.n) FROM h x WHERE x.query = a.query AND x.\"end\" <= a.\"end\" AND x.\"end\" > a.\"end\" - 86400000000)::BIGINT AS long_count FROM h a), "
    "r AS (SELECT query, \"end\", short_count / (long_count + 200) * 24 AS rank FROM b) "
)


@query(_TRENDS + "SELECT \"end\", arg_max(query, (rank, query)) AS query, max(rank) AS rank FROM r WHERE rank > 0.02 GROUP BY \"end\"")
def trends(spark, d):
    return Trends(threshold=0.02).top(events(spark, d), "event_type").df


_STREAMED = ("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT event_type AS key, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS start_ms, ((epoch_us(ts) // 1000) // 3600000 + 1) * 3600000 AS end_ms, count(*)::BIGINT AS value FROM events GROUP BY 1, 2, 3")
def stream_time_window(spark, d):
    out = count_by_key(ending(spark, f"{d}/events.parquet", "ts", columns=_STREAMED), "event_type", Tumbling(HOUR))
    return flat(out.having(run_to_end(out)), "key", "value")


@query(f"SELECT user_id AS key, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) + 21600000 AS end_ms, count(*)::BIGINT AS value FROM ({_SESSIONS}) GROUP BY user_id, s")
def stream_session_window(spark, d):
    out = count_by_key(ending(spark, f"{d}/events.parquet", "ts", columns=_STREAMED), "user_id", Session(timedelta(hours=6)))
    return flat(out.having(run_to_end(out)), "key", "value")


@query("SELECT DISTINCT event_type, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS start_ms, ((epoch_us(ts) // 1000) // 3600000 + 1) * 3600000 AS end_ms FROM events")
def stream_distinct(spark, d):
    out = distinct(ending(spark, f"{d}/events.parquet", "ts", columns=_STREAMED), {"event_type": "event_type"}, Tumbling(HOUR))
    return flat(out.having(run_to_end(out)), "event_type")


@query(
    f"SELECT a.user_id AS key, coalesce(a.event_id, -1) AS click, coalesce(b.event_id, -1) AS view, a.h * 3600000 AS start_ms, (a.h + 1) * 3600000 AS end_ms "
    f"FROM {_HALF.format('click')} a LEFT JOIN {_HALF.format('view')} b ON a.user_id = b.user_id AND a.h = b.h"
)
def stream_join(spark, d):
    sides = []
    for kind in ("click", "view"):
        e = ending(spark, f"{d}/events.parquet", "ts", columns=_STREAMED, last={"user_id": -1})
        sides.append(filter_by(e, F.col("event_type").isNull() | (F.col("event_type") == kind)))
    out = left_join(*sides, ("user_id", "user_id"), {"click": known("l.event_id"), "view": known("r.event_id")}, windowing=Tumbling(HOUR))
    return flat(out.having(run_to_end(out)), "key", "click", "view")


@query("SELECT user_id, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events) GROUP BY user_id, (r - 1) // 7")
def stream_count_window(spark, d):
    e = ending(spark, f"{d}/events.parquet", "ts", columns=_STREAMED, last={"user_id": -1})
    e = e.having(e.df.withColumn("cents", cents()))
    return run_to_end(count_windows(e, "user_id", "cents", 7)).where("user_id <> -1")


@query(
    "SELECT user_id, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS start_ms, ((epoch_us(ts) // 1000) // 86400000 + 1) * 86400000 AS end_ms, true AS final, count(*)::BIGINT AS n FROM events GROUP BY 1, 2, 3"
)
def stream_state(spark, d):
    e = ending(spark, f"{d}/events.parquet", "ts", columns=_STREAMED, last={"user_id": -1})
    return run_to_end(reduce_state_stream(e, "user_id", DAY, 0, lambda n, row: n + 1, lambda n: [(n,)], "n long"))


_RANGE = "count(*)::BIGINT AS n, min(round(value * 100)::BIGINT) AS low, max(round(value * 100)::BIGINT) AS high"


def _ranges(spark, d, windowing, trigger=None) -> DataFrame:
    e = ending(spark, f"{d}/events.parquet", "ts", columns=_STREAMED, last={"user_id": -1, "value": 0.0})
    e = e.having(e.df.select("user_id", "ts", cents().alias("cents")))
    return run_to_end(reduce_windows(e, "user_id", _Range, "n long, low long, high long", windowing, trigger)).where("user_id <> -1")


@query(f"SELECT user_id, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(max(ts)) // 1000) + 21600000 AS end_ms, true AS final, {_RANGE} FROM ({_SESSIONS}) GROUP BY user_id, s")
def stream_state_session(spark, d):
    return _ranges(spark, d, Session(timedelta(hours=6)))


@query(
    f"SELECT user_id, s AS start_ms, s + 86400000 AS end_ms, true AS final, {_RANGE} FROM "
    "(SELECT *, unnest(generate_series(((epoch_us(ts) // 1000) // 43200000 - 1) * 43200000, ((epoch_us(ts) // 1000) // 43200000) * 43200000, 43200000)) AS s FROM events) GROUP BY 1, 2, 3"
)
def stream_state_sliding(spark, d):
    return _ranges(spark, d, Sliding(DAY, timedelta(hours=12)))


@query(
    f"SELECT user_id, start_ms, start_ms + 86400000 AS end_ms, pane = 4 AS final, n, low, high FROM (SELECT user_id, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS start_ms, {_RANGE} FROM events GROUP BY 1, 2), range(1, 5) r(pane)"
)
def stream_early_panes(spark, d):
    """All elements are there when the watermark passes the panes, so each shows the whole window."""
    return _ranges(spark, d, Tumbling(DAY), Periodic(timedelta(hours=6)))


def queries() -> dict[str, Query]:
    return {k.rstrip("_"): f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k.rstrip("_"): s for k, s in ORACLES.items()}
