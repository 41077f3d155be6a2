from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.functions import scalars


def test_scalars(spark):
    df = spark.createDataFrame([("  The  cat\tÉté ",)], "s string")
    assert df.select(scalars.tokens("s"), scalars.strip_accents(F.lit("Příliš žluťoučký kůň Åß"))).first()[:] == (["the", "cat", "été"], "Prilis zlutoucky kun Aß")


def test_access_log(spark):
    lines = ['1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326', 'h - - [10/Oct/2000:13:55:36 +0000] "-" 404 -', "junk", None]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(scalars.access_log("l").alias("x")).select("x.*", scalars.day_label("x.time").alias("day")).collect()
    assert got[0][:] == ("1.2.3.4", datetime(2000, 10, 10, 20, 55, 36), "GET /a HTTP/1.0", 200, 2326, "10/Oct/2000")
    assert got[1].bytes is None and got[1].status == 404 and got[2].host is None and got[3].host is None


def test_search_events(spark):
    lines = ["1000\tKŮŇ \tx", "1000", "1000\t ", "x\ty", None]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(scalars.search_event("l").alias("x")).collect()
    assert (got[0].x.time, got[0].x.query) == (datetime(1970, 1, 1, 0, 0, 1), "kun") and all(r.x is None for r in got[1:])


def test_trend_rank(spark):
    assert spark.range(1).select(scalars.trend_rank(F.lit(10), F.lit(40), timedelta(hours=1), timedelta(hours=24), 200)).first()[0] == 1.0
