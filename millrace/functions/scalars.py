"""Scalar expressions of the usual log and text workloads; all stay inside the JVM."""

from __future__ import annotations

import unicodedata
from datetime import timedelta
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.dataset import Expr, column

_LOG = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)'


def tokens(line: Expr) -> Column:
    """Lower-cased words of a line, without empty ones."""
    return F.filter(F.split(F.lower(column(line)), r"\s+"), lambda w: w != "")


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, and those letters."""
    marked, plain = [], []
    for i in range(0xC0, 0x250):
        first, *rest = unicodedata.normalize("NFD", chr(i))
        if rest and first.isascii():
            marked.append(chr(i))
            plain.append(first)
    return "".join(marked), "".join(plain)


def strip_accents(text: Expr) -> Column:
    """Latin letters without their accents."""
    return F.translate(column(text), *_accents())


def access_log(line: Expr) -> Column:
    """struct<host, time, request, status, bytes> of a common-log-format line; null if it is none."""
    part = lambda k: F.regexp_extract(column(line), _LOG, k)
    row = F.struct(
        part(1).alias("host"),
        F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("time"),
        part(3).alias("request"),
        F.try_to_number(part(4), F.lit("999")).cast("int").alias("status"),
        F.when(part(5) != "-", part(5)).cast("long").alias("bytes"),
    )
    return F.when(column(line).rlike(_LOG), row)


def search_event(line: Expr) -> Column:
    """struct<time, query> of ``epoch millis, tab, query``; the query lower-cased, trimmed and without accents; null if the line is short or blank."""
    parts = F.split(column(line), "\t")
    query = strip_accents(F.trim(F.lower(F.get(parts, F.lit(1)))))
    millis = F.try_to_number(F.trim(F.get(parts, F.lit(0))), F.lit("9999999999999999")).cast("long")
    return F.when((F.size(parts) >= 2) & (query != "") & millis.isNotNull(), F.struct(F.timestamp_millis(millis).alias("time"), query.alias("query")))


def day_label(time: Expr) -> Column:
    """dd/MMM/yyyy."""
    return F.date_format(column(time), "dd/MMM/yyyy")


def trend_rank(short: Expr, long: Expr, short_window: timedelta, long_window: timedelta, smoothness: int) -> Column:
    """How much more frequent something is in the short window than the long one leads to expect."""
    return column(short) / (column(long) + smoothness) * (long_window / short_window)
