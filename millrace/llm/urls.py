"""URL filters: a blocked Bloom filter before an exact hash join.

A list holds canonical URLs: of whole sites (``host/``) or of single pages
(``host/path``).  A URL is looked up as its page and as the site of its host and
of each of that host's parent domains; a domain name has 127 labels at most, so
of a longer host only itself and the parents that can be names are asked for.
The listed keys are hashed into a blocked Bloom filter (one 512-bit block of
eight words a key, one bit in each word), which has at most ``MAX_BLOCKS``
blocks, 4 MiB, however long the list is; Spark builds it with bitwise OR, and it
is broadcast.  Keys without a possible hit are done.  The others are joined
exactly with the list (a hash join on a broadcast list of measured size, else a
shuffled join), which removes the filter's false positives; a long list only
sends more keys there, it changes no verdict.

Allow and block rules come first: a rule (host, path) fits its host and all
subdomains if the URL's path starts with the rule's path; the longest rule
wins.  The list decides where no rule fits.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.

Defined results: a null URL or one without ``://`` has empty host and path, no
rule and the verdict ``allow``; equal URLs get equal verdicts; an empty list
blocks nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from millrace.llm.common import lookup, table

MAX_BLOCKS = 1 << 16
KEYS_A_BLOCK = 40
#: Labels of a domain name, at most.
MAX_LABELS = 127
WORDS = 8

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The registered query's list: the domains with one of these words in their name,
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: and the single pages whose text has two of these or more.
ABUSE = ("disgusting", "moron", "pathetic", "scum", "stupid")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without port and a leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^www\.", "")


def canonical(site: Column, path: Column) -> Column:
    """The key of a page: site + path, without slashes at the end; a site's own page is ``site/``."""
    bare = F.regexp_replace(path, r"/+$", "")
    return F.when(site != "", F.concat(site, F.when(bare == "", F.lit("/")).otherwise(bare)))


def keys_of(rows: DataFrame, *others: str) -> DataFrame:
    """A row for each key of each of ``rows`` (host, path): the page, and the site of the host and of each parent."""
    rows = rows.select(*others, site_of(F.col("host")).alias("site"), "path").where("site <> ''")
    rows = rows.select(*others, "site", canonical(F.col("site"), F.col("path")).alias("page"), F.split("site", r"\.").alias("labels"))
    first = F.greatest(F.lit(2), F.size("labels") - MAX_LABELS + 1)
    parents = F.transform(F.when(F.size("labels") > 1, F.sequence(first, F.size("labels"))), lambda i: F.concat(F.array_join(F.slice("labels", i, F.lit(MAX_LABELS)), "."), F.lit("/")))
    keys = F.concat(F.array("page", F.concat("site", F.lit("/"))), F.coalesce(parents, F.array().cast("array<string>")))
    return rows.select(*others, keys.alias("keys")).select(*others, F.explode("keys").alias("key"))


def _probe(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number, and the bit (0 to 63) in each of its words."""
    second = F.xxhash64(F.lit("bits"), key)
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), [F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]


def bloom_filter(keys: DataFrame, n: int) -> np.ndarray:
    """uint64[blocks, 8] over the column ``key``; the array is bounded by MAX_BLOCKS."""
    blocks = max(1, min(MAX_BLOCKS, -(-n // KEYS_A_BLOCK)))
    block, bits = _probe(F.col("key"), blocks)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), b)).alias(f"w{k}") for k, b in enumerate(bits)]
    filled = np.zeros((blocks, WORDS), dtype=np.uint64)
    for r in keys.groupBy(block.alias("block")).agg(*words).toLocalIterator():
        filled[r[0]] = np.array(r[1:], dtype=np.int64).view(np.uint64)
    return filled


def possible(filled: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which keys, given as their two hashes (int64), the filter may hold."""
    words = filled[np.mod(first, np.int64(len(filled)))]
    shifts = np.arange(0, 6 * WORDS, 6, dtype=np.uint64)
    bits = (second.view(np.uint64)[:, None] >> shifts) & np.uint64(63)
    return ((words >> bits) & np.uint64(1)).all(axis=1)


def _passing(spark: SparkSession, filled: np.ndarray, key: Column) -> Column:
    """Whether the key may be listed."""
    shared = spark.sparkContext.broadcast(filled)

    @F.pandas_udf(BooleanType())
    def passing(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second in parts:
            yield pd.Series(possible(shared.value, first.to_numpy(), second.to_numpy()))

    return passing(F.xxhash64(key), F.xxhash64(F.lit("bits"), key))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and listed (the key that the list holds, if it decided).

    pages: page_id, url.  listed: url, of sites or single pages.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    url = listed.select(F.col("url").cast("string").alias("url"))
    url = url.select(site_of(host_of(F.col("url"))).alias("site"), path_of(F.col("url")).alias("path"))
    keys = lookup(url.select(canonical(F.col("site"), F.col("path")).alias("key")).where("key IS NOT NULL").distinct())
    filled = bloom_filter(keys, keys.count())
    asked = keys_of(rows.where("rule IS NULL"), "url")
    asked = asked.where(_passing(spark, filled, F.col("key"))).distinct()
    found = asked.join(keys, "key").groupBy(F.col("url").alias("u")).agg(F.max_by("key", F.struct(F.length("key"), "key")).alias("listed"))
    judged = rows.join(lookup(found), F.col("url") == F.col("u"), "left")
    by_list = F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_list).alias("verdict"), "listed")


def a_list(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS, abuse: tuple[str, ...] = ABUSE) -> DataFrame:
    """(url): a list of domains and single pages that grows with the table, in place of one from elsewhere."""
    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("url", site_of(host_of(F.col("url"))).alias("site"), (F.regexp_count("html", F.lit("|".join(abuse))) >= 2).alias("bad"))
    domain = F.regexp_extract("site", rf"[^.]*(?:{'|'.join(words)})[^.]*\..*$", 0)
    sites = rows.select(domain.alias("domain")).where("domain <> ''").distinct().select(F.concat(F.lit("http://"), "domain", F.lit("/")).alias("url"))
    return sites.unionByName(rows.where("bad").select("url"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), a_list(pages))


OP2_SQL = r"""
WITH r AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
bare AS (SELECT *, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^www\.', '') AS site FROM h),
k AS (SELECT *, string_split(site, '.') AS l, site || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS page FROM bare),
listed AS (SELECT regexp_extract(site, '[^.]*(adult|ads|bets|casino|pills|spam)[^.]*\..*$') || '/' AS key FROM k WHERE regexp_matches(site, '(adult|ads|bets|casino|pills|spam)[^.]*\.')
  UNION SELECT page FROM k WHERE site <> '' AND len(regexp_extract_all(html, 'disgusting|moron|pathetic|scum|stupid')) >= 2),
s AS (SELECT *, list_concat([page], list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.') || '/')) AS keys FROM k),
hit AS (SELECT page_id, max({'n': length(key), 'k': key}).k AS hit FROM (SELECT page_id, unnest(keys) AS x FROM s WHERE site <> '') JOIN listed ON key = x GROUP BY page_id),
v AS (SELECT s.*, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule FROM s)
SELECT v.page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS listed FROM v LEFT JOIN hit ON v.page_id = hit.page_id
"""
