"""SimHash near-dedup: meet-in-the-middle ball hashing.

A document's fingerprint has a bit set if over half of its shingles' XXH64
have it set.  Two fingerprints link if at most ``RADIUS`` = 2 bits differ.
Each distinct fingerprint emits all 65 values within half the radius, one bit;
two fingerprints within two bits meet in at least one value, and any two that
meet differ in two bits at most.  A value's fingerprints are sorted and each is
linked to the one before, so a group of g gives g - 1 links, not g * g / 2,
and joins the same fingerprints (a group has 65 members at most, as they are
distinct).  The links are deduplicated and verified, and components come from
alternating large-star and small-star rounds, each of which is a partial
minimum and an equi-join that Spark can split where it is skewed.

``near_duplicates`` is that, with three-word shingles.  ``deduplicate`` keeps one
document of each group of near copies at a similarity of ``near.SIMILARITY`` on
five-word shingles.  Such copies differ in about 3 to 14 of 64 bits, and balls of
half that radius have millions of members, so the fingerprints' links are not
enough: those of ``near.pairs``, where vectors of minima meet in the same way,
are added, and components are taken over both.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; a text with fewer words than a shingle is one shingle; null
doc_ids belong to components but never name one unless all in it are null;
equal rows stay separate rows; an empty table gives an empty result; other
columns are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.llm import near
from millrace.llm.common import components, content_id, cut, fresh, table, text_of

SHINGLE = 3
RADIUS = 2
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for k in range(0, len(every), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(every[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits((2 * counts > len(every)).astype(np.uint8), bitorder="little")
    return int(majority.view("<u8")[0])


def _fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf(LongType())
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return hashed(text.cast("string"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: links of the distinct fingerprints ``fp`` that keep every component together."""
    within = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    balls = prints.select("fp", F.explode(within).alias("middle"))
    along = Window.partitionBy("middle").orderBy("fp")
    pairs = balls.select(F.lag("fp").over(along).alias("a"), F.col("fp").alias("b")).where(F.col("a").isNotNull()).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _classes(known: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints of ``known`` that have links."""
    return components(links(known.select("fp").distinct()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id (the least doc_id reachable)."""
    known = cut(docs.select("doc_id", _fingerprints(F.col("text")).alias("fp")))
    roots = _classes(known)
    by_print = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = by_print.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    to = named.join(by_root, "root").select(F.col("fp").alias("k"), "component_id")
    return known.join(to, F.col("fp") == F.col("k")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = near.SHINGLE, similarity: float = near.SIMILARITY) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id (then of least content), all its columns."""
    maps = {c for c, kind in docs.dtypes if "map<" in kind}  # the one type that has no hash
    c1, c2 = content_id(*(F.to_json(F.col(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in docs.columns))
    t1, t2 = content_id(text_of())
    known = cut(docs.select("doc_id", c1.alias("c1"), c2.alias("c2"), F.struct(t1.alias("c1"), t2.alias("c2")).alias("t"), _fingerprints(F.col("text"), shingle).alias("fp")))
    roots = _classes(known)
    by_print = known.select("t", "fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("t", F.coalesce("root", "fp").alias("root"))
    least = by_print.groupBy("root").agg(F.min("t").alias("b"))
    alike = by_print.join(least, "root").select(F.col("t").alias("a"), "b")
    linked = components(alike.unionByName(near.pairs(near.texts_of(docs), similarity)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("c1"), F.col("c2"))
    best = known.groupBy("t").agg(F.min(order).alias("best"))
    named = best.join(linked, F.col("t") == F.col("node"), "left").select("best", F.coalesce("root", "t").alias("root"))
    k1, k2 = fresh(docs, "mr_c1", "mr_c2")
    kept = named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.c1").alias(k1), F.col("best.c2").alias(k2))
    found = docs.join(kept, (c1 == F.col(k1)) & (c2 == F.col(k2)))
    return found.dropDuplicates([k1, k2]).drop(k1, k2)  # rows equal in every column share their content


def op10_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
