"""Near copies at a similarity of 0.8 or more on five-word shingles (DataFrame operations only).

A text's shingles are the 64-bit hashes of its lower-cased five-word windows (a
shorter text is one shingle; a text without words has none and is no near
copy).  ``MINHASHES`` = 24 minima, each of the shingles XORed with a constant
of its own, are taken as four vectors of six.  A vector emits its six variants
with one coordinate left out, so two texts meet where five or more of a
vector's six agree: with probability 0.986 at a similarity of 0.8, 0.998 at
0.85, 0.9999 at 0.9.

A variant's texts are not paired with each other.  Each is paired with the one
among them that meets most others, the closest to what a group was copied from,
and the pairs' shingles are compared exactly.  Exact copies are one text.

Variants are counted by partial aggregation and joined with their counts, so a
variant that a third of all texts share is one that an equi-join can split.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, content_id, cut, fresh, lookup, measured, words_of

SHINGLE = 5
SIMILARITY = 0.8
WIDTH = 6
MINHASHES = 24
_rng = random.Random(5)
_SEEDS = [_rng.getrandbits(64) - (1 << 63) for _ in range(MINHASHES)]


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """array<bigint> of the distinct shingles, null if there are no words; ``words`` has to be a column, not an expression."""
    at = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n)))))


def _shingled(texts: DataFrame) -> DataFrame:
    """(c1, c2, t) to (c1, c2, sh)."""
    return texts.select("c1", "c2", words_of(F.lower("t")).alias("w")).select("c1", "c2", shingles(F.col("w")).alias("sh"))


def pairs(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), structs of c1 and c2: verified links of near copies among (c1, c2, t); rows of equal c1 and c2 have equal t."""
    names = [f"m{k}" for k in range(MINHASHES)]
    # windows as rows, so that they are hashed and their minima taken in generated code; a text's windows meet in its task
    words = texts.select("c1", "c2", words_of(F.lower("t")).alias("w"))
    at = F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)))))
    windows = words.select("c1", "c2", "w", at.alias("i")).select("c1", "c2", F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(SHINGLE))).alias("h"))
    once = windows.groupBy("c1", "c2").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(s))).alias(m) for m, s in zip(names, _SEEDS)))
    # their upper halves, two to a long, and a text is a number that the checkpoint fixes: this is what is written and shuffled for each text
    half = lambda m: F.shiftrightunsigned(F.col(m), 32)
    packed = [F.call_function("shiftleft", half(a), F.lit(32)).bitwiseOR(half(b)).alias(a) for a, b in zip(names[::2], names[1::2])]
    kept = cut(once.select("c1", "c2", *packed, F.monotonically_increasing_id().alias("id")))
    value = [F.shiftrightunsigned(F.col(names[k]), 32) if k % 2 == 0 else F.col(names[k - 1]).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(MINHASHES)]
    variants = [F.xxhash64(F.lit(k), *(m for j, m in enumerate(value) if j // WIDTH == k // WIDTH and j != k)) for k in range(MINHASHES)]
    held = kept.select("id", F.explode(F.array(*variants)).alias("v"))
    common = held.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(held.join(common, "v"))
    middle = met.groupBy("id").agg(F.sum("n").alias("n"))
    # of equally close ones another in each variant: what lies too far from one meets the others elsewhere
    first = F.max(F.struct("n", F.xxhash64("v", "id").alias("turn"), "id")).alias("to")
    leaders = met.drop("n").join(middle, "id").groupBy("v").agg(first).select("v", F.col("to.id").alias("b"))
    found = cut(met.join(leaders, "v").select("id", "b").where("id <> b").distinct())
    # a text goes to those it is compared with, and to itself if others come to it
    needs = found.unionByName(found.select(F.col("b").alias("id"), "b").distinct()).groupBy("id").agg(F.collect_list("b").alias("to"))
    ends = lookup(kept.select("id", "c1", "c2").join(needs, "id"))
    # of the rows with equal text any will do, and no text is shuffled; shingles are twice, here and to where they are compared
    firsts = (F.first(c).alias(c) for c in ("sh", "c1", "c2", "to"))
    known = cut(_shingled(texts.join(ends, ["c1", "c2"])).join(ends, ["c1", "c2"]).groupBy("id").agg(*firsts))
    to = measured(known.where(F.array_contains("to", F.col("id"))).select(F.col("id").alias("b"), F.col("sh").alias("other"), F.col("c1").alias("b1"), F.col("c2").alias("b2")))
    both = known.select("id", "c1", "c2", "sh", F.explode("to").alias("b")).where("id <> b").join(to, "b")
    same = F.size(F.array_intersect("sh", "other"))
    near = both.withColumn("same", same).where(F.col("same") >= similarity * (F.size("sh") + F.size("other") - F.col("same")) - 1e-9)
    return near.select(F.struct("c1", "c2").alias("a"), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")).alias("b"))


def classes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(c1, c2, k1, k2): for each text of (c1, c2, t) with near copies the name of its class, the least (c1, c2) in it."""
    roots = components(pairs(texts, similarity))
    return cut(roots.select("node.c1", "node.c2", F.col("root.c1").alias("k1"), F.col("root.c2").alias("k2")))


def with_classes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with c1 and c2) plus k1 and k2, those of ``classes`` or a text's own."""
    (n1, n2) = fresh(rows, "mr_n1", "mr_n2")
    side = lookup(found.select("c1", "c2", F.col("k1").alias(n1), F.col("k2").alias(n2)))
    out = rows.join(side, ["c1", "c2"], "left")
    # a class of one is named by its text; found names are never null
    return out.withColumns({"k1": F.coalesce(F.col(n1), F.col("c1")), "k2": F.when(F.col(n1).isNull(), F.col("c2")).otherwise(F.col(n2))}).drop(n1, n2)


def texts_of(docs: DataFrame) -> DataFrame:
    """(c1, c2, t) of the rows of ``docs``; a null text is the empty text."""
    t = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    c1, c2 = content_id(F.col("t"))
    return t.select(c1.alias("c1"), c2.alias("c2"), "t")
