"""Packing: optimal length buckets.

Lengths (words) are counted into an exact histogram, a row for each length that
occurs; d different lengths need d * d / 2 words in all, so it has at most the
square root of twice the corpus's words, and a few hundred thousand rows in
practice.  Over it dynamic programming picks the ``buckets`` boundaries for
which padding every document to its bucket's boundary wastes least; the boundary
of a bucket is the longest document in it.  The waste of a bucket that ends at a
length is a minimum over lines, one for each start, whose slopes fall as the
starts rise; so a layer takes time in proportion to the histogram, in whole
numbers.  Within a bucket documents are put in a fixed pseudo-random order and
cut into batches of as many as fit ``budget`` padded tokens (at least one: a
document over the budget is a batch of its own, whole).

A bucket is never gathered in one task: its rows are dealt to salts, equal rows
too, numbered there, and the salts' counts give each its first number.

Defined results: a null or empty text has length 0 and is packed like any
other; equal rows get different places; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import content_id, cut, numbered, table, text_of, words_of

BUCKETS = 16
BUDGET = 32_768
#: Rows that one salt of a bucket numbers, about.
SALT_ROWS = 2_000_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The indexes of the lengths that end a bucket, least padding, the fewest buckets among equals.

    lengths, rising, and the documents of each.
    """
    m = len(lengths)
    if not m:
        return []
    n, total = [0], [0]
    for x, c in zip(lengths, counts, strict=True):
        n.append(n[-1] + c)
        total.append(total[-1] + x * c)
    best: list[int | None] = [0, *[None] * m]
    cuts: list[np.ndarray] = []
    while len(cuts) < min(buckets, m):
        now: list[int | None] = [None] * (m + 1)
        at = np.full(m + 1, -1, dtype=np.int32)
        lines: list[int] = []  # starts whose line is least somewhere ahead
        head = 0
        value = lambda i, x: best[i] + total[i] - x * n[i]
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                while len(lines) - head >= 2:
                    a, b = lines[-2], lines[-1]
                    # b is never least if the new line passes a no later than b does
                    if (best[i] + total[i] - best[a] - total[a]) * (n[b] - n[a]) <= (best[b] + total[b] - best[a] - total[a]) * (n[i] - n[a]):
                        lines.pop()
                    else:
                        break
                lines.append(i)
            x = lengths[j - 1]
            while len(lines) - head >= 2 and value(lines[head + 1], x) <= value(lines[head], x):
                head += 1
            if len(lines) > head:
                at[j] = lines[head]
                now[j] = value(lines[head], x) + x * n[j] - total[j]
        if cuts and now[m] >= best[m]:
            break
        cuts.append(at)
        best = now
    ends, j = [], m
    for at in reversed(cuts):
        ends.append(j - 1)
        j = int(at[j])
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, bucket_length, batch (in its bucket), slot (in its batch), n_pad."""
    first, second = content_id(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", F.size(words_of(text_of())).cast("long").alias("n_tokens"), first.alias("h"), second.alias("h2"))
    rows, number = numbered(cut(rows), "h", "h2")
    # one row per length that occurs
    seen = sorted((r[0], r[1]) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1))).collect())
    ends = boundaries([r[0] for r in seen], [r[1] for r in seen], buckets)
    total = sum(r[1] for r in seen)
    salts = max(64, -(-total // SALT_ROWS))
    bucket, longest = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, e in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("n_tokens") <= seen[e][0], F.lit(k)).otherwise(bucket)
        longest = F.when(F.col("n_tokens") <= seen[e][0], F.lit(seen[e][0]).cast("long")).otherwise(longest)
    rows = rows.withColumns({"bucket": bucket, "bucket_length": longest, "h": F.xxhash64("h", number)}).withColumn("salt", F.pmod(F.xxhash64("h", "h2"), F.lit(salts)))
    counts = rows.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("h", "h2")) - 1
    placed = rows.withColumn("place", place).join(offsets, ["bucket", "salt"])
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    at = F.col("place") + F.col("first")
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_length",
        F.floor(at / size).cast("long").alias("batch"),
        F.pmod(at, size).cast("int").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("n_pad"),
    )


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
