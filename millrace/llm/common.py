"""Shared expressions of the training-data operators.

White space is the ASCII set ``[\\x20\\x09-\\x0D]`` everywhere, and a word is a
maximal run of anything else.  A null text counts as the empty text.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"

#: Bytes up to which a lookup side may be broadcast, counted as below.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 64
#: Links up to which components are found in one task.
FEW_LINKS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """array<string> of the words of a non-null text, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (letter case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; only on a local master
    (tests, one machine) a temporary folder stands in where that is unset.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return df.checkpoint(eager=True)


def lookup(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` materialised; with the broadcast hint if it was measured to have at most ``most`` bytes."""
    return measured(cut(df), most)


def measured(kept: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``kept`` (numbers, strings, arrays of longs and of structs of three numbers), cheap to compute again, with the broadcast hint as in ``lookup``."""
    strings = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in kept.dtypes if kind == "string"]
    strings += [F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) * 8 for c, kind in kept.dtypes if kind.startswith("array<bigint")]
    strings += [F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) * 24 for c, kind in kept.dtypes if kind.startswith("array<struct")]
    size = sum(strings, F.lit(ROW_BYTES + 8 * len(kept.columns)).cast("long"))
    total = kept.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(kept) if total <= most else kept


def where_after(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)``, taken after the columns that it names have been computed.

    Spark moves a filter below the projections it can, with the columns' own
    expressions written into it.  An array function whose lambda reads another
    computed array would then compute that array again for each element.
    """
    (flag,) = fresh(df, "mr_flag")
    return df.withColumn(flag, F.explode(F.when(condition, F.array(F.lit(True))))).drop(flag)


def content_id(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that together name the content of ``cols``; nulls differ from every value."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums of longs in a total order, the row itself included, and no task that sees all rows.

    Rows are dealt by ranges of the order; each range is summed by itself, and
    then the ranges' totals, of which there are as many as partitions.
    """
    (part,) = fresh(df, "mr_part")
    dealt = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(part).alias("p"), *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"before_{name}") for name in sums))
    along = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({name: F.sum(c).over(along) for name, c in sums.items()}).join(F.broadcast(totals), F.col(part) == F.col("p"))
    return summed.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(name) + F.col(f"before_{name}")).alias(name) for name in sums))


def numbered(df: DataFrame, k1: str, k2: str) -> tuple[DataFrame, str]:
    """``df`` with each row's number from 1 among those with the same ``k1`` and ``k2``, and that column's name.

    Rows that stand alone are not shuffled.  The others are numbered in each
    partition that they come from, and the partitions' counts give each its
    first number, so one key's rows never meet in one task.
    """
    number, part, first, p1, p2, p3 = fresh(df, "mr_number", "mr_part", "mr_first", "mr_p1", "mr_p2", "mr_p3")
    repeated = lookup(df.groupBy(k1, k2).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(k1, k2))
    if repeated.isEmpty():
        return df.withColumn(number, F.lit(1).cast("long")), number
    alone = df.join(repeated, [k1, k2], "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    some = df.join(repeated, [k1, k2], "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
    some = cut(some.withColumn(part, F.spark_partition_id()))
    counts = some.groupBy(k1, k2, part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(k1, k2).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(k1).alias(p1), F.col(k2).alias(p2), F.col(part).alias(p3), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    own = F.row_number().over(Window.partitionBy(k1, k2, part).orderBy(k1))
    placed = some.withColumn(number, own).join(counts, (F.col(k1) == F.col(p1)) & (F.col(k2) == F.col(p2)) & (F.col(part) == F.col(p3)))
    placed = placed.withColumn(number, (F.col(number) + F.col(first)).cast("long")).drop(part, first, p1, p2, p3)
    return alone.withColumn(number, F.lit(1).cast("long")).unionByName(placed), number


def _star_round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over (u, v); equi-joins, which Spark can split where they are skewed."""
    # large star: larger neighbours move to the least of the neighbourhood
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    moved = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    # small star: smaller neighbours, and the node, move to the least of them
    down = moved.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    joined = moved.join(down, F.col("u") == F.col("k"))
    small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return small.distinct()


def _star_round_of_few(edges: DataFrame) -> DataFrame:
    """The same in one partition, by windows: one task and no shuffle."""
    least = F.min("v").over(Window.partitionBy("u"))
    turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.coalesce(1).select(F.inline(F.array(F.struct("u", "v"), turned))).withColumn("m", F.least(least, "u"))
    moved = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().withColumn("m", least)
    small = moved.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
    return small.where("u <> v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) links of any orderable type to (node, root): every linked node and the least node it reaches.

    The links are counted first: rounds over at most ``FEW_LINKS`` are one task each, which
    dealing them to all partitions would turn into thousands of nearly empty ones.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    step = _star_round_of_few if edges.count() <= FEW_LINKS else _star_round
    before = None
    while True:
        edges = cut(step(edges))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
