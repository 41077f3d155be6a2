"""Chat formatting: cumulative-snapshot collapse (DataFrame operations only).

A logger that stores a conversation after each turn leaves many snapshots, of
which each is the beginning of the next.  Every turn gets a rolling hash of all
turns up to it: two 64-bit hashes of (position, role, text), XORed along the
conversation.  The hash of a conversation's last turn names the conversation,
the hashes of its other turns name its proper prefixes.  An anti-join drops the
conversations whose name is a proper prefix of another; of equal conversations
the one with the least id stays.  What is left is maximal and is rendered.

Texts take no part in this: a turn is its position and hashes, about 50 bytes.
The rolling hash is a running window aggregate, which spills; it is computed
once, and names and prefixes are both read from it.  Prefixes are deduplicated
by partial aggregation before they are shuffled, so a first turn shared by very
many conversations costs one row a task.  Only the turns of the conversations
that stay are shuffled with their text.  A conversation is rendered into one
row, so it has to fit one.

Defined results: turns are ordered by turn, role and MD5 of the text, nulls
first; repeated rows are repeated turns; a null role is rendered as ``unknown``
and a null text as the empty text, but neither equals the other in a
comparison; a null conv_id is one conversation, with a null id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def rolling(turns: DataFrame) -> DataFrame:
    """(conv_id, at, p1, p2, last) of each turn: its position from 1, the hash of the turns up to it, whether its conversation ends here."""
    texts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    light = _turns(turns).select("conv_id", "turn", "role", F.md5("text").alias("m"), F.xxhash64(F.lit(1), *texts).alias("h1"), F.xxhash64(F.lit(2), *texts).alias("h2"))
    along = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "m")))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = light.withColumn("at", F.row_number().over(along))
    placed = placed.withColumns({"h1": F.xxhash64("at", "h1"), "h2": F.xxhash64("at", "h2")})
    return placed.select("conv_id", "at", F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"), F.lead("at").over(along).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): the conversations that no other one extends, and how many equal ones each stands for."""
    hashed = cut(rolling(turns))
    names = hashed.where("last").groupBy("p1", "p2", "at").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    prefixes = hashed.where(~F.col("last")).select("p1", "p2", "at").distinct()
    return names.join(prefixes, ["p1", "p2", "at"], "left_anti").select("conv_id", F.col("at").alias("n_turns"), "n_equal")


def _line() -> Column:
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(CLOSE + "\n"), F.coalesce("text", F.lit("")), F.lit("\n" + END + "\n"))


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row for each of ``chosen``: conv_id, n_turns, n_equal, n_chars and text, each turn as ``<|role|>``, text, ``<|end|>``."""
    # null ids as values of their own, so that the join and the grouping share one exchange
    ids = lambda c: (c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("id"))
    picked = chosen.select(*ids(F.col("conv_id")), "conv_id", "n_turns", "n_equal")
    lines = _turns(turns).select(*ids(F.col("conv_id")), "turn", "role", F.md5("text").alias("m"), _line().alias("line"))
    joined = lines.join(picked, ["none", "id"]).groupBy("none", "id")
    # sort_array puts null fields first, as the rolling hash does
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "m", "line"))), lambda x: x["line"]), "")
    out = joined.agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").cast("long").alias("n_turns"), F.first("n_equal").alias("n_equal"), whole.alias("text"))
    return out.select("conv_id", "n_turns", "n_equal", F.length("text").cast("long").alias("n_chars"), "text")


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations of ``turns``, rendered."""
    return render(turns, maximal(turns))


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text,
    coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2) AS mark,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos FROM conversations),
p AS (SELECT conv_id, pos, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM t),
n AS (SELECT conv_id, string_agg(mark, '' ORDER BY pos) AS whole, string_agg(line, '' ORDER BY pos) AS text, count(*)::BIGINT AS n_turns FROM t GROUP BY conv_id),
proper AS (SELECT DISTINCT p.prefix FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id WHERE p.pos < n.n_turns)
SELECT min(conv_id) AS conv_id, n_turns, count(*)::BIGINT AS n_equal, length(text)::BIGINT AS n_chars, text FROM n
WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.prefix = n.whole) GROUP BY whole, text, n_turns
"""
