"""Mixing sources to target weights: Pareto order sampling (DataFrame operations only).

A document's size is its number of words.  Sources in code-point order, null
last, weigh 1, 2, 3, 1, 2, ... and share all words by weight; a target stops at
``MAX_COPIES`` times its source's size, and the excess is shared again by
weight.

Within a source a document is expected min(``MAX_COPIES``, kappa * class) times,
where its class is the number of binary digits of its size, so that a text of a
thousand words counts for ten, one of ten words for four; kappa is the value for
which the source's expected words are its target.  There are at most 63 classes
in a source, and kappa is found from their sums.  Of its expected copies a
document gets the whole ones for certain.  The fraction f left over is its
inclusion probability in a Pareto order sample: with the uniform number U it has
the rank

    Q = (U / (1 - U)) / (f / (1 - f)),

and documents are taken in order of Q while their words fit what the certain
copies left open: the sample's size is fixed in words.  Of those after them, the
one whose size comes nearest to what is still missing is taken too, if it brings
the sum nearer.  U comes from an MD5 of seed, doc_id, text, and the row's number
among equal rows, so reruns agree and equal rows are drawn one by one.

No source is ever sorted as a whole.  Ranks fall into 4096 bins, words are
summed by (source, bin), the bin where the target is met is found from those
sums and cut into 4096 in turn, until at most ``ORDERED`` rows are left to
order.  Sources are numbered by range partitions and sums of these.

Defined results: a null or empty text has size 0 and takes 0 words; a source
without words has target 0; rows that agree in source, doc_id and text are
numbered in any order; an empty table gives an empty result; other columns are
passed through or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import content_id, cut, fresh, lookup, numbered, running, table, text_of, words_of

MAX_COPIES = 3
BINS = 4096
#: After so many rounds of bins ranks are told apart as doubles.
ROUNDS = 4
#: Rows of one source that one task orders.
ORDERED = 65_536
SEED = "millrace-mix"


def uniform(seed: str, doc_id: Column, text_md5: Column, number: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5."""
    name = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text_md5, F.lit("|"), number.cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(2.0**52)


def class_of(size: Column) -> Column:
    """The number of binary digits; 0 for 0."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); one row per source."""
    placed = running(by_source, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    turn = ((F.col("place") - 1) % len(weights)).cast("int")
    weighed = placed.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), turn + 1)).drop("place")
    full = weighed.withColumn("most", F.col("source_size") * MAX_COPIES)
    ratio = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    # with the first k sources at their most, the others share what is left by weight; the fewest such k is right
    share = cut(running(full, ratio, {"rank": F.lit(1).cast("long"), "full": F.col("most"), "heavy": F.col("weight")}))
    all_words, all_weight = share.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(all_words) - F.col("full") + F.col("most")).cast("double") / (F.lit(all_weight) - F.col("heavy") + F.col("weight"))
    share = share.withColumn("level", level)
    first = share.where(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min(F.struct("rank", "level"))).first()[0]
    most = F.col("most").cast("double")
    target = most if first is None else F.when(F.col("rank") < first["rank"], most).otherwise(F.least(most, F.lit(first["level"]) * F.col("weight")))
    return share.select("source", "source_size", "weight", target.alias("target"))


def _measured(docs: DataFrame, names: list[str], seed: str) -> DataFrame:
    """``docs`` with size, class and u added under the first three of five free names."""
    size, kind, u, k1, k2 = names
    c1, c2 = content_id(F.col("source"), F.col("doc_id"), F.col("text"))
    rows, number = numbered(docs.withColumns({k1: c1, k2: c2}), k1, k2)
    words = F.size(words_of(text_of())).cast("long")
    rows = rows.withColumn(size, words).withColumns({kind: class_of(F.col(size)), u: uniform(seed, F.col("doc_id"), F.md5(text_of()), F.col(number))})
    return rows.drop(k1, k2, number)


def expected(light: DataFrame) -> DataFrame:
    """Per source and class: source_size, target, words, copies (expected), n_whole and f."""
    by_class = cut(light.groupBy("source", "class").agg(F.sum("size").alias("words")))
    goals = targets(by_class.groupBy("source").agg(F.sum("words").alias("source_size"))).drop("weight").withColumnRenamed("source", "s")
    along = Window.partitionBy("source").orderBy(F.desc("class"))  # at most 64 rows a source
    every = by_class.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    above = F.sum("words").over(along) - F.col("words")
    units = F.col("class") * F.col("words")
    below = F.sum(units).over(Window.partitionBy("source")) - F.sum(units).over(along) + units
    every = every.withColumn("kappa", F.when(below > 0, (F.col("target") - F.lit(float(MAX_COPIES)) * above) / below))
    # of the classes from the top, the first that does not pass the most
    top = F.max(F.when(F.col("kappa") * F.col("class") <= MAX_COPIES, F.struct("class", "kappa"))).over(Window.partitionBy("source"))
    copies = F.when(F.col("top").isNull() | (F.col("class") > F.col("top.class")), F.lit(float(MAX_COPIES))).otherwise(F.col("top.kappa") * F.col("class"))
    every = every.withColumn("top", top).withColumn("copies", F.when(F.col("class") > 0, copies).otherwise(F.lit(0.0)))
    every = every.withColumn("n_whole", F.floor("copies").cast("long")).withColumn("f", F.col("copies") - F.col("n_whole"))
    return every.select("source", "class", "source_size", "target", "words", "copies", "n_whole", "f")


def _rank(f: Column, u: Column) -> Column:
    """Q / (1 + Q), which has the order of Q; null where no fraction is left."""
    q = (u / (1 - u)) / (f / (1 - f))
    return F.when(f > 0, q / (1 + q))


def plan(light: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The copies by source and class, and by source (s) what is drawn: ranks below ``low``, up to ``upto``, and ``extra``.

    light: source, size, class, u.
    """
    classes = lookup(expected(light))
    open_ = classes.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("words") * F.col("n_whole")).alias("certain"))
    goals = lookup(open_.select(F.col("source").alias("s"), (F.col("target") - F.col("certain")).alias("open")))
    same = F.col("source").eqNullSafe(F.col("s"))
    side = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), "f").where("f > 0")
    ranked = light.join(side, same & (F.col("class") == F.col("c"))).select("source", "size", _rank(F.col("f"), F.col("u")).alias("t"))
    bins = lambda k: F.floor(F.col("t") * float(BINS**k)).cast("long")
    scope, before = ranked, goals.withColumn("before", F.lit(0).cast("long"))
    k = 0
    while True:
        k += 1
        sums = scope.groupBy("source", bins(k).alias("bin")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        sums = sums.join(before, same)
        along = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
        sums = sums.withColumn("after", F.col("before") + F.sum("n").over(along))
        met = (F.col("after") >= F.col("open")) & (F.col("after") - F.col("n") < F.col("open"))
        crossing = lookup(sums.where(met).select("s", "open", (F.col("after") - F.col("n")).alias("before"), F.col("bin").alias("b"), "rows"))
        scope = ranked.join(crossing.select("s", "b"), same & (bins(k) == F.col("b"))).drop("s", "b")
        before = crossing.select("s", "open", "before")
        if k == ROUNDS or (crossing.agg(F.max("rows")).first()[0] or 0) <= ORDERED:
            break
    order = Window.partitionBy("source").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    near = scope.join(before, same).withColumn("sum", F.col("before") + F.sum("size").over(order)).where("sum <= open")
    inside = near.groupBy(F.col("source").alias("i")).agg(F.max("t").alias("upto"), F.max("sum").alias("taken"))
    known = goals.join(crossing.drop("open").withColumnRenamed("s", "x"), F.col("s").eqNullSafe(F.col("x")), "left").join(inside, F.col("s").eqNullSafe(F.col("i")), "left")
    # without a crossing bin all that is drawn from fits
    low = F.when(F.col("b").isNull(), F.lit(2.0)).otherwise(F.col("b") / float(BINS**k))
    known = lookup(known.select("s", low.alias("low"), "upto", F.when(F.col("b").isNotNull(), F.col("open") - F.coalesce("taken", "before")).alias("missing")))
    after = ranked.join(known, same).where("NOT (t < low OR coalesce(t <= upto, false))")
    off = F.abs(F.col("size") - F.col("missing"))
    best = after.where(off < F.col("missing")).groupBy(F.col("source").alias("x")).agg(F.min(F.struct(off.alias("off"), F.col("t"))).alias("best"))
    drawn = known.join(best, F.col("s").eqNullSafe(F.col("x")), "left").select("s", "low", "upto", F.col("best.t").alias("extra"))
    return classes, lookup(drawn)


def _chosen(rows: DataFrame, light: DataFrame, names: list[str], n: str) -> DataFrame:
    """``rows`` (with size, class and u under ``names``) with source_size, target and the number of copies ``n``; names[3:] are free."""
    size, kind, u, s1, c, s2, low, upto, extra, total, goal, whole, f, copies, words = names
    classes, drawn = plan(light)
    classes = classes.toDF(s1, c, total, goal, words, copies, whole, f)
    out = rows.join(classes, F.col("source").eqNullSafe(F.col(s1)) & (F.col(kind) == F.col(c)))
    out = out.join(drawn.toDF(s2, low, upto, extra), F.col("source").eqNullSafe(F.col(s2)), "left")
    t = _rank(F.col(f), F.col(u))
    taken = F.coalesce((t < F.col(low)) | (F.coalesce(t <= F.col(upto), F.lit(False))) | F.coalesce(t == F.col(extra), F.lit(False)), F.lit(False))
    return out.withColumn(n, F.col(whole) + taken.cast("long"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, n_copies."""
    docs = docs.select("doc_id", "source", "text")
    rows = cut(_measured(docs, ["size", "class", "u", "k1", "k2"], seed).drop("text"))
    names = ["size", "class", "u", "s1", "c", "s2", "low", "upto", "extra", "source_size", "target", "n_whole", "f", "copies", "words"]
    out = _chosen(rows, rows.select("source", "size", "class", "u"), names, "n_copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")


def sample(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns."""
    names = fresh(docs, *(f"mr_{k}" for k in range(17)))
    measured = _measured(docs, [*names[:3], *names[15:]], seed)
    light = cut(measured.select("source", *names[:3]).toDF("source", "size", "class", "u"))
    (n, copy) = fresh(measured, "mr_n", "mr_copy")
    out = _chosen(measured, light, names[:15], n)
    copies = F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("long"), F.col(n)))
    return out.withColumn(copy, F.explode(copies)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH e AS (SELECT doc_id, source, coalesce(text, '') AS t0, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  row_number() OVER (PARTITION BY source, doc_id, text) AS k FROM documents),
d AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END::BIGINT AS class,
  ((('0x' || substr(md5('millrace-mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(t0) || '|' || k), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS most, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS rank FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) - (sum(most) OVER (ORDER BY rank)) + most)::DOUBLE / ((sum(weight) OVER ()) - (sum(weight) OVER (ORDER BY rank)) + weight)::DOUBLE AS level FROM r),
f AS (SELECT *, min(CASE WHEN level * weight <= most THEN rank END) OVER () AS first FROM l),
z AS (SELECT *, max(CASE WHEN rank = first THEN level END) OVER () AS final FROM f),
g AS (SELECT source, source_size, CASE WHEN first IS NULL OR rank < first THEN most::DOUBLE ELSE least(most::DOUBLE, final * weight) END AS target FROM z),
c AS (SELECT source, class, sum(size)::BIGINT AS words FROM d GROUP BY source, class),
h AS (SELECT c.*, g.source_size, g.target, coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  sum(class * words) OVER (PARTITION BY c.source ORDER BY class) AS below FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CASE WHEN below > 0 THEN (target - 3.0::DOUBLE * above::DOUBLE) / below::DOUBLE END AS kappa FROM h),
o AS (SELECT *, max(CASE WHEN kappa * class <= 3 THEN {'c': class, 'k': kappa} END) OVER (PARTITION BY source) AS top FROM k),
p AS (SELECT *, CASE WHEN class = 0 THEN 0.0::DOUBLE WHEN top IS NULL OR class > top.c THEN 3.0::DOUBLE ELSE top.k * class END AS copies FROM o),
w AS (SELECT *, floor(copies)::BIGINT AS n_whole, copies - floor(copies) AS f, target - (sum(words * floor(copies)::BIGINT) OVER (PARTITION BY source))::DOUBLE AS open FROM p),
q AS (SELECT d.*, source_size, target, n_whole, open, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS q FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.class = w.class),
n AS (SELECT *, q / (1 + q) AS t FROM q),
a AS (SELECT *, sum(size) OVER (PARTITION BY source, t IS NULL ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM n),
i AS (SELECT *, t IS NOT NULL AND upto <= open AS inside FROM a),
m AS (SELECT *, open - coalesce(max(CASE WHEN inside THEN upto END) OVER (PARTITION BY source), 0) AS missing FROM i),
x AS (SELECT *, min(CASE WHEN t IS NOT NULL AND NOT inside AND abs(size - missing) < missing THEN {'o': abs(size - missing), 't': t} END) OVER (PARTITION BY source) AS best FROM m)
SELECT doc_id, size, source_size, target, size * n_copies AS taken, n_copies FROM (SELECT *, n_whole + CASE WHEN inside OR coalesce(t = best.t, false) THEN 1 ELSE 0 END::BIGINT AS n_copies FROM x)
"""
