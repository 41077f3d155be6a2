"""Quality rules: cross-document line frequency (DataFrame operations only).

Every line is normalised and hashed together with its host (``source``).  For
each (host, line) the documents that hold it are counted, and a line above the
limit is boilerplate: it is cut from its documents, and a document of which
too little is left is rejected.

A near-copied text is not boilerplate, though each of its lines is in many
documents: exact copies and near copies (``near.classes``, at a similarity of
0.8) are one document in these counts, however many there are.

Defined results: a null text is the empty text (0 words, fails the base
rules); a null source is a host of its own; equal rows get equal verdicts and
do not influence each other's counts of removed words; an empty table gives an
empty result; other columns are passed through or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import near
from millrace.llm.common import content_id, cut, fresh, lookup, table, text_of, where_after, words_of

#: Documents of one host that may share a line.
MAX_DOCS = 20
MIN_WORDS = 10
#: A document is depleted if over this share of its words is removed.
MAX_REMOVED_PERCENT = 80

# translate() looks up each character in a map; lower() and a regex that seldom matches are far cheaper
_SYMBOLS = "[#*$%&|<>]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _normal(line: Column) -> Column:
    """Trimmed, lower-cased, each digit as 0."""
    return F.btrim(F.regexp_replace(F.lower(line), "[0-9]", "0"), F.lit(" \t\x0b\x0c\r"))


def base_metrics(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added.

    Windows of five words are compared by 64-bit hash.  Only texts with a
    hash that occurs twice pay for sorting their windows.
    """
    w, h, s, p = fresh(df, "mr_words", "mr_windows", "mr_sorted", "mr_at")
    get = lambda c, i: F.get(F.col(c), i)
    df = df.withColumn(w, words_of(text))
    df = df.withColumn(
        h,
        F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(get(w, i + k) for k in range(5))))),
    )
    df = df.withColumn(
        s,
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    same = lambda x, j: get(s, j)["h"].eqNullSafe(x["h"])
    df = df.withColumn(
        p,
        F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(x, j + 1) | F.when(j > 0, same(x, j - 1)).otherwise(False), x["i"])), lambda i: i.isNotNull())),
    )
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(_lines(text), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop(w, h, s, p)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def _normal_lines(col: str) -> Column:
    return F.filter(F.transform(_lines(F.col(col)), _normal), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.xxhash64(F.col("source").isNull(), F.col("source"), line)


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``key`` of each (host, normalised line) in over ``max_docs`` documents of the host, near copies counting as one, with n_docs."""
    c1, c2 = content_id(text_of())
    base = docs.select("source", text_of().alias("t"), c1.alias("c1"), c2.alias("c2"))
    keys = base.select("source", "c1", "c2", _normal_lines("t").alias("lines")).select("c1", "c2", F.array_distinct(F.transform("lines", _key)).alias("keys"))
    every = keys.select("c1", "c2", F.explode("keys").alias("key"))
    often = lambda rows: lookup(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("key"))
    # lines in many rows, then those in many texts: the texts are split twice, but only lines in many rows are shuffled with them
    held = cut(every.join(often(every.select("key")), "key").distinct())
    held = cut(held.join(often(held), "key"))
    classed = near.with_classes(held, near.classes(near.texts_of(docs))).select("key", "k1", "k2").distinct()
    return classed.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)


def removed_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(c1, c2, at, n_removed): for each content with lines of ``frequent`` their indexes and words."""
    c1, c2 = content_id(F.col("source"), F.col("text"))
    lines = docs.select("source", c1.alias("c1"), c2.alias("c2"), F.posexplode(_lines(text_of())).alias("at", "line"))
    lines = lines.select("c1", "c2", "at", _normal(F.col("line")).alias("norm"), "source").withColumn("key", _key(F.col("norm")))
    hit = lines.join(lookup(frequent.select("key")), "key").select("c1", "c2", "at", F.size(words_of(F.col("norm"))).alias("n"))
    once = hit.groupBy("c1", "c2", "at").agg(F.max("n").alias("n"))  # rows of equal content give the same lines
    return once.groupBy("c1", "c2").agg(F.collect_list("at").alias("at"), F.sum("n").alias("n_removed"))


def _depleted(n_words: Column, n_removed: Column) -> Column:
    gone = F.coalesce(n_removed, F.lit(0))
    return (gone > 0) & ((n_words - gone < MIN_WORDS) | (gone * 100 > n_words * MAX_REMOVED_PERCENT))


def line_frequency(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document: doc_id, the base figures, kept, and n_removed words in lines above the limit."""
    c1, c2 = content_id(F.col("source"), F.col("text"))
    docs = docs.select("doc_id", "source", "text")
    measured = base_metrics(docs.withColumns({"c1": c1, "c2": c2}), text_of()).drop("text", "source")
    found = measured.join(lookup(removed_lines(docs, frequent_lines(docs, max_docs)).drop("at")), ["c1", "c2"], "left")
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~_depleted(F.col("n_words"), F.col("n_removed"))).alias("kept"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
    )


def clean(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The kept documents, all their columns, boilerplate cut from ``text`` (and ``n_chars`` renewed)."""
    names = fresh(docs, "mr_c1", "mr_c2", "mr_cut", "mr_gone")
    k1, k2, at, gone = names
    c1, c2 = content_id(F.col("source"), F.col("text"))
    texts = docs.select("source", "text")
    removed = lookup(removed_lines(texts, frequent_lines(texts, max_docs))).toDF(*names)
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    plain = docs.withColumns({k1: c1, k2: c2})
    inner = plain.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(k1), F.col(k2))
    inner = base_metrics(inner, F.coalesce(F.col("row.text"), F.lit("")))
    inner = where_after(inner, ~F.col("base_failed")).drop(*measured[1:])
    found = inner.join(removed, [k1, k2], "left").where(~_depleted(F.col("n_words"), F.col(gone)))
    left = F.array_join(F.filter(_lines(F.col("row.text")), lambda x, i: ~F.array_contains(at, i)), "\n")
    text = F.when(F.col(at).isNull(), F.col("row.text")).otherwise(left)
    out = found.select(text.alias("t"), "row").select(*(F.col("t").alias(c) if c == "text" else F.length("t").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return out


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce(text, '') AS t, row_number() OVER () AS id FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM d),
win AS (SELECT id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT id, sum(least(5, i - last)) AS n FROM (SELECT id, i, coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), -9) AS last FROM dup) GROUP BY id),
base AS (SELECT w.id, doc_id, source, text, l, w, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.id = rep.id),
ln AS (SELECT id, source, unnest(range(1, len(l) + 1)) AS at, trim(regexp_replace(lower(unnest(l)), '[0-9]', '0', 'g'), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS norm FROM base),
text_line AS (SELECT DISTINCT t, ln.source, norm FROM ln JOIN d ON d.id = ln.id WHERE norm <> ''),
shared AS (SELECT source, norm FROM text_line GROUP BY source, norm HAVING count(*) > 20),
held AS (SELECT t, x.source, x.norm FROM text_line x JOIN shared s ON x.source IS NOT DISTINCT FROM s.source AND x.norm = s.norm),
cand AS (SELECT t, row_number() OVER (ORDER BY t) AS k, list_filter(regexp_split_to_array(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT t FROM held)),
sh AS (SELECT DISTINCT k, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM cand WHERE len(w) > 0)),
n_sh AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
met AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.k <> b.k GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n_sh x ON x.k = a JOIN n_sh y ON y.k = b WHERE met.n >= 0.8 * (x.n + y.n - met.n)),
reach AS (SELECT k AS a, k AS b FROM cand UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT cand.t, min(b) AS class FROM reach JOIN cand ON cand.k = reach.a GROUP BY cand.t),
freq AS (SELECT source, norm FROM held JOIN class ON class.t = held.t GROUP BY source, norm HAVING count(DISTINCT class) > 20),
gone AS (SELECT ln.id, sum(len(list_filter(regexp_split_to_array(ln.norm, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS n FROM ln JOIN freq ON ln.source IS NOT DISTINCT FROM freq.source AND ln.norm = freq.norm GROUP BY ln.id),
f AS (SELECT base.*, coalesce(gone.n, 0)::BIGINT AS n_removed, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base LEFT JOIN gone ON base.id = gone.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed > 0 AND (n_words - n_removed < 10 OR n_removed * 100 > n_words * 80)) AS kept, n_removed FROM f
"""
