"""PII: information-theoretic sanitisation (DataFrame operations only).

Base rules find e-mail addresses, IP addresses, card and phone numbers; each
distinct value is a protected entity.  A term is a word of at least three
characters in a document that holds an entity, lower-cased and without
punctuation at its ends.  Over the corpus, with N distinct documents, n(e) and
n(t) that hold entity and term, and n(t, e) that hold both,

    disclosure(t, e) = PMI(t; e) / IC(e)
                     = log(N n(t, e) / (n(t) n(e))) / log(N / n(e))

says how much of the entity's information the term gives away: 1 if the term
never occurs without it, 0 if the two are independent.  A term that is with an
entity in at least ``MIN_SUPPORT`` documents and discloses ``THRESHOLD`` or more
of it gives the entity away wherever it stands: each of its occurrences, in any
document, becomes a span of kind ``term`` and is generalised.

Documents are counted by content, and near copies (``near.classes``) as one:
N, n(e), n(t) and n(t, e) all count such classes, so neither thousands of copies
nor edited ones are witnesses.

Defined results: a null text is the empty text, without spans; equal texts get
equal spans; an empty table gives an empty result; a word that overlaps what a
base pattern matches (its valid matches and the others) is not a term; no value
of an entity is written to a checkpoint, only hashes and places; other columns are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import near
from millrace.llm.common import content_id, cut, fresh, lookup, table, text_of, where_after, words_of

KINDS = ("email", "ip", "card", "phone", "term")
MIN_SUPPORT = 3
THRESHOLD = 0.8

# A match can't begin inside a run of its first characters, unless the last match ended there; said so, and with
# possessive quantifiers, no text takes more than linear time or deep recursion.
_PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
_PLACE = "array<struct<s:int,k:int,e:int>>"
#: Numbers that are summed one after the other; sums of such blocks are summed in the same way.
_BLOCK = 256


def _gates(text: Column) -> tuple[Column, ...]:
    """What a text must have for a kind to be worth looking for; cheap, and implied by a match."""
    return F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.contains(text, F.lit("+"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(k: int, v: Column) -> Column:
    n = F.length(_digits(v))
    return (
        F.lit(True),
        v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        F.when((n >= 12) & (n <= 19), _luhn(_digits(v))).otherwise(False),
        (n >= 9) & (n <= 15),
    )[k]


def _sums(numbers: Column) -> Column:
    """Running sums; the array that aggregate() builds is copied at each step, so this is for short arrays."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out"))
    return F.aggregate(numbers, zero, step, lambda a: a["out"])


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(numbers: Column) -> Column:
    """Running sums of array<int>, in blocks."""

    def summed(own: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), _sums(F.transform(own, lambda x: F.element_at(x, -1))))
        return _let(before, lambda y: F.flatten(F.transform(own, lambda x, b: F.transform(x, lambda n: n + F.get(y, b)))))

    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda b: b * _BLOCK + 1)
    return F.when(F.size(numbers) > 0, _let(F.transform(starts, lambda a: _sums(F.slice(numbers, a, F.lit(_BLOCK)))), summed)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, k: int) -> Column:
    """Spans of kind k: the text between matches and the matches themselves give their places."""
    between, hits = F.split(text, _PATTERNS[k]), F.regexp_extract_all(text, F.lit(_PATTERNS[k]), F.lit(0))
    gaps = F.zip_with(between, hits, lambda b, h: F.struct(F.length(b).alias("gap"), h.alias("v")))

    def spans(parts: Column) -> Column:
        ends = _let(F.transform(parts, lambda x: x["gap"] + F.length(x["v"])), _running)
        return F.zip_with(parts, ends, lambda x, e: F.struct((e - F.length(x["v"])).alias("s"), F.lit(k).alias("k"), e.alias("e"), x["v"].alias("v")))

    return F.filter(_let(F.filter(gaps, lambda x: x["v"].isNotNull()), spans), lambda x: _valid(k, x["v"]))


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, v>> in order of start, then kind."""
    kinds = [F.when(gate, _matches(text, k)).otherwise(F.array().cast(_SPAN)) for k, gate in enumerate(_gates(text))]
    return F.sort_array(F.concat(*kinds))


def places(spans: Column) -> Column:
    """The spans without their values."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).cast(_PLACE)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def _masked(rows: DataFrame, name: str) -> DataFrame:
    """Every base match in the column, failing ones too, as blanks of its length; a projection for each kind keeps the expressions small."""
    for k, pattern in enumerate(_PATTERNS):
        text = F.col(name)
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        blank = F.zip_with(F.split(text, pattern), hits, lambda b, h: F.concat(b, F.coalesce(F.repeat(F.lit(" "), F.length(h)), F.lit(""))))
        rows = rows.withColumn(name, F.when(_gates(text)[k], F.array_join(blank, "")).otherwise(text))
    # no filter is moved below a generator; below these projections it would hold their expressions many times over
    return rows.withColumn(name, F.explode(F.array(name)))


def _term(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(_PUNCTUATION))


def _words(docs: DataFrame) -> DataFrame:
    """(c1, c2, ents, m): each distinct text, hashes of its entities, and the text, masked where it has some."""
    c1, c2 = content_id(F.col("t"))
    rows = docs.select(text_of().alias("t")).withColumn("spans", base_spans(F.col("t")))
    ents = F.array_distinct(F.transform("spans", lambda x: F.xxhash64(x["k"], F.lower(x["v"]))))
    return rows.select(c1.alias("c1"), c2.alias("c2"), ents.alias("ents"), F.col("t").alias("m"))


def _terms(rows: DataFrame) -> DataFrame:
    """(c1, c2, term): the distinct terms of each row's text ``m``, as hashes."""
    hashes = F.array_distinct(F.transform(F.filter(F.transform(words_of(F.col("m")), _term), lambda x: F.length(x) >= 3), lambda x: F.xxhash64(x)))
    return rows.select("c1", "c2", hashes.alias("terms")).select("c1", "c2", F.explode("terms").alias("term"))


def _classes_with(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, k1, k2), once each: the classes of documents that hold the key."""
    return near.with_classes(rows.select(key, "c1", "c2"), found).select(key, "k1", "k2").distinct()


def _n_t(terms: DataFrame, contents: DataFrame, found: DataFrame) -> DataFrame:
    """(term, n_t): the classes that hold each term of (c1, c2, term).

    A text that has no copy of any kind is a class of its own: its terms are
    counted where they are, in partial sums.  Only those of texts with copies
    are shuffled with their class, so that each class counts once.
    """
    one, two = F.lit(1).cast("long"), F.count(F.lit(1))
    several = near.with_classes(contents.where("n_rows > 1").select("c1", "c2").unionByName(found.select("c1", "c2")).distinct(), found)
    side = lookup(several.toDF("d1", "d2", "k1", "k2"))
    tagged = terms.join(side, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")), "left")
    # one aggregate for both: a text on its own has the class null, whose rows are all counted
    by_class = tagged.groupBy("term", "k1", "k2").agg(two.alias("n"))
    counted = by_class.select("term", F.when(F.col("k1").isNull(), F.col("n")).otherwise(one).alias("n"))
    return counted.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(ent, term, disclosure) of the terms at or above the threshold.

    A pair has n(t, e) <= min(n(t), n(e)), so only entities and terms in
    ``MIN_SUPPORT`` documents, and terms with log(N / n(t)) >= THRESHOLD log(N / n(e)),
    can reach the threshold; the others are left out before pairs are made.
    """
    every = _words(docs)
    contents = cut(every.select("c1", "c2", "ents").groupBy("c1", "c2").agg(F.first("ents").alias("ents"), F.count(F.lit(1)).alias("n_rows")))
    found = near.classes(near.texts_of(docs))
    in_classes, n_classes = found.agg(F.count(F.lit(1)), F.count_distinct("k1", "k2")).first()
    n = float(contents.count() - in_classes + n_classes)
    held = contents.select("c1", "c2", F.explode("ents").alias("ent"))
    by_class = _classes_with(held, "ent", found)
    n_e = lookup(by_class.groupBy("ent").agg(F.count(F.lit(1)).alias("n_e")).where((F.col("n_e") >= MIN_SUPPORT) & (F.col("n_e") < n)))
    held = cut(held.join(n_e, "ent"))
    some = _masked(every.where(F.size("ents") > 0), "m")
    plain = every.where(F.size("ents") == 0)
    close = cut(_terms(some.join(lookup(held.select("c1", "c2").distinct()), ["c1", "c2"])).distinct())
    most = held.agg(F.max("n_e")).first()[0] or 0
    # a hair below the threshold, so that rounding leaves out no term that the value itself would keep
    rare = lambda c: F.log2(F.lit(n) / F.col(c)) >= (THRESHOLD - 1e-9) * F.log2(F.lit(n) / F.lit(float(max(most, 1))))
    # a term that is too frequent in the documents with entities is so in all: common words are not counted any further
    by_term = _classes_with(close, "term", found).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    many = lookup(by_term.where((F.col("n") >= MIN_SUPPORT) & rare("n")).select("term"))
    n_t = lookup(_n_t(_terms(some.unionByName(plain)).join(many, "term"), contents, found).where(rare("n_t")))
    content = F.log2(F.lit(n) / F.col("n_e"))
    pairs = close.join(n_t, "term").join(held, ["c1", "c2"])
    pairs = pairs.where(F.log2(F.lit(n) / F.col("n_t")) >= (THRESHOLD - 1e-9) * content)
    witnesses = near.with_classes(pairs, found).select("ent", "term", "n_e", "n_t", "k1", "k2").distinct()
    known = witnesses.groupBy("ent", "term").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")).where(F.col("n_te") >= MIN_SUPPORT)
    value = F.log2(F.lit(n) * F.col("n_te") / F.col("n_t") / F.col("n_e")) / content
    return known.select("ent", "term", value.alias("disclosure")).where(F.col("disclosure") >= THRESHOLD)


def term_spans(docs: DataFrame) -> DataFrame:
    """(c1, c2, terms): the places of the terms in each distinct text that has some."""
    terms = lookup(disclosing(docs).select("term").distinct())
    if terms.isEmpty():  # nothing to look for
        return docs.sparkSession.createDataFrame([], f"c1 long, c2 long, terms {_PLACE}")
    by_text = _terms(_words(docs)).join(terms, "term").groupBy("c1", "c2").agg(F.collect_set("term").alias("wanted"))
    rows = _words(docs).join(lookup(by_text), ["c1", "c2"]).select("c1", "c2", "wanted", "m")
    word = r"[^\x20\x09-\x0D]++"
    rows = _masked(rows, "m").select("c1", "c2", "wanted", F.split("m", word).alias("gaps"), F.regexp_extract_all("m", F.lit(word), F.lit(0)).alias("words"))
    parts = F.filter(F.arrays_zip("gaps", "words"), lambda x: x["words"].isNotNull())
    rows = rows.select("c1", "c2", "wanted", F.posexplode(parts).alias("at", "x")).select("c1", "c2", "wanted", "at", F.length("x.gaps").alias("gap"), F.col("x.words").alias("v"))
    rows = rows.dropDuplicates(["c1", "c2", "at"])
    before = Window.partitionBy("c1", "c2").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("e", F.sum(F.col("gap") + F.length("v")).over(before).cast("int"))
    rows = where_after(rows.withColumn("term", F.xxhash64(_term(F.col("v")))), F.array_contains("wanted", F.col("term")))
    span = F.struct((F.col("e") - F.length("v")).alias("s"), F.lit(KINDS.index("term")).alias("k"), F.col("e"))
    return lookup(rows.groupBy("c1", "c2").agg(F.collect_list(span).alias("terms")))


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    terms = term_spans(docs.select("text"))
    c1, c2 = content_id(F.col("t"))
    rows = docs.select("doc_id", text_of().alias("t")).select("doc_id", c1.alias("c1"), c2.alias("c2"), places(base_spans(F.col("t"))).alias("base"))
    out = cut(rows).join(terms, ["c1", "c2"], "left")
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:-1])]
    every = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "terms")))
    return out.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term")
    )


def _replaced(text: Column, spans: Column) -> Column:
    """Each span as its kind in brackets; of overlapping spans the first speaks for all."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        free = x["s"] >= a["at"]
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.get(names, x["k"]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.coalesce(F.when(free, new).otherwise(a["out"]), F.lit("")).alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` generalised (and ``n_chars`` renewed); all rows and columns stay."""
    k1, k2, terms, base = fresh(docs, "mr_c1", "mr_c2", "mr_terms", "mr_base")
    found = term_spans(docs.select("text")).toDF(k1, k2, terms)
    c1, c2 = content_id(text_of())
    rows = docs.withColumns({k1: c1, k2: c2, base: places(base_spans(text_of()))}).join(found, [k1, k2], "left")
    spans = F.when(F.col(terms).isNull(), F.col(base)).otherwise(F.sort_array(F.concat(base, terms)))
    rows = rows.withColumn(base, spans)
    text = F.when(F.size(base) > 0, _replaced(F.col("text"), F.col(base))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(base) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
