"""Language ID: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters.  The script of its first letter, by code-point
range, leaves only the languages that were seen in that script; each of those
scores the word by the log-probabilities of its letter trigrams (with word
ends).  Viterbi over these words, at a penalty for each change of language,
labels spans.  A word in a script that no language was seen in is evidence for
none: it takes no part, and is a span ``und`` with others like it.  The
document's language is the one whose spans have most letters, and its score is
their share of all its letters.  Texts are scored in parts of ``CHUNK``
characters, which bounds the memory taken; a word may go on over parts.

Training counts trigrams and scripts for each language on a bounded sample of
labelled rows: with n rows of a language, those whose hash is 0 modulo
ceil(n / ``SAMPLE_DOCS``).  Every language is learned.  The model is a table of
``BUCKETS`` hashed trigrams by language, 256 KiB for each, and is broadcast.

Most documents are of one language, and for those Viterbi is not run: the
constant path is the answer if no stretch of words favours another language by
the penalty, nor do the best beginning and the best end together.  An excursion
through k other languages then gains less than k penalties and pays k at least;
a path that never comes to the language gains less than k - 1 and pays k - 1.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if
nothing could be learned; a text with letters, but only in unseen scripts, gets
the first language with score 0; ties go to the language first in code-point order; equal texts get
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import lookup, table

#: Labelled documents a language that training reads, about.
SAMPLE_DOCS = 4000
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Log-odds that a change of language costs.
PENALTY = 12.0
#: Share of a language's letters in a script from which words in that script may be of the language.
SCRIPT_SHARE = 0.01
#: Log-odds against a language that is not written in a word's script.
UNLIKELY = 1e4
#: Characters that are scored at a time, about.
CHUNK = 1 << 19

#: First code points of ranges, each up to the next; 0 is no script of its own (other letters).
_RANGES = (
    (0x0, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x750, 6), (0x780, 0), (0x8A0, 6), (0x900, 7), (0x980, 8),
    (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13), (0xC80, 14), (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18), (0xF00, 19), (0x1000, 20),
    (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x1380, 0), (0x1780, 24), (0x1800, 0), (0x1C80, 3), (0x1C90, 21), (0x1CC0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x2C60, 1), (0x2C80, 0), (0x3040, 25), (0x30A0, 25), (0x3100, 0), (0x3130, 22), (0x3190, 0), (0x31F0, 25), (0x3200, 0), (0x3400, 26), (0xA000, 0), (0xA640, 3), (0xA6A0, 0),
    (0xA720, 1), (0xA800, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 26), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF66, 25), (0xFFA0, 22), (0xFFE0, 0), (0x20000, 26), (0x32000, 0),
)
SCRIPTS = 27


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or 0, and the script; the ranges' starts."""
    folded = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            folded[i] = ord(low) if len(low) == 1 else i
    starts = np.array([a for a, _ in _RANGES])
    script = np.array([s for _, s in _RANGES], dtype=np.int8)
    return folded, script[np.searchsorted(starts, np.arange(0x110000), side="right") - 1], starts


def _letters(text: str, before: str = "", after: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text between two characters: the letters' positions, their trigrams' buckets, their scripts, and which of the letters begin a word."""
    folded, scripts, _ = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = np.zeros(len(points) + 2, dtype=np.uint64)
    low[1:-1] = folded[points]
    low[0], low[-1] = folded[ord(before or " ")], folded[ord(after or " ")]
    at = np.flatnonzero(low[1:-1])
    a, b, c = low[at], low[at + 1], low[at + 2]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
    bucket = ((mixed ^ (mixed >> np.uint64(9))) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return at, bucket, scripts[points[at]], a == 0


def pieces(text: str) -> Iterator[tuple[int, str, str, str]]:
    """The text in parts of CHUNK characters: the place of each, the part, and the characters before and after it."""
    for start in range(0, max(1, len(text)), CHUNK):
        yield start, text[start : start + CHUNK], text[start - 1 : start] if start else "", text[start + CHUNK : start + CHUNK + 1]


class Model:
    """Languages in code-point order, log-probabilities float32[BUCKETS, languages], and scripts allowed bool[SCRIPTS, languages]."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.langs = sorted(counts)
        grams = np.zeros((BUCKETS, len(self.langs)))
        seen = np.zeros((SCRIPTS, len(self.langs)))
        for k, lang in enumerate(self.langs):
            for at, n in counts[lang].items():
                (seen if at >= BUCKETS else grams)[at - BUCKETS if at >= BUCKETS else at, k] = n
        self.logs = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
        self.allowed = (seen > 0) & (seen >= SCRIPT_SHARE * seen.sum(axis=0))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its first position, its letters, its scores float64[words, languages], and whether some language has its script."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for start, *part in pieces(text):
            at, bucket, script, begins = _letters(*part)
            if not len(at):
                continue
            goes_on = not begins[0]  # a word of the part before
            first = np.flatnonzero(begins) if not goes_on else np.concatenate([[0], np.flatnonzero(begins)])
            scores = np.add.reduceat(self.logs[bucket], first, axis=0).astype(np.float64)
            n, place, script = np.diff(np.append(first, len(at))), at[first] + start, script[first]
            if goes_on:
                found[-1][1][-1] += n[0]
                found[-1][2][-1] += scores[0]
                n, place, script, scores = n[1:], place[1:], script[1:], scores[1:]
            if len(n):
                found.append((place, n, scores, script))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros((0, len(self.langs))), none.astype(bool)
        place, n, scores, script = found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))
        allowed = self.allowed[script]
        known = allowed.any(axis=1)
        scores -= UNLIKELY * (~allowed & known[:, None])
        return place, n, scores, known

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word."""
        n, k = scores.shape
        best = int(np.argmax(scores.sum(axis=0)))
        if k == 1:
            return np.zeros(n, dtype=np.int64)
        gain = np.zeros((n + 1, k))
        np.cumsum(scores - scores[:, best : best + 1], axis=0, out=gain[1:])
        if (gain - np.minimum.accumulate(gain, axis=0)).max() < PENALTY and gain.max() + (gain[-1] - gain).max() < PENALTY:
            return np.full(n, best)
        return viterbi(scores)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    n, k = scores.shape
    back = np.zeros((n, k), dtype=np.int32)
    every = list(range(k))
    total = scores[0].tolist()
    for i, row in enumerate(scores[1:].tolist(), 1):
        top = max(every, key=total.__getitem__)
        least = total[top] - penalty
        for j in every:
            if total[j] >= least:
                back[i, j], total[j] = j, total[j] + row[j]
            else:
                back[i, j], total[j] = top, least + row[j]
    out = np.zeros(n, dtype=np.int64)
    j = max(every, key=total.__getitem__)
    for i in range(n - 1, -1, -1):
        out[i] = j
        j = back[i, j]
    return out


def train(labelled: DataFrame) -> Model:
    """labelled: text, lang and doc_id (for the choice of the sample only), none of them null."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("l"), F.ceil(F.col("n") / SAMPLE_DOCS).alias("every"))
    chosen = labelled.join(lookup(sizes), F.col("lang") == F.col("l")).where(F.pmod(F.xxhash64("doc_id"), F.col("every")) == 0).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for lang, own in rows.groupby("lang")["text"]:
                sums = np.zeros(BUCKETS + SCRIPTS, dtype=np.int64)
                for part in (part for text in own for _, *part in pieces(text)):
                    _, bucket, script, _ = _letters(*part)
                    sums[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(script, minlength=SCRIPTS)
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "at": at, "n": sums[at]})

    counted = chosen.mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n"))
    counts: dict[str, dict[int, int]] = {}
    for lang, at, n in counted.toLocalIterator():  # at most BUCKETS + SCRIPTS rows a language
        counts.setdefault(lang, {})[at] = n
    return Model(counts)


def label(model: Model, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
    """lang_pred, score and the spans (start, end, language) of one text."""
    if not model.langs:
        return "und", 0.0, []
    first, letters, scores, known = model.words(text or "")
    if not len(first):
        return "und", 0.0, []
    path = np.full(len(first), -1)
    if known.any():
        path[known] = model.path(scores[known])
    share = np.bincount(path[known], weights=letters[known], minlength=len(model.langs))
    top = int(np.argmax(share))
    change = np.flatnonzero(np.diff(path, prepend=-2))
    ends = np.append(change[1:] - 1, len(path) - 1)
    spans = [(int(first[a]), int(first[b] + letters[b]), model.langs[path[a]] if path[a] >= 0 else "und") for a, b in zip(change, ends)]
    return model.langs[top], float(share[top] / letters.sum()), spans


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and held_out of ``docs`` with lang_pred, score, n_spans and spans (array of start, end, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            found = [label(shared.value, t) for t in rows["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "held_out": rows["held_out"],
                    "lang_pred": [x[0] for x in found],
                    "score": [x[1] for x in found],
                    "n_spans": [len(x[2]) for x in found],
                    "spans": [[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found],
                }
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")
    out = rows.mapInPandas(score, "doc_id string, held_out boolean, lang_pred string, score double, n_spans int, spans array<struct<start:int,end:int,lang:string>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def held_out(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, held_out: crc32 of the doc_id as text leaves 1 modulo 3 (false for a null doc_id)."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(rest == 1, F.lit(False)).alias("held_out"))


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(table(spark, sf_dir, "documents"))
    model = train(docs.where("NOT held_out AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"], x["lang"])), ",")
    return identify(docs.drop("lang"), model).withColumn("spans", spans)
