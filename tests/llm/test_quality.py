import re
from collections import Counter

import pytest

from millrace.llm import common, near, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), failed


TEXTS = [
    None,
    "",
    " \n\t ",
    "a b c d e a b c d e",
    "a a a a a a a a a a a a",
    "one two three four five six seven eight nine ten\neleven\neleven\n\n  \n",
    "#x* $y% &z| <b> " * 3,
    "é ü ñ 漢字 𝒳\x0bw\x0cv\x85u t",
    " ".join(f"w{i}" for i in range(30_000)),
    "\n".join("w%d again and again here" % (i % 7) for i in range(3000)),
]


def test_base_figures(docs):
    rows = quality.line_frequency(docs([(i, t) for i, t in enumerate(TEXTS)])).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


def body(i):
    return "\n".join(" ".join(f"word{i}x{j}y{k}" for k in range(8)) for j in range(3))


def test_boilerplate_goes_and_depleted_documents_are_rejected(docs):
    license_ = "This work is Licensed under the public terms 4.0"
    rows = [(i, body(i) + "\n" + license_) for i in range(30)]
    rows += [(100 + i, "\n".join([license_] * 3) + f"\nonly this {i}") for i in range(5)]
    out = {r.doc_id: r for r in quality.line_frequency(docs(rows)).collect()}
    assert all(out[i].kept and out[i].n_removed == 9 for i in range(30))
    assert not any(out[100 + i].kept for i in range(5))
    kept = {r.doc_id: r.text for r in quality.clean(docs(rows)).collect()}
    assert kept == {i: body(i) for i in range(30)}


def test_a_line_is_counted_by_host(docs):
    rows = [(i, body(i) + "\nthe same line everywhere", "en", f"host{i}") for i in range(30)]
    assert all(r.n_removed == 0 for r in quality.line_frequency(docs(rows)).collect())


def long_body(i):
    return "\n".join(" ".join(f"word{i}x{j}y{k}" for k in range(8)) for j in range(20))


def edited(i):
    """One word of the long body changed: a similarity of 0.938 to it."""
    return long_body(7).replace(f"word7x{i % 20}y{i % 8} ", f"v{i} ")


def test_copies_do_not_make_boilerplate(docs):
    rows = [(i, long_body(7)) for i in range(40)] + [(100 + i, edited(i)) for i in range(40)]
    assert all(r.kept and r.n_removed == 0 for r in quality.line_frequency(docs(rows)).collect())


@pytest.mark.parametrize("footer", ["all rights kept by us", "all rights kept by https://www.example.com/terms-of-service.html"])
def test_a_footer_is_cut_whatever_its_words(docs, footer):
    lettered = lambda t: t.translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  # digits are all one to a line
    out = quality.line_frequency(docs([(i, lettered(body(i)) + "\n" + footer) for i in range(200)])).collect()
    assert {r.n_removed for r in out} == {len(footer.split())}


def test_a_footer_with_the_longest_words_goes(docs):
    footer = "More at https://news.example.com/subscribe/newsletter\nor https://news.example.com/subscribe/by/letter"
    rows = [(i, body(i) + "\n" + footer) for i in range(30)]
    assert {r.doc_id: r.text for r in quality.clean(docs(rows)).collect()} == {i: body(i) for i in range(30)}


def test_copies_of_one_document_do_not_save_a_footer(docs):
    rows = [(i, body(min(i, 28)) + "\nthe same line everywhere") for i in range(128)]
    assert {r.doc_id: r.text for r in quality.clean(docs(rows)).collect()} == {i: body(min(i, 28)) for i in range(128)}


def test_documents_with_one_longest_word_are_told_apart(docs):
    text = lambda i: body(i) + "\nincomprehensibilities"
    rows = [(i, text(i) + "\nthe same line everywhere") for i in range(30)]
    assert all("everywhere" not in r.text for r in quality.clean(docs(rows)).collect())


def test_near_copies_do_not_make_boilerplate_of_their_text(docs):
    rows = [(i, edited(i)) for i in range(40)]
    assert all(r.kept and r.n_removed == 0 for r in quality.line_frequency(docs(rows)).collect())
    assert {r.doc_id: r.text for r in quality.clean(docs(rows)).collect()} == dict(rows)


def test_shingles_are_shuffled_twice_only(spark, docs, monkeypatch):
    words = [[f"w{i}x{k * k % 997}" for k in range(1500)] for i in range(60)]
    texts = [" ".join(w[:200] + [f"v{j}"] + w[201:]) for w in words for j in range(2)]
    # ids are broadcast, shingles are not
    monkeypatch.setattr(common.lookup, "__defaults__", (1 << 16,))
    monkeypatch.setattr(common.measured, "__defaults__", (1 << 16,))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    context = spark.sparkContext
    rows = common.cut(near.texts_of(docs(list(enumerate(texts)))))
    context.setJobGroup("shingles", "")
    try:
        found = near.pairs(rows).collect()
        assert len({frozenset(r) for r in found}) == 60
        tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
        stages = {k for job in tracker.getJobIdsForGroup("shingles") for k in tracker.getJobInfo(job).stageIds}
        written = sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in stages)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # each text's once, and once more for each comparison and each text compared with
    each = 8 * 1497
    assert written < 0.9 * each * (len(texts) + len(found) + len({r.b for r in found}))


def test_repeated_and_null_rows(docs):
    rows = [(None, body(1), None, None), (None, body(1), None, None), (1, None, None, None), (1, body(2))]
    out = quality.line_frequency(docs(rows)).collect()
    assert sorted((r.doc_id is None, r.n_words, r.kept) for r in out) == [(False, 0, False), (False, 24, True), (True, 24, True), (True, 24, True)]
    assert quality.clean(docs(rows)).count() == 3


@pytest.mark.parametrize("f", [quality.line_frequency, quality.clean])
def test_empty(docs, f):
    assert f(docs([])).collect() == []


def test_columns_stay(docs):
    d = docs([(1, body(1))])
    out = quality.clean(d)
    assert out.columns == d.columns and out.collect() == d.collect()
