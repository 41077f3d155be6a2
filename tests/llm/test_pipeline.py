"""The registered queries on whole small tables, and the pipeline against a brute-force version of all its stages."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from test_pii import slow as slow_pii
from test_quality import base
from test_simhash import groups, shingles

import corpus_pipeline
from millrace.llm import packing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rng = random.Random(11)
    vocabulary = [f"w{i}" + "x" * (i % 9) for i in range(4000)]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(4, 12))) for _ in range(rng.randrange(1, 9))]
        if i % 3 == 0:
            lines.append("Licensed to all, version 2")
        if i % 10 == 0:
            lines.append(f"mail user{i}@corp{i}.com or +1 (269) 555-{1000 + i} about it all")
        rows.append((i, "\n".join(lines), "en", f"src{i % 2}"))
    for k in range(40):
        i, text, lang, _ = rows[rng.randrange(60)]
        rows.append((200 + k, text if k % 2 else text.replace(" ", "  ", 1), lang, "src1"))
    rows += [(300, None, None, None), (301, "", "en", "src0"), (302, "same " * 50, "en", "src0"), (5, rows[5][1], "en", "src1"), (None, rows[7][1], "en", "src1")]
    return rows


def quality(rows):
    line = lambda x: re.sub("[0-9]", "0", x.lower()).strip(" \t\x0b\x0c\r")
    texts = list(dict.fromkeys(r[1] or "" for r in rows))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    named = dict(zip(texts, root))
    held = defaultdict(set)
    for _, text, _, source in rows:
        for x in {line(x) for x in (text or "").split("\n")} - {""}:
            held[source, x].add(named[text or ""])
    frequent = {k for k, v in held.items() if len(v) > 20}
    out = []
    for i, text, lang, source in rows:
        n_words, *_, failed = base(text)
        cut = [x for x in (text or "").split("\n") if (source, line(x)) in frequent]
        gone = sum(len(WORD.findall(x)) for x in cut)
        if not failed and not (gone and (n_words - gone < 10 or gone * 100 > n_words * 80)):
            out.append((i, "\n".join(x for x in text.split("\n") if (source, line(x)) not in frequent), lang, source))
    return out


def dedup(rows):
    return [min((rows[k] for k in own), key=lambda r: (r[0] is None, r[0])) for own in groups([(k, r[1]) for k, r in enumerate(rows)])]


def pii(rows):
    out = []
    for i, text, lang, source in rows:
        spans = [s.split(":") for s in slow_pii(text)[5].split(",") if s]
        new, at = "", 0
        for kind, a, b in spans:
            if int(a) >= at:
                new += text[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        out.append((i, new + text[at:], lang, source))
    return out


def mixing(rows):
    size = {r: len(WORD.findall(r[1])) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r]
    order = sorted(total)
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        left, share = sum(total.values()) - sum(3 * total[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * total[s] if s in capped else left * weight[s] / share for s in order}
        over = {s for s in order if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = Counter()
    for s in order:
        own, words = [r for r in rows if r[3] == s], Counter()
        for r in own:
            words[size[r].bit_length()] += size[r]
        kappa, top = 0.0, -1
        for c in sorted(words, reverse=True):
            above, below = sum(w for k, w in words.items() if k > c), sum(k * w for k, w in words.items() if k <= c)
            if (target[s] - 3.0 * above) / below * c <= 3:
                kappa, top = (target[s] - 3.0 * above) / below, c
                break
        u, missing = {}, target[s]
        for r in own:
            c = size[r].bit_length()
            copies = 3.0 if c > top else kappa * c
            out[r] += int(copies)
            missing -= int(copies) * size[r]
            f = copies - int(copies)
            name = f"millrace-mix|{'' if r[0] is None else r[0]}|{hashlib.md5(r[1].encode()).hexdigest()}|1"
            x = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if f:
                u[r] = (x / (1 - x)) / (f / (1 - f))
        after = []
        for r in sorted(u, key=u.get):
            if not after and size[r] <= missing:
                out[r] += 1
                missing -= size[r]
            else:
                after.append(r)
        near = min(((abs(size[r] - missing), u[r], k) for k, r in enumerate(after) if abs(size[r] - missing) < missing), default=None)
        if near:
            out[after[near[2]]] += 1
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(*r, None if r[1] is None else len(r[1])) for r in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "http://a.com/de/", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def test_pipeline(spark, tables):
    want = mixing(pii(dedup(quality(documents()))))
    out = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter({(i, len(WORD.findall(t))): n for (i, t, _, _), n in want.items() if n})
    lengths = Counter(len(WORD.findall(t)) for (_, t, _, _), n in want.items() for _ in range(n))
    known = sorted(lengths)
    ends = packing.boundaries(known, [lengths[n] for n in known], packing.BUCKETS)
    assert {r.bucket_length for r in out} == {known[e] for e in ends}


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, tables)
        assert docs.columns == before.columns
        assert [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]


def test_empty_pipeline(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_cover_their_tables(spark, tables, name):
    n = queries.queries()[name](spark, tables).count()
    assert n == {"op1_chat_snapshots": 1, "op2_url_filter": 2, "op6_line_blocks": 2}.get(name, len(documents()))
