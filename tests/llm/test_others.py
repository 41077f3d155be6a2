"""op1 to op4, op6, op8 and op9."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from html import unescape
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat, langid, line_blocks, media, mixing, packing, urls

# op1


def slow_chat(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role, text))
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    none_first = lambda t: tuple((x is not None, x if x is not None else 0) for x in (t[0], t[1], md5(t[2])))
    conv = {c: tuple((r, t) for _, r, t in sorted(x, key=none_first)) for c, x in by.items()}
    out = Counter()
    for whole in set(conv.values()):
        if any(len(o) > len(whole) and o[: len(whole)] == whole for o in conv.values()):
            continue
        ids = [c for c, w in conv.items() if w == whole]
        known = [c for c in ids if c is not None]
        text = "".join(f"<|{'unknown' if r is None else r}|>\n{t or ''}\n<|end|>\n" for r, t in whole)
        out[(min(known) if known else None, len(whole), len(ids), len(text), text)] += 1
    return out


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "2 AS p1", "'x' AS last")


def test_chat(spark):
    rng, rows = random.Random(4), []
    for c in range(60):
        n, base = rng.randrange(1, 6), rng.randrange(4)
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"{base} {k}" if k < 3 or rng.random() < 0.7 else f"{c}") for k in range(n)]
    rows += [(100, 0, None, None), (101, 0, "user", None), (102, 0, "user", ""), (None, 0, "user", "q"), (None, 1, None, "q"), (103, None, "user", "n"), (103, None, "user", "n"), (104, 0, "user", "x" * 300_000)]
    got = Counter(tuple(r) for r in chat.collapse(turns(spark, rows)).collect())
    assert got == slow_chat(rows)
    assert chat.collapse(turns(spark, [])).collect() == []


def test_snapshots_collapse(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(1, 200) for k in range(min(c, 20))]
    (one,) = chat.collapse(turns(spark, rows)).collect()
    assert (one.conv_id, one.n_turns, one.n_equal) == (20, 20, 180)


# op2


def slow_verdict(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:k].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[k:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict
    site = host.rsplit(":", 1)[0] if host.rsplit(":", 1)[-1].isdigit() and ":" in host else host
    site = site.removeprefix("www.")
    page = site + (path.rstrip("/") or "/")
    sites = [x[:-1] for x in listed if x.index("/") == len(x) - 1]
    hit = page in listed or any(site == x or site.endswith("." + x) for x in sites)
    return host, path, None, "block" if host and hit else "allow"


URLS = [None, "", "no host", "http://", "http://A.example.ORG/es/x?q", "https://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#a", "ftp://m.bad.net/a?b", "http://bad.net:80/a/b/",
        "http://www.bad.net", "http://good.net/page/", "http://good.net/page?x=1", "http://good.net/pages", "http://a.b.c.deep.net/x", "http://q.a.b.c.deep.net/x", "x://y://z.net/", "http://a.b.c.d.e.f.g.h.i.bad.net/x", "http://one.top/x", "http://bad.net.top/", "http://xbad.net/", "http://z.net?http://bad.net", "http://" + "a." * 20_000 + "bad.net/"]
LISTED = {"bad.net/", "good.net/page", "deep.net/", "top/"}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[4], "x")], "page_id long, url string, hits string")
    listed = spark.createDataFrame([("http://BAD.net",), ("http://good.net/page/",), ("https://www.deep.net/",), ("x://top",), (None,)], "url string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed).collect())
    assert got == Counter([(i, *slow_verdict(u, LISTED)) for i, u in enumerate(URLS)] + [(0, *slow_verdict(URLS[4], LISTED))])
    assert urls.judge(pages.limit(0), listed).collect() == []
    assert {r.verdict for r in urls.judge(pages, listed.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_a_full_filter_changes_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BLOCKS", 1)  # everything is a possible hit
    pages = spark.createDataFrame([(i, f"http://site{i}.net/p") for i in range(400)], "page_id long, url string")
    listed = spark.createDataFrame([(f"http://site{i}.net/",) for i in range(0, 400, 2)], "url string")
    assert {r.page_id for r in urls.judge(pages, listed).where("verdict = 'block'").collect()} == set(range(0, 400, 2))


# op3


def waste(longest, counts, totals, ends):
    out, a = 0, 0
    for e in ends:
        out += longest[e] * sum(counts[a : e + 1]) - sum(totals[a : e + 1])
        a = e + 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 9)), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(bins, buckets):
    lengths = np.cumsum([b[0] for b in bins]).tolist()
    counts = [b[1] for b in bins]
    totals = [n * c for n, c in zip(lengths, counts)]
    ends = packing.boundaries(lengths, counts, buckets)
    m = len(bins)
    best = min(waste(lengths, counts, totals, [*c, m - 1]) for k in range(min(buckets, m)) for c in combinations(range(m - 1), k))
    assert ends[-1] == m - 1 and len(ends) <= buckets and waste(lengths, counts, totals, ends) == best


def test_boundaries_of_many_lengths():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(60_000, 2500, replace=False) + 1)
    counts = rng.integers(1, 2000, 2500)
    n, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.concatenate([[0.0], np.full(2500, np.inf)])
    for _ in range(16):  # every start of every bucket
        best = np.array([np.inf, *((best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])).min() for j in range(1, 2501))])
    ends = packing.boundaries(lengths.tolist(), counts.tolist(), 16)
    assert waste(lengths.tolist(), counts.tolist(), (counts * lengths).tolist(), ends) == best[-1]


def test_packing(docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice((3, 40, 41, 900, 5000))))) for i in range(400)] + [(None, None), (1000, ""), (7, "same text"), (7, "same text"), (2000, "w " * 50_000)]
    out = packing.pack(docs(rows), buckets=4, budget=8192).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert Counter(r.n_tokens for r in out) == Counter(len((t or "").split()) for _, t in rows)
    batches = defaultdict(list)
    for r in out:
        assert r.n_tokens + r.n_pad == r.bucket_length and r.n_pad >= 0
        batches[(r.bucket, r.batch)].append(r)
    for (bucket, batch), own in batches.items():
        size = max(1, 8192 // max(1, own[0].bucket_length))
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= size
        assert len(own) == size or (bucket, batch + 1) not in batches
    assert packing.pack(docs([])).collect() == []


# op4

ENGLISH, FRENCH, GREEK = "the house and the thing with that water", "le maison et la chose avec cette eau où été", "το σπίτι και το νερό με αυτό"


def model(spark, docs):
    rows = [(i, " ".join(random.Random(i).choices(t.split(), k=40)), lang) for i in range(30) for lang, t in (("en", ENGLISH), ("fr", FRENCH), ("el", GREEK))]
    return langid.train(docs(rows).select("doc_id", "text", "lang"))


def test_languages(spark, docs):
    m = model(spark, docs)
    assert m.langs == ["el", "en", "fr"]
    text = ENGLISH + ". " + " ".join(FRENCH.split() * 2) + " " + GREEK
    lang, score, spans = langid.label(m, text)
    assert [s[2] for s in spans] == ["en", "fr", "el"] and lang == "fr" and 0.3 < score < 0.8
    assert text[spans[0][0] : spans[0][1]] == ENGLISH
    for none in (None, "", "123 --", "\x00"):
        assert langid.label(m, none) == ("und", 0.0, [])
    assert langid.label(langid.Model({}), "text")[0] == "und"
    rows = [(1, ENGLISH), (1, ENGLISH), (None, None), (2, "the water " * 40_000), (3, text)]
    got = sorted((r.doc_id or -1, r.lang_pred, r.n_spans) for r in langid.identify(langid.held_out(docs(rows)), m).collect())
    assert got == [(-1, "und", 0), (1, "en", 1), (1, "en", 1), (2, "en", 1), (3, "fr", 3)]
    assert langid.identify(langid.held_out(docs([])), m).collect() == []
    assert {r.doc_id: r.held_out for r in langid.held_out(docs(rows)).collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 if i else False for i in (1, None, 2, 3)}


def test_long_texts_are_scored_in_parts(spark, docs, monkeypatch):
    m = model(spark, docs)
    text = f"{ENGLISH}. {FRENCH} {GREEK}, " * 30
    whole = langid.label(m, text)
    monkeypatch.setattr(langid, "CHUNK", 40)
    assert langid.label(m, text) == whole


def test_unseen_scripts_are_evidence_for_none(spark, docs):
    m = langid.train(docs([(i, ENGLISH, "en") for i in range(9)] + [(20 + i, FRENCH, "fr") for i in range(9)]).select("doc_id", "text", "lang"))
    assert langid.label(m, GREEK) == ("en", 0.0, [(0, len(GREEK), "und")])
    lang, score, spans = langid.label(m, f"{ENGLISH} {GREEK} {FRENCH}")
    assert [x[2] for x in spans] == ["en", "und", "fr"] and 0 < score < 0.7


def test_a_word_may_go_on_over_parts(spark, docs, monkeypatch):
    m = model(spark, docs)
    text = "the " + "houseandthething" * 20 + " with, " + "το" * 50
    whole = m.words(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    parts = m.words(text)
    assert len(whole[0]) == 4 and all(np.allclose(a, b) for a, b in zip(whole, parts))


def test_every_language_is_learned(spark, docs):
    rows = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} " * 20, f"l{i:03}") for i in range(100)]
    assert len(langid.train(docs(rows).select("doc_id", "text", "lang")).langs) == 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.floats(-20, 20).map(lambda x: round(x, 2)), min_size=3, max_size=3), min_size=1, max_size=7))
def test_viterbi(rows):
    scores = np.array(rows)
    m = langid.Model({"a": {0: 1}, "b": {0: 1}, "c": {0: 1}})

    def value(path):
        return sum(scores[i, p] for i, p in enumerate(path)) - langid.PENALTY * sum(a != b for a, b in zip(path, path[1:]))

    best = max(value(p) for p in np.ndindex(*(3,) * len(rows)))
    assert abs(value(langid.viterbi(scores).tolist()) - best) < 1e-6 and abs(value(m.path(scores).tolist()) - best) < 1e-6


# op6

PAGES = {
    None: "",
    "": "",
    "<p>": "",
    "just text": "just text",
    "<html><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>One<br>two  <b>three</b></p><p>Four<p>Five</article><footer>f</footer>": "A & B\n\nOne two three\n\nFour\n\nFive",
    "<article><p>x &am</p>": "x &am",
    "<div class='ad'>buy<article><p>kept</p></article>": "kept",
    "<article><p>kept</p><section id=comments><article><p>reader</p></article></section><form>f</form><script>if(a<b){'</p>'}</script></article>": "kept",
    "<style>p{}</style><p>a</p><!-- <p>b</p> --><p>c &lt; d &#233; 1 < 2</p>": "a\n\nc < d é 1 < 2",
    "<p>" + "x " * 100_000 + "</p>": ("x " * 100_000).strip(),
    "<header>h</header><div>" + "<p>word word word word word word word word word word word</p>" * 3 + "</div><aside>s</aside>": "\n\n".join(["word word word word word word word word word word word"] * 3),
    "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
    "<article><p>ends in a tag <b": "ends in a tag",
    "<div class='page with-sidebar'><article class='post widget'><p>kept</p></article><div class='sidebar'>s</div></div>": "kept",
    "<p title='" + '"' * 3000 + ">": "",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_html(html):
    assert line_blocks.main_text(html)[0] == PAGES[html]


def test_surges():
    long = "text " * 30
    page = "<div>menu</div><hr><div>" + f"<p>{long}</p>" * 3 + "</div><hr><div>foot</div>"
    assert line_blocks.main_text(page)[0] == "\n\n".join([long.strip()] * 3)


def test_an_advert_in_the_middle_takes_nothing_along():
    long = "text " * 40
    page = f"<div><h1>Title</h1><div class='share'>s</div><p>{long}</p><div class='ad'>buy</div><p>Closing.</p></div><hr><div>Imprint</div>"
    assert line_blocks.main_text(page)[0] == "\n\n".join(["Title", long.strip(), "Closing."])


def test_comments_before_an_unclosed_advert():
    page = "<p>comment on this</p>" + "<i></i>" * 900 + "<div class='ad'>buy<article><p>kept</p></article>"
    assert line_blocks.main_text(page)[0] == "kept"


def _page(rng):
    """A page, and its article as it was written."""
    words = lambda a, b: " ".join(rng.choice(("alpha", "beta", "gamma", "delta &amp; co", "<b>bold</b>", "<a href='#'>link</a>")) for _ in range(rng.randrange(a, b)))
    plain = lambda t: unescape(re.sub("<[^>]+>", "", t))
    named = rng.random() < 0.6
    noise = ["<nav><ul><li>Home</li></ul></nav>", "<div class='ad-slot'>{}</div>", "<aside>{}</aside>", "<form>{}<input></form>", "<div id='cookie-notice'>{}</div>", "<div class='social share'>{}</div>", "<script>{}</script>"]
    junk = lambda: rng.choice(noise).format(words(1, 60))
    inner, kept = [], []
    for k in range(rng.randrange(1, 9)):
        tag = "h1" if k == 0 and rng.random() < 0.5 else "p"
        text = words(30, 60) if k == 1 or not named and tag == "p" and rng.random() < 0.5 else words(1, 20)
        inner.append(f"<{tag}>{text}</{tag}>")
        kept.append(plain(text))
        if rng.random() < 0.3:
            inner.append(junk())
    if not named and max(map(len, kept)) <= line_blocks.SURGE:
        inner.append(f"<p>{'long ' * 30}</p>")
        kept.append(("long " * 30).strip())
    around = "article" if named else "div"
    outer = [junk() for _ in range(rng.randrange(3))]
    page = "<html><head><title>t</title></head><body>" + "".join(outer) + f"<header>{words(1, 30)}</header><{around}>{''.join(inner)}</{around}>"
    page += f"<section class='comments'><article>{words(1, 80)}</article></section>" * rng.randrange(2) + f"<footer>{words(1, 40)}</footer></body></html>"
    return page, "\n\n".join(kept)


def test_pages_as_they_were_written():
    rng = random.Random(12)
    for _ in range(400):
        page, kept = _page(rng)
        assert line_blocks.main_text(page)[0] == kept, page


def test_html_table(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(PAGES)] + [(1, None, None)], "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    got = Counter((r.page_id, r.text, r.n_chars) for r in line_blocks.extract(pages).collect())
    assert got == Counter([(i, t, len(t)) for i, t in enumerate(PAGES.values())] + [(1, "", 0)])
    assert line_blocks.extract(pages.limit(0)).collect() == []


# op8


def test_mixing(docs):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice("aabbbbbbbbcd")) for i in range(3000)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", None), (5002, "one two", "en", None), (5002, "one two", "en", None), (None, "x", "en", "a")]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, total, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    out = mixing.mix(docs(rows)).collect()
    assert len(out) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert Counter(map(tuple, mixing.mix(docs(rows)).collect())) == Counter(map(tuple, out))
    copies = Counter(r.doc_id for r in mixing.sample(docs(rows)).collect())
    want = Counter()
    for r in out:
        want[r.doc_id] += r.n_copies
    assert copies == +want
    assert mixing.mix(docs([])).collect() == [] == mixing.sample(docs([])).collect()
    assert {r.taken for r in mixing.mix(docs([(1, None), (2, "")])).collect()} == {0}


def test_equal_rows_are_drawn_one_by_one(docs):
    rows = [(1, "one two three four five six seven eight nine ten", "en", "a")] * 100 + [(10 + i, "w " * 10, "en", "b") for i in range(250)]
    out = mixing.mix(docs(rows)).collect()
    for s, size in (("a", 1000), ("b", 2500)):
        own = [r for r in out if (r.doc_id == 1) == (s == "a")]
        assert own[0].source_size == size and abs(sum(r.taken for r in own) - own[0].target) <= 10
    assert 1 < len({r.n_copies for r in out if r.doc_id == 1})


def test_inclusion_follows_the_odds(docs):
    rows = [(i, "w " * (3 if i % 3 else 900), "en", "ab"[i % 2]) for i in range(120)]
    table = docs(rows, extra=False)
    light = mixing._measured(table, ["size", "class", "u", "k1", "k2"], "x").select("source", "size", "class", "u")
    copies = {(r.source, r["class"]): r.copies for r in mixing.expected(light).collect()}
    assert len(set(copies.values())) == 4 and all(0 < c < 3 for c in copies.values())
    got, seeds = Counter(), 6
    for seed in range(seeds):
        for r in mixing.mix(table, f"seed{seed}").collect():
            got[r.doc_id] += r.n_copies
    for kind in copies:
        ids = [i for i, t, _, s in rows if (s, 2 if len(t) < 10 else 10) == kind]
        assert abs(sum(got[i] for i in ids) / len(ids) / seeds - copies[kind]) < 0.17


def test_ranks_are_cut_into_bins_again(docs, monkeypatch):
    rows = [(i, "w " * (i % 50 + 1), "en", "ab"[i % 2]) for i in range(400)]
    whole = Counter(map(tuple, mixing.mix(docs(rows)).collect()))
    monkeypatch.setattr(mixing, "ORDERED", 3)
    monkeypatch.setattr(mixing, "BINS", 4)
    assert Counter(map(tuple, mixing.mix(docs(rows)).collect())) == whole


# op9


def test_media_round_trip(docs):
    rows = [(0, None), (1, ""), (2, "x" * 192), (3, "é" * 97), (4, "long " * 60_000), (5, "same"), (5, "same"), (None, "\x00\x7f")]
    for r in media.digest(docs(rows)).collect():
        raw = (dict((a, b) for a, b in rows)[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        data = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.feature.startswith(f"frames={len(payload) // 192};") and ";resync=0;" in r.feature
    assert media.digest(docs([])).collect() == []
    (one,) = media.media_column(docs([(1, "abc")])).collect()
    assert (one.seconds_num, one.seconds_den) == (9, 250) and one.seek[0]["offset"] == 28 + 216 and one.offsets == [28 + 216]


def protected_frame(header, size, bits):
    """A frame whose checksum is computed bit by bit over the header's last half and ``bits``."""
    crc = 0xFFFF
    for bit in f"{int.from_bytes(header[2:], 'big'):016b}{bits}":
        top = crc >> 15 ^ int(bit)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    return header + crc.to_bytes(2, "big") + body + b"\x55" * (size - 6 - len(body))


def test_checksums_of_every_layer():
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("01") for _ in range(n))
    stereo, joint, mono = b"\x00", b"\x50", b"\xc0"  # joint: subbands from 8 on are shared
    cases = [(bytes((0xFF, 0xFE, 0x80)) + mode, 12 * 256000 // 44100 * 4, some(n)) for mode, n in ((stereo, 256), (joint, 4 * (16 + 24)), (mono, 128))]
    for mode, fields in ((stereo, [b for b in [4] * 11 + [3] * 12 + [2] * 4 for _ in range(2)]), (joint, [4] * 16 + [4] * 3 + [3] * 12 + [2] * 4)):
        # layer II, 128 kbit/s at 44.1 kHz: 64 a channel
        values = [rng.choice((0, rng.randrange(1 << b))) for b in fields]
        shared = mode == joint
        n = sum((2 if shared and k >= 16 else 1) for k, v in enumerate(values) if v)
        bits = "".join(f"{v:0{b}b}" for v, b in zip(values, fields)) + some(2 * n)
        cases.append((bytes((0xFF, 0xFC, 0x80)) + mode, 144 * 128000 // 44100, bits))
    for head, size, bits in cases:
        frame = protected_frame(head, size, bits)
        s = media.parse(frame * 3)
        assert (len(s.offsets), s.n_crc_ok, s.n_crc_bad) == (3, 3, 0)
        for k in (8 * 6, 8 * 6 + len(bits) - 1):  # the first and the last bit that are covered, and the next
            broken = bytearray(frame * 3)
            broken[k // 8] ^= 128 >> k % 8
            assert media.parse(bytes(broken)).n_crc_bad == 1 or k > 48
        k = 8 * 6 + len(bits)
        broken = bytearray(frame * 3)
        broken[k // 8] ^= 128 >> k % 8
        assert media.parse(bytes(broken)).n_crc_bad == 0


def frames(kbits, n, hertz=44100, pad=0):
    rate = media._RATES[(1, 3)].index(kbits) << 4 | {44100: 0, 48000: 4, 32000: 8}[hertz] | pad << 1
    size = 144000 * kbits // hertz + pad
    return (bytes((0xFF, 0xFB, rate, 0x00)) + bytes(size - 4)) * n


def test_media_streams():
    s = media.parse(b"ID3\x03\x00\x00\x00\x00\x00\x05abcde" + frames(128, 10) + frames(64, 5) + b"TAG" + bytes(125))
    assert len(s.offsets) == 15 and s.samples == 15 * 1152 and s.seconds == Fraction(15 * 1152, 44100) and s.tags == {"ID3v2": 15, "ID3v1": 128}
    s = media.parse(b"noise\xff\xfb\x00" * 50 + frames(128, 6) + b"\x00" * 77 + frames(128, 6))
    assert len(s.offsets) == 12 and s.n_resync == 2 and s.n_skipped == 8 * 50 + 77
    for junk in (b"", b"\xff", b"\xff" * 5000, bytes(5000), b"ID3", b"TAG" + bytes(125)):
        s = media.parse(junk)
        assert s.offsets == [] and s.seconds == 0 and media.feature(s).startswith("frames=0;")


def test_media_keeps_a_payload_that_looks_like_a_tag():
    ape = b"y" * 161 + b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little")
    for text in (b"x" * 65 + b"TAG", b"x" * (65 + 192) + b"TAG" + b"z" * 124, ape.ljust(192)):
        payload = text.ljust(-(-len(text) // 192) * 192)
        data = media.store(payload)
        assert media.load(data, media.parse(data)) == payload
        tagged = media.parse(data + b"TAG" + bytes(125))
        assert media.load(data, tagged) == payload and tagged.tags["ID3v1"] == 128
    small = ape[:169] + (40).to_bytes(4, "little") * 2
    data = media.store(small.ljust(192))
    assert media.load(data, media.parse(data)) == small.ljust(192)


def test_media_checksums_and_tables():
    data = bytearray(media.store(b"x" * 192 * 8))
    s = media.parse(bytes(data))
    assert (s.table, s.table_frames, s.table_bytes, len(s.toc), s.n_crc_ok, s.n_crc_bad) == ("Info", 8, 216 * 9, 100, 9, 0)
    data[s.offsets[3] + 8] ^= 1
    assert media.parse(bytes(data)).n_crc_bad == 1
    xing = bytearray(frames(128, 1))
    xing[36:44] = b"Xing" + (1).to_bytes(4, "big")
    xing[44:48] = (10).to_bytes(4, "big")
    xing[48:52], xing[69:72] = b"LAME", (576 << 12 | 100).to_bytes(3, "big")
    s = media.parse(bytes(xing) + frames(128, 10))
    assert (s.table, s.table_frames, s.delay, s.padding, s.samples) == ("Xing", 10, 576, 100, 11520 - 676)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=800))
def test_media_parses_anything(data):
    s = media.parse(data)
    assert all(0 <= o < len(data) for o in s.offsets)
