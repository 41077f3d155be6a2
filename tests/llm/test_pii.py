import hashlib
import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.llm import pii

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(k, v):
    d = re.sub("[^0-9]", "", v)
    return (True, all(int(x) <= 255 for x in v.split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]


def slow(text):
    spans = sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, text or "") if valid(k, m[0]))
    text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return [sum(x[1] == k for x in spans) for k in range(4)] + [hashlib.sha256(text.encode()).hexdigest(), text]


FIXED = [
    None,
    "",
    "write to Bob.12@mail.example.com, or a@b.c_d@e.f.g and x@y",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 +1 (269) 555-3296 +12 34",
    "é漢𝒳 a@b.co 𝒳 8.8.8.8 +49 (30) 123456-78",
    "9" * 30_000 + " 1" * 20_000 + " a@" + "b." * 20_000 + "c",
    "x" * 200_000 + "@",
]


def check(docs, texts):
    rows = pii.find(docs([(i, t) for i, t in enumerate(texts)])).collect()
    got = {r.doc_id: [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans] for r in rows}
    assert got == {i: slow(t) for i, t in enumerate(texts)}


def test_base_spans(docs):
    check(docs, FIXED)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a1Z@.-+ (5)_%\té", max_size=60), min_size=60, max_size=120))
def test_random_texts(docs, texts):
    check(docs, texts)


def fill(i, n=12):
    return " ".join(f"w{i}x{k}longword{i}" for k in range(n))


def test_terms_that_disclose(docs):
    rows = [(i, f"{fill(i)} project Bluebird contact bob@corp.com and others {fill(1000 + i)}") for i in range(5)]
    rows += [(100 + i, f"{fill(100 + i)} and others contact project") for i in range(200)]
    out = {r.doc_id: r for r in pii.find(docs(rows)).collect()}
    text = rows[0][1]
    start = text.index("Bluebird")
    assert f"term:{start}:{start + 8}" in out[0].spans.split(",") and out[0].n_term == 1
    assert all(r.spans == "" for i, r in out.items() if i >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}
    assert clean[0] == text.replace("Bluebird", "[TERM]").replace("bob@corp.com", "[EMAIL]")
    assert clean[100] == rows[5][1]


def test_copies_are_one_witness(docs):
    rows = [(i, f"{fill(1)} bluebird bob@corp.com") for i in range(50)] + [(100 + i, fill(100 + i)) for i in range(50)]
    assert all(r.n_term == 0 for r in pii.find(docs(rows)).collect())


def test_an_entity_may_be_the_longest_word(docs):
    rows = [(i, f"text{i} more{i} bluebird somebody.with.a.long.name@department.corporation.example") for i in range(5)]
    rows += [(100 + i, f"other{i} text") for i in range(200)]
    out = {r.doc_id: r for r in pii.find(docs(rows)).collect()}
    assert all(out[i].n_term == 1 for i in range(5))


def test_terms_anywhere_in_the_document(docs):
    rows = [(i, f"Bluebird, {fill(i, 90)} bob@corp.com {fill(1000 + i, 90)} bluebird") for i in range(5)]
    rows += [(100 + i, fill(100 + i)) for i in range(200)]
    out = {r.doc_id: r.spans for r in pii.find(docs(rows)).collect()}
    n = len(rows[0][1])
    assert out[0].startswith("term:0:9,") and out[0].endswith(f",term:{n - 8}:{n}") and out[0].count("term") == 2
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}
    assert all(clean[i] == f"[TERM] {fill(i, 90)} [EMAIL] {fill(1000 + i, 90)} [TERM]" for i in range(5))


def test_terms_where_the_entity_is_not(docs):
    rows = [(i, f"{fill(i)} project Bluebird contact bob@corp.com") for i in range(40)] + [(50, f"{fill(50)} about bluebird")]
    rows += [(100 + i, f"{fill(100 + i)} project contact") for i in range(300)]
    out = {r.doc_id: r for r in pii.find(docs(rows)).collect()}
    at = rows[40][1].index("bluebird")
    assert out[50].spans == f"term:{at}:{at + 8}" and all(out[i].n_term == 1 for i in range(40))


def test_edited_copies_are_one_witness(docs):
    rows = [(i, f"{fill(1, 100)} bluebird bob@corp.com {fill(2, 100)} edit{i}") for i in range(30)] + [(100 + i, fill(100 + i)) for i in range(50)]
    assert all(r.n_term == 0 for r in pii.find(docs(rows)).collect())


def test_disclosure_by_brute_force(docs):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = [f"t{rng.randrange(90)}word" for _ in range(rng.randrange(3, 12))] + [f"own{i}"]
        if i % 3 == 0:
            e = rng.randrange(9)
            words += [f"e{e}@x.org"] + [f"near{e}" for _ in range(rng.random() < 0.7)]
        if i % 50 == 1:
            words.append(f"near{rng.randrange(9)}")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            rows.append((1000 + i, rows[-1][1]))
    terms, ents = {}, {}
    for text in {t for _, t in rows}:
        for w in text.split():
            (ents if "@" in w else terms).setdefault(w, set()).add(text)
    n, want = len({t for _, t in rows}), {}
    for e, with_e in ents.items():
        for t, with_t in terms.items():
            both = len(with_e & with_t)
            if both >= pii.MIN_SUPPORT and len(with_e) < n:
                value = math.log(n * both / len(with_t) / len(with_e)) / math.log(n / len(with_e))
                if value >= pii.THRESHOLD:
                    want[e, t] = value
    assert len(want) > 3
    found = {(r.ent, r.term): r.disclosure for r in pii.disclosing(docs(rows)).collect()}
    assert sorted(found.values()) == pytest.approx(sorted(want.values()))
    hidden = {t for _, t in want}
    out = {r.doc_id: r.n_term for r in pii.find(docs(rows)).collect()}
    assert out == {i: sum(w in hidden for w in t.split()) for i, t in rows}


def test_many_matches(docs):
    check(docs, [" ".join(f"a{i}@b.co" for i in range(3000)), ". ".join("1.2.3.4" for _ in range(257))])


def test_repeated_and_null_rows(docs):
    rows = [(None, "a@b.co"), (None, "a@b.co"), (1, None), (1, None)]
    out = sorted((r.doc_id is None, r.n_email, r.spans) for r in pii.find(docs(rows)).collect())
    assert out == [(False, 0, "")] * 2 + [(True, 1, "email:0:6")] * 2
    assert sorted(map(repr, (r.text for r in pii.sanitise(docs(rows)).collect()))) == ["'[EMAIL]'"] * 2 + ["None"] * 2


@pytest.mark.parametrize("f", [pii.find, pii.sanitise])
def test_empty(docs, f):
    assert f(docs([])).collect() == []


def test_columns_stay(docs):
    d = docs([(1, "a@b.co x"), (2, "y")])
    assert pii.sanitise(d).columns == d.columns
