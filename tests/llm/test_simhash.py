import random
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import common, simhash


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB c\n\té\x85", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow(text)


def test_components_of_fingerprints(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(4):  # chains and clusters
        for p in prints[-60:]:
            for _ in range(rng.randrange(3)):
                prints.append(p ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64)) * rng.randrange(2))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = dict(simhash.components(pairs).collect())
    want = classes(signed, prints)
    assert [roots.get(p, p) for p in signed] == want


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_few_and_many_links(spark, monkeypatch, few):
    rng = random.Random(3)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(200, 201 + i) for i in range(30)]
    root = list(range(300))
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if x == old else x for x in root]
    monkeypatch.setattr(common, "FEW_LINKS", few)
    found = simhash.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert sorted(found) == sorted((k, root[k]) for k in {x for a, b in links if a != b for x in (a, b)})


def test_few_links_take_few_tasks(spark):
    pairs = common.cut(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"))
    context, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    context.setJobGroup("few links", "")
    try:
        simhash.components(pairs).collect()
        tracker = context.statusTracker()
        stages = {k for job in tracker.getJobIdsForGroup("few links") for k in tracker.getJobInfo(job).stageIds}
        assert sum(tracker.getStageInfo(k).numCompletedTasks for k in stages if tracker.getStageInfo(k)) < 500
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert set(simhash.components(pairs).collect()) == {(i, 0) for i in range(201)}


def documents():
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 300))) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n"), (None, base[0]), (None, "alone one two three"), (5, base[5]), (5, base[5]), (303, "One two"), (304, "one TWO")]
    rows.append((305, "long word " * 40_000))
    return rows


def test_documents(docs):
    rows = documents()
    prints = [slow(t) for _, t in rows]
    want = sorted(zip((i for i, _ in rows), (f"{p:016x}" for p in prints), classes([i for i, _ in rows], prints)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == want


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(rows):
    """Brute force: the rows' groups, linked by a similarity of 0.8 on five-word shingles or two bits of their SimHash."""
    sets, prints = [shingles(t) for _, t in rows], [simhash.fingerprint(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return out.values()


def test_one_of_each_group_stays(docs):
    rows = documents()
    want = [min((i for i in ids if i is not None), default=None) for ids in groups(rows)]
    out = simhash.deduplicate(docs(rows))
    got = [r.doc_id for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and out.columns == docs(rows).columns


def test_edited_copies_go(docs):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for g in range(8):
        base = [word() for _ in range(300)]
        rows.append((1000 * g, " ".join(base)))
        for k in range(1, 40):
            copy = list(base)
            for _ in range(rng.randrange(1, 7)):
                copy[rng.randrange(300)] = word()
            rows.append((1000 * g + k, " ".join(copy)))
    rows += [(9000 + k, " ".join(word() for _ in range(300))) for k in range(40)]
    got = {r.doc_id for r in simhash.deduplicate(docs(rows)).collect()}
    want = {min(ids) for ids in groups(rows)}
    # nothing goes that has no copy; of those that have, nearly all (six edits are a similarity of 0.816)
    assert want <= got and len(got - want) <= 0.06 * (len(rows) - len(want))


def test_a_map_column_is_no_obstacle(docs):
    rows = docs([(1, "a b c"), (1, "a b c"), (2, "d e f")]).selectExpr("*", "map('k', 1) AS extra")
    assert sorted(r.doc_id for r in simhash.deduplicate(rows).collect()) == [1, 2]


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).collect() == [] == simhash.deduplicate(docs([])).collect()
