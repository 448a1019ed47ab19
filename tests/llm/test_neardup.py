import random
import re

import numpy as np

from lodestar.llm import neardup
from tests.llm import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def brute(rows, size, num, den):
    s = [(d, sets(t, size)) for d, t in rows if d is not None]
    up = {d: d for d, _ in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(s):
        for b, y in s[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in up}


def variants(seed, groups=12, most=25):
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = data.prose(1000 * seed + g, r.randint(20, 150)).split()
        for _ in range(r.randint(1, most)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 15))):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


def check(spark, rows, size, num, den):
    got = neardup.near_duplicates(data.documents(spark, rows).repartition(3), size, num, den).collect()
    want = brute(rows, size, num, den)
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            assert g.component_id == want[g.doc_id]
            assert g.kept == (g.doc_id == g.component_id)
        else:
            assert g.component_id is None and g.kept
    assert sorted(g.n_shingles for g in got) == sorted(len(sets(t, size)) for _, t in rows)


def test_components_equal_brute_force(spark):
    check(spark, variants(1), 3, 85, 100)


def test_five_words_at_four_fifths(spark):
    check(spark, variants(2), 5, 80, 100)


def test_awkward_rows(spark):
    check(spark, data.awkward(), 3, 85, 100)


def test_groups_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    check(spark, variants(3, 4, 30), 3, 85, 100)


def test_lists_over_a_block_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    check(spark, variants(5, 5, 30), 3, 85, 100)


def chained(seed, n, words=120, step=9):
    """Texts of which each shares much with the next and little with those far off: one loose group, few links."""
    r = random.Random(seed)
    base, rows = data.prose(seed, words).split(), []
    for k in range(n):
        for _ in range(r.randrange(1, step)):
            base[r.randrange(words)] = f"w{r.randrange(10**6)}"
        rows.append((k, " ".join(base)))
    r.shuffle(rows)
    return rows


def test_a_loose_group_of_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = chained(6, 160)
    check(spark, rows, 3, 85, 100)
    # no node's set goes to more lists than it is posted under, in as many blocks as such a list has
    classes = neardup.written(neardup.classes_of(neardup._signed(data.documents(spark, rows).select("doc_id", "text"), 3)), "t")
    matches = neardup.least_matches(85, 100)
    chosen = neardup._posted(classes, matches)
    assert chosen.groupBy("node").count().agg(F.max("count")).first()[0] <= neardup.COORDINATES - matches + 1
    edges = neardup.stars(chosen, classes, matches)
    assert edges.count() <= 160 * (neardup.COORDINATES - matches + 1) and edges.where("u <= v").isEmpty()


def test_repeated_ids_with_other_texts(spark):
    a, b = data.prose(70, 60), data.prose(71, 60)
    rows = [(5, a), (5, b), (6, a + " more"), (2, b + " more"), (7, a)]
    got = neardup.near_duplicates(data.documents(spark, rows), 3, 85, 100).collect()
    assert sorted((g.doc_id, g.component_id) for g in got) == [(2, 2), (5, 2), (5, 5), (6, 5), (7, 5)]


def test_few_links_are_lost():
    from math import comb

    for num, den in ((85, 100), (80, 100), (50, 100), (1, 1)):
        m, t, n = neardup.least_matches(num, den), num / den, neardup.COORDINATES
        tail = lambda k: sum(comb(n, i) * t**i * (1 - t) ** (n - i) for i in range(k))
        assert tail(m) <= 1e-9 or m == 1
        assert m == n or tail(m + 1) > 1e-9


def test_no_documents(spark):
    assert neardup.near_duplicates(data.empty(spark)).collect() == []


def test_confirmed_counts_exactly():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 400, dtype=np.uint64)
    s = [np.unique(np.where(rng.random(400) < rng.random() * 0.12, rng.integers(0, 1 << 60, 400, dtype=np.uint64), base)) for _ in range(300)]
    edges = neardup.confirmed(s, 85, 100)
    up = list(range(300))

    def find(up, x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(up, a), find(up, b))] = min(find(up, a), find(up, b))
    want, f = list(range(300)), [frozenset(x.tolist()) for x in s]
    for a in range(300):
        for b in range(a):
            if 100 * len(f[a] & f[b]) >= 85 * len(f[a] | f[b]):
                p, q = find(want, a), find(want, b)
                want[max(p, q)] = min(p, q)
    assert [find(up, x) for x in range(300)] == [find(want, x) for x in range(300)]


def test_one_document_of_each_group_stays(spark):
    rows = [*variants(4), (0, "repeated"), (0, "repeated")]
    docs = data.documents(spark, rows)
    left = neardup.distinct_documents(docs).collect()
    want = brute(rows, 5, 80, 100)
    assert sorted(r.doc_id for r in left) == sorted({d for d in want if want[d] == d})
    assert neardup.distinct_documents(docs).schema == docs.schema
