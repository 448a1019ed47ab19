import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lodestar.llm import divergence
from lodestar.llm.queries import ORACLES, QUERIES
from tests.compare import from_duckdb, from_spark
from tests.llm import data

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30, most=50):
    """rows (text, lang, source)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)]
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (n + 5 * len(kept)) for t in kept}
        n = sum(counts[lang, s][t] for t in kept for s in sources)
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found[:limit])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(k, *r, 1, 2, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, rank int, value long, item string")


def test_trie_holds_what_was_added_in_order():
    r = random.Random(3)
    trie, want = divergence.Trie(), defaultdict(Counter)
    for _ in range(3000):
        key = bytes(r.choice(b"ab\xc3\xa9z") for _ in range(r.randrange(0, 7)))
        trie.add(key, 1, [(r.choice("xyz"), 2)])
        want[key]["docs"] += 1
    found = [(k, n.docs) for k, n in trie.leaves()]
    assert found == sorted((k, n["docs"]) for k, n in want.items())
    assert trie.entries == sum(len(n.counts) for _, n in trie.leaves())


def test_long_keys_need_no_recursion():
    trie = divergence.Trie()
    for k in range(1, 5000):
        trie.add(b"a" * k, 1, [("s", 1)])
    assert sum(1 for _ in trie.leaves()) == 4999


def test_shares_are_exact():
    r = random.Random(5)
    for _ in range(200):
        n, kept = r.randrange(1, 10**14), r.randrange(1, 10**6)
        c = r.randrange(0, n + 1)
        assert divergence.shares(np.array([c]), np.array([n]), kept)[0] == 1 + 10**9 * (c + 5) // (n + 5 * kept)


def prose(seed, n=400):
    r = random.Random(seed)
    words = ["Stone", "river", "LAMP", "été", "Ünder", "x1y", "naïve", "日本", "it's", "a", "B", "zeta", "theta"]
    return [(" ".join(r.choices(words, weights=range(1, 14), k=r.randrange(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "é", "z", None])) for _ in range(n)]


def test_rows_of_kept_terms_pass(spark):
    r = random.Random(9)
    keys = sorted((r.choice(["de", "en"]), r.choice([b"", b"a", b"ab", b"b", b"zz"]), r.choice([1, 1, 2, 9])) for _ in range(200))
    total = Counter()
    for lang, term, n in keys:
        total[lang, term] += n
    for size in (1, 3, 50, 200):
        kept, got = divergence.Kept(90), []
        for at in range(0, len(keys), size):
            lang, term, docs = zip(*keys[at : at + size], strict=True)
            lists = pa.array([["s"]] * len(docs)), pa.array([[1]] * len(docs))
            got += [(x["lang"], x["term"], x["docs"]) for x in kept.take(pa.RecordBatch.from_arrays([pa.array(lang), pa.array(term, pa.binary()), pa.array(docs, pa.int64()), *lists], ["lang", "term", "docs", "sources", "counts"])).to_pylist()]
        assert got == [k for k in keys if total[k[:2]] >= 90 or not k[1]]


def test_terms_of_texts():
    r = random.Random(8)
    texts = ["".join(r.choice("aB c.\x00é日") for _ in range(r.randrange(0, 9))).encode() for _ in range(300)] + [b"", b"end"]
    terms, place = divergence.terms_of(texts)
    want = [(t.encode(), k) for k, x in enumerate(texts) for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x.decode()))]
    assert list(zip(terms.to_pylist(), place.tolist(), strict=True)) == want
    assert [len(x) for x in divergence.terms_of([b"", b" "])] == [0, 0]


def test_audit_equals_brute_force(spark):
    rows = prose(1)
    assert got(divergence.audit(table(spark, rows).repartition(5))) == brute(rows)


def test_tries_that_leave_early_merge_to_the_same(spark):
    rows = prose(2)
    leaves = divergence.counted(table(spark, rows).repartition(3), most=20, chunk=400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    assert leaves.groupBy("lang", "term").count().where("count > 3").count() > 0
    blocks = divergence.merged(leaves, 30, terms=3, most=10).cache()
    whole = divergence.merged(divergence.counted(table(spark, rows)), 30)
    flat = lambda b: sorted((r.lang, bytes(x.term), sorted(zip(x.sources, x.counts, strict=True))) for r in b.collect() for x in r.leaves)
    assert flat(blocks) == flat(whole)
    a = divergence.measured(blocks, divergence.totals(blocks), 2)
    assert a.where("part = 'term'").count() > 0


def test_awkward_documents(spark):
    rows = [(None, None, None), ("", "en", "s1"), ("...", "en", "s2"), *[("word Word wörd", "en", "s1")] * 31, *[("same word", "en", "s3")] * 31, ("only here", "fr", "s1"), ("word " * 200_000, "en", "s2"), ("x" * 100_000, "en", "s2")]
    assert got(divergence.audit(table(spark, rows))) == brute(rows)
    assert divergence.audit(data.empty(spark)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    for folder in (sf_dir, sf_dir.replace("0.001", "0.01")):
        assert from_spark(QUERIES["op11_source_divergence"](spark, folder)) == from_duckdb(ORACLES["op11_source_divergence"], folder)
