import random

import numpy as np
import pytest

from lodestar.llm import ann, decontam, licenses, toxicity
from tests.llm import data


def labelled(spark, n=600):
    r, rows, labels = random.Random(7), [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = data.prose(k + 50, 60).split()
        if toxic:
            for _ in range(4):
                words[r.randrange(60)] = "grum" + r.choice(["ble", "py", "ling", "mest"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic), 1, "x"))
    return data.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    import zlib

    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in held) for d in got)
    assert np.mean([got[d].predicted == (d % 4 == 0) for d in held]) > 0.95
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got.values())


def test_toxicity_of_awkward_rows(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.fit(docs, labels)
    rows = data.documents(spark)
    got = toxicity.score(rows, model).collect()
    assert len(got) == rows.count() and all(0 <= g.score <= 1 for g in got)
    assert toxicity.ordinary(rows, model).schema == rows.schema
    assert toxicity.score(data.empty(spark), model).collect() == []


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 40)
    model = toxicity.fit(docs, labels.limit(0))
    assert all(g.predicted == 0 for g in toxicity.score(docs, model).collect())
    assert toxicity.score(data.empty(spark), toxicity.fit(data.empty(spark), labels)).collect() == []


def kneser_ney(by_class, every, discount=0.75):
    """log p(word | toxic) - log p(word | ordinary) by dictionaries of strings; by_class: words of ordinary and toxic rows."""
    from collections import Counter, defaultdict
    from math import log

    order = toxicity.ORDER
    grams = lambda w: [("\x01" * order + w + "\x02")[k + 1 : k + 1 + order] for k in range(len(w) + 1)]
    longer = {g for w in every for g in grams(w)}
    lower = {}
    for k in range(order - 1, 0, -1):
        ends = Counter(g[1:] for g in longer)
        lower[k], longer = ends, set(ends)
    after = {k: defaultdict(Counter) for k in lower}
    for k, ends in lower.items():
        for g, n in ends.items():
            after[k][g[:-1]][g[-1]] = n
    toxic_heads = {g[:-1] for w in by_class[1] for g in grams(w)}
    top = []
    for words in by_class:
        counts = defaultdict(Counter)
        for w in words:
            for g in grams(w):
                if g[:-1] in toxic_heads:
                    counts[g[:-1]][g[-1]] += 1
        top.append(counts)

    def mixed(counts, char, rest):
        total = sum(counts.values())
        if not total:
            return rest
        share = {c: max(n - discount, 0) / total for c, n in counts.items()}
        return share.get(char, 0) + (1 - sum(share.values())) * rest

    def p(counts, g):
        below = 1 / 65536
        for k in range(1, order):
            below = mixed(after[k].get(g[-k:-1], {}) if k > 1 else after[1][""], g[-1], below)
        return mixed(counts.get(g[:-1], {}), g[-1], below)

    return lambda w: sum(log(p(top[1], g)) - log(p(top[0], g)) if g[:-1] in toxic_heads else 0.0 for g in grams(w))


def test_probabilities_against_dictionaries(spark):
    from collections import Counter

    r = random.Random(9)
    word = lambda: "".join(r.choice(["ab", "ba", "cä", "Жя", "漢", "a"]) for _ in range(r.randrange(1, 7))).lower()
    by_class = [[word() for _ in range(400)], [word() for _ in range(60)] + ["abbacäab" * 3] * 4]
    every = [*by_class[0], *by_class[1], *[word() for _ in range(200)]]
    n = [Counter(x) for x in by_class]
    rows = [(w, n[0][w], n[1][w]) for w in set(every)]
    counted = toxicity.gram_counts(spark.createDataFrame(rows, "word string, n0 long, n1 long").repartition(3), toxicity.contexts(list(n[1])))
    model = toxicity.model_of(counted.toArrow(), 0.75)
    plain, asked = kneser_ney(by_class, set(every)), [*set(every), "abx", "unseen", "漢字", "abbacäab" * 4]
    assert model.differences(asked) == pytest.approx([plain(w) for w in asked], rel=1e-4, abs=1e-4)


def test_scripts_stay_apart():
    keys = [made.key(next(made.chunks())).tolist() for made in map(toxicity.Grams, ([w] for w in ("привет", "приват", "γειά", "γεια", "漢字", "漢学", "\x85a")))]
    assert len({tuple(k) for k in keys}) == 7


def test_long_words_are_worked_on_in_chunks(spark):
    docs, labels = labelled(spark, 100)
    model = toxicity.fit(docs, labels)
    long = "grumble" * 200_000
    whole = model.differences([long])[0]
    size, toxicity.CHUNK = toxicity.CHUNK, 1000
    try:
        assert model.differences(["x", long, "grumpy"]) == pytest.approx([*model.differences(["x"]), whole, *model.differences(["grumpy"])])
    finally:
        toxicity.CHUNK = size
    model.raws([" ".join(f"{k}{'z' * 1000}" for k in range(100_000))], limit=1 << 20)
    assert sum(map(len, model.cache)) < 4 << 20
    rows = data.documents(spark, [(1, long + " " + long), (2, " ".join(f"{k}{'y' * 5000}" for k in range(2000)))])
    assert toxicity.score(rows, model).count() == 2


QUESTION = "Yesterday the farmer called Alice Smith bought 12 apples and then sold 5 kg of pears to Bob, but later he gave 12 plums away again."


def contaminated(spark, texts):
    docs = data.documents(spark, texts)
    bench = spark.createDataFrame([(1, QUESTION, "x"), (2, "short one", "x"), (3, None, "x"), (None, QUESTION, "x"), (4, "12 13 14 15 16 17 18 19 20 21", "x")], "item_id long, text string, doc_id string")
    return sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect())


def test_changed_parameters_are_caught_if_consistent(spark):
    other = QUESTION.replace("Alice Smith", "Zoe Miller").replace("12", "30").replace("5 kg", "7 lb").replace("Bob", "Tom")
    rows = [(1, QUESTION), (2, "Well. " + other + " End"), (3, other.replace("30 plums", "31 plums")), (4, "the farmer called and then sold of pears"), (5, None), (6, ""), (7, "1 2 3 4 5 6 7 8 9 10 11"), (1, QUESTION), (None, QUESTION)]
    assert contaminated(spark, rows) == [(1, 1), (2, 1)]


def pairs(spark, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontam.contaminated(data.documents(spark, texts), bench).collect())


def test_changed_names_at_the_start_of_sentences_are_caught(spark):
    items = [
        (1, "Tom bought 5 pens. Tom gave 2 pens to his sister. How many pens has he left?"),
        (2, "James writes a 3-page letter to 2 different friends twice a week.\nJames mails them all at once on the same day. How many pages does he write a year?"),
        (3, "A note says that \"Mia has 4 red marbles and a jar\" (Mia keeps them in a box). Mr. Smith takes 2 of the marbles away."),
    ]
    changed = [(1, items[0][1].replace("Tom", "Ana").replace("5", "7")), (2, items[1][1].replace("James", "Mary Jane").replace("3", "8")), (3, items[2][1].replace("Mia", "Zoe").replace("Smith", "Jones").replace("4", "9"))]
    other = [(4, "Ana bought 7 pens. Ben gave 3 pens to his sister. How many pens has he left?"), (5, "She bought a pen and he gave two to a sister.")]
    assert pairs(spark, changed + other, items) == [(1, 1), (2, 2), (3, 3)]


def test_short_and_number_dense_items_are_caught(spark):
    items = [(1, "What is the capital of France?"), (2, "12 + 7 = 19"), (3, "3.5, 4.5, 6.5, 9.5, 13.5, 18.5, 24.5, 31.5, 39.5"), (4, "Boil water slowly")]
    docs = [(1, "Well: what is the capital of France? Paris."), (2, "so 12 + 7 = 19 it is"), (3, "Go on: 3.5, 4.5, 6.5, 9.5, 13.5, 18.5, 24.5, 31.5, 39.5 and so on"), (4, "boil water slowly"), (5, "so 12 + 8 = 20 it is"), (6, "1.5, 4.5, 6.5, 9.5, 12.5, 18.5, 24.5, 30.5, 39.5"), (7, "what is the capital"), (8, "boil the water slowly")]
    assert pairs(spark, docs, items) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_a_long_passage_of_a_longer_item_is_caught(spark):
    words = [f"w{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}" for k in range(300)]
    docs = [(1, "so " + " ".join(words[120:220]) + " end"), (2, "so " + " ".join(words[120:160]) + " end"), (3, " and ".join(" ".join(words[k : k + 20]) for k in range(0, 100, 20)))]
    assert pairs(spark, docs, [(1, " ".join(words))]) == [(1, 1)]


def test_contamination_equals_sql(spark):
    import duckdb

    docs = [(k, data.prose(k, 80).capitalize() + (" " + QUESTION.replace("12", str(k)) if k % 5 == 0 else "")) for k in range(60)]
    bench = [(k, data.prose(k * 3, 80).capitalize()[: 60 + k * 5]) for k in range(30)] + [(99, QUESTION)]
    got = decontam.contaminated(data.documents(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", bench)
    assert sorted(map(tuple, got)) == sorted(con.execute(decontam.SQL).fetchall())
    assert len(got) > 12


def test_clean_documents_keep_the_rest(spark):
    rows = [(1, QUESTION), (2, "clean"), (3, None), (None, "x")]
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    docs = data.documents(spark, rows)
    left = decontam.clean_documents(docs, bench)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "None"] and left.columns == docs.columns
    assert decontam.contaminated(docs, bench.limit(0)).collect() == [] and decontam.contaminated(data.empty(spark), bench).collect() == []


def test_license_notices(spark):
    notice = "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    rows = [(1, "x. Released under the MIT License. y"), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0"), (4, "the license of the version under review"), (5, None), (6, ""), (7, notice), (8, "Licensed under the\nApache   License (Version 2.0). " * 2), (None, "Released under the MIT License")]
    got = licenses.scan(data.documents(spark, rows)).collect()
    assert sorted((str(g.doc_id), g.license) for g in got) == [("1", "MIT"), ("2", "CC-BY-NC-4.0"), ("3", "CC-BY-4.0"), ("7", "MIT"), ("8", "Apache-2.0"), ("8", "Apache-2.0"), ("None", "MIT")]
    one = next(g for g in got if g.doc_id == 1)
    assert rows[0][1][one.start : one.end] == "Released under the MIT License" and one.coverage == 1.0
    assert licenses.scan(data.empty(spark)).collect() == []


def test_short_license_notices_with_another_word():
    found = licenses.Templates(licenses.TEMPLATES).matches
    for text in ("x. Released under a MIT License. y", "Licensed under an MIT License", "under the MIT License"):
        assert [(m[0], m[1]) for m in found(text, 0.8)] == [("MIT", 0.8)]
    assert found("released under review", 0.8) == found("MIT", 0.8) == found("", 0.8) == []


def test_deciding_words_must_align():
    found = licenses.Templates(licenses.TEMPLATES).matches
    of = lambda text: [m[0] for m in found(text, 0.8)]
    for text, want in {
        "Released under the BSD License.": [], "Licensed under the Foo License.": [], "Licensed under CC BY 3.0": ["CC-BY-3.0"], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"],
        "This work is licensed under the GNU General Public License, version 1.": ["GPL-1.0"], "This work is licensed under the GNU Lesser General Public License, version 2.": ["LGPL-2.0"],
        "This work is licensed under the GNU Lesser General Public License, version 5.": [], "This work is licensed under the GNU General Public License, version 3.0": ["GPL-3.0"],
        "Licensed under the Apache License, Version 1.0.": [], "Licensed under the Apache License, v2.0": ["Apache-2.0"], "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"], "SPDX-License-Identifier: (MIT OR ISC)": ["MIT"],
        "Licensed under the Eclipse Public License, version 2.0": ["EPL-2.0"], "distributed under the terms of the New BSD License": ["BSD-3-Clause"], "under the terms of the license of the day": [],
    }.items():
        assert of(text) == want, text
    bsd = {k: licenses.BODIES[k][0].replace("{", "").replace("}", "") for k in ("BSD-2-Clause", "BSD-3-Clause")}
    assert of(bsd["BSD-2-Clause"]) == ["BSD-2-Clause"] and of("x " + bsd["BSD-3-Clause"]) == ["BSD-3-Clause"]
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            got = found("Some words. " + t.replace("{", "").replace("}", "") + " And more.", 0.8)
            assert name in [g[0] for g in got], t


def test_repeated_and_tied_notices(spark):
    rows = [(1, "Released under the MIT License. " * 3), (2, "same words here and there"), (2, "same words here and there")]
    got = licenses.scan(data.documents(spark, rows), {"b": ["same words here"], "a": ["same words here"]}).collect()
    assert [(g.doc_id, g.license) for g in got] == [(2, "a"), (2, "a")]
    assert licenses.scan(data.documents(spark, rows)).count() == 3
    table = spark.createDataFrame([("a", "same {words} here"), (None, "x"), ("c", None)], "license string, text string")
    assert licenses.from_table(table) == {"a": ["same {words} here"]}
    with pytest.raises(ValueError):
        licenses.from_table(table, 3)


def test_many_notices_take_linear_time():
    import time

    start, found = time.time(), licenses.Templates(licenses.TEMPLATES).matches
    assert len(found("Released under the MIT License. " * 5_000, 0.8)) == 5_000
    for text in ("of the software and the software ", "under the license ", "copyright notice this list of conditions ", "a "):
        found(text * 20_000, 0.8)
    assert time.time() - start < 60


def test_alignment():
    import itertools

    r = random.Random(2)
    for _ in range(500):  # against the longest increasing run by trying all of them
        pairs = sorted({(k, r.randrange(8)) for k in range(r.randrange(9))})
        pairs = [p for k, p in enumerate(pairs) if k == 0 or p[0] != pairs[k - 1][0]]
        run = licenses.increasing(pairs)
        rises = lambda c: all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))
        most = max(n for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n) if rises(c))
        assert rises(run) and len(run) == most and set(run) <= set(pairs)
    for _ in range(500):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randrange(12))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        if len(set(a)) == len(a) and len(set(b)) == len(b):  # without repeated words the alignment is the longest common run
            common = [(i, b.index(w)) for i, w in enumerate(a) if w in b]
            assert len(pairs) == len(licenses.increasing(common))
    a, b = "a b c x d e f".split(), "a q b c d x e g f".split()
    assert len(licenses.align(a, b)) == 6


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[7] = x[100]  # a tie
    rows = [(k, v.tolist(), "c") for k, v in enumerate(x)] + [(3000, None, "c"), (3100, [0.0] * 32, "c"), (3200, [float("nan")] * 32, "c"), (3300, [1.0] * 31 + [None], "c"), (3400, [1.0, 2.0], "c"), (None, x[0].tolist(), "c"), (200, x[200].tolist(), "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string").repartition(3)
    got = ann.nearest(table).collect()
    assert {g.query_id for g in got} == set(range(0, 3000, 100))
    d64, hit = x.astype(np.float64), 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in mine] == list(range(1, 11))
        assert [(g.score, g.vec_id) for g in mine] == sorted((g.score, g.vec_id) for g in mine)
        assert all(g.score == d[g.vec_id] for g in mine)
        hit += len({g.vec_id for g in mine} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hit >= 0.9 * 300


@pytest.mark.parametrize("case", ["plain", "by 1e2", "by 1e4", "by 1e6", "groups 1e-2", "groups 1e-4", "groups 1e-5", "times 1e-20", "times 1e20", "one far", "whole query"])
def test_recall_of_the_tables_away_from_the_origin(case):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 32))
    if case.startswith("by"):
        x = x + float(case[3:])
    elif case.startswith("groups"):
        x = rng.normal(size=(6, 32))[rng.integers(0, 6, len(x))] * 3 + x * float(case[7:])
    elif case.startswith("times"):
        x = x * float(case[6:])
    elif case == "one far":
        x[5] = 1e9
    elif case == "whole query":
        x = 200 + 0.05 * x
    books = ann.Codebooks(x[:3000], rounds=3)
    code, norm = ann.encode(x, books)
    asked, hit = np.arange(0, 4000, 100), 0
    for i, near, _ in ann.best_by_tables(x[asked], books, np.arange(4000), code, norm, 257):
        d = ((x - x[asked[i]]) ** 2).sum(1)
        d[asked[i]] = np.inf
        hit += len(set(near.tolist()) & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.95 * 10 * len(asked)


def test_lengths_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)] + [(1000 + k, rng.normal(size=5).tolist()) for k in range(40)]
    rows += [(k, [1.0] * 8) for k in range(400, 1000)]  # more copies than are ranked anew
    rows += [(400, [1.0] * 8)] * 500 + [(200, [9.0] * 8)]  # one row many times; another vector of one id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index, books = ann.build(table)
    got = {}
    for g in ann.search(index, books, index.where("vec_id % 100 = 0"), most=64).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.score, g.vec_id))
    of = {}
    for v, x in rows:
        of.setdefault(v, []).append(np.array(x))
    for q in (0, 100, 200, 400, 500, 900, 1000):
        d = {v: min(float(np.sqrt(((a - b) ** 2).sum())) for a in xs for b in of[q]) for v, xs in of.items() if v != q and len(xs[0]) == len(of[q][0])}
        want = sorted((s, v) for v, s in d.items())[:10]
        mine = [(s, v) for _, s, v in sorted(got[q])]
        if q in (400, 500, 900, 1000):
            assert [v for _, v in mine] == [v for _, v in want], q
        assert len(mine) == 10 and all(abs(d[v] - s) < 1e-12 for s, v in mine)
    assert ann.candidates(index, books, index.where("vec_id = 0").select("vec_id", "embedding", "dims"), 64, rows_a_block=100).count() == 64


def test_few_or_no_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(few.limit(0)).collect() == []


def test_long_texts_of_numbers_and_names_are_decontaminated_in_linear_time(spark):
    import time

    numbers = ",".join(map(str, range(100_000)))
    names = "the " + "Word " * 100_000
    mixed = " ".join(f"the thing {k} costs {k + 1} euros" for k in range(33_000))
    rows = [(1, numbers), (2, names), (3, mixed + " " + QUESTION + " " + mixed), (4, "-".join(["1"] * 100_000) + " " + QUESTION)]
    start = time.time()
    assert contaminated(spark, rows) == [(3, 1), (4, 1)]
    assert time.time() - start < 60


def test_recall_of_the_production_settings(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12_000, 48))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for g in ann.nearest(table, every=400).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    hit = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 30 and hit >= 0.95 * 300
