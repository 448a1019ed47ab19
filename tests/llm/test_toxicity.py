import random
from collections import Counter, defaultdict
from math import log

import pytest
from pyspark.sql import functions as F

from lodestar.llm import toxicity

from . import data


def by_dictionaries(by_class, every, discount=0.75):
    """log p(word | toxic) - log p(word | ordinary) after all contexts, by dictionaries of strings."""
    order = toxicity.ORDER
    grams = lambda w: [("\x01" * order + w + "\x02")[k + 1 : k + 1 + order] for k in range(len(w) + 1)]
    longer, after = {g for w in every for g in grams(w)}, {}
    for k in range(order - 1, 0, -1):
        ends, longer = Counter(g[1:] for g in longer), {g[1:] for g in longer}
        after[k] = defaultdict(Counter)
        for g, n in ends.items():
            after[k][g[:-1]][g[-1]] = n
    top = [defaultdict(Counter), defaultdict(Counter)]
    for counts, words in zip(top, by_class, strict=True):
        for g in (g for w in words for g in grams(w)):
            counts[g[:-1]][g[-1]] += 1

    def mixed(counts, char, rest):
        total = sum(counts.values())
        share = {c: max(n - discount, 0) / total for c, n in counts.items()}
        return share.get(char, 0) + (1 - sum(share.values())) * rest if total else rest

    def difference(g):
        below = 1 / 65536
        for k in range(1, order):
            below = mixed(after[k].get(g[order - k : -1], {}), g[-1], below)
        return log(mixed(top[1].get(g[:-1], {}), g[-1], below)) - log(mixed(top[0].get(g[:-1], {}), g[-1], below))

    return lambda w: sum(map(difference, grams(w)))


@pytest.mark.parametrize("frequent", [200_000, 40])
def test_both_classes_count_after_all_contexts(spark, monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ab", "ba", "cä", "жя", "漢", "a"]) for _ in range(r.randrange(1, 7)))
    by_class = [[word() for _ in range(400)] + ["ordinary"] * 30, [word() for _ in range(60)] + ["abbacäab" * 3] * 4]
    every = [*by_class[0], *by_class[1], *[word() for _ in range(200)]]
    n = [Counter(x) for x in (*by_class, every)]
    rows = [(k, w, n[0][w], n[1][w], n[2][w]) for k, w in enumerate(sorted(set(every)))]
    model = toxicity.Fitted(spark.createDataFrame(rows, "id long, word string, n0 long, n1 long, n long").repartition(3), 0.75)
    plain, asked = by_dictionaries(by_class, set(every)), [*sorted(set(every)), "abx", "unseen", "ordinarily", "漢字", "abbacäab" * 4]
    assert model.differences(asked) == pytest.approx([plain(w) for w in asked], rel=1e-6, abs=1e-6)
    assert model.differences(["ordinary"])[0] < -1  # no toxic text has its contexts
    texts = ["ordinary abx  ordinary", "", None, " ".join(asked)]
    wanted = []
    for t in texts:
        d = [plain(w) for w in toxicity.words_of(t)]
        wanted.append((sum(d) / len(d), sum(max(x - toxicity.FLOOR, 0) for x in d) / len(d) ** 0.5) if d else (0, 0))
    assert [tuple(x) for x in model.raws(texts)] == [pytest.approx(w, abs=1e-6) for w in wanted]


def test_every_label_counts(spark):
    labels = spark.range(26_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"))
    assert toxicity.chosen_labels(labels).count() == labels.where(~toxicity.held_out(F.col("doc_id"))).count()


def test_rows_whose_text_is_toxic_go(spark):
    rows = [(k, " ".join(["grumble" if k % 4 == 0 else "apple", f"w{k % 9}", "pear"])) for k in range(300)]
    docs = data.documents(spark, [*rows, (None, "grumble pear"), (5, None), (7, "apple"), (7, "grumble")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    kept = [(r.doc_id, r.text) for r in toxicity.ordinary(docs, toxicity.fit(docs, labels)).collect()]
    assert sorted(kept, key=str) == sorted([*[x for x in rows if x[0] % 4], (5, None), (7, "apple")], key=str)


def test_shuffles_end_with_their_tables(spark):
    """Files of a shuffle go once the table made by it is written, not at the driver's next collection; the setting stays as it was."""
    import time

    from lodestar.llm.common import tidied, written

    def files():
        return sum(1 for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f)

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, start = spark.conf.get(key, "false"), files()
    with tidied(spark):
        assert spark.conf.get(key) == "true"
    t = written(spark.range(10_000).selectExpr("id % 997 as k").groupBy("k").count(), "counts")
    for _ in range(50):
        if files() <= start:
            break
        time.sleep(0.1)
    assert files() <= start and t.count() == 997 and spark.conf.get(key, "false") == before
