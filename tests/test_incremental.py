"""What is kept up to date: each change against a run over everything, by small fixtures and plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.operators import audit, connect, embed, expand, graph
from lodestar.operators.pair_index import PairIndex
from lodestar.plans import pipelines, rounds
from lodestar.sources import pages, readers
from lodestar.sources.buckets import Buckets, Conflict
from lodestar.streaming import jobs

PAIRS = ("a", "b", "domain_a", "domain_b", "shared", "strong")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def papers_of(spark, papers):
    return spark.createDataFrame(papers, "paper_id string, domain string, tags array<string>, depth int")


def made(seed, n=60, tags=40, most=14):
    """Papers with a few tags that most have and many that few have."""
    r = random.Random(seed)
    weights = [30, 20, 10, *[1] * (tags - 3)]
    names = ["mamba_transformer", *[f"t{k}" for k in range(tags - 1)]]
    return [(f"p{k}", r.choice(["x", "y", "z"]), list(set(r.choices(names, weights, k=r.randrange(0, most)))), 1) for k in range(n)]


def brute(papers, scope="all", least=1, domains=None):
    out = []
    for x, y in itertools.combinations(sorted(papers), 2):
        both = set(x[2]) & set(y[2])
        fits = scope == "all" or (x[1] == y[1]) == (scope == "within")
        if len(both) >= least and both and fits and (not domains or {x[1], y[1]} == set(domains)):
            out.append((x[0], y[0], x[1], y[1], len(both), "mamba_transformer" in both))
    return sorted(out)


@pytest.mark.parametrize("how", ["blocks", "prefix", "tags", None])
def test_pairs_by_every_way(spark, how):
    papers = made(1)
    tagged = connect.tag_rows(papers_of(spark, papers))
    for scope, least, domains in (("all", 1, None), ("within", 3, None), ("cross", 2, ("x", "y")), ("all", 20, None)):
        assert rows(connect.pairs(tagged.unionByName(tagged), scope, domains, least=least, how=how), *PAIRS) == brute(papers, scope, least, domains)
    assert rows(connect.pairs(tagged.where("false"), how=how)) == []


def test_blocks_meet_each_pair_once(spark):
    papers = made(2, n=150)
    sets = connect.tag_rows(papers_of(spark, papers)).groupBy("paper_id", "domain").agg(F.collect_set("tag").alias("tags"))
    for scope in ("all", "within", "cross"):
        assert rows(connect.by_blocks(sets, scope, 1, postings=40), *PAIRS) == brute(papers, scope)


def test_prefixes_meet_a_fifth_of_the_rows(spark):
    papers = [(f"p{k:03}", "x", ["common", "usual", f"g{k // 4}", f"h{k // 4}"], 1) for k in range(200)]
    sets = connect.tag_rows(papers_of(spark, papers)).groupBy("paper_id", "domain").agg(F.collect_set("tag").alias("tags"))
    every = sets.select("paper_id", "domain", F.explode("tags").alias("tag"))
    all_rows = connect.met_in_blocks(every, "all", 50).count()
    some = connect.met_in_blocks(connect.prefixes(connect.in_order(sets, "all"), 3), "all", 50).count()
    assert all_rows > 39_000 and some * 5 < all_rows
    assert rows(connect.by_prefix(sets, "all", 3, 50), *PAIRS) == brute(papers, least=3)


def test_dense_sets_are_told_by_their_tags(spark):
    sets = lambda p: connect.tag_rows(papers_of(spark, p)).groupBy("paper_id", "domain").agg(F.collect_set("tag").alias("tags"))
    assert connect.dense(sets([(f"p{k}", "x", ["one", "two"], 1) for k in range(40)]), "all")
    assert not connect.dense(sets([(f"p{k}", "x", [f"t{k // 2}"], 1) for k in range(40)]), "all")
    assert not connect.dense(sets([]), "all")


def test_a_pair_index_equals_a_full_run(spark, tmp_path):
    papers = made(3, n=80)
    index = PairIndex(spark, str(tmp_path / "index"), buckets=4, block=7)
    first = index.update(papers_of(spark, papers[:70]))
    assert rows(first, *PAIRS) == brute(papers[:70]) == rows(index.pairs(), *PAIRS)
    # one new paper: its pairs alone are made
    delta = index.update(papers_of(spark, papers[:71]))
    new = papers[70][0]
    assert rows(delta, *PAIRS) == [p for p in brute(papers[:71]) if new in p[:2]] and rows(index.pairs(), *PAIRS) == brute(papers[:71])
    postings = lambda which: spark.createDataFrame([(p[0], p[1], t) for p in which for t in p[2]], "paper_id string, domain string, tag string")
    met, every = index.matches(postings(papers[70:71]), postings(papers[:70])), connect.met_in_blocks(postings(papers[:71]), "all", 7)
    assert met.count() * 20 < every.count()
    # a paper that loses tags, one that moves, one that is deeper, and the rest of the new ones
    later = [*papers]
    later[5] = (papers[5][0], papers[5][1], papers[5][2][:1], 1)
    later[6] = (papers[6][0], "elsewhere", papers[6][2], 1)
    later[7] = (*papers[7][:3], 4)
    changed = {r.paper_id for r in index.changed(papers_of(spark, later)).collect()}
    assert changed == {p[0] for p in papers[71:]} | {"p6", "p7"} | ({"p5"} if len(set(papers[5][2])) > 1 else set())
    index.update(papers_of(spark, later))
    assert rows(index.pairs(), *PAIRS) == brute(later)
    assert index.update(papers_of(spark, later)).count() == 0
    n = spark.read.parquet(f"{index.path}/pairs").count()
    index.compact()
    assert rows(index.pairs(), *PAIRS) == brute(later) and spark.read.parquet(f"{index.path}/pairs").count() <= n


def test_what_a_lost_update_wrote_does_not_count(spark, tmp_path, monkeypatch):
    papers = made(4, n=30)
    index = PairIndex(spark, str(tmp_path / "index"), buckets=4)
    index.update(papers_of(spark, papers[:20]))
    monkeypatch.setattr(index.papers, "upsert", lambda rows: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.update(papers_of(spark, papers))
    monkeypatch.undo()
    assert rows(index.pairs(), *PAIRS) == brute(papers[:20])
    index.update(papers_of(spark, papers))
    assert rows(index.pairs(), *PAIRS) == brute(papers)


def test_components_kept_up_to_date(spark):
    r = random.Random(5)
    edge = lambda n: [(r.randrange(40), r.randrange(40)) for _ in range(n)]
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    old, new = edge(20), [*edge(12), (None, 3), (4, 4), (50, 51)]
    labels = graph.components(frame(old))
    assert rows(graph.updated(labels, frame(new))) == rows(graph.components(frame(old + new)))
    gone = [e for e in old if e[0] != e[1]][:6]
    left = [e for e in old if e not in gone and e[::-1] not in gone]
    assert rows(graph.updated(labels, frame(new), frame(gone), frame(left))) == rows(graph.components(frame(left + new)))
    assert rows(graph.updated(labels, frame([]))) == rows(labels) and rows(graph.updated(labels.where("false"), frame(new))) == rows(graph.components(frame(new)))
    with pytest.raises(ValueError, match="all edges"):
        graph.updated(labels, frame(new), frame(gone))


def test_a_store_in_buckets(spark, tmp_path):
    store = Buckets(spark, str(tmp_path / "s"), ["k"], 8)
    frame = lambda x: spark.createDataFrame(x, "k long, v string")
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.schema() is None and store.remove(frame([(1, "a")])) == set()
    store.upsert(frame([(k, f"v{k}") for k in range(50)]))
    files = {b: f for b, f in store.manifest()["folders"].items()}
    touched = store.upsert(frame([(3, "new"), (99, "more")]), removed=frame([(4, "")]))
    assert len(touched) <= 3 and {b for b, f in store.manifest()["folders"].items() if files.get(b) != f} == {str(b) for b in touched}  # other buckets stay where they are
    want = {k: f"v{k}" for k in range(50) if k != 4} | {3: "new", 99: "more"}
    assert dict(rows(store.read())) == want and rows(store.find(frame([(3, ""), (4, ""), (10, "")]))) == [(3, "new"), (10, "v10")]
    assert store.upsert(frame([])) == set() and store.version() == 2
    store.upsert(spark.createDataFrame([(7,)], "k long"))
    assert dict(rows(store.read()))[7] is None
    with pytest.raises(ValueError, match="no columns"):
        store.upsert(spark.createDataFrame([(7, 1)], "k long, other int"))
    assert store.vacuum() > 0 and dict(rows(store.read())) == want | {7: None}
    # of two writers of one version the later fails
    other = Buckets(spark, str(tmp_path / "s"), ["k"])
    seen = other.manifest()
    store.upsert(frame([(1, "first")]))
    with pytest.raises(Conflict):
        other._commit(seen | {"version": seen["version"] + 1})
    assert dict(rows(other.read()))[1] == "first"


def plain_fold(vectors, threshold):
    kept, out = [], []
    for v in vectors:
        size = np.linalg.norm(v)
        x = v / size if size > 0 else v
        s = max((float(k @ x) for k in kept), default=0.0)
        out.append(s)
        if s < threshold:
            kept.append(x)
    return out


@pytest.mark.parametrize("block", [1, 3, 256])
def test_fold_in_blocks(spark, block):
    rng = np.random.default_rng(4)
    vectors = {f"paper {k}": rng.normal(0, 1, (n, 3)) for k, n in enumerate((1, 40, 7))}
    vectors["paper 1"][5] = 0
    frame = spark.createDataFrame([(p, k, v.tolist()) for p, x in vectors.items() for k, v in enumerate(x)], "paper_id string, seq int, vec array<double>")
    got = {(r.paper_id, r.seq): (r.score, r.redundant) for r in expand.fold(frame, 0.9, block=block).collect()}
    for p, x in vectors.items():
        for k, s in enumerate(plain_fold(x, 0.9)):
            assert abs(got[p, k][0] - s) < 1e-9 and got[p, k][1] == (s >= 0.9)
    # what is known beforehand counts as accepted and isn't returned
    known, late = frame.where("seq < 4 and paper_id = 'paper 1'"), frame.where("seq >= 4 or paper_id <> 'paper 1'")
    assert expand.fold(late, 2.0, known, block).count() == late.count()
    assert rows(expand.fold(late, 2.0, known, block), "paper_id", "seq") == rows(late, "paper_id", "seq")
    empty = spark.createDataFrame([("p", 1, None), ("p", 2, None)], "paper_id string, seq int, vec array<double>")
    assert rows(expand.fold(empty)) == [("p", 1, 0.0, False), ("p", 2, 0.0, False)]


def expansion_items(spark, seed=6, papers=8):
    rng = np.random.default_rng(seed)
    out = []
    for p in range(papers):
        for k in range(rng.integers(1, 16)):
            text = '{"statement": "s%d", "confidence": "%s"}' % (k, rng.choice(["speculative", "derived"], p=[0.8, 0.2])) if rng.random() > 0.1 else '{"none": 1}'
            out.append((f"p{p}", k, k // 3, "derivations", text, rng.normal(0, 1, 3).tolist()))
    return spark.createDataFrame(out, "paper_id string, seq long, batch long, bucket string, payload string, vec array<double>")


def test_rounds_equal_one_fold_and_go_on_after_a_loss(spark, tmp_path):
    items = expansion_items(spark)
    targets = spark.createDataFrame([(f"p{k}", 1 + k % 3, k % 2) for k in range(9)], "paper_id string, pages int, recorded_depth int")
    want = pipelines.expansion(items, targets, 2, threshold=0.7)
    columns = ("paper_id", "seq", "redundant", "speculative", "text")
    asked = []

    def source(open_, k):
        asked.append((k, {r.paper_id for r in open_.collect()}))
        if len(asked) == 3 and k == 3:
            raise OSError("lost")
        return rounds.batches_of(items)(open_, k)

    folder = str(tmp_path / "rounds")
    with pytest.raises(OSError):
        rounds.expansion(source, targets, folder, 2, threshold=0.7)
    made_ = rounds.expansion(source, targets, folder, 2, threshold=0.7)
    assert rows(made_["items"], *columns) == rows(want["items"], *columns)
    assert rows(made_["headers"]) == rows(want["headers"])
    assert [k for k, _ in asked][:4] == [1, 2, 3, 3]  # rounds before the loss aren't asked for again
    assert all(later <= sooner for (_, sooner), (_, later) in itertools.pairwise(asked))
    assert {r.criterion for r in made_["headers"].collect()} >= {"completed", "hard_cap"}
    n = len(asked)
    assert rows(rounds.expansion(source, targets, folder, 2, threshold=0.7)["headers"]) == rows(want["headers"]) and len(asked) == n


def test_only_targets_are_expanded(spark, tmp_path):
    items = expansion_items(spark, 7)
    targets = spark.createDataFrame([("p1", 5, None)], "paper_id string, pages int, recorded_depth int")
    got = rounds.expansion(rounds.batches_of(items), targets, str(tmp_path / "r"), 3)
    assert {r.paper_id for r in got["items"].collect()} == {"p1"} == {r.paper_id for r in got["headers"].collect()}
    none = rounds.expansion(rounds.batches_of(items), targets.where("false"), str(tmp_path / "s"), 3)
    assert none["items"] is None and none["headers"].count() == 0


def test_topk_with_pivots_is_exact(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (6, 5))
    x = np.concatenate([c + rng.normal(0, 0.05, (60, 5)) for c in centres] + [np.zeros((3, 5)), centres[:1].repeat(40, 0)])
    store = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None)], "item_id long, vec array<double>")
    asked = store.where("item_id % 7 = 0").withColumnRenamed("item_id", "query_id")
    size = np.linalg.norm(x, axis=1)
    u = x / np.where(size > 0, size, 1)[:, None]
    want = []
    for q in range(0, len(x), 7):
        s = np.round(u @ u[q], 12)
        order = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-s[k], k))[:6]
        want += [(q, k, r + 1) for r, k in enumerate(order)]
    for kwargs in ({}, {"small": 0, "block": 20, "asked": 8}, {"small": 0, "block": 1000}):
        assert rows(embed.topk(store, asked, 6, **kwargs), "query_id", "item_id", "rank") == sorted(want)
    assert rows(embed.topk(store.where("false"), asked, 6)) == [] and rows(embed.topk(store, asked.where("false"), 6)) == []
    few = embed.topk(store.where("item_id in (1, 7, 9)"), asked.where("query_id = 7"), 6, small=0, block=1)
    assert {r.item_id for r in few.collect()} == {1, 9}


def test_far_blocks_are_skipped():
    pivots, radius = np.eye(3), np.array([0.1, 0.1, 0.1])
    q = np.array([[1.0, 0, 0], [0, 0.8, 0.6]])
    bound = embed.reach(q, pivots, radius)
    assert bound[0, 0] == 1 and abs(bound[0, 1] - np.cos(np.pi / 2 - 0.1)) < 1e-12 and bound[1, 1] > 0.8


def test_pair_depths_by_stream_and_batch(spark, tmp_path):
    parts = [[("a::b", 1, 1, 1), ("a::b", 2, 1, 1), ("c::d", 3, None, 2)], [("a::b", 5, 3, 1), ("c::d", 6, 0, 2)], [("a::b", 4, 2, 2), ("a::b", 9, 3, 2), ("e::f", 8, 0, 0)]]
    schema = "pair string, seq long, depth_a int, depth_b int"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_available(jobs.opened_pairs(jobs.inbox(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "pair", "seq", "reason")
    # the late event 4 opens its pair again, as it is deeper than what the state holds
    assert got == [("a::b", 1, "initial"), ("a::b", 4, "depth_upgrade"), ("a::b", 5, "depth_upgrade"), ("c::d", 3, "initial"), ("e::f", 8, "initial")]
    arrived = spark.createDataFrame([(p, k, a, b) for k, (p, _, a, b) in enumerate(x for part in parts for x in part)], schema)
    assert len(rows(connect.opened(arrived))) == len(got)


def test_page_source(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes("one\ftwo é".encode())
    (tmp_path / "in" / "deep" / "b.txt").write_text(" \n")
    (tmp_path / "in" / "c.txt").write_text("")
    (tmp_path / "in" / "d.other").write_text("no")
    got = pages.pages(spark, str(tmp_path / "in"), ".txt", partition_bytes=4)
    assert got.rdd.getNumPartitions() == 2
    found = sorted((r.path.rpartition("/")[2], r.page, r.page_count, r.text, r.encrypted, r.image_only) for r in got.collect())
    assert found == [("a.txt", 1, 2, "one", False, False), ("a.txt", 2, 2, "two é", False, False), ("b.txt", 1, 1, " \n", False, True), ("c.txt", 1, 1, "", False, True)]
    put = {r.path.rpartition("/")[2]: r for r in pages.documents(got).collect()}
    old = {r.path.rpartition("/")[2]: r for r in readers.documents(spark, str(tmp_path / "in")).collect()}
    assert all((put[n].text, put[n].page_count, put[n].encrypted, put[n].image_only) == (old[n].text, old[n].page_count, old[n].encrypted, old[n].image_only) for n in old)
    assert pages.pages(spark, str(tmp_path / "in" / "deep"), ".pdf").count() == 0


def test_blocks_in_reading_order(spark):
    blocks = [(300.0, 10.0, "right top"), (20.0, 30.0, "left low"), (20.0, 10.0, "left top"), (300.0, 50.0, "right low"), (21.0, 60.0, "left last")]
    frame = spark.createDataFrame([(1, *b) for b in blocks], "page int, x double, y double, text string")
    assert pages.in_reading_order(blocks) == readers.reading_order(frame, ["page"]).first().text
    assert pages.in_reading_order([]) == "" and pages.in_reading_order(blocks[:1]) == "right top"


def test_payloads_as_variants(spark):
    payloads = ['{"content": " a ", "closable": "false"}', '{"content": [1], "item": {"x": 1}, "question": 7}', '{"closable": 0, "can_close": true}', '{"closable": null, "can_close": []}', '{"answerable": 1.5}', '{"closable": ""}', "no json", None, '{"content": "x\\u00e9", "closable": {"a": 1}}']
    rows_ = spark.createDataFrame([(k, "open_questions", p) for k, p in enumerate(payloads)], "k int, bucket string, payload string")
    got = {r.k: (r.text, r.closable) for r in expand.normalised(rows_).collect()}
    assert got == {0: ("a", True), 1: ("7", False), 2: (None, False), 3: (None, False), 4: (None, True), 5: (None, False), 6: (None, False), 7: (None, False), 8: ("xé", True)}
    stores = ["[1, 2, 3]", '{"entries": [1, 2]}', '{"nodes": [1], "edges": [1, 2]}', '{"a": 1, "b": 2}', "7", "broken {", None, '{"nodes": 3, "edges": {}}']
    counts = spark.createDataFrame(list(enumerate(stores)), "k int, p string").select("k", audit.store_counts(F.col("p")).alias("c")).orderBy("k").collect()
    assert [(r.c.nodes, r.c.edges) for r in counts] == [(3, 0), (2, 0), (1, 2), (2, 0), (0, 0), (0, 0), (0, 0), (2, 0)]


def test_blocks_shuffle_no_papers(spark):
    """Blocks are read from the shared folder: what is dealt out for a pair of blocks is a row of a list, and no paper."""
    papers = made(7, n=120)
    sets = connect.tag_rows(papers_of(spark, papers)).groupBy("paper_id", "domain").agg(F.collect_set("tag").alias("tags"))
    found = connect.by_blocks(sets, "all", 1, postings=60)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "paper_id" not in text.partition("MapInArrow")[2].partition("Exchange")[2]
    ordered = connect.in_order(sets, "within")
    assert rows(connect.by_blocks(ordered, "within", 4, postings=60, heads=True), *PAIRS) == brute(papers, "within", 4)


def test_links_connect_what_pairs_connect(spark):
    papers = made(8, n=120)
    tagged = connect.tag_rows(papers_of(spark, papers))
    want = brute(papers, "within", 3)
    of = lambda edges: {r.node: r.component for r in graph.components(edges.selectExpr("a as u", "b as v")).collect()}
    every = of(spark.createDataFrame([p[:2] for p in want], "a string, b string"))
    for postings in (None, 50):
        edges = connect.linked(tagged, "within", 3, postings=postings)
        assert of(edges) == every
        n = {}
        for a, _, k in rows(edges, "a", "b", "links"):
            n[every[a]] = n.get(every[a], 0) + k
        assert n == {c: sum(every[p[0]] == c for p in want) for c in set(every.values())}
    assert edges.count() < len(want)


def test_pairs_bring_columns_and_vectors_of_both(spark):
    papers = made(9, n=50)
    tagged = connect.tag_rows(papers_of(spark, papers))
    more = spark.createDataFrame([(p[0], k) for k, p in enumerate(papers) if k % 3], "paper_id string, depth int")
    vectors = spark.createDataFrame([(p[0], [float(k % 5), 1.0, float(k % 3)][: 1 + k % 3]) for k, p in enumerate(papers) if k % 4], "paper_id string, vec array<double>")
    got = {}
    for how in ("blocks", "tags"):
        found = connect.pairs(tagged, "all", how=how, more=more, vectors=vectors)
        got[how] = sorted((r.a, r.b, r.depth_a or -1, r.depth_b or -1, round(r.similarity, 9)) for r in found.collect())
    assert got["blocks"] == got["tags"] and any(r[4] > 0 for r in got["tags"]) and any(r[2] > 0 for r in got["tags"])


@pytest.mark.parametrize("scope", ["all", "within"])
def test_a_log_comes_along_with_blocks(spark, scope):
    """Logged pairs are neither broadcast nor joined with pairs, and the report counts kinds of pairs; ids may hold the separator."""
    papers = [(f"p::{p[0]}" if k % 3 else f"{p[0]}:", *p[1:]) for k, p in enumerate(made(10, n=90))]
    depth = {p[0]: k % 4 or None for k, p in enumerate(papers)}
    frame = papers_of(spark, papers).drop("exhausted_at_depth").join(spark.createDataFrame(list(depth.items()), "paper_id string, exhausted_at_depth int"), "paper_id")
    vecs = {p[0]: [float(k % 5), 1.0] for k, p in enumerate(papers) if k % 4}
    pairs_ = brute(papers, scope)
    old = {(a, b): (k % 3, None if k % 5 == 0 else 2) for k, (a, b, *_) in enumerate(pairs_) if k % 7 < 2}
    rows_ = [("::".join(sorted(p)), *d) for p, d in old.items()]
    log = spark.createDataFrame([*rows_, *[(r[0], 0, 0) for r in rows_[::2]], ("p::p1::gone", 3, 3), ("nothing", 1, 1)], "pair string, depth_a int, depth_b int")

    def reason(a, b, d, e, shared, strong):
        x, y = vecs.get(a), vecs.get(b)
        cos = sum(p * q for p, q in zip(x, y, strict=True)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5 if x and y else 0.0
        if (a, b) in old and (depth[a] or 0) <= (old[a, b][0] or 0) and (depth[b] or 0) <= (old[a, b][1] or 0):
            return "skipped_analyzed"
        if cos < 0.9 and not strong and shared < 2:
            return "skipped_similarity"
        if int("".join(filter(str.isdigit, a))) % 5 == 0 or int("".join(filter(str.isdigit, b))) % 5 == 0:
            return "missing_records"
        return "below_confidence" if d != e else "kept"

    library = frame.where(F.regexp_extract("paper_id", "[0-9]+", 0).cast("int") % 5 != 0)
    means = spark.createDataFrame(list(vecs.items()), "paper_id string, vec array<double>")
    got = pipelines.connections(frame, log, means, library, scope=scope, settings=Settings(similarity=0.9), upgrades=True)
    text = got["candidates"]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Join" not in text
    want = {(p[0], p[1]): reason(*p) for p in pairs_}
    assert {(r.a, r.b): r.reason for r in got["candidates"].collect()} == want and len(set(want.values())) == (5 if scope == "all" else 4)
    few = connect.Blocks(spark.createDataFrame([("p1", "x", ["t"]), ("p2", "x", ["t"])], "paper_id string, domain string, tags array<string>"), scope, [], None, marks=connect.of_keys(log.where("pair = 'p1::p2'"), "string"))
    assert few.mark_kinds(9) == 0 and few.pairs(1).first().asDict() == {"a": "p1", "b": "p2", "domain_a": "x", "domain_b": "x", "shared": 1, "strong": False, "depth_a": None, "depth_b": None}
    report = got["report"].first()
    assert report.candidates == len(want) and all(report[k] == sum(v == k for v in want.values()) for k in connect.REASONS)
    assert "(a" not in got["report"]._jdf.queryExecution().analyzed().toString().partition("MapInArrow")[2].partition("Repartition")[0]


@pytest.mark.parametrize("how", ["blocks", "tags"])
def test_pairs_are_counted_by_kind(spark, how):
    papers = made(12, n=100)
    number = lambda id_: F.substring(id_, 2, 9).cast("int")
    got = connect.tally(connect.tag_rows(papers_of(spark, papers)), "all", lambda i: number(i) % 3, 3, lambda i: number(i) % 4, 4, most=3, how=how)
    want = {}
    for a, b, d, e, shared, strong in brute(papers):
        kind = (int(a[1:]) % 3, int(b[1:]) % 4, min(shared, 3), strong, d != e)
        want[kind] = want.get(kind, 0) + 1
    assert {tuple(r)[:-1]: r.n for r in got.collect()} == want


@pytest.mark.parametrize("scope", ["within", "all", "cross"])
def test_blocks_count_only_pairs_with_an_asking_set(spark, scope):
    papers = made(13, n=110)
    sets = connect.tag_rows(papers_of(spark, papers)).groupBy("paper_id", "domain").agg(F.collect_set("tag").alias("tags"))
    asks = {p[0] for k, p in enumerate(papers) if k % 4 == 0}
    blocks = connect.Blocks(sets.withColumn("_asks", F.col("paper_id").isin(*asks)), scope, connect.HIGH_SIGNAL_TAGS, 40, asking="_asks")
    assert rows(blocks.pairs(1), *PAIRS) == [p for p in brute(papers, scope) if {p[0], p[1]} & asks]


@pytest.mark.parametrize("scope", ["within", "all"])
def test_components_need_few_pairs(spark, scope, monkeypatch):
    """What papers with many tags connect isn't counted again; small components are found all the same."""
    papers = made(14, n=150, most=20) + [(f"q{k}", "xy"[k % 2], [f"s{k // 6}", f"u{k // 6}", f"v{k // 6}"], 1) for k in range(40)]
    tagged, counted = connect.tag_rows(papers_of(spark, papers)), []
    init = connect.Blocks.__init__
    monkeypatch.setattr(connect.Blocks, "__init__", lambda self, sets, *a, **b: (counted.append(sets.where("_asks").count()), init(self, sets, *a, **b))[1])
    of = lambda edges: {r.node: r.component for r in graph.components(edges.selectExpr("a as u", "b as v")).collect()}
    want = of(spark.createDataFrame([p[:2] for p in brute(papers, scope, 3)], "a string, b string"))
    assert of(connect.connected(tagged, scope, 3, postings=60, large=0, hubs=60)) == want and len(set(want.values())) > 5
    assert len(counted) == 2 and sum(counted) < 110 and of(connect.connected(tagged, scope, 3, postings=60, large=0, hubs=1)) == want


@pytest.mark.parametrize("small", [0, 1000])
def test_an_index_joins_no_pairs_with_papers(spark, tmp_path, small):
    """Pairs of new papers with many tags come from blocks with both versions, and current ones are told without a shuffle."""
    papers = made(15, n=120)
    index = PairIndex(spark, str(tmp_path / "index"), buckets=4, small=small)
    index.update(papers_of(spark, papers[:80]))
    later = [(*p[:2], p[2][:2], 5) if k % 9 == 0 else p for k, p in enumerate(papers)]
    delta = index.update(papers_of(spark, later))
    new = {p[0] for k, p in enumerate(later) if k >= 80 or k % 9 == 0}
    assert rows(delta, *PAIRS) == [p for p in brute(later) if {p[0], p[1]} & new] and rows(index.pairs(), *PAIRS) == brute(later)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = index.pairs()._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("Exchange hashpartitioning" in text) == (small == 0)
    sets = spark.createDataFrame([(p[0], p[1], p[2], "v", k % 2 == 0) for k, p in enumerate(papers) if p[2]], "paper_id string, domain string, tags array<string>, version string, _asks boolean")
    made_ = index._met(sets.where("_asks"), sets.where("_asks").select("paper_id", "domain", F.explode("tags").alias("tag")), sets.where("not _asks").select("paper_id", "domain", "version", F.explode("tags").alias("tag")), "w")
    assert "MapInArrow" in (plan := made_._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan
