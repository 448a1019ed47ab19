"""Assertions on small fixtures, one group for each family of operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import config
from lodestar.functions import links, numeric, text
from lodestar.operators import audit, classify, connect, contracts, embed, expand, gaps, graph, prior_art, registry, review
from lodestar.sources import readers, writers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


# ---- configuration ---------------------------------------------------------------------------------------------------


def test_layers_override_and_bad_values_fall_back():
    s = config.load({"similarity": "0.7", "batch_size": "x"}, {"multipliers": {"1": "3", "9": "bad"}, "unknown": 1})
    assert s.similarity == 0.7 and s.batch_size == 3 and s.multipliers[1] == 3 and s.multipliers[5] == 12
    assert config.set_nested({"a": {"b": 1}}, "a.c", 2) == {"a": {"b": 1, "c": 2}}
    assert config.coerced(bool, "YES", False) is True and config.coerced(int, None, 4) == 4


# ---- texts -----------------------------------------------------------------------------------------------------------

ABSTRACT = "We present a sparse routing layer for long inputs, using gated block attention over tokens. Results show lower loss at equal cost! Short one. The loss is L = a + b where all terms are positive and bounded."


def test_sentences_and_claims(spark):
    rows = spark.createDataFrame([(1, ABSTRACT), (2, None), (3, "tiny")], "id int, t string")
    got = {r.id: r for r in rows.select("id", text.sentences(F.col("t")).alias("s"), text.claims(text.sentences(F.col("t")), F.lit("f.pdf")).alias("c"), text.methods(text.sentences(F.col("t"))).alias("m")).collect()}
    assert len(got[1].s) == 3 and got[1].c[0].confidence == "hypothesized" and got[1].c[1].confidence == "demonstrated"
    assert got[1].m[0].name == "gated block attention over tokens"
    assert got[2].s == [] and got[2].c[0].statement == "Automated ingest found content in f.pdf." and got[3].m[0].name == "automated text parsing"


def test_other_extraction(spark):
    t = F.lit(ABSTRACT)
    assert one(spark, text.techniques(t), a=1) == ["attention", "routing", "loss"]
    assert one(spark, text.tags(F.lit("Neural"), t), a=1) == ["ingested", "fallback", "attention", "sparse_computation", "routing", "optimization", "neural_networks"]
    assert any("L = a + b" in e for e in one(spark, text.equations(t), a=1))
    assert one(spark, text.year(F.lit("x 1850 of 2021 and 1999")), a=1) == 2021
    assert one(spark, text.year(F.lit("none 12345")), a=1) is None
    assert one(spark, text.authors(F.lit("T - A B, C, , D, E, F\nx")), a=1) == ["A B", "C", "D", "E"] and one(spark, text.authors(F.lit("x")), a=1) == ["Unknown"]
    assert one(spark, text.references(F.lit("a\nReferences\n one \n\ntwo")), a=1) == ["References", "one", "two"] and one(spark, text.references(F.lit("none")), a=1) == []
    assert one(spark, text.abstract_like(F.lit("x\nIn this paper we look at many things")), a=1) == "In this paper we look at many things"
    assert one(spark, text.examples(F.lit("try (e.g., a, b/c; d)")), a=1) == ["a", "b", "c", "d"]
    assert one(spark, text.connection_stem(F.lit("cluster_a_1_b_2_7")), a=1) == "a_1_b_2"
    assert one(spark, text.normalized(F.lit("Œuvre ﬁne: X-ray")), a=1) == "oeuvre fine x ray"
    assert one(spark, text.paper_type(F.array(F.lit("a Review")), F.lit(True)), a=1) == "review" and one(spark, text.paper_type(F.array(F.lit("x")), F.lit(False)), a=1) == "commentary"


def test_ids_and_slugs(spark):
    import hashlib

    n = int(hashlib.sha1(b"a_b.pdf").hexdigest()[:10], 16) % 10**9
    assert one(spark, text.paper_id(F.lit("Looped World-Models!"), F.lit("a_b.pdf")), a=1) == f"loopedworldmodels_{n:09d}"
    assert one(spark, text.paper_id(F.lit("???"), F.lit("a_b.pdf")), a=1) == f"paper_{n:09d}"
    assert one(spark, text.slug(F.lit("--A  b__C--")), a=1) == "a-b-c" and one(spark, text.slug(F.lit("!!")), a=1) == "item"
    assert one(spark, text.title(F.lit(" "), F.lit(None).cast("string"), F.lit("my_file.pdf")), a=1) == "my file"
    assert one(spark, text.shorten(F.lit("a  b " * 100), 20), a=1) == "a b a b a b a b a..."


# ---- numbers ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("x,dialect,fallback,want", [("high", "connect", 0, 4), ("very low", "connect", 0, 1), ("very_low", "connect", 3, 3), ("very_low", "detect", 0, 1), ("4.9", "connect", 0, 4), ("99", "connect", 0, 5), ("-3", "detect", 0, 1), ("", "connect", 2, 2), ("true", "connect", 7, 7), ("likely", "migrate", 0, 3), ("Very High", "migrate", 0, 5), (None, "export", 3, 3)])
def test_confidence(spark, x, dialect, fallback, want):
    assert one(spark, numeric.confidence(F.lit(x).cast("string"), dialect, fallback), a=1) == want


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 4) for r in rows.select(numeric.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.7071, 0.0]
    v = one(spark, numeric.hash_vector(F.lit("x")), a=1)
    import hashlib

    assert v == pytest.approx([b / 255 - 0.5 for b in hashlib.sha256(b"x").digest()])


def test_budget_and_domain_confidence(spark):
    m = config.Settings().multipliers
    assert [one(spark, numeric.item_budget(F.lit(p), F.lit(d), m), a=1) for p, d in ((3, 1), (0, 2), (3, 5), (3, 9))] == [6, 48, 36, 36]
    assert [one(spark, numeric.domain_confidence(F.lit(t).cast("double"), F.lit(s).cast("double")), a=1) for t, s in ((None, None), (0.5, None), (0.95, None), (3.0, 0.5))] == [0.15, 0.35, 0.742, 0.98]


# ---- links -----------------------------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {"https://arxiv.org/abs/1234.5678": "https://arxiv.org/pdf/1234.5678.pdf", "https://www.arxiv.org/html/1.2/": "https://arxiv.org/pdf/1.2.pdf", "https://notarxiv.org/abs/1": None, "https://x.org/a.PDF?download=1": "https://x.org/a.PDF?download=1", "https://x.org/landing": None, "nonsense": None}
    for u, want in cases.items():
        assert one(spark, links.resolve_url(F.lit(u)), a=1) == want
    assert one(spark, links.is_pdf(F.lit("http://x/y"), F.lit("application/PDF"), F.lit("")), a=1) and not one(spark, links.is_pdf(F.lit("http://x/y"), F.lit("text/html"), F.lit("<html")), a=1)


def test_json_in_text(spark):
    assert one(spark, links.salvaged_json(F.lit('so: ```json {"a": 1} ```')), a=1) == '{"a": 1}'
    assert one(spark, links.salvaged_json(F.lit("none {x")), a=1) is None


# ---- pairs -----------------------------------------------------------------------------------------------------------


def test_pairs_and_pruning(spark):
    rows = [("a1", "ML", ["Fallback", "mixture_of_experts ", "latent_moe"]), ("a2", "ML", ["ingested", "latent_moe", "mixture_of_experts"]), ("b1", "ML", ["ingested", "fallback"]), ("c1", "ML", ["inference", "long"]), ("c2", "ML", ["inference", "fp8"]), ("d1", "physics", ["world_model"]), ("d2", "ML", ["world_model"]), ("e", "ML", None)]
    papers = spark.createDataFrame(rows, "paper_id string, domain string, tags array<string>")
    tags = connect.tag_rows(papers)
    pairs = {(r.a, r.b): r for r in connect.pairs(tags, "all").collect()}
    assert set(pairs) == {("a1", "a2"), ("c1", "c2"), ("d1", "d2")} and pairs["a1", "a2"].shared == 2
    assert {(r.a, r.b) for r in connect.pairs(tags).collect()} == {("a1", "a2"), ("c1", "c2")}
    assert {(r.a, r.b) for r in connect.pairs(tags, "cross", ("ML", "physics")).collect()} == {("d1", "d2")}
    assert {(r.a, r.b) for r in connect.pairs(tags, "all", paper="c2").collect()} == {("c1", "c2")}
    made = connect.pairs(tags, "all")
    worth = lambda s: {(r.a, r.b) for r in made.where(connect.worth(F.lit(s), F.col("strong"), F.col("shared"), 0.82)).collect()}
    assert worth(0.0) == {("a1", "a2"), ("d1", "d2")} and worth(0.91) == set(pairs)


def test_only_exhausted_papers_pair(spark):
    papers = spark.createDataFrame([("a", "x", ["t"], "exhausted"), ("b", "x", ["t"], "pending")], "paper_id string, domain string, tags array<string>, status string")
    assert connect.pairs(connect.tag_rows(papers)).count() == 0


def test_logged_pairs(spark):
    f = lambda now, old, upgrades: one(spark, connect.already(F.lit(True), F.lit(now), F.lit(1), F.lit(old), F.lit(1), upgrades), a=1)
    assert f(1, 1, True) and not f(3, 1, True) and f(3, 1, False) and not f(1, None, True)
    events = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "z")], "pair string, pos int, v string")
    assert {(r.pair, r.v) for r in connect.latest(events, "pair", [F.col("pos")]).collect()} == {("p", "y"), ("q", "z")}


def test_judgement_reasons_and_report(spark):
    c = spark.createDataFrame([("a", "b", "x", "x", 2), ("a", "c", "x", "y", 2), ("b", "c", "x", "x", 3)], "a string, b string, domain_a string, domain_b string, shared int")
    plain = {(r.a, r.b): r for r in connect.judged(c).collect()}
    assert plain["a", "b"].score == 6.0 and plain["a", "c"].confidence == 2
    answers = spark.createDataFrame([("a", "b", "t", "high", "speculative"), ("b", "c", "t", "low", "strange")], "a string, b string, connection_type string, confidence string, novelty string")
    rows = connect.with_reason(connect.judged(c, answers))
    assert {(r.a, r.b): r.reason for r in rows.collect()} == {("a", "b"): "kept", ("a", "c"): "below_confidence", ("b", "c"): "below_confidence"}
    r = connect.report(rows).first()
    assert r.candidates == sum(r[k] for k in connect.REASONS) == 3


# ---- classification, vectors -----------------------------------------------------------------------------------------


def test_classifier(spark):
    docs = spark.createDataFrame([(1, "Looped World Models"), (2, "Looped World Models with latent dynamics and a looped transformer"), (3, ""), (4, "Meta-learning"), (5, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in classify.classified(docs, classify.rule_rows(spark)).collect()}
    assert got[1].domain == "ML" and got[2].domain == "ML" and got[2].confidence >= 0.65
    assert got[3].domain == "unclassified" and got[3].confidence == 0.15 and got[5].domain == "unclassified"
    assert got[4].score == pytest.approx(2.0)  # both spellings of one cue count


def test_upsert_is_idempotent(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "item_id string, v int")
    once = embed.upsert(store, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, embed.upsert(once, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_topk_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    store = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "item_id long, vec array<double>").repartition(4)
    q = store.where("item_id < 10").withColumnRenamed("item_id", "query_id")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for block in (4096, 3):
        got = embed.topk(store, q, 3, block).orderBy("query_id", "rank").collect()
        for i in range(10):
            s = u @ u[i]
            s[i] = -9
            assert [r.item_id for r in got if r.query_id == i] == np.argsort(-s)[:3].tolist()


# ---- expansion -------------------------------------------------------------------------------------------------------


def test_stop_rules_equal_a_fold(spark):
    r, rows, want = random.Random(3), [], {}
    for p in range(40):
        n, flags = r.randint(1, 30), []
        for seq in range(1, n + 1):
            flags.append((r.random() < 0.4, r.random() < 0.6))
            rows.append((p, seq, (seq - 1) // 3, *flags[-1]))
        why, at, batches = "completed", (n - 1) // 3, (n - 1) // 3 + 1
        for b in range(batches):
            seen = flags[: (b + 1) * 3]
            last = seen[-5:]
            if sum(not x for x, _ in seen) >= 12:
                why, at = "hard_cap", b
            elif len(last) == 5 and sum(x for x, _ in last) >= 3:
                why, at = "redundancy", b
            elif len(last) == 5 and all(y for _, y in last):
                why, at = "speculative_ceiling", b
            else:
                continue
            break
        want[p] = (at, why)
    items = spark.createDataFrame(rows, "paper_id int, seq int, batch int, redundant boolean, speculative boolean")
    assert {r.paper_id: (r.batch, r.criterion) for r in expand.stops(items, F.lit(12)).collect()} == want


def test_fold(spark):
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.1, 0.99], [1.0, 0.02]]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)] + [(2, 0, [0.0, 0.0])], "paper_id long, seq long, vec array<double>")
    got = {(r.paper_id, r.seq): r.redundant for r in expand.fold(rows, 0.85).collect()}
    assert [got[1, k] for k in range(5)] == [False, True, False, True, True] and got[2, 0] is False


def test_aliases(spark):
    rows = [("derivations", '{"content": " x ", "confidence": "Speculative"}'), ("derivations", '{"statement": ["l"], "item": "y"}'), ("open_questions", '{"prompt": "q", "closable": "false"}'), ("open_questions", '{"question": "q", "can_close": false}'), ("exercises", "{}")]
    got = expand.normalised(spark.createDataFrame(rows, "bucket string, payload string")).collect()
    assert [(g.text, g.confidence) for g in got[:2]] == [("x", "speculative"), ("y", "likely")]
    assert [g.closable for g in got[2:4]] == [True, False] and got[4].text is None and got[4].detail == "To be validated."


def test_eligibility(spark):
    rows = spark.createDataFrame([("a", "x", "exhausted", 3, 1), ("b", "x", "ingested_only", None, 2), ("c", "x", "exhausted", 1, 3), ("d", "y", "ingested_only", None, 4)], "paper_id string, domain string, status string, exhausted_at_depth int, registry_pos int")
    ids = lambda **k: {r.paper_id for r in expand.eligible(rows, 2, **k).collect()}
    assert ids(everything=True) == {"b", "c", "d"} and ids(domain="x") == {"b", "c"} and ids(domain="x", count=1) == {"b"} and ids(target="a") == set() and ids(target="a", reprocess=True) == {"a"}


# ---- graph and gaps --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_partition(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(r.choice([60, 150]))] + [(300 + k, 301 + k) for k in range(40)] + [(400, k) for k in range(401, 440)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_clusters_and_fallback(spark):
    edges = spark.createDataFrame([("b_2", "a_1"), ("b_2", "c_3"), ("x", "y")], "a string, b string")
    found = gaps.clusters(gaps.latest_edges(edges))
    r = found.first()
    assert found.count() == 1 and r.cluster_id == "cluster_a_1_b_2_3" and r.edges == 2
    assert gaps.hinted(found, ["c_3"]).count() == 1 and gaps.unseen(found, found).count() == 0 and gaps.unseen(found, found, forced=True).count() == 1
    h = gaps.fallback(found).first()
    assert h.summary == "Fallback synthesis across 3 papers based on 2 connections." and h.gaps[0].supporting_papers == ["a_1", "b_2", "c_3"]
    assert one(spark, gaps.override(F.array(F.lit(" a "), F.lit("a"), F.lit("b"))), a=1) is None


def test_gap_order(spark):
    rows = spark.createDataFrame([("c", 1, "2", "high"), ("c", 2, "4", "low"), ("c", 3, "4", "4"), ("c", 4, "4", "5")], "cluster_id string, pos int, feasibility string, confidence string")
    got = gaps.ranked(rows).orderBy("sorted_rank").collect()
    assert [(g.pos, g.rank) for g in got] == [(4, 3), (3, 2), (1, 1)]
    some = spark.sql("SELECT array(named_struct('rank', 2, 'd', 'b'), named_struct('rank', CAST(NULL AS INT), 'd', 'z'), named_struct('rank', 1, 'd', 'a')) AS g")
    assert [x.d for x in some.select(gaps.by_rank(F.col("g")).alias("g")).first().g] == ["a", "b", "z"]
    assert some.select(gaps.gap_at(F.col("g"), 9).alias("g")).first().g.d == "a"


# ---- registry, review ------------------------------------------------------------------------------------------------


def test_registry(spark):
    rows = spark.createDataFrame([("a", "pending", False), ("b", "exhausted", False)], "paper_id string, status string, connected boolean")
    new = spark.createDataFrame([("b", "pending", True), ("c", "pending", True)], "paper_id string, status string, connected boolean")
    assert {r.paper_id: r.status for r in registry.inserted(rows, new, "paper_id").collect()} == {"a": "pending", "b": "exhausted", "c": "pending"}
    flags = spark.createDataFrame([("a", True), ("z", True)], "paper_id string, connected boolean")
    assert {r.paper_id: r.connected for r in registry.updated(rows, flags, "paper_id").collect()} == {"a": True, "b": False}
    events = spark.createDataFrame([("a", 1, "ingested_only"), ("a", 2, "exhausted"), ("a", 3, "ingested_only")], "k string, t int, status string")
    assert [r.t for r in registry.regressions(events, "k", ["t"]).collect()] == [3]


def test_promotion_needs_reviewer_and_note(spark):
    h = spark.createDataFrame([("c1", ["a", "ghost"], "pending_review"), ("c2", ["b"], "pending_review")], "cluster_id string, paper_ids array<string>, status string")
    d = spark.createDataFrame([("c1", "needs_prior_art", "me", "why"), ("c2", "accepted", "me", " ")], "cluster_id string, decision string, reviewer string, note string")
    papers = spark.createDataFrame([("a", False), ("b", False)], "paper_id string, triaged boolean")
    out, flagged = registry.promoted(h, d, papers)
    assert {r.cluster_id: r.status for r in out.collect()} == {"c1": "investigate", "c2": "pending_review"}
    assert {r.paper_id: r.triaged for r in flagged.collect()} == {"a": True, "b": False}


def test_review(spark):
    gap = "named_struct('rank', 1, 'supporting_papers', array('a', 'zz'), 'confidence', 4, 'feasibility', 9, 'suggested_approach', 'look')"
    h = spark.sql(f"SELECT 'c1' AS cluster_id, array('a', 'b', 'g') AS paper_ids, 'pending_review' AS status, array({gap}) AS gaps")
    ids = spark.createDataFrame([("a",), ("b",), ("g",)], "paper_id string")
    con = spark.createDataFrame([("a", "b")], "a string, b string")
    got = {r.check: r for r in review.checks(h, ids, ids.where("paper_id <> 'g'"), con).collect()}
    status = {k: v.status for k, v in got.items()}
    assert status == {"hypothesis_status": "pass", "cluster_size": "pass", "library_records": "pass", "exhaustion_records": "warn", "connection_support": "pass", "candidate_gaps": "pass", "gap_1_supporting_papers": "fail", "gap_1_scores": "fail", "gap_1_experiment_specificity": "warn", "prior_art_search": "warn"}
    assert got["gap_1_supporting_papers"].detail.endswith("outside the cluster: zz.") and got["exhaustion_records"].detail == "Missing exhaustion records: g."
    assert review.verdicts(review.checks(h, ids, ids, con)).first().decision == "rejected"


def test_drafts_and_experiments(spark):
    rows = spark.createDataFrame([("cluster_a", None, "d", "compare (e.g., x, y) and measure " + "z" * 80, ["p", "q"])], "cluster_id string, summary string, description string, approach string, papers array<string>")
    r = review.drafts(rows, F.lit("2026-01-02")).first()
    assert r.markdown.startswith("---\ngap_id: cluster_a\n") and "\\n" not in r.markdown and r.index_line.endswith("papers:p,q\n") and r.file == "cluster-a.md"
    e = review.experiments(rows.select("cluster_id", "description", F.col("approach").alias("suggested_approach"), F.col("papers").alias("supporting_papers"))).first()
    assert e.variants == ["x", "y"] and e.readiness == "pilot_ready"


# ---- prior art, signals, contracts -----------------------------------------------------------------------------------


def test_prior_art(spark):
    rows = [("k", 1, "A", "https://arxiv.org/html/1", "blocking"), ("k", 2, "A", "https://arxiv.org/abs/1", "blocking"), ("k", 3, "", "https://x.org/p.pdf", "partial"), ("k", 4, "P", "https://x.org/page", "blocking"), ("k", 5, "Q", None, "minor")]
    src = spark.createDataFrame(rows, "key string, pos int, title string, url string, impact string")
    q = prior_art.queue(src, ["blocking", "partial"])
    got = {r.pos: r for r in q.collect()}
    assert [got[k].status for k in (1, 2, 3, 4)] == ["queued", "queued", "queued", "manual_required"] and got[3].title == "source-3"
    assert got[1].file != got[2].file and got[2].file.endswith("_2.pdf")
    assert prior_art.totals(q).first().manual_required == 1
    done = spark.createDataFrame([("https://x.org/p.pdf", False), ("https://arxiv.org/pdf/1.pdf", True)], "url string, ok boolean")
    assert {r.pos: r.status for r in prior_art.queue(src, None, 3, done).collect()} == {1: "downloaded", 2: "downloaded", 3: "failed"}


def test_signals(spark):
    rows = spark.createDataFrame([("c", "text", None), ("d", None, None)], "k string, a string, b string")
    made = rows.select(*prior_art.envelope("hypothesis_candidate", F.col("k"), F.col("k"), F.col("a"), [("a", F.col("a")), ("b", F.col("b"))], F.lit(None).cast("string"), F.lit("4"), "speculative")).orderBy("signal_id").collect()
    assert [len(m.evidence) for m in made] == [1, 1] and made[1].evidence[0].excerpt == "No excerpt available." and made[0].status == "pending_review"


CONTRACT = {"id": {"type": "string", "required": True}, "n": {"type": "integer", "required": True, "default": 1, "minimum": 1}, "flag": {"type": "boolean"}, "when": {"type": "string", "format": "ISO 8601"}, "sub": {"type": "object", "fields": {"x": {"type": "number", "maximum": 2}}}}


def test_contracts_in_both_modes(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', '2', 'yes', '2024-01-02T03:04:05Z', named_struct('x', 1.0D)), (NULL, 'x', 'perhaps', 'soon', named_struct('x', 3.0D)), ('c', NULL, NULL, NULL, NULL) AS t(id, n, flag, `when`, sub)")
    lax = [r.e for r in rows.select(contracts.errors(rows, CONTRACT).alias("e")).collect()]
    assert lax[0] == [] and lax[2] == [] and lax[1] == ["/id: missing", "/n: expected integer", "/flag: expected boolean", "/when: expected ISO 8601", "/sub/x: maximum 2"]
    strict = [r.e for r in rows.select(contracts.errors(rows, CONTRACT, "strict").alias("e")).collect()]
    assert strict[2] == ["/n: missing"]
    fixed = contracts.fixed(rows, CONTRACT)
    assert [r.n for r in fixed.collect()] == ["2", "x", "1"] and fixed.first().flag == "true"
    assert contracts.errors(rows, CONTRACT, header_only=["id"]) is not None


def test_migrations_settle(spark):
    old = spark.createDataFrame([("x/within_domain/a", "p", "q", "shared_approach", "high"), ("x/cross_domain/a", "p", "q", "other", None)], "path string, paper_a string, paper_b string, connection_type string, confidence string")
    once = contracts.migrated_connections(old)
    twice = contracts.migrated_connections(once.withColumn("confidence", F.col("confidence").cast("string")))
    assert once.collect() == twice.collect() and once.first().confidence == 4 and once.first().connection_type == "methodological_overlap"
    lib = spark.createDataFrame([("a", "2020"), ("b", None)], "id string, year string")
    assert [r.year for r in contracts.migrated_library(lib).collect()] == [2020, 0]
    ex = spark.createDataFrame([("a", "9", "odd", None, " c2 ")], "id string, depth string, criterion string, source_claim string, follows_from string")
    e = contracts.migrated_expansions(ex).first()
    assert (e.depth, e.criterion, e.source_claim) == (5, "completed", "c2")
    assert [r.id for r in contracts.changed(lib, lib.withColumn("year", F.when(F.col("id") == "a", "1").otherwise(F.col("year"))), "id").collect()] == ["a"]


def test_gates(spark):
    c = spark.createDataFrame([("a", "b", "non-obvious"), ("a", "c", "obvious")], "a string, b string, novelty string")
    cites = spark.createDataFrame([("b", "a"), ("c", "a")], "citing string, cited string")
    assert [(r.a, r.b) for r in audit.novelty_gate(c, cites).collect()] == [("a", "b")]
    told = c.withColumn("cited", F.col("b") == "b")
    assert [(r.a, r.b) for r in audit.novelty_gate(told).collect()] == [("a", "b")]
    d = spark.createDataFrame([("p", "claim_1", "derived"), ("p", "claim_9", "derived"), ("p", "claim_9", "likely")], "paper_id string, source_claim string, confidence string")
    assert audit.unbacked_gate(d, spark.createDataFrame([("p", "claim_1")], "paper_id string, claim_id string")).count() == 1
    again = audit.resurfaced_gate(spark.createDataFrame([("k", "e1"), ("m", "e2")], "key string, evidence string"), spark.createDataFrame([("k", "e1"), ("m", "e1")], "key string, evidence string"))
    assert [r.key for r in again.collect()] == ["k"]
    assert one(spark, audit.path_allowed(F.lit("src/a.py"), ["src/", "docs/"]), a=1) is True
    assert one(spark, audit.store_counts(F.lit('{"nodes": [1, 2], "edges": [1]}')), a=1).asDict() == {"nodes": 2, "edges": 1}
    assert one(spark, audit.store_counts(F.lit("[1, 2, 3]")), a=1).nodes == 3


# ---- sources and sinks -----------------------------------------------------------------------------------------------


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("1 Intro\nMETHODS\nbody\fmore")
    (tmp_path / "in" / "b.txt").write_text("x")
    (tmp_path / "in" / "e.pdf").write_text("  ")
    assert [r.name for r in readers.listing(spark, f"{tmp_path}/in").collect()] == ["a.pdf", "e.pdf"]
    assert {r.suffix: r.files for r in readers.counts_by_suffix(spark, f"{tmp_path}/in").collect()} == {"pdf": 2, "txt": 1}
    docs = readers.usable(readers.documents(spark, f"{tmp_path}/in/*.pdf"))
    assert docs.count() == 1 and docs.first().page_count == 2
    assert {r.title for r in readers.sections(docs).collect()} == {"1 Intro", "Methods"}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nbroken\n[1]\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, f"{tmp_path}/l.jsonl", "a int").collect() if r.a is not None) == [1, 2]
    (tmp_path / "y.yaml").write_text("a: 1\n")
    (tmp_path / "z.yaml").write_text("- 1\n")
    assert sorted(str(r.json) for r in readers.yaml_documents(spark, f"{tmp_path}/*.yaml").collect()) == ["None", '{"a": 1}']
    assert readers.store(spark, f"{tmp_path}/none").count() == 0


def test_reading_order(spark):
    blocks = [(1, 0.0, 1.0, "L1"), (1, 10.0, 0.0, "R1"), (1, 0.0, 2.0, "L2"), (1, 10.0, 3.0, "R2"), (2, 5.0, 2.0, "b"), (2, 5.0, 1.0, "a")]
    got = {r.page: r.text for r in readers.reading_order(spark.createDataFrame(blocks, "page int, x double, y double, text string"), ["page"]).collect()}
    assert got == {1: "L1\nL2\nR1\nR2", 2: "a\nb"}


def test_sinks_prune_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "x", "x"), ("a", "c", "x", "y")], "a string, b string, domain_a string, domain_b string")
    writers.connections(rows, f"{tmp_path}/c")
    got = readers.connections(spark, f"{tmp_path}/c", "within", "x")
    assert [r.b for r in got.collect()] == ["b"] and "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    ids = spark.createDataFrame([("a",), ("c",)], "paper_id string")
    assert [r.b for r in readers.among(rows, ids).collect()] == ["c"]
    writers.append_log(rows, f"{tmp_path}/log")
    writers.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    rows.write.parquet(f"{tmp_path}/t")
    writers.replace_table(spark.read.parquet(f"{tmp_path}/t").where("b = 'b'"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    assert one(spark, writers.intake_name(F.lit("a.pdf"), F.lit(False), F.lit("d/a.pdf")), a=1) == "a.pdf"


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    from lodestar.streaming import jobs

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = jobs.inbox(spark, f"{tmp_path}/in", events.schema)
    jobs.run_available(jobs.activity(stream).select("event_type", F.col("window.start").alias("at"), "n"), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = {(r.event_type, r.at): r.n for r in events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("at"), "n").collect()}
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert got and all(batch[r.event_type, r.at] == r.n for r in got)


# ---- plans -----------------------------------------------------------------------------------------------------------


def test_from_documents_to_hypotheses(spark):
    from lodestar.plans import pipelines

    body = "1 {t}\nAbstract\nWe present neural routing with sparse attention for a language model of many layers. Results show that the quantum game has lower loss using deep gates.\nE = m c + {t}\n"
    docs = spark.createDataFrame([(f"in/{t}.pdf", body.format(t=t), 2, False, False) for t in ("alpha", "beta", "gamma")] + [("in/locked.pdf", "", 1, True, False)], "path string, text string, page_count int, encrypted boolean, image_only boolean")
    made = pipelines.ingest(docs, classify.rule_rows(spark))
    records = made["records"].orderBy("paper_id").collect()
    assert len(records) == 3 and records[0].title == "1 alpha" and records[0].domain == "ML" and len(records[0].equations) >= 1 and len(records[0].claims) >= 2
    assert made["vectors"].where("item_id like '%claim_1'").count() == 3 and {r.status for r in made["registry"].collect()} == {"ingested_only"}
    assert pipelines.ingest(docs, classify.rule_rows(spark), registered=made["registry"])["records"].count() == 0
    papers = made["registry"].withColumn("status", F.lit("exhausted"))
    c = pipelines.connections(papers, library=made["records"])
    r = c["report"].first()
    assert r.candidates == 3 == r.kept and c["log"].count() == 3
    again = pipelines.connections(papers, log=c["log"], library=made["records"])["report"].first()
    assert again.skipped_analyzed == 3 and again.kept == 0
    h = pipelines.detection(c["edges"])
    assert h.count() == 1 and h.first().connection_count == 3 and pipelines.detection(c["edges"], h).count() == 0
    items = spark.createDataFrame([(records[0].paper_id, 1, "experiments", '{"hypothesis": "h", "design": "d"}'), (records[0].paper_id, 2, "derivations", '{"statement": "s"}')], "paper_id string, seq int, bucket string, payload string")
    e = {x.paper_id: x for x in pipelines.evidence(h, made["records"], items, c["edges"]).collect()}
    assert e[records[0].paper_id].experiments == 1 and all(x.connections == 2 and x.in_library for x in e.values())
    p = pipelines.checkpoint(items).first()
    assert p.counts == "derivations=1 experiments=1" and p.direction == "h - d"
    assert pipelines.expansion_lines(items).first().lines == ["derivations: s", "experiments: h | d"]


def test_expansion_plan(spark):
    from lodestar.plans import pipelines

    v = np.eye(6).tolist()
    rows = [(1, k, (k - 1) // 3, "derivations", '{"statement": "s%d", "confidence": "%s"}' % (k, "speculative"), v[k % 6]) for k in range(1, 13)]
    items = spark.createDataFrame(rows, "paper_id long, seq long, batch long, bucket string, payload string, vec array<double>")
    papers = spark.createDataFrame([(1, 3, 1), (2, 1, None)], "paper_id long, pages int, recorded_depth int")
    got = pipelines.expansion(items, papers, 3)
    heads = {r.paper_id: r for r in got["headers"].collect()}
    assert heads[1].criterion == "speculative_ceiling" and heads[2].criterion == "completed" and heads[1].exhausted_at_depth == 3 and heads[2].deeper_available
    assert got["items"].count() == 6


def test_prompt_blocks(spark):
    from lodestar.functions import prompts

    row = spark.sql("SELECT array(named_struct('statement', 'c1')) AS c, array(named_struct('name', 'm1')) AS m, array(named_struct('expression', 'e=1')) AS e, array('x: y') AS l")
    t = row.select(prompts.paper_block(F.lit("T"), F.lit("t_1"), F.col("c"), F.col("m"), F.col("m"), F.col("e"), F.col("l")).alias("x")).first().x
    assert t == "Paper: T\nPaper ID: t_1\nClaims: ['c1']\nMethods: ['m1']\nTechniques: ['m1']\nEquations: ['e=1']\nExpansion outputs:\n- x: y"
    assert prompts.scope_label(cross=("a", "b")) == "cross_a_b" and prompts.scope_label() == "all"
    assert "cross-domain" in one(spark, prompts.strategy(F.lit(4)), a=1)


def test_stores(spark, tmp_path):
    import json

    from lodestar.sources import stores

    e = [{"id": "2"}]
    assert stores.appended(None, e) == '{"id": "2"}\n' and len(stores.appended('{"id": "1"}\n\n', e).splitlines()) == 2
    assert json.loads(stores.appended('{"entries": [1]}', e))["entries"] == [1, {"id": "2"}]
    g = json.loads(stores.appended('{"nodes": [{"id": "1"}], "edges": []}', e))
    assert len(g["nodes"]) == 2 and g["edges"] == [{"from": "1", "to": "2", "kind": "next"}]
    s = config.Settings(similarity=0.5)
    assert config.load(json.loads(stores.saved(s))) == s
    (tmp_path / "library").mkdir()
    (tmp_path / "library" / "a.yaml").write_text("a: 1")
    (tmp_path / "library" / "a.tmp").write_text("a: 1")
    assert stores.targets(spark, str(tmp_path)).count() == 1 and stores.targets(spark, f"{tmp_path}/none").count() == 0
    assert stores.endpoint("ollama", "http://h:1/") == "http://h:1/api/chat" and stores.endpoint("x", "http://h/v1") == "http://h/v1/chat/completions"
    prompts_ = spark.createDataFrame([("a", "1"), ("b", "x")], "key string, prompt string")
    assert {r.key: r.answer for r in stores.injected(prompts_, lambda t: str(int(t) + 1)).collect()} == {"a": "2", "b": None}


def test_frequent_tags_meet_in_blocks(spark):
    import itertools
    import random

    r = random.Random(1)
    tags_of = {k: set(r.sample("abcdefgh", r.randrange(5))) | ({"hot"} if k % 3 else set()) | ({f"own{k}"} if k % 5 == 0 else set()) for k in range(60)}
    rows = [(k, "xy"[k % 2], t) for k, ts in tags_of.items() for t in ts]
    table = spark.createDataFrame(rows + rows[:50], "paper_id long, domain string, tag string").repartition(3)
    want = {(a, b): sorted(tags_of[a] & tags_of[b]) for a, b in itertools.combinations(range(60), 2) if tags_of[a] & tags_of[b]}
    for block in (1, 7, 1000):
        got = connect.pairs(table, "all", with_tags=True, block=block).collect()
        assert {(g.a, g.b): g.tags for g in got} == want and all(g.shared == len(g.tags) and not g.strong for g in got)
        assert {(g.a, g.b) for g in connect.pairs(table, least=3, block=block).collect()} == {p for p, t in want.items() if len(t) >= 3 and (p[0] - p[1]) % 2 == 0}
    assert {(g.a, g.b) for g in connect.pairs(table, "cross", ("x", "y"), block=5).collect()} == {p for p in want if (p[0] - p[1]) % 2}
    assert connect.pairs(table.limit(0)).collect() == []


def test_means_take_items_in_their_own_order(spark):
    ids = [f"p_{kind}_{k}" for kind in ("technique", "method", "claim") for k in (10, 2, 1)]
    rows = spark.createDataFrame([(i, "p", [float(n)]) for n, i in enumerate(ids)], "item_id string, paper_id string, vec array<double>")
    assert [r.item_id for r in rows.orderBy(embed.item_order(F.col("item_id"))).collect()] == [f"p_{kind}_{k}" for kind in ("claim", "method", "technique") for k in (1, 2, 10)]
    assert embed.means(rows, "paper_id", 2).first()["mean"] == (ids.index("p_claim_1") + ids.index("p_claim_2")) / 2


@pytest.mark.parametrize("postings", [1, 60, 10_000])
@pytest.mark.parametrize("ceiling", [2, 3])
def test_top_pairs_by_rounds(spark, postings, ceiling, monkeypatch):
    r = random.Random(4)
    rows = spark.createDataFrame([(k, "xy"[k % 2], t) for k in range(40) for t in r.sample("abcdefghijklmnop", r.randrange(1, 15))], "paper_id long, domain string, tag string")
    judge = lambda met: met.where("(a + b) % 5 <> 0").withColumn("score", (F.col("a") + F.col("b")) % 3)
    seen, pairs = [], connect.pairs
    monkeypatch.setattr(connect, "pairs", lambda *a, **k: seen.append(k.get("least", 1)) or pairs(*a, **k))
    of = lambda x: [(q.a, q.b, q.shared, q.score) for q in x.collect()]
    assert of(connect.top_pairs(rows, judge, ceiling, 4, postings=postings)) == of(connect.top(judge(pairs(rows, "all")), 4))
    assert 1 in seen if ceiling == 3 else postings > 1 or 1 not in seen  # all pairs are read only where they have to be


def test_workers_hold_little_of_blocks(spark, monkeypatch):
    """What a pair of blocks takes besides the blocks, which lie there without their codes, is bounded; pairs are the same
    however many blocks a task meets at a time."""
    import itertools
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodestar.operators import pair_blocks

    r = random.Random(5)
    codes = [sorted(r.sample(range(400), 200)) for _ in range(1500)]
    rows = pa.table({"paper_id": pa.array(range(1500), pa.int64()), "domain": ["x"] * 1500, "codes": pa.array(codes, pa.list_(pa.int64()))})
    side = pair_blocks.Side(rows)
    assert "codes" not in side.rows.column_names
    tracemalloc.start()
    n = sum(len(x) for x, *_ in pair_blocks.found(side, side, True, 1, np.array([7]), False, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 * 1499 // 2 and peak < 32 << 20, peak
    papers = [(f"p{k}", "xyz"[k % 3], r.sample([f"t{i}" for i in range(30)], r.randint(1, 6))) for k in range(120)]
    sets = spark.createDataFrame(papers, "paper_id string, domain string, tags array<string>")
    for scope in ("all", "within", "cross"):
        meet = {"all": lambda d, e: True, "within": lambda d, e: d == e, "cross": lambda d, e: d != e}[scope]
        want = sorted((min(a, b), max(a, b), len(set(s) & set(t))) for (a, d, s), (b, e, t) in itertools.combinations(papers, 2) if meet(d, e) and set(s) & set(t))
        for many in (0, 1000):
            monkeypatch.setattr(pair_blocks, "MANY", many)
            blocks = pair_blocks.Blocks(sets, scope, [], 30)
            assert blocks.square == (4 if many == 0 else 2) and sorted((x.a, x.b, x.shared) for x in blocks.pairs(1).collect()) == want
