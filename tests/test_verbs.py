"""The verbs on a folder of small files, and the operators that only they or a caller's model use."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.functions import prompts, text
from lodestar.operators import audit, contracts, prior_art, registry
from lodestar.plans import pipelines, tables
from lodestar.sources import readers, writers

PAPER = """1 Introduction
Abstract: We show that the mixture of experts model with sparse routing improves reasoning. The latent state of the world model is shared. Introduction
We propose a looped transformer with adaptive computation. Our method uses distillation for inference.
2020
"""


def test_verbs_end_to_end(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "root")
    inbox.mkdir()
    (tmp_path / "root").mkdir()
    for k in range(4):
        (inbox / f"paper{k}.txt").write_text(PAPER.replace("Introduction\n", f"Introduction number {k}\n", 1))
    go = lambda *args: cli.run(spark, [args[0], root, *args[1:]])
    counts = go("ingest", str(inbox))
    assert {r["status"]: r["n"] for r in counts}["ingested_only"] == 4
    assert {r["status"]: r["n"] for r in go("ingest", str(inbox))}[None] == 4  # registered papers stay as they are
    assert go("validate")[0] == {"validated": 4, "failed": 0}
    assert go("connect")[0]["candidates"] == 0  # nothing is exhausted yet
    ids = sorted(r.paper_id for r in spark.read.parquet(f"{root}/registry").collect())
    items(spark, ids, str(tmp_path / "items"))
    assert go("expand", str(tmp_path / "items")) == [{"criterion": "completed", "n": 4}]
    report = go("connect")[0]
    assert report["candidates"] == 6 == report["kept"]
    again = go("connect", "--paper", ids[0])[0]
    assert again["candidates"] == 3 == again["skipped_analyzed"] and spark.read.parquet(f"{root}/connections").count() == 6
    assert spark.read.json(f"{root}/reports/connect").count() == 3
    found = go("detect")
    assert len(found) == 1 and found[0]["cluster_size"] == 4 and found[0]["connection_count"] == 6
    assert len(go("detect")) == 1
    papers = spark.read.parquet(f"{root}/registry").collect()
    assert len(papers) == 4 and all(p.connected and p.detected and not p.drafted for p in papers)
    assert go("triage", found[0]["cluster_id"]) == [{"file": f"{found[0]['cluster_id']}.yaml"}]
    import yaml

    packet = yaml.safe_load((tmp_path / "root" / "triage" / f"{found[0]['cluster_id']}.yaml").read_text())
    assert list(packet)[:3] == ["schema_version", "artifact_type", "cluster_id"] and packet["paper_count"] == 4 and packet["connection_count"] == 6
    cluster = found[0]["cluster_id"]
    assert "Write candidate notes from hypotheses." in [r["action"] for r in go("next")] and go("next", "--inbox", str(inbox))[0]["action"] == "Run ingestion on queued inbox items."
    verdict = go("review", cluster)[0]
    assert verdict["decision"] == "needs_prior_art" and verdict["fails"] == 0
    checked = yaml.safe_load((tmp_path / "root" / "review" / f"{cluster}.yaml").read_text())
    assert len(checked["results"]) == verdict["checks"] and {"check", "status", "detail"} == set(checked["results"][0])
    assert go("experiment", cluster, "--gap-rank", "9")[0]["cluster_id"] == cluster  # no such rank: the first gap
    drafted = go("draft")
    assert len(drafted) == 1 and (tmp_path / "root" / "drafts" / drafted[0]["file"]).read_text().startswith("---\ngap_id: ")
    (tmp_path / "found.jsonl").write_text('{"pos": 1, "title": "A", "url": "https://arxiv.org/abs/2001.00001", "impact": "high"}\nbroken\n{"pos": 2, "title": "B", "url": "", "impact": "high"}\n{"pos": 3, "title": "C", "impact": "low"}\n')
    for _ in range(2):
        queued = go("sources", cluster, str(tmp_path / "found.jsonl"), "--impact", "high")[0]
        assert (queued["sources"], queued["queued"], queued["manual_required"]) == (2, 1, 1)
    assert go("promote", cluster, "--decision", "needs_prior_art", "--reviewer", "r", "--note", "n") == [{"cluster_id": cluster, "status": "investigate"}]
    papers = spark.read.parquet(f"{root}/registry").collect()
    assert len(papers) == 4 and all(p.triaged and p.drafted for p in papers)
    for verb in (["triage", "none"], ["review", "none"], ["draft", "none"], ["promote", "none", "--decision", "accepted", "--reviewer", "r", "--note", "n"]):
        with pytest.raises(LookupError):
            go(*verb)
    assert go("migrate", "--dry-run")[0]["changed"] == 0 and go("migrate", "--target", "2")[0]["changed"] == 4
    assert {r["status"]: r["n"] for r in go("status", "--status", "exhausted") if r["domain"] is None}["exhausted"] == 4
    assert len(go("export", str(tmp_path / "out"))) == 3
    assert go("config", "similarity", "0.5")[0]["similarity"] == 0.5 and go("config")[0]["similarity"] == 0.5


def items(spark, papers, path, n=2, mode="overwrite"):
    """n items for each paper, one batch an item, with vectors that aren't alike."""
    rows = [(p, k, k, "open_questions", json.dumps({"question": f"question {k} of {p}"}), [float(j == k) for j in range(n)]) for p in papers for k in range(n)]
    spark.createDataFrame(rows, "paper_id string, seq long, batch int, bucket string, payload string, vec array<double>").write.mode(mode).parquet(path)


def test_expansion_and_scopes_keep_what_others_made(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "root")
    inbox.mkdir()
    (tmp_path / "root").mkdir()
    for k in range(4):
        (inbox / f"paper{k}.txt").write_text(PAPER.replace("Introduction\n", f"Introduction number {k}\n", 1))
    go = lambda *args: cli.run(spark, [args[0], root, *args[1:]])
    read = lambda name: {repr(sorted(r.asDict().items())) for r in spark.read.parquet(f"{root}/{name}").collect()}
    go("ingest", str(inbox))
    ids = sorted(r.paper_id for r in spark.read.parquet(f"{root}/registry").collect())
    known = spark.read.parquet(f"{root}/registry")
    two = F.when(F.col("paper_id").isin(ids[:2]), "ML").otherwise("physics")
    writers.replace_table(known.withColumn("domain", two), f"{root}/registry")
    writers.replace_table(spark.read.parquet(f"{root}/library").withColumn("domain", two), f"{root}/library")
    items(spark, ids, str(tmp_path / "all"))
    go("expand", str(tmp_path / "all"), "--paper", ids[0], "--depth", "2")
    state = lambda: {r.paper_id: (r.status, r.exhausted_at_depth) for r in spark.read.parquet(f"{root}/registry").collect()}
    assert state() == {p: ("exhausted", 2) if p == ids[0] else ("ingested_only", None) for p in ids}
    first = read("expansion")
    assert len(first) == 2
    items(spark, ids[1:2], str(tmp_path / "one"), 3)
    go("expand", str(tmp_path / "one"))
    assert first < read("expansion") and len(read("expansion")) == 5  # the first paper's items stay
    assert {p: s for p, (s, _) in state().items()} == {p: "exhausted" if p in ids[:2] else "ingested_only" for p in ids}  # others aren't touched
    go("expand", str(tmp_path / "all"), "--domain", "physics")
    assert {s for s, _ in state().values()} == {"exhausted"} and len(read("expansion")) == 9
    assert go("connect", "--within", "ML")[0]["kept"] == 1
    kept = read("connections")
    assert go("connect", "--within", "physics")[0]["kept"] == 1
    assert kept < read("connections") and len(read("connections")) == 2  # another scope's stay
    assert go("connect", "--cross", "ML", "physics")[0]["candidates"] == 4
    total = len(read("connections"))
    assert go("connect")[0] | {"candidates": 6} == go("connect")[0]
    assert go("connect")[0]["skipped_analyzed"] == 6 and len(read("connections")) == total
    go("expand", str(tmp_path / "all"), "--paper", ids[0], "--depth", "4")  # deeper: its pairs are looked at again
    assert state()[ids[0]] == ("exhausted", 4)
    assert go("connect")[0]["skipped_analyzed"] == 6
    assert go("connect", "--upgrades")[0]["skipped_analyzed"] == 3
    assert go("connect", "--upgrades")[0]["skipped_analyzed"] == 6
    assert go("detect", "--cross", "ML", "physics") == []  # without a model's answers pairs across domains stay below the confidence
    given = go("detect", "--papers", *ids[:3])
    assert len(given) == 1 and given[0]["cluster_size"] == 3 and given[0]["connection_count"] == 1
    assert go("detect", "--papers", *ids[:2]) == given  # two papers are no cluster
    assert cli.vectors(spark, root).read().groupBy("paper_id").count().count() == 4


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://h:7077"
        applicationId = "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())


def test_damaged_and_missing_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    assert readers.store(spark, path).count() == 0
    rows = spark.createDataFrame([("i", "p", "t", [1.0])], "item_id string, paper_id string, text string, vec array<double>")
    writers.store(rows, path)
    writers.store(rows.unionByName(rows), path)
    assert readers.store(spark, path).count() == 2
    assert [f.name for f in tmp_path.iterdir()] == ["store"]
    for f in (tmp_path / "store").glob("*.parquet"):
        f.write_bytes(b"no parquet")
    for f in (tmp_path / "store").glob(".*.crc"):
        f.unlink()
    assert readers.store(spark, path).count() == 0


def test_outside_pdf_text(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo\x0c")
    backend = lambda content: readers.pdftotext(content, ("cat",))
    got = readers.documents(spark, str(tmp_path), backend).first()
    assert (got.page_count, got.text, got.encrypted, got.image_only) == (2, "one\ntwo", False, False)
    assert readers.pdftotext(b"x", ("no-such-program",)) == ([], False) == readers.pdftotext(b"x", ("sleep", "9"), 1) == readers.pdftotext(b"x", ("false",))


def test_an_answer_with_errors_is_asked_for_once_more(spark):
    docs = spark.createDataFrame([("a", "T", "x" * 20_000, [("e", "1=1")] * 9), ("b", "U", "y", [])], "key string, title string, text string, equations array<struct<label:string,expression:string>>")
    prompt = {r.key: r.p for r in docs.select("key", prompts.extraction(F.col("title"), F.col("text"), F.col("equations")).alias("p")).collect()}
    assert prompt["a"].count("x") < 18_020 and prompt["a"].count("- e: 1=1") == 8 and "equations" not in prompt["b"]

    def answer(p):
        return "good" if "Validation errors:\n- bad" in p and "Title: T" in p else "poor"

    errors = lambda a: F.when(a == "good", F.array().cast("array<string>")).otherwise(F.array(F.lit("bad")))
    got = {r.key: (r.answer, r.errors, r.tries) for r in pipelines.extracted(docs, answer, errors).collect()}
    assert got == {"a": ("good", [], 2), "b": ("poor", ["bad"], 2)}


def test_versions_and_reports(spark):
    assert contracts.versions() == {"library": 1, "expansion": 2, "connection": 1, "hypothesis": 1}
    assert contracts.versions(3, library=5, expansion=None) == {"library": 5, "expansion": 3, "connection": 3, "hypothesis": 3}
    with pytest.raises(ValueError):
        contracts.versions(other=1)
    before = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in contracts.migration_report(before, after, "k", False).orderBy("k").collect()] == [(1, "unchanged", []), (2, "updated", ["v"])]
    rows = spark.createDataFrame([("", "i", "p", "ACCEPTED")], "cluster_id string, id string, paper_id string, status string")
    got = contracts.migrated_hypotheses(rows, 4).first()
    assert (got.schema_version, got.cluster_id, got.paper_ids, got.status, got.novelty) == (4, "i", ["p"], "accepted", True)


def test_flags_state_and_signals(spark):
    papers = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "paper_id string, drafted boolean")
    keys = spark.createDataFrame([("c",), ("c",), ("z",)], "paper_id string")
    assert sorted(map(tuple, registry.flagged(papers, keys, "drafted").collect())) == [("a", True), ("b", False), ("c", True)]
    state, findings = spark.createDataFrame([("x", 2), ("y", 1)], "kind string, n long"), spark.createDataFrame([("x", "t", 1), ("x", "u", 2), ("w", "v", 1)], "kind string, text string, seq int")
    assert sorted(map(tuple, audit.closed(state, findings).collect())) == [("w", 1), ("x", 4), ("y", 1)]
    assert {r.kind: r.last for r in audit.closing_counts(findings).collect()} == {"x": "u", "w": "v"}
    with pytest.raises(ValueError):
        prior_art.three_signals(papers, papers, papers, 4)
    rows = spark.range(1).select(text.stamp(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("t"), text.index_papers(F.lit("- d | papers: a,b , |x")).alias("p")).first()
    assert rows.t == "2026-01-02T03:04:05Z" and rows.p == ["a", "b"]


def test_long_numbered_lines_are_headers(spark):
    line = "1" + ".1" * 100_000 + " Title"
    assert spark.createDataFrame([(line,)], "s string").select(text.is_header(F.col("s")).alias("h")).first().h


def test_yaml_keeps_the_order_of_fields(spark):
    rows = spark.createDataFrame([(2, "k", None, ["é"])], "z int, key string, a string, list array<string>")
    got = writers.yaml_texts(rows, "key").first()
    assert got.key == "k" and got.yaml == "z: 2\nkey: k\na: null\nlist:\n- é\n"


def test_reports_are_appended(spark, tmp_path):
    for k in range(2):
        writers.append_report(spark.range(1).select(F.lit(k).alias("k")), str(tmp_path / "log"), F.lit("now"))
    assert sorted(json.loads(x)["k"] for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()) == [0, 1]
