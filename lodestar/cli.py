"""Verbs over a folder of tables: ingest, expand, connect, detect, triage, review, experiment, draft, sources, promote, next,
validate, migrate, status, export, config.

    python -m lodestar VERB ROOT [options]

ROOT holds library, registry, expansion, connections, pair_log, hypotheses and sources, each a table of Parquet files,
vectors in hashed buckets, the reports of connect, and config.json; triage, review, experiments and drafts hold a file a hypothesis. Every verb is a thin call of plans and operators;
a table that is replaced is written beside the old one first.
"""

from __future__ import annotations

import argparse
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import config
from lodestar.operators import audit, classify, connect, contracts, expand, gaps, prior_art, registry, review
from lodestar.plans import pipelines, rounds, tables
from lodestar.sources import readers, stores, writers
from lodestar.sources.buckets import Buckets

#: What a library record must hold.
LIBRARY = {
    "schema_version": {"type": "integer", "required": True, "default": 1, "minimum": 1}, "paper_id": {"type": "string", "required": True}, "title": {"type": "string", "required": True},
    "domain": {"type": "string", "required": True}, "domain_confidence": {"type": "number", "minimum": 0, "maximum": 1}, "tags": {"type": "list[string]", "required": True, "min_items": 1},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__.splitlines()[0])
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *options: tuple) -> None:
        v = verbs.add_parser(name)
        v.add_argument("root")
        for names, kwargs in options:
            v.add_argument(*names, **kwargs)

    verb("ingest", (["inbox"], {}), (["--domain"], {}), (["--reprocess"], {"action": "store_true"}))
    again, count = (["--reprocess"], {"action": "store_true"}), (["--count"], {"type": int})
    verb("expand", (["items"], {"help": "a table of paper_id, seq, batch, bucket, payload, vec"}), (["--depth"], {"type": int, "default": 3}), (["--paper"], {}), (["--domain"], {}), again, count, (["--resume"], {"help": "the folder of a run that was lost"}))
    verb("connect", (["--within"], {}), (["--cross"], {"nargs": 2}), (["--paper"], {}), (["--upgrades"], {"action": "store_true"}))
    verb("detect", (["--domain"], {}), (["--cross"], {"nargs": 2}), (["--papers"], {"nargs": "+"}), (["--force"], {"action": "store_true"}))
    verb("triage", (["cluster"], {}))
    verb("review", (["cluster"], {}))
    verb("experiment", (["cluster"], {}), (["--gap-rank"], {"type": int, "default": 1}))
    verb("draft", (["cluster"], {"nargs": "?"}), (["--top"], {"type": int, "default": 1}))
    verb("sources", (["cluster"], {}), (["found"], {"help": "JSON lines of pos, title, url, impact"}), (["--impact"], {"action": "append"}), (["--most"], {"type": int, "default": 8}))
    verb("promote", (["cluster"], {}), (["--decision"], {"choices": sorted(registry.DECISIONS), "required": True}), (["--reviewer"], {"required": True}), (["--note"], {"required": True}))
    verb("next", (["--inbox"], {}))
    verb("validate", (["--strict"], {"action": "store_true"}))
    verb("migrate", (["--dry-run"], {"action": "store_true"}), (["--target"], {"type": int}))
    verb("status", (["--domain"], {}), (["--status"], {}))
    verb("export", (["output"], {}))
    verb("config", (["key"], {"nargs": "?"}), (["value"], {"nargs": "?"}))
    return p


def settings_of(root: str) -> config.Settings:
    path = Path(root) / "config.json"
    return config.load(json.loads(path.read_text()) if path.exists() else {})


def opened(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the folder, or None where it isn't there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def added(rows: DataFrame, old: DataFrame | None, key: str | list[str], root: str, name: str, gone: DataFrame | None = None) -> None:
    """Writes rows, and those of the old table whose key they (and gone) lack."""
    if old is not None:
        keys = [key] if isinstance(key, str) else key
        new = rows.select(keys) if gone is None else rows.select(keys).unionByName(gone.select(keys))
        rows = rows.unionByName(old.join(new.distinct(), keys, "left_anti"), allowMissingColumns=True)
    writers.replace_table(rows, f"{root}/{name}")


def vectors(spark: SparkSession, root: str) -> Buckets:
    """The folder's vector store: items in hashed buckets."""
    return Buckets(spark, f"{root}/vectors", ["item_id"])


def papers_of(library: DataFrame, registry_: DataFrame) -> DataFrame:
    """The library's papers as far as pairs look at them, each with its status and depth in the registry."""
    known = with_depth(registry_).select("paper_id", "status", "exhausted_at_depth")
    return library.select("paper_id", "domain", "tags").join(known, "paper_id")


def with_depth(registry_: DataFrame) -> DataFrame:
    return registry_ if "exhausted_at_depth" in registry_.columns else registry_.withColumn("exhausted_at_depth", F.lit(None).cast("int"))


def expanded(spark: SparkSession, a, settings: config.Settings) -> list[dict]:
    """Expands the papers that the options name and the items table holds, and no others; a folder of rounds is kept until the
    results are in."""
    known, library = with_depth(opened(spark, a.root, "registry")).withColumn("registry_pos", F.col("paper_id")), opened(spark, a.root, "library")
    items = spark.read.parquet(a.items)
    items = items.withColumn("paper_id", F.col("paper_id").cast("string"))
    chosen = expand.eligible(known, a.depth, a.domain, a.paper, everything=not a.domain and not a.paper, reprocess=a.reprocess, count=a.count)
    targets = chosen.join(items.select("paper_id").distinct(), "paper_id", "left_semi").join(library.select("paper_id", "page_count"), "paper_id")
    folder = a.resume or f"{a.root}/rounds/{uuid.uuid4().hex}"
    print(f"rounds in {folder}")
    targets = targets.select("paper_id", F.col("page_count").alias("pages"), F.col("exhausted_at_depth").alias("recorded_depth"))
    made = rounds.expansion(rounds.batches_of(items), targets, folder, a.depth, settings)
    headers = tables.written(made["headers"], "headers")
    if made["items"] is not None:
        added(made["items"], opened(spark, a.root, "expansion"), "paper_id", a.root, "expansion", headers)
    done = headers.select("paper_id", F.lit("exhausted").alias("status"), "exhausted_at_depth")
    writers.replace_table(registry.updated(with_depth(opened(spark, a.root, "registry")), done, "paper_id"), f"{a.root}/registry")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return [r.asDict() for r in headers.groupBy("criterion").agg(F.count(F.lit(1)).alias("n")).collect()]


def connected(spark: SparkSession, a, settings: config.Settings) -> list[dict]:
    """Connects exhausted papers in a scope; pairs that the log holds are skipped, and connections of other pairs stay."""
    library, scope = opened(spark, a.root, "library"), "within" if a.within else "cross" if a.cross else "all"
    papers = papers_of(library, opened(spark, a.root, "registry"))
    papers = papers.where(F.col("domain") == a.within) if a.within else papers
    papers = papers.withColumn("status", F.when(F.col("paper_id") == a.paper, "exhausted").otherwise(F.col("status"))) if a.paper else papers  # whatever it is itself
    log, store = opened(spark, a.root, "pair_log"), vectors(spark, a.root)
    means = pipelines.paper_vectors(store.read()) if store.exists() else None
    made = pipelines.connections(papers, log, means, library, None, scope, tuple(a.cross) if a.cross else None, settings, a.paper, a.upgrades)
    met = tables.written(made["candidates"], "candidates")  # the tables below come from it, and it reads the log
    added(met.where("reason = 'kept'").withColumn("status", F.lit("pending_review")), opened(spark, a.root, "connections"), ["a", "b"], a.root, "connections")
    added(met.where("reason <> 'skipped_analyzed'").select("pair", "depth_a", "depth_b", "reason", F.current_timestamp().alias("analyzed_at")), log, "pair", a.root, "pair_log")
    report = tables.written(connect.report(met), "report")
    label = "::".join([scope, *([a.within] if a.within else a.cross or [a.paper or "all"])])
    writers.append_report(report.withColumn("scope", F.lit(label)), f"{a.root}/reports/connect", F.current_timestamp().cast("string"))
    _flag(spark, a.root, opened(spark, a.root, "connections").select(F.explode(F.array("a", "b")).alias("paper_id")), "connected")
    return [r.asDict() for r in report.collect()]


def _flag(spark: SparkSession, root: str, keys: DataFrame, flag: str) -> None:
    papers = opened(spark, root, "registry")
    if papers is not None:
        writers.replace_table(registry.flagged(papers, keys, flag), f"{root}/registry")


def hypothesis(hypotheses: DataFrame | None, cluster: str) -> DataFrame:
    """The hypothesis of a cluster, its gaps numbered where they have no rank; an error if there is none."""
    found = None if hypotheses is None else hypotheses.where(F.col("cluster_id") == cluster)
    if found is None or found.isEmpty():
        raise LookupError(f"no hypothesis {cluster}")
    return with_ranks(found)


def with_ranks(hypotheses: DataFrame) -> DataFrame:
    if "rank" in hypotheses.schema["gaps"].dataType.elementType.names:
        return hypotheses
    return hypotheses.withColumn("gaps", F.transform("gaps", lambda g, i: g.withField("rank", i + 1)))


def run(spark: SparkSession, args: list[str]) -> list[dict]:
    """Runs a verb; returns what it reports, a dict a row."""
    a = parser().parse_args(args)
    settings, table = settings_of(a.root), lambda name: opened(spark, a.root, name)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if a.verb == "config":
        path = Path(a.root) / "config.json"
        kept = json.loads(path.read_text()) if path.exists() else {}
        if a.key and a.value is not None:
            kept = config.set_nested(kept, a.key, a.value)
            path.write_text(json.dumps(kept, indent=1))
        return [json.loads(stores.saved(config.load(kept)))]
    if a.verb == "ingest":
        known = table("registry")
        made = pipelines.ingest(readers.documents(spark, a.inbox), classify.rule_rows(spark), settings, known, a.reprocess, a.domain)
        vectors(spark, a.root).upsert(pipelines.embedded(made["vectors"]))  # before the registry, from which all of this is told
        added(made["records"], table("library"), "paper_id", a.root, "library")
        added(made["registry"], table("registry"), "paper_id", a.root, "registry")
        return rows(registry.counts(table("registry"), "status"))
    if a.verb == "expand":
        return expanded(spark, a, settings)
    if a.verb == "connect":
        return connected(spark, a, settings)
    if a.verb == "detect":
        old = table("hypotheses")
        made = pipelines.detection(table("connections"), old, a.domain, tuple(a.cross) if a.cross else None, a.force, a.papers)
        added(made, old, "cluster_id", a.root, "hypotheses")
        _flag(spark, a.root, table("hypotheses").select(F.explode("paper_ids").alias("paper_id")), "detected")
        return rows(table("hypotheses").select("cluster_id", "cluster_size", "connection_count"))
    if a.verb in ("triage", "review"):
        chosen, edges = hypothesis(table("hypotheses"), a.cluster), table("connections")
        items = table("expansion")
        items = spark.createDataFrame([], "paper_id string, bucket string") if items is None else items
        if a.verb == "triage":
            packet = review.triage(chosen, pipelines.evidence(chosen, table("library"), items, edges), edges, F.current_timestamp().cast("string"))
            return rows(writers.yaml_files(packet, f"{a.root}/triage", "cluster_id"))
        checks = review.checks(chosen, table("library"), items, edges)
        listed = checks.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("check", "status", "detail"))).alias("results"))
        packet = review.verdicts(checks).join(listed, "cluster_id")
        writers.yaml_files(packet, f"{a.root}/review", "cluster_id")
        return rows(packet.drop("results"))
    if a.verb == "experiment":
        gap = hypothesis(table("hypotheses"), a.cluster).select("cluster_id", gaps.gap_at(F.col("gaps"), a.gap_rank).alias("g")).where("g is not null")
        made = review.experiments(gap.select("cluster_id", "g.description", "g.suggested_approach", "g.supporting_papers"))
        writers.yaml_files(made, f"{a.root}/experiments", "cluster_id")
        return rows(made)
    if a.verb == "draft":
        every = table("hypotheses")
        chosen = hypothesis(every, a.cluster) if a.cluster else with_ranks(every).orderBy("cluster_id").limit(a.top)
        first = gaps.gap_at(F.col("gaps"), 1)
        made = review.drafts(chosen.select("cluster_id", "summary", first["description"].alias("description"), first["suggested_approach"].alias("approach"), F.col("paper_ids").alias("papers")), F.current_date().cast("string"))
        out = rows(writers.text_files(made.select("file", F.col("markdown").alias("body")), f"{a.root}/drafts"))
        writers.append_log(made.select("cluster_id", "index_line"), f"{a.root}/draft_index")
        _flag(spark, a.root, chosen.select(F.explode("paper_ids").alias("paper_id")), "drafted")
        return out
    if a.verb == "sources":
        hypothesis(table("hypotheses"), a.cluster)
        found = readers.json_lines(spark, a.found, "pos int, title string, url string, impact string").withColumn("key", F.lit(a.cluster))
        old, queued = table("sources"), prior_art.queue(found, a.impact, a.most)
        writers.replace_table(queued if old is None else queued.unionByName(old.where(F.col("key") != a.cluster)), f"{a.root}/sources")
        return rows(prior_art.totals(table("sources").where(F.col("key") == a.cluster)))
    if a.verb == "promote":
        hypothesis(table("hypotheses"), a.cluster)
        decision = spark.createDataFrame([(a.cluster, a.decision, a.reviewer, a.note)], "cluster_id string, decision string, reviewer string, note string")
        done, papers = registry.promoted(table("hypotheses"), decision, table("registry"))
        writers.replace_table(papers, f"{a.root}/registry")  # first, as its rows come from the old hypotheses; both may be repeated
        writers.replace_table(done, f"{a.root}/hypotheses")
        writers.append_report(decision, f"{a.root}/decisions", F.current_timestamp().cast("string"))
        return rows(table("hypotheses").where(F.col("cluster_id") == a.cluster).select("cluster_id", "status"))
    if a.verb == "next":
        n = lambda df: F.lit(0 if df is None else df.count())
        known = table("registry")
        files = readers.listing(spark, a.inbox, "") if a.inbox else None
        pending = None if known is None else registry.selected(known, "ingested_only")
        steps = audit.actions(n(files), n(pending), n(known), n(table("connections")), n(table("hypotheses")))
        return rows(spark.range(1).select(F.explode(steps).alias("action")))
    if a.verb == "validate":
        checked = table("library").withColumn("errors", contracts.errors(table("library"), LIBRARY, "strict" if a.strict else "pipeline"))
        return rows(contracts.validation_totals(checked))
    if a.verb == "migrate":
        before, to = table("library"), contracts.versions(a.target)
        after = contracts.migrated_library(before).withColumn("schema_version", F.lit(to["library"]))
        report = contracts.migration_totals(contracts.migration_report(before, after, "paper_id", a.dry_run))
        out = rows(report)
        if not a.dry_run:
            writers.replace_table(after, f"{a.root}/library")
        return [out[0] | {"dry_run": a.dry_run, "target_versions": to}]
    if a.verb == "status":
        return rows(registry.counts(registry.selected(table("registry"), a.status, a.domain), "status", "domain"))
    found = connect.top(table("connections"), 3)
    writers.json_column(found).write.mode("overwrite").text(a.output)
    return rows(found.select("a", "b", "score"))


VERBS = ("ingest", "expand", "connect", "detect", "triage", "review", "experiment", "draft", "sources", "promote", "next", "validate", "migrate", "status", "export", "config")
