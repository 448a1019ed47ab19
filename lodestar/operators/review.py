"""Review of hypotheses by rules; evidence; experiments; drafts; triage packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import prompts, text
from lodestar.operators import gaps as gaps_

SEVERITY = {"pass": 0, "warn": 1, "fail": 2}


def _check(rows: DataFrame, name: Column | str, status: Column, detail: Column) -> DataFrame:
    return rows.select("cluster_id", (F.lit(name) if isinstance(name, str) else name).alias("check"), status.alias("status"), detail.alias("detail"))


def checks(hypotheses: DataFrame, library: DataFrame, expansions: DataFrame, connections: DataFrame) -> DataFrame:
    """(cluster_id, check, status, detail): one row a rule and hypothesis (cluster_id, paper_ids, status, gaps).

    library and expansions have paper_id, connections a and b. Without prior-art evidence the last rule always warns.
    """
    members = hypotheses.select("cluster_id", F.explode_outer("paper_ids").alias("paper_id"))
    missing = lambda known: members.where("paper_id is not null").join(known.select("paper_id").distinct(), "paper_id", "left_anti").groupBy("cluster_id").agg(F.array_sort(F.collect_set("paper_id")).alias("_m"))
    s = lambda c: c.cast("string")
    out = [
        _check(hypotheses, "hypothesis_status", F.when(F.col("status") == "pending_review", "pass").otherwise("warn"), F.concat(F.lit("Hypothesis status is "), F.coalesce("status", F.lit("unknown")), F.lit("."))),
        _check(hypotheses, "cluster_size", F.when(F.size("paper_ids") >= 3, "pass").otherwise("fail"), F.concat(F.lit("Cluster includes "), s(F.size("paper_ids")), F.lit(" paper(s); clusters should have at least 3."))),
    ]
    for name, known, bad in (("library", library, "fail"), ("exhaustion", expansions, "warn")):
        m = hypotheses.join(missing(known), "cluster_id", "left")
        detail = F.when(F.col("_m").isNull(), f"All {name} records are present.").otherwise(F.concat(F.lit(f"Missing {name} records: "), F.array_join(F.col("_m").cast("array<string>"), ", "), F.lit(".")))
        out.append(_check(m, f"{name}_records", F.when(F.col("_m").isNull(), "pass").otherwise(bad), detail))
    ends = connections.join(members.select("cluster_id", F.col("paper_id").alias("a")), "a").join(members.select("cluster_id", F.col("paper_id").alias("b")), ["cluster_id", "b"])
    n = hypotheses.join(ends.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")), "cluster_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    out.append(_check(n, "connection_support", F.when(F.col("_n") > 0, "pass").otherwise("warn"), F.concat(F.lit("Found "), s(F.col("_n")), F.lit(" connection artifact(s) inside this cluster."))))
    size = F.greatest(F.size("gaps"), F.lit(0))
    out.append(_check(hypotheses, "candidate_gaps", F.when(size > 0, "pass").otherwise("fail"), F.concat(F.lit("Found "), s(size), F.lit(" candidate gap(s)."))))
    gap = hypotheses.select("cluster_id", "paper_ids", F.explode("gaps").alias("g")).withColumn("_r", s(F.coalesce(F.col("g.rank"), F.lit(0))))
    outside = F.array_sort(F.array_except("g.supporting_papers", "paper_ids"))
    name = lambda x: F.concat(F.lit("gap_"), F.col("_r"), F.lit(x))
    out.append(_check(gap, name("_supporting_papers"), F.when(F.size(outside) <= 0, "pass").otherwise("fail"), F.when(F.size(outside) <= 0, F.concat(F.lit("Gap "), F.col("_r"), F.lit(" supporting papers are inside the cluster."))).otherwise(F.concat(F.lit("Gap "), F.col("_r"), F.lit(" references papers outside the cluster: "), F.array_join(outside.cast("array<string>"), ", "), F.lit(".")))))
    c, f = F.coalesce("g.confidence", F.lit(0)), F.coalesce("g.feasibility", F.lit(0))
    out.append(_check(gap, name("_scores"), F.when(c.between(1, 5) & f.between(1, 5), "pass").otherwise("fail"), F.concat(F.lit("Gap "), F.col("_r"), F.lit(" confidence="), s(c), F.lit(", feasibility="), s(f), F.lit("."))))
    fine = text.approach_specific(F.trim("g.suggested_approach"))
    out.append(_check(gap, name("_experiment_specificity"), F.when(fine, "pass").otherwise("warn"), F.concat(F.lit("Gap "), F.col("_r"), F.lit(" suggested approach is "), F.when(fine, "specific enough for a pilot").otherwise("too vague for direct execution"), F.lit("."))))
    out.append(_check(hypotheses, "prior_art_search", F.lit("warn"), F.lit("External prior-art search has not been run; do not accept novelty yet.")))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def verdicts(rows: DataFrame) -> DataFrame:
    """By cluster: any failure rejects, any warning asks for prior art, else review."""
    level = F.try_element_at(F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv]), F.col("status"))
    worst = rows.groupBy("cluster_id").agg(F.max(level).alias("_w"), F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "warn").alias("warns"))
    return worst.select("cluster_id", "checks", "fails", "warns", F.when(F.col("_w") == 2, "rejected").when(F.col("_w") == 1, "needs_prior_art").otherwise("pending_review").alias("decision"))


def summary(items: Column, keys: list[str], most: int = 3, width: int = 300) -> Column:
    """The first items' chosen fields, joined by ' - ', cut."""
    lines = F.transform(items, lambda x: F.substring(F.array_join(F.filter(F.array(*[F.trim(x[k].cast("string")) for k in keys]), lambda v: F.coalesce(v, F.lit("")) != ""), " - "), 1, width))
    return F.slice(F.filter(lines, lambda v: v != ""), 1, most)


def experiments(gaps: DataFrame) -> DataFrame:
    """A pilot's outline for gaps (cluster_id, description, suggested_approach, supporting_papers)."""
    papers = F.array_join(F.col("supporting_papers").cast("array<string>"), ", ")
    return gaps.select(
        "cluster_id",
        F.concat(F.lit("Test whether "), F.lower(F.col("description"))).alias("hypothesis"),
        text.examples(F.col("suggested_approach")).alias("variants"),
        F.when(papers == "", "Simple untreated control.").otherwise(F.concat(F.lit("Methods of "), papers, F.lit(" run unchanged."))).alias("baseline"),
        F.when(text.approach_specific(F.col("suggested_approach")), "pilot_ready").otherwise("needs_detail").alias("readiness"),
    )


def drafts(hypotheses: DataFrame, date: Column) -> DataFrame:
    """(cluster_id, file, markdown, index_line) of hypotheses (cluster_id, summary, description, approach, papers)."""
    refs = F.array_join(F.col("papers"), ", ")
    title = F.concat(F.lit("Working note: "), F.col("cluster_id"))
    front = F.concat(F.lit("---\ngap_id: "), F.col("cluster_id"), F.lit("\ntitle: "), title, F.lit("\ndate: "), date, F.lit("\nstatus: pending_review\npapers: ["), refs, F.lit("]\n---\n\n"))
    body = F.concat(F.lit("## Title\n"), title, F.lit("\n\n## Context\n"), F.coalesce("summary", F.lit("No summary available.")), F.lit("\n\n## The Gap\n"), F.col("description"), F.lit("\n\n## Proposed Direction\n"), F.col("approach"), F.lit("\n\n## Open Questions\n- Feasibility is unverified.\n- Evidence strength remains candidate-level.\n\n## References\n"), refs, F.lit("\n"))
    file = F.concat(text.slug(F.col("cluster_id"), "draft"), F.lit(".md"))
    return hypotheses.select("cluster_id", file.alias("file"), F.concat(front, body).alias("markdown"), F.concat(F.lit("- "), date, F.lit(" | "), file, F.lit(" | gap:"), F.col("cluster_id"), F.lit(" | papers:"), F.array_join(F.col("papers"), ","), F.lit("\n")).alias("index_line"))


def triage(hypotheses: DataFrame, evidence: DataFrame, connections: DataFrame, stamp: Column) -> DataFrame:
    """One packet a hypothesis (cluster_id, status, summary, novelty, paper_ids, gaps) for a human decision.

    evidence: rows of pipelines.evidence (cluster_id, paper_id, in_library, the buckets, connections); connections (a, b,
    connection_type, score). Nothing is searched outside: the checklist says what is still to be done.
    """
    rows = [c for c in evidence.columns if c != "cluster_id"]
    buckets = [c for c in rows if c not in ("paper_id", "in_library", "connections")]
    expanded = sum((F.coalesce(F.col(b), F.lit(0)) for b in buckets), F.lit(0)) > 0
    table = evidence.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("paper_id", *[c for c in rows if c != "paper_id"]))).alias("evidence_table"), F.count_if(expanded).alias("exhaustion_count"))
    members = hypotheses.select("cluster_id", F.explode("paper_ids").alias("p"))
    inside = connections.join(members.select("cluster_id", F.col("p").alias("a")), "a").join(members.select("cluster_id", F.col("p").alias("b")), ["cluster_id", "b"])
    inside = inside.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "connection_type", "score"))).alias("connections"))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    checklist = F.struct(
        F.coalesce(F.col("novelty"), F.lit(False)).alias("cluster_novelty_claim"), F.lit("not_run").alias("prior_art_search"), F.lit("not_implemented").alias("citation_overlap_check"),
        F.lit(True).alias("required_before_promotion"), F.lit("This packet searches no literature; it records what is to be checked before a promotion.").alias("notes"),
    )
    ranked = "rank" in hypotheses.schema["gaps"].dataType.elementType.names
    ordered = gaps_.by_rank(F.col("gaps")) if ranked else F.col("gaps")
    packed = hypotheses.join(table, "cluster_id", "left").join(inside, "cluster_id", "left")
    return packed.select(
        F.lit(1).alias("schema_version"), F.lit("triage").alias("artifact_type"), "cluster_id", F.lit("pending_review").alias("status"), stamp.alias("generated_at"),
        F.coalesce("status", F.lit("unknown")).alias("hypothesis_status"), F.coalesce("summary", F.lit("")).alias("summary"), "paper_ids", n("paper_ids").alias("paper_count"),
        n("connections").alias("connection_count"), F.coalesce("exhaustion_count", F.lit(0)).alias("exhaustion_count"), ordered.alias("candidate_gaps"), "evidence_table", "connections",
        checklist.alias("novelty_checklist"), F.array(*map(F.lit, ["accepted", "rejected", "needs_prior_art"])).alias("decision_options"), prompts.linked_paths(F.col("cluster_id")).alias("linked_artifacts"),
    )
