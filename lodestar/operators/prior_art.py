"""Prior-art records: rejection, source queue, counts; signals for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import links, text


def rejected(kind: Column, wanted: str, decision: Column, novelty: Column) -> Column:
    d, n = F.lower(F.trim(F.coalesce(decision, F.lit("")))), F.lower(F.trim(F.coalesce(novelty, F.lit(""))))
    return F.coalesce(kind == wanted, F.lit(False)) & (d.isin("reject_novelty_claim", "rejected") | (n == "rejected"))


def queue(sources: DataFrame, impacts: list[str] | None = None, most: int | None = None, downloaded: DataFrame | None = None) -> DataFrame:
    """sources (key, pos, title, url, impact) as queue rows with resolved_url, status and file name.

    Without a resolved URL a source is manual_required. downloaded (url, ok) turns queued ones to downloaded or failed.
    Files of one name within a key are numbered.
    """
    if impacts is not None:
        sources = sources.where(F.trim("impact").isin(*impacts))
    by = Window.partitionBy("key").orderBy("pos")
    rows = sources.withColumn("source_index", F.row_number().over(by))
    if most is not None:
        rows = rows.where(F.col("source_index") <= most)
    url = F.trim(F.coalesce("url", F.lit("")))
    rows = rows.withColumn("url", url).withColumn("resolved_url", links.resolve_url(F.col("url")))
    rows = rows.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("source-"), F.col("source_index").cast("string")))).withColumn("impact", F.coalesce(F.nullif(F.trim("impact"), F.lit("")), F.lit("unspecified")))
    status = F.when(F.col("resolved_url").isNull(), "manual_required").otherwise("queued")
    if downloaded is not None:
        rows = rows.join(downloaded.select(F.col("url").alias("resolved_url"), F.col("ok").alias("_ok")), "resolved_url", "left")
        status = F.when(F.col("resolved_url").isNull(), "manual_required").when(F.col("_ok"), "downloaded").when(~F.col("_ok"), "failed").otherwise("queued")
    rows = rows.withColumn("status", status).drop("_ok")
    name = F.concat(text.slug(F.col("title"), "source"), F.lit("_"), text.short_id(F.coalesce("resolved_url", F.lit(""))))
    rows = rows.withColumn("_f", name)
    again = F.row_number().over(Window.partitionBy("key", "_f").orderBy("source_index"))
    return rows.withColumn("file", F.concat(F.col("_f"), F.when(again > 1, F.concat(F.lit("_"), again.cast("string"))).otherwise(""), F.lit(".pdf"))).drop("_f")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("sources"), *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "downloaded", "manual_required", "failed")])


def evidence(path: Column, fields: list[tuple[str, Column]], most: int = 360) -> Column:
    """Entries of the fields that hold text; a placeholder where none does."""
    every = F.array(*[F.struct(path.alias("artifact"), F.lit(n).alias("field"), text.shorten(v.cast("string"), most).alias("excerpt")) for n, v in fields])
    found = F.filter(every, lambda e: e["excerpt"] != "")
    none = F.array(F.struct(path.alias("artifact"), F.lit("artifact").alias("field"), F.lit("No excerpt available.").alias("excerpt")))
    return F.when(F.size(found) > 0, found).otherwise(none)


def envelope(kind: str, key: Column, path: Column, summary: Column, fields: list[tuple[str, Column]], status: Column, confidence: Column, label: str) -> list[Column]:
    """Columns of one signal."""
    return [
        F.concat(F.lit(f"{kind}:"), key).alias("signal_id"), F.lit(kind).alias("signal_type"), F.array(path).alias("source_artifacts"), text.shorten(summary, 500).alias("summary"),
        evidence(path, fields).alias("evidence"), F.coalesce(F.nullif(text.collapse(status), F.lit("")), F.lit("pending_review")).alias("status"), F.coalesce(confidence.try_cast("int"), F.lit(3)).alias("confidence"),
        F.lit("unverified").alias("authority_label"), F.lit("pending_review").alias("review_status"), F.lit(label).alias("recommended_label"),
    ]


def best_connection(connections: DataFrame, key: str) -> DataFrame:
    """By key the connection of most confidence, ties to the later path."""
    return connections.groupBy(key).agg(F.max_by("path", F.struct("confidence", "path")).alias("path"), F.max("confidence").alias("confidence"))


def three_signals(prior: DataFrame, hypotheses: DataFrame, connections: DataFrame, most: int = 3) -> DataFrame:
    """The signals of each prior-art record: its own, its hypothesis's and the best connection's of its cluster; three.

    prior (cluster_id, path, decision, status, confidence, claim, rationale, reframe, finding), hypotheses (cluster_id, path,
    summary, status, confidence, gap_description, gap_evidence, gap_confidence), connections (cluster_id, path, a, b,
    description, evidence_a, evidence_b, status, confidence). A cluster without all three has none.
    """
    if most != 3:
        raise ValueError("an export holds exactly 3 signals")
    whole = prior.select("cluster_id").distinct().join(hypotheses.select("cluster_id").distinct(), "cluster_id").join(connections.select("cluster_id").distinct(), "cluster_id")
    c, text_or = F.col, lambda *xs: F.coalesce(*[F.nullif(text.collapse(x), F.lit("")) for x in xs])
    key = c("cluster_id").cast("string")
    best = connections.join(whole, "cluster_id").groupBy("cluster_id").agg(F.max_by(F.struct(*[x for x in connections.columns if x != "cluster_id"]), F.struct(c("confidence").try_cast("int"), "path")).alias("x")).select("cluster_id", "x.*")
    between = F.concat(F.lit("Connection candidate between "), F.coalesce(c("a").cast("string"), F.lit("paper-a")), F.lit(" and "), F.coalesce(c("b").cast("string"), F.lit("paper-b")), F.lit("."))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    of_connection = best.select("cluster_id", *envelope("connection_candidate", stem, c("path"), text_or(c("description"), between), [("description", c("description")), ("evidence_a", c("evidence_a")), ("evidence_b", c("evidence_b"))], c("status"), c("confidence").cast("string"), "inferred"))
    of_hypothesis = hypotheses.join(whole, "cluster_id").select("cluster_id", *envelope("hypothesis_candidate", key, c("path"), text_or(c("summary"), c("gap_description"), key), [("summary", c("summary")), ("gaps[0].supporting_evidence", c("gap_evidence")), ("gaps[0].description", c("gap_description"))], c("status"), F.coalesce(c("gap_confidence"), c("confidence")).cast("string"), "speculative"))
    said = F.concat(F.lit("Prior-art result for "), key, F.lit("."))
    of_prior = prior.join(whole, "cluster_id").select("cluster_id", *envelope("prior_art_seed", key, c("path"), text_or(c("reframe"), c("claim"), said), [("assessment.rationale", c("rationale")), ("assessment.recommended_reframe", c("reframe")), ("sources[0].finding", c("finding"))], text_or(c("decision"), c("status")), c("confidence").cast("string"), "speculative"))
    return of_connection.unionByName(of_hypothesis).unionByName(of_prior)
