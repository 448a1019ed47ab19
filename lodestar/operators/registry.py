"""The registry of papers: insert, update, filters, counts, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"pending": 0, "ingested_only": 1, "exhausted": 2}
DECISIONS = {"accepted": "accepted", "rejected": "rejected", "needs_prior_art": "investigate"}


def rank(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in RANKS.items() for v in kv]), status)


def selected(registry: DataFrame, status: str | None = None, domain: str | None = None, prefix: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("domain", domain)):
        if value is not None:
            registry = registry.where(F.col(column) == value)
    return registry.where(F.startswith("paper_id", F.lit(prefix))) if prefix else registry


def counts(registry: DataFrame, *keys: str) -> DataFrame:
    """Totals by each key and over all, in one pass."""
    return registry.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count(F.lit(1)).alias("n"))


def inserted(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """registry and the rows of new whose key it lacks."""
    return registry.unionByName(new.join(registry.select(key), key, "left_anti").select(registry.columns))


def updated(registry: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """registry with the non-null values of changes, which has one row a key at most; unknown keys are ignored."""
    named = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    joined = registry.join(named, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in named.columns else c for c in registry.columns])


def upserted(registry: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    named = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    joined = registry.join(named, key, "full")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in named.columns else c for c in registry.columns if c != key])


def regressions(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events whose status ranks lower than the one before it."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("before", F.lag("status").over(w)).where(rank(F.col("before")) > rank(F.col("status")))


def promoted(hypotheses: DataFrame, decisions: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hypotheses with their new status, papers with triaged): decisions (cluster_id, decision, reviewer, note) need both
    a reviewer and a note; unknown members are ignored."""
    good = decisions.where("trim(coalesce(reviewer, '')) <> '' and trim(coalesce(note, '')) <> ''")
    status = F.try_element_at(F.create_map(*[F.lit(v) for kv in DECISIONS.items() for v in kv]), F.col("decision"))
    good = good.select("cluster_id", status.alias("_to")).where("_to is not null")
    done = hypotheses.join(good, "cluster_id", "left")
    members = done.where("_to is not null").select(F.explode("paper_ids").alias("paper_id")).distinct().withColumn("_t", F.lit(True))
    out = papers.join(members, "paper_id", "left").withColumn("triaged", F.coalesce("_t", "triaged")).drop("_t")
    return done.withColumn("status", F.coalesce("_to", "status")).drop("_to"), out


def flagged(papers: DataFrame, keys: DataFrame, flag: str, key: str = "paper_id") -> DataFrame:
    """papers with a flag (connected, detected, drafted or triaged) set for the given keys; others keep theirs, unknown keys
    are ignored, and a repeated key sets it once."""
    given = keys.select(key).distinct().withColumn("_f", F.lit(True))
    had = F.col(flag) if flag in papers.columns else F.lit(False)
    return papers.join(given, key, "left").withColumn(flag, F.coalesce(F.col("_f"), had, F.lit(False))).drop("_f")
