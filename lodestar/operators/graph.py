"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.tables import dropped, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component: the smallest node that is reachable.

    Nodes are longs or strings. Each round keeps at most as many rows as there are edges, in a written table. The smallest
    neighbours are written too, one row a node, so that Spark can split the join at a node with very many neighbours. An
    empty edge table gives no rows; loops and null ends are left out.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        dropped(spark, low)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        small = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        for t in (now, large, low):
            dropped(spark, t)
        now = small
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError("components did not settle")


def updated(labels: DataFrame, added: DataFrame, removed: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """(node, component) after a change of edges, from labels (node, component) before it: the same as components() over all.

    added (u, v): new edges. Their ends are put in place of their components, and only that contracted graph is searched; a
    component that none of them touches keeps its label. removed (u, v): edges that went; components they lay in are searched
    anew among kept (u, v), all edges that are left, of which only those components' are read into the search. A node without
    an edge drops out; null ends and loops are left out.
    """
    labels = labels.select("node", "component")
    if removed is not None:
        if kept is None:
            raise ValueError("edges that go need all edges that are left")
        ends = removed.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        torn = written(labels.join(ends, "node").select("component").distinct(), "torn")
        members = labels.join(torn, "component", "left_semi").select("node")
        inside = kept.join(members.select(F.col("node").alias("u")), "u", "left_semi")
        labels = labels.join(torn, "component", "left_anti").select("node", "component").unionByName(components(inside))
    new = written(added.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "new-edges")
    labels = written(labels, "labels")
    known = labels.join(new.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
    for end in ("u", "v"):
        at = known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
        new = new.join(at, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    new = written(new, "contracted")
    merged = components(new.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    merged = written(merged.select(F.col("node").alias("component"), F.col("component").alias("_to")), "merged")
    every = labels.unionByName(new.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("_u").alias("component")), F.struct(F.col("v").alias("node"), F.col("_v").alias("component")))).alias("x")).select("x.*")).distinct()
    return every.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
