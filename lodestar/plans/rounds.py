"""Expansion in rounds over written state: each round asks for one batch of the papers that are still open.

A round is two tables, its items and the state of the papers it asked for; the state is written last, so a round without it
hasn't been, and a run that is started again goes on after the last one that has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.operators import expand
from lodestar.plans.tables import complete

FLAGS = "array<struct<redundant: boolean, speculative: boolean>>"


def batches_of(items: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """A source of rounds: the k-th batch that items (paper_id, seq, batch, ...) holds of each open paper in round k."""
    nth = items.withColumn("_k", F.dense_rank().over(Window.partitionBy("paper_id").orderBy("batch")))
    return lambda open_, k: nth.where(F.col("_k") == k).drop("_k").join(open_, "paper_id", "left_semi")


def expansion(source: Callable[[DataFrame, int], DataFrame], targets: DataFrame, folder: str, depth: int, settings: Settings = Settings(), threshold: float | None = None, most_rounds: int = 100) -> dict[str, DataFrame]:
    """items and headers, as pipelines.expansion gives them, of targets (paper_id, pages, recorded_depth) alone.

    source(open papers, k): the items (paper_id, seq, batch, bucket, payload, vec) of round k, from a model or a table; a paper
    without any ends as completed, as one does that is open after most_rounds. Stop rules are looked at after each round, and
    later rounds read nothing of papers that have ended. folder: where rounds are kept; given again, they go on.
    """
    spark, threshold = targets.sparkSession, settings.redundancy if threshold is None else threshold
    place = lambda k, name: f"{folder}/round-{k:04d}/{name}"
    if not complete(spark, place(0, "papers")):
        cap = expand.budget(F.col("pages"), F.lit(depth), settings)
        first = targets.dropDuplicates(["paper_id"]).select("paper_id", cap.cast("long").alias("cap"), F.lit(0).cast("long").alias("kept"), F.array().cast(FLAGS).alias("flags"), F.lit(None).cast("string").alias("criterion"))
        first.write.mode("overwrite").parquet(place(0, "papers"))
    k = 0
    while complete(spark, place(k + 1, "papers")):
        k += 1
    while k < most_rounds:
        open_ = spark.read.parquet(place(k, "papers")).where("criterion is null")
        if open_.isEmpty():
            break
        k += 1
        keys = open_.select("paper_id")
        given = expand.normalised(source(keys, k).join(keys, "paper_id", "left_semi")).where("text is not null")
        earlier = [place(j, "items") for j in range(1, k)]
        known = spark.read.parquet(*earlier).where("not redundant").join(keys, "paper_id", "left_semi") if earlier else None
        folded = expand.fold(given, threshold, known).select("paper_id", "seq", "redundant")
        flagged = given.join(folded, ["paper_id", "seq"]).withColumn("speculative", F.coalesce(F.col("confidence") == "speculative", F.lit(False)))
        flagged.write.mode("overwrite").parquet(place(k, "items"))
        made = spark.read.parquet(place(k, "items")).groupBy("paper_id").agg(F.count_if(~F.col("redundant")).alias("_n"), F.array_sort(F.collect_list(F.struct("seq", "redundant", "speculative"))).alias("_f"))
        joined = open_.drop("criterion").join(made, "paper_id", "left")
        new = F.transform("_f", lambda x: F.struct(x["redundant"].alias("redundant"), x["speculative"].alias("speculative")))
        every = F.when(F.col("_f").isNotNull(), F.concat("flags", new)).otherwise(F.col("flags"))
        last = joined.withColumn("flags", every).withColumn("flags", F.slice("flags", F.greatest(F.lit(1), F.size("flags") - settings.window + 1), settings.window)).withColumn("kept", F.col("kept") + F.coalesce("_n", F.lit(0)))
        ended = F.when(F.col("_f").isNull(), "completed").otherwise(expand.verdict(F.col("kept"), F.col("cap"), F.col("flags"), settings))
        last.select("paper_id", "cap", "kept", "flags", ended.alias("criterion")).write.mode("overwrite").parquet(place(k, "papers"))
    rounds = range(1, k + 1)
    ends = spark.read.parquet(*[place(j, "papers") for j in rounds]).where("criterion is not null").select("paper_id", "criterion") if rounds else spark.createDataFrame([], "paper_id string, criterion string")
    header = targets.dropDuplicates(["paper_id"]).join(ends, "paper_id", "left").select(
        "paper_id", F.lit(depth).alias("exhaustion_depth"), F.coalesce("criterion", F.lit("completed")).alias("criterion"), expand.deeper(F.lit(depth), F.col("recorded_depth")).alias("deeper_available"),
        F.greatest(F.coalesce("recorded_depth", F.lit(0)), F.lit(depth)).alias("exhausted_at_depth"),
    )
    return {"items": spark.read.parquet(*[place(j, "items") for j in rounds]) if rounds else None, "headers": header}
