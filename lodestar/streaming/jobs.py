"""Structured Streaming forms of the incremental steps; an extra, as the batch operators give the same results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPENED = "pair string, seq long, depth_a int, depth_b int, reason string"


def inbox(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, archive: str | None = None) -> DataFrame:
    """New files of an inbox, some at a time; read ones are archived where a folder is given."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, resuming from its checkpoint, and stops."""
    df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path).awaitTermination()


def new_pairs(pairs: DataFrame, time: str = "analyzed_at", delay: str = "1 day") -> DataFrame:
    """Each pair once within the watermark."""
    return pairs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["pair"])


def activity(events: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, delay).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def stop_state(items: DataFrame, redundancy_stop: int = 3, window: int = 5) -> DataFrame:
    """(paper_id, seq, stopped) for items (paper_id, seq, redundant): the last flags of a paper are its state."""

    def step(key, frames, state):
        last = list(state.get[0]) if state.exists else []
        out = []
        for pdf in frames:
            for seq, redundant in sorted(zip(pdf["seq"], pdf["redundant"], strict=True)):
                last = [*last, int(redundant)][-window:]
                out.append((key[0], seq, len(last) == window and sum(last) >= redundancy_stop))
        state.update((last,))
        yield pd.DataFrame(out, columns=["paper_id", "seq", "stopped"])

    return items.groupBy("paper_id").applyInPandasWithState(step, "paper_id long, seq long, stopped boolean", "last array<int>", "append", "NoTimeout")


class PairDepths(StatefulProcessor):
    """State of a pair: the largest depth of each of its papers with which it has been analysed."""

    def init(self, handle) -> None:
        self.depths = handle.getMapState("depths", "side string", "depth int")

    def handleInputRows(self, key, rows, timerValues):
        known = {k[0]: v[0] for k, v in self.depths.iterator()}
        pdf = pd.concat(list(rows))
        out = []
        for seq, *now in pdf.sort_values("seq")[["seq", "depth_a", "depth_b"]].itertuples(index=False):
            depths = {side: 0 if pd.isna(d) else int(d) for side, d in zip("ab", now, strict=True)}
            if known and all(depths[side] <= known[side] for side in "ab"):
                continue
            out.append((key[0], seq, depths["a"], depths["b"], "depth_upgrade" if known else "initial"))
            known = {side: max(depths[side], known.get(side, 0)) for side in "ab"}
        for side, depth in known.items():
            self.depths.updateValue((side,), (depth,))
        yield pd.DataFrame(out, columns=["pair", "seq", "depth_a", "depth_b", "reason"])

    def close(self) -> None:
        pass


def opened_pairs(events: DataFrame) -> DataFrame:
    """(pair, seq, depth_a, depth_b, reason) of those of events (pair, seq, depth_a, depth_b) at which a pair is to be analysed:
    the first, and each with a depth larger than any before; null depths are 0. An event that comes late, in a later trigger,
    opens its pair again if it is deeper; within a trigger events go by seq.

    The state is a map a pair and stays for good, as a pair may become deeper at any time; it needs the RocksDB state store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.select("pair", "seq", F.col("depth_a").cast("int").alias("depth_a"), F.col("depth_b").cast("int").alias("depth_b"))
    return rows.groupBy("pair").transformWithStateInPandas(statefulProcessor=PairDepths(), outputStructType=OPENED, outputMode="Append", timeMode="None")
