"""File events as streams: debouncing, micro-batches, merging into tables, running metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(events: DataFrame, within: float = 0.1) -> DataFrame:
    """Drops an event of a path within ``within`` seconds of the last one kept.

    ``events``: (path, event_type, ts double). The last kept time of each path is
    the state, so the rule holds across micro-batches.
    """
    out = "path string, event_type string, ts double"

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        kept = []
        for r in rows.itertuples(index=False):
            if r.ts - last >= within:
                kept.append((key[0], r.event_type, r.ts))
                last = r.ts
        state.update((last,))
        yield pd.DataFrame(kept, columns=["path", "event_type", "ts"])

    return events.groupBy("path").applyInPandasWithState(keep, out, "last double", "append", GroupStateTimeout.NoTimeout)


def last_per_path(batch: DataFrame) -> DataFrame:
    """The last event of each path wins; of events at one time, a deletion yields to what came with it, then the greatest type."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.col("event_type") == "deleted", F.desc("event_type"))
    return batch.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def expand_moves(batch: DataFrame) -> DataFrame:
    """A move is a deletion of the old path and a creation of the new one."""
    old = F.struct(F.col("old_path").alias("path"), F.lit("deleted").alias("event_type"), F.col("ts"))
    new = F.struct(F.col("path"), F.lit("created").alias("event_type"), F.col("ts"))
    same = F.struct(F.col("path"), F.col("event_type"), F.col("ts"))
    return batch.select(F.explode(F.when(F.col("event_type") == "moved", F.array(old, new)).otherwise(F.array(same))).alias("e")).select("e.*")


def process(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Runs ``apply`` on each micro-batch of last events, moves expanded; ``every``: trigger interval, else what is there."""

    def batch(df: DataFrame, epoch: int) -> None:
        apply(last_per_path(expand_moves(df)), epoch)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def running_metrics(metrics: DataFrame, name: str = "name", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Count, sum, extremes and mean of each metric and minute."""
    g = metrics.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), F.col(name).alias("name"))
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def sessions(history: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = history.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id")
    return g.agg(F.count("*").alias("searches"), F.min("ts").alias("start"), F.max("ts").alias("end"))
