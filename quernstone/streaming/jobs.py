"""Structured Streaming jobs: ingest without duplicates, windows over event time, change-driven sync, expiry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quernstone.operators import graph
from quernstone.sources.snapshots import SnapshotTable


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Event files as a stream: those in a folder, or one file. Their timestamps have no zone, which watermarks do not accept, so they are cast."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if not folder:
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, value) per tumbling window."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n) with a gap of inactivity."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def without_duplicates(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped after it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there and stop; the result is read from the files written."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_complete(stream: DataFrame, path: str) -> DataFrame:
    """All groups, also those whose window is still open. Each batch writes its result as files, and the last one is read; nothing goes through the driver."""
    batches = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/{batch}")
        batches.append(batch)

    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out/{batches[-1]}")


def sync_graph(changes: DataFrame, nodes: SnapshotTable, edges: SnapshotTable, rebuilt, checkpoint: str):
    """Start a query that applies each batch of changed ids to the graph snapshots. rebuilt(ids) gives the new nodes and edges of those ids."""

    def apply(batch: DataFrame, _: int) -> None:
        ids = batch.select("id").distinct().cache()
        if not ids.isEmpty():
            new_nodes, new_edges = rebuilt(ids)
            n, e = graph.incremental_sync(nodes.read(), edges.read(), new_nodes, new_edges, ids)
            nodes.write(n)
            edges.write(e)
        ids.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expiring_counts(events: DataFrame, key: str, ttl_ms: int = 3_600_000) -> DataFrame:
    """(key, n): running counts per key, which are forgotten ttl_ms after the key's last event."""

    def count(k: tuple, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        n = sum(len(df) for df in batches) + (state.get[0] if state.exists else 0)
        state.update((n,))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [str(k[0])], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(count, "key string, n long", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)
