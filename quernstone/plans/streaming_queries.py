"""Streams over the event table, run to the end; the SQL is their batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.operators import autocomplete, graph
from quernstone.plans.registry import query
from quernstone.sources import snapshots
from quernstone.sources import views as v
from quernstone.streaming import jobs


def folder(spark) -> str:
    return f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = jobs.run_complete(jobs.tumbling_counts(jobs.event_stream(spark, f"{sf_dir}/events.parquet")), folder(spark))
    return out.withColumn("window_start", F.unix_timestamp("window_start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = jobs.run_complete(jobs.sessions(jobs.event_stream(spark, f"{sf_dir}/events.parquet")), folder(spark))
    return out.select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    stream = jobs.without_duplicates(jobs.event_stream(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "60 days")
    return jobs.run_to_table(stream.select("user_id", "event_type", "ts"), folder(spark)).select("user_id", "event_type")


@query("""WITH q AS (SELECT * FROM (VALUES (1, 'pro'), (2, 'S'), (3, 'zz')) t(query_id, prefix)), w AS (SELECT DISTINCT p_type AS text, 'class' AS kind FROM part UNION ALL SELECT DISTINCT p_brand, 'variable' FROM part),
 h AS (SELECT query_id, text, kind, row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 'variable' THEN 5 ELSE 4 END DESC, text, kind) AS r FROM q JOIN w ON starts_with(lower(text), lower(prefix))) SELECT query_id::BIGINT AS query_id, text, kind, r FROM h WHERE r <= 10""")
def prefix_suggestions(spark, sf_dir):
    c = v.component(spark, sf_dir)
    words = c.select(F.col("type").alias("text"), F.lit("class").alias("kind")).distinct().unionByName(c.select(F.col("language").alias("text"), F.lit("variable").alias("kind")).distinct()).withColumn("confidence", F.lit(1.0))
    asked = spark.createDataFrame([(1, "pro"), (2, "S"), (3, "zz")], "query_id long, prefix string")
    return autocomplete.suggestions(asked, words).withColumn("r", F.col("r").cast("long"))


@query(f"""WITH {v.LATEST}, e AS (SELECT src, dst FROM latest WHERE src % 10 <> 0 AND dst % 10 <> 0 UNION SELECT src, dst FROM latest WHERE src % 20 = 0), kept AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 20 <> 10)
 SELECT src, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""")
def stream_sync(spark, sf_dir):
    """Changed ids come as a stream and are applied to snapshots of the graph: half of them come back with their dependencies, half are gone."""
    path = folder(spark)
    nodes, edges = v.component(spark, sf_dir).select("id"), v.latest_edge(spark, sf_dir)
    held = [snapshots.SnapshotTable(spark, f"{path}/{n}") for n in ("nodes", "edges")]
    held[0].write(nodes)
    held[1].write(edges)
    nodes.where("id % 10 = 0").repartition(3).write.parquet(f"{path}/changes")
    changes = spark.readStream.schema("id long").option("maxFilesPerTrigger", 8).parquet(f"{path}/changes")
    rebuilt = lambda ids: (ids.where("id % 20 = 0"), edges.where("src % 20 = 0").join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    jobs.sync_graph(changes, *held, rebuilt, f"{path}/state").awaitTermination()
    return held[1].read().select("src", "dst")
