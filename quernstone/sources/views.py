"""Adapter views: the engine's relations derived from the star-schema tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


COMPONENT = """component AS (SELECT p_partkey AS id, p_partkey % 7 AS project_id, p_name AS name, p_type AS type, p_brand AS language,
 concat(p_type, '/', p_brand, '/', CAST(p_partkey AS VARCHAR)) AS path, CAST(p_size AS DOUBLE) AS complexity, CAST(floor(p_retailprice) AS BIGINT) AS line_count,
 CAST(p_partkey * 37 % 101 AS DOUBLE) AS coverage_pct, CAST(p_partkey * 37 % 101 AS DOUBLE) / 100 AS coverage_frac, CAST(p_partkey * 13 % 101 AS DOUBLE) / 100 AS doc_score,
 CAST(p_partkey * 7 % 101 AS DOUBLE) / 100 AS security_score, CAST(100 - p_size AS DOUBLE) AS maintainability, CAST(p_partkey % 10 AS DOUBLE) / 10 AS debt,
 string_split(p_name, ' ') AS tags, [p_type, p_brand] AS categories FROM part)"""


def component(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("p_partkey"), lambda c: c.cast("double")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 7).alias("project_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("language"),
        F.concat_ws("/", "p_type", "p_brand", k.cast("string")).alias("path"), d(F.col("p_size")).alias("complexity"), F.floor("p_retailprice").cast("long").alias("line_count"),
        d(k * 37 % 101).alias("coverage_pct"), (d(k * 37 % 101) / 100).alias("coverage_frac"), (d(k * 13 % 101) / 100).alias("doc_score"),
        (d(k * 7 % 101) / 100).alias("security_score"), d(100 - F.col("p_size")).alias("maintainability"), (d(k % 10) / 10).alias("debt"),
        F.split("p_name", " ").alias("tags"), F.array("p_type", "p_brand").alias("categories"),
    )


EDGE = """edge AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
 ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies: consecutive parts of an order depend on one another."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return lines.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").where("src <> dst").distinct()


LATEST = """newest AS (SELECT src, dst, l_orderkey FROM (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 1000000000000 + l_partkey) AS src, arg_max(l_partkey, l_linenumber * 1000000000000 + l_partkey) AS dst FROM lineitem GROUP BY 1)
 JOIN (SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS l_orderkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1) USING (l_orderkey) WHERE src <> dst),
 latest AS (SELECT src, dst FROM newest UNION SELECT dst, src FROM newest JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')"""


def latest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of the newest state: the first part of each customer's newest order depends on its last, and in urgent orders the last on the first too. A sparse graph with long chains and many small cycles; `edge` has one large component."""
    at = F.struct("l_linenumber", "l_partkey")  # line numbers repeat
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(at)["l_partkey"].alias("src"), F.max(at)["l_partkey"].alias("dst"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", F.col("o_orderkey").alias("l_orderkey")).join(ends, "l_orderkey")
    newest = orders.groupBy("o_custkey").agg(F.max_by(F.struct("src", "dst", "o_orderpriority"), F.struct("o_orderdate", "l_orderkey")).alias("e")).select("e.*").where("src <> dst")
    ways = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).otherwise(F.array(F.struct("src", "dst")))
    return newest.select(F.explode(ways).alias("e")).select("e.*").distinct()


MEMORY = """memory AS (SELECT d.doc_id AS id, d.text AS content, d.lang AS memory_type, d.source AS agent, CAST(1 + d.doc_id % 10 AS BIGINT) AS importance,
 coalesce(l.quality, 1) = 1 AS is_active, d.doc_id % 7 AS project_id, d.doc_id AS created_seq, e.embedding AS embedding, e.label AS label
 FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def memory(spark: SparkSession, sf_dir: str, embeddings: bool = True) -> DataFrame:
    d, e, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")
    out = d.join(x.select("doc_id", "quality"), "doc_id", "left")
    if embeddings:
        out = out.join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    more = ["embedding", "label"] if embeddings else []
    k = F.col("doc_id")
    return out.select(
        k.alias("id"), F.col("text").alias("content"), F.col("lang").alias("memory_type"), F.col("source").alias("agent"), (1 + k % 10).cast("long").alias("importance"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("is_active"), (k % 7).alias("project_id"), k.alias("created_seq"), *more,
    )


METRIC = "metric AS (SELECT event_id AS id, user_id AS component_id, event_type AS metric, value, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props FROM events)"


def metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("component_id"), F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


MESSAGE = "message AS (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations)"
