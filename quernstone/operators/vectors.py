"""Top-k search for many query vectors at once: exactly, in blocks, and through an inverted-file index.

Units of work are a block of items by a block of queries. A unit multiplies the two and keeps the k best items of each query, a bounded heap; the heaps
of a query are merged by rank, first where they were made and then across units, so no task sees more than its units' heaps. Similarities
are cosines in double, rounded to six places; ties go to the smaller id.

The index has a list for each centroid. Centroids are fitted by spherical k-means on a bounded sample (SAMPLE rows, those with the smallest hash of
their id), every row is put into the list of its nearest centroid, and the lists are folders, so that a search reads only those it probes.
Probing all lists gives the exact result. How many have to be probed for a wanted recall depends on the vectors, so it is measured when the index is made
(probes_for), against exact neighbours of a sample.

Rows without a vector, or with one of another length than the first query's, are left out. A vector of length zero has similarity 0 to all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of items and of a block of queries.
ITEM_BLOCK, QUERY_BLOCK = 8192, 512
#: Rows that centroids are fitted on, at most.
SAMPLE = 8192
FOUND = "query_id long, id long, similarity double"


def stacked(vectors: pd.Series) -> np.ndarray:
    """Unit vectors, one a row; zero vectors stay zero."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norms == 0, 1.0, norms)[:, None]


def cosines(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    return np.round(queries @ items.T, 6)


def best(similarity: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the positions of the k highest, ties by id. The k-th highest value bounds what is sorted."""
    if similarity.shape[1] > k:
        least = -np.partition(-similarity, k - 1, axis=1)[:, k - 1]
        rows = [np.flatnonzero(s >= m) for s, m in zip(similarity, least, strict=True)]
    else:
        rows = [np.arange(similarity.shape[1])] * len(similarity)
    return [at[np.lexsort((ids[at], -s[at]))][:k] for s, at in zip(similarity, rows, strict=True)]


def unit_heaps(items: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The heaps of one unit."""
    if not len(items) or not len(queries):
        return pd.DataFrame({"query_id": [], "id": [], "similarity": []}).astype({"query_id": "int64", "id": "int64"})
    s, ids = cosines(stacked(queries["vector"]), stacked(items["vector"])), items["id"].to_numpy()
    kept = best(s, ids, k)
    at, sizes = np.concatenate(kept), [len(x) for x in kept]
    rows = np.repeat(np.arange(len(queries)), sizes)
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[rows], "id": ids[at], "similarity": s[rows, at]})


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank) of the k best of each query. The bound on the rank is applied before the shuffle too."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rows_of(table: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    return table.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(vector).cast("array<double>").alias("vector"))


def blocks(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def of_same_length(items: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = queries.select(F.size("vector").alias("n"), "query_id").orderBy("query_id").limit(1).collect()
    n = first[0].n if first else 0
    return items.where(F.size("vector") == n), queries.where(F.size("vector") == n)


def top_k_join(items: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): for each row of queries the k most similar rows of items, itself included if it is one. Exact."""
    i, q = of_same_length(rows_of(items, id_col, vector, "id"), rows_of(queries, id_col, vector, "query_id"))
    n_items, n_queries = blocks(i, ITEM_BLOCK), blocks(q, QUERY_BLOCK)
    i = i.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n_items))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))))
    q = q.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(n_queries))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_items - 1).cast("long"))))
    heaps = i.groupBy("i", "q").cogroup(q.groupBy("i", "q")).applyInPandas(lambda a, b: unit_heaps(a, b, k), FOUND)
    return merged(heaps, k)


def fit_centroids(items: DataFrame, lists: int, id_col: str = "id", vector: str = "embedding", sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means on a sample of at most `sample` rows; the same rows give the same centroids, in any order and partitioning."""
    rows = rows_of(items, id_col, vector, "id")
    found = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).drop("h").toPandas()
    if not len(found):
        return np.zeros((1, 1))
    found = found[found["vector"].map(len) == len(found["vector"].iloc[0])]
    x = stacked(found["vector"])
    # the next centre is the row farthest from the centres so far
    centres = [x[0]]
    nearest = x @ x[0]
    while len(centres) < min(lists, len(x)):
        centres.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norms[:, None] > 0, sums / np.where(norms == 0, 1.0, norms)[:, None], c)
    return c


def nearest_lists(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """Add `lists`: the n nearest centroids of each row. The centroids (their number by their length, whatever the rows) are sent to each worker once."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        s = np.round(stacked(vectors) @ held.value.T, 9)
        order = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), -s), axis=1) if n > 1 else s.argmax(axis=1)[:, None]
        return pd.Series(list(order[:, :n].astype(np.int32)))

    return rows.withColumn("lists", near("vector"))


def write_index(items: DataFrame, folder: str, lists: int, id_col: str = "id", vector: str = "embedding", sample: int = SAMPLE) -> None:
    """Fit the centroids and write every row into the folder of its list, and the centroids beside them. A list of more than a block is several files."""
    spark = items.sparkSession
    centroids = fit_centroids(items, lists, id_col, vector, sample)
    rows = rows_of(items, id_col, vector, "id").where(F.size("vector") == centroids.shape[1])
    dealt = nearest_lists(rows, centroids, 1).select("id", "vector", F.col("lists")[0].alias("list"))
    # a large list is dealt over as many tasks as it has blocks
    sizes = dealt.groupBy("list").agg(((F.count("*") - 1) / ITEM_BLOCK).cast("int").alias("last"))
    placed = dealt.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int")).drop("last")
    placed.repartition("list", "block").write.partitionBy("list").parquet(f"{folder}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")


def read_centroids(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()
    return np.array([r.centroid for r in rows])


def probes_for(spark: SparkSession, folder: str, target: float = 0.95, k: int = 10, sample: int = 64) -> int:
    """The least number of lists to probe at which `sample` rows of the index (those with the smallest hash) find the target share of their k exact neighbours: few where vectors are in clusters, most lists where they are spread evenly."""
    centroids = read_centroids(spark, folder)
    rows = spark.read.parquet(f"{folder}/rows")
    asking = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select("id", "vector")
    near = top_k_join(rows, asking, k + 1, vector="vector").where("id <> query_id").select("query_id", "id")
    order = nearest_lists(asking.withColumnRenamed("id", "query_id"), centroids, len(centroids)).select("query_id", "lists")
    at = near.join(rows.select("id", "list"), "id").join(order, "query_id").select(F.array_position("lists", F.col("list")).alias("probe"))
    counts = {r.probe: r.n for r in at.groupBy("probe").agg(F.count("*").alias("n")).collect()}  # no more rows than lists
    found, total = 0, sum(counts.values())
    for probes in range(1, len(centroids) + 1):
        found += counts.get(probes, 0)
        if found >= target * total:
            return probes
    return len(centroids)


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, probes: int = 4, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank) from the lists nearest to each query. Only the folders of probed lists are read; a block of a list meets a block of the queries that probe it."""
    centroids = read_centroids(spark, folder)
    q = rows_of(queries, id_col, vector, "query_id").where(F.size("vector") == centroids.shape[1])
    asked = nearest_lists(q, centroids, min(probes, len(centroids))).select("query_id", "vector", F.explode("lists").alias("list"))
    sizes = asked.groupBy("list").agg(((F.count("*") - 1) / QUERY_BLOCK).cast("int").alias("last_q"))
    wanted = [r.list for r in sizes.select("list").collect()]  # no more than there are centroids
    rows = spark.read.parquet(f"{folder}/rows").where(F.col("list").isin(wanted))
    held = rows.groupBy("list").agg(F.max("block").alias("last_b"))
    units = sizes.withColumnRenamed("last_q", "n_q").join(held, "list")
    i = rows.join(F.broadcast(sizes), "list").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("last_q"))))
    a = asked.join(F.broadcast(units), "list").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("n_q") + 1).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last_b"))))
    a = a.select(*[F.col(c).alias(f"{c}_") if c in ("list", "block", "q") else c for c in ("query_id", "vector", "list", "block", "q")])
    heaps = i.groupBy("list", "block", "q").cogroup(a.groupBy("list_", "block_", "q_")).applyInPandas(lambda x, y: unit_heaps(x, y, k), FOUND)
    return merged(heaps, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n, hits): how many of the exact rows of each query were found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
