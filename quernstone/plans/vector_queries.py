"""Queries of many vectors at once, and through the index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.operators import vectors
from quernstone.operators.graph import shared_folder
from quernstone.plans.registry import query
from quernstone.sources import views as v

#: Lists of the index, and neighbours wanted.
LISTS, K = 16, 10
JOIN = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
 p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.x, e.x), 6) AS similarity FROM e q, e WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM p) SELECT query_id, id, similarity, rank FROM r WHERE rank <= {K}"""


def both(spark, sf_dir):
    items = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return items, items.where("id % 50 = 0")


def index(spark, items) -> str:
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.write_index(items, folder, LISTS)
    return folder


@query(JOIN)
def vector_join_topk(spark, sf_dir):
    """The ten nearest of every row whose id is divisible by 50, against all rows."""
    return vectors.top_k_join(*both(spark, sf_dir), K)


@query(JOIN)
def vector_index_all_lists(spark, sf_dir):
    """Through the index with all lists probed: the exact result."""
    items, queries = both(spark, sf_dir)
    return vectors.search_index(spark, index(spark, items), queries, K, LISTS)


@query()
def vector_index_search(spark, sf_dir):
    """Through the index with as many lists probed as were measured to find 0.95 of the neighbours of other rows; hit tells whether a row is one of the exact ten, so recall is the mean of hits over ten."""
    items, queries = both(spark, sf_dir)
    folder = index(spark, items)
    found = vectors.search_index(spark, folder, queries, K, vectors.probes_for(spark, folder))
    exact = vectors.top_k_join(items, queries, K).select("query_id", "id", F.lit(True).alias("hit"))
    return found.join(exact, ["query_id", "id"], "left").select("query_id", "id", "similarity", "rank", F.coalesce("hit", F.lit(False)).alias("hit"))
