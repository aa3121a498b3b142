"""Batched top-k search and the inverted-file index against every pair."""

import numpy as np
import pytest

from quernstone.operators import vectors
from quernstone.plans import vector_queries


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], "id long, embedding array<double>")


def brute(rows, queries, k):
    out = []
    for q, a in queries:
        found = []
        for i, b in rows:
            norm = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
            found.append((-round(float(np.dot(a, b) / norm), 6) if norm else -0.0, i))
        out += [(q, i, -s + 0.0, r + 1) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.id, r.similarity + 0.0, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    return [(i, centres[i % 12] + 0.3 * rng.normal(size=8)) for i in range(400)] + [(1000 + i, centres[0]) for i in range(30)]


@pytest.mark.parametrize("block", [(7, 3), (8192, 512)])
def test_blocks_equal_all_pairs(spark, monkeypatch, some, block):
    monkeypatch.setattr(vectors, "ITEM_BLOCK", block[0])
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block[1])
    rows, queries = some[-130:], some[::37]
    assert result(vectors.top_k_join(table(spark, rows), table(spark, queries), 5)) == brute(rows, queries, 5)


def test_all_lists_are_exact(spark, monkeypatch, some, tmp_path):
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    queries = some[::29]
    vectors.write_index(table(spark, some), str(tmp_path / "i"), 9)
    rows = spark.read.parquet(str(tmp_path / "i" / "rows"))
    assert rows.count() == len(some) and rows.select("list").distinct().count() <= 9
    assert result(vectors.search_index(spark, str(tmp_path / "i"), table(spark, queries), 6, probes=9)) == brute(some, queries, 6)


def test_few_lists_are_read(spark, some, tmp_path):
    vectors.write_index(table(spark, some), str(tmp_path / "i"), 9)
    found = vectors.search_index(spark, str(tmp_path / "i"), table(spark, some[:1]), 6, probes=1)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan or "PartitionFilters: [list" in plan
    assert found.count() == 6


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall(spark, size):
    hits = vector_queries.vector_index_search(spark, f"/root/testdata/{size}").toPandas()["hit"]
    print(f"recall on {size}: {hits.mean():.3f}")
    assert hits.mean() >= 0.9


def test_probes_follow_the_vectors(spark, some, tmp_path):
    vectors.write_index(table(spark, some), str(tmp_path / "i"), 12)
    assert vectors.probes_for(spark, str(tmp_path / "i"), 0.9, 5) <= 4
    rng = np.random.default_rng(2)
    vectors.write_index(table(spark, [(i, rng.normal(size=32)) for i in range(300)]), str(tmp_path / "j"), 12)
    assert vectors.probes_for(spark, str(tmp_path / "j"), 0.9, 5) > 4


def test_defined_cases(spark, tmp_path):
    rows = [(1, [1, 0]), (2, None), (3, [0, 0]), (4, [1, 0, 0]), (5, [-1, 0]), (5, [-1, 0])]
    got = result(vectors.top_k_join(table(spark, rows), table(spark, rows[:1]), 10))
    assert got == [(1, 1, 1.0, 1), (1, 3, 0.0, 2), (1, 5, -1.0, 3), (1, 5, -1.0, 4)]
    empty = table(spark, [])
    assert vectors.top_k_join(empty, table(spark, rows[:1]), 3).count() == 0
    assert vectors.top_k_join(table(spark, rows), empty, 3).count() == 0
    vectors.write_index(table(spark, rows), str(tmp_path / "i"), 2)
    assert len(result(vectors.search_index(spark, str(tmp_path / "i"), table(spark, rows[:1]), 10, 2))) == 4
