"""Graphs above one task's bound that fall into parts below it."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.operators import components, graph, kernels


@pytest.fixture(scope="module")
def many(spark):
    """Twelve parts of ten nodes with random edges, chains and loops, and single nodes."""
    rng = random.Random(2)
    edges = {(10 * p + rng.randrange(10), 10 * p + rng.randrange(10)) for p in range(12) for _ in range(11)}
    edges |= {(10 * p + i, 10 * p + i + 1) for p in range(0, 12, 3) for i in range(9)} | {(7, 999), (998, 31)}
    return spark.createDataFrame([(i,) for i in range(130)], "id long").cache(), spark.createDataFrame(sorted(edges), "src long, dst long").cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def refuse(*_, **__):
    raise AssertionError("rounds over tables")


def test_parts_are_analysed_apart(many, monkeypatch):
    want = rows(graph.small_levels(*many)), rows(graph.layers_in_rounds(*many))
    monkeypatch.setattr(graph, "SMALL_GRAPH", 60)
    monkeypatch.setattr(graph, "BIN", 25)
    for name in ("depths", "all_components"):
        monkeypatch.setattr(components, name, refuse)
    monkeypatch.setattr(graph, "layers_in_rounds", refuse)
    assert rows(graph.levels(*many)) == want[0]
    assert rows(graph.components_of(*many)) == [r[:3] for r in want[0]]
    assert rows(graph.layers(*many)) == want[1]


def test_larger_parts_go_over_tables(many, monkeypatch):
    nodes, edges = many
    want = rows(graph.layers_in_rounds(nodes, edges))
    monkeypatch.setattr(graph, "SMALL_GRAPH", 22)
    assert graph.parted(nodes, edges)[1] is not None
    assert rows(graph.layers(nodes, edges)) == want


def brute_reach(edges):
    succ, out = {}, {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)
    for s in succ:
        seen, at, n = {}, {s}, 0
        while at:
            n += 1
            at = {w for v in at for w in succ.get(v, ())} - set(seen)
            seen |= dict.fromkeys(at, n)
        out[s] = seen
    return out


@pytest.mark.parametrize("most", [100_000, 22])
def test_searches_stay_in_parts(many, monkeypatch, most):
    nodes, edges = many
    monkeypatch.setattr(graph, "SMALL_REACH", most)
    if most > 100:
        monkeypatch.setattr(graph, "reach", refuse)
    pairs = rows(edges)
    found = brute_reach(pairs)
    level, start, last = min((-n, s, v) for s, seen in found.items() for v, n in seen.items() if v != s)
    parts = graph.parted(edges.selectExpr("src AS id"), edges, most)
    assert rows(graph.farthest(parts, 30)) == [(start, last, -level)]
    want = graph.shortest_path(edges, start, last).collect()
    if most > 100:
        monkeypatch.setattr(graph, "shortest_path", refuse)
    assert want and graph.shortest_in_parts(parts, start, last).collect() == want
    assert not graph.shortest_in_parts(parts, start, last, -level - 1).collect() and not graph.shortest_in_parts(parts, start, -1).collect()
    back = brute_reach([(b, a) for a, b in pairs])
    got = {r[0]: r[1:] for r in rows(graph.impact(edges, nodes))}
    assert got == {i: (d := sum(n == 1 for n in back.get(i, {}).values()), a := len(back.get(i, {})), a - d, d > 5 or a > 20) for i in range(130)}


def test_arrays_give_the_components_of_plain_searches():
    rng = random.Random(5)
    nodes = rng.sample(range(1_000), 400)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(420)] + [(nodes[i], nodes[i + 1]) for i in range(60)] + [(nodes[60], nodes[50]), (nodes[3], nodes[3]), (5_000, nodes[0]), (nodes[1], 5_000)]
    inside = [(a, b) for a, b in edges if a != 5_000 and b != 5_000]
    df = pd.DataFrame([(v, None) for v in nodes] + edges + edges[:9], columns=["src", "dst"])
    found = graph.levels_run()(df)
    want = sorted((v, component, on_cycle, layer) for v, component, _, on_cycle, layer in kernels.analyse(inside, sorted(nodes)))
    assert [tuple(r[:4]) for r in found.itertuples(index=False)] == want and any(r[2] for r in want) and max(r[3] for r in want) > 9
    assert not len(graph.levels_run()(df[:0])) and not len(graph.kahn_run()(df[:0]))


def test_a_part_of_most_nodes_is_one_task_s(spark, monkeypatch):
    """300,000 nodes and as many edges in one part, as newest orders give them for a million parts: no rounds over tables, in which layers took longer than their limit."""
    for name in ("depths", "all_components"):
        monkeypatch.setattr(components, name, refuse)
    monkeypatch.setattr(graph, "layers_in_rounds", refuse)
    n = 300_000
    nodes = spark.range(n)
    edges = spark.range(1, n).selectExpr("id AS src", "id div 2 AS dst").unionByName(spark.range(1).selectExpr("0L AS src", "1L AS dst"))
    got = graph.levels(nodes, edges).agg(F.max("layer"), F.count_if("on_cycle"), F.max("depth")).first()
    assert tuple(got) == (18, 2, 20)
    assert graph.layers(nodes, edges).agg(F.max("layer")).first()[0] == 17
