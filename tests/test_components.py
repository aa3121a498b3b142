"""Components, layers, cycles and depths over tables against plain searches."""

import random

import pandas as pd

from quernstone.operators import components, kernels


def tables(spark, nodes, edges):
    return spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def graphs():
    rng = random.Random(3)
    out = {
        "chain": (range(40), [(i, i + 1) for i in range(39)]),
        "ring": (range(5, 45), [(i, 5 + (i - 4) % 40) for i in range(5, 45)]),
        "star": (range(13), [(0, i) for i in range(1, 13)] + [(i, 0) for i in range(1, 13)]),
        "loops": (range(6), [(1, 1), (1, 2), (2, 3), (3, 2), (4, 5)]),
        "runs back": (range(20), [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 2), (5, 6), (6, 7), (7, 8), (9, 10), (10, 9), (8, 9), (11, 12), (12, 13), (13, 11), (13, 14), (15, 0)]),
        "alone": ([1, 2], []),
    }
    for i in range(5):
        n = rng.choice([8, 15, 30])
        out[f"random {i}"] = (range(n), [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.1, 1.5])))])
    return out


GRAPHS = graphs()


def together():
    """All graphs side by side as one, each with ids of its own."""
    nodes, edges = [], []
    for i, (own, e) in enumerate(GRAPHS.values()):
        nodes += [1000 * i + v for v in own]
        edges += [(1000 * i + a, 1000 * i + b) for a, b in e]
    return nodes, edges


def successors(edges):
    succ = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)
    return succ


def longest(succ, v, path=()):
    best, on = 0, {*path, v}
    for w in succ.get(v, ()):
        best = max(best, 1 if w in on else 1 + longest(succ, w, (*path, v)))
    return best


def test_depths_equal_plain_searches(spark):
    nodes, edges = together()
    found = components.depths(*tables(spark, nodes, [*edges, *edges[:9], (None, 1), (1, 999_999)]))
    assert rows(found, "id", "component", "on_cycle", "layer") == sorted((v, c, on, layer) for v, c, _, on, layer in kernels.analyse(edges, nodes))
    succ, sizes = successors(edges), {i: len(own) for i, (own, _) in enumerate(GRAPHS.values())}
    star = 1000 * list(GRAPHS).index("star")
    for r in found.collect():
        assert r.exact == (r.low == r.high)
        if sizes[r.id // 1000] <= 20:
            assert r.exact and r.low == longest(succ, r.id)
        if star <= r.id < star + 13:
            assert r.low == (2 if r.id == star else 3)


def test_cycles_are_shortest_paths(spark):
    nodes, edges = together()
    found = components.cycle_paths(*tables(spark, nodes, edges)).collect()
    on = {c for _, c, _, cyc, _ in kernels.analyse(edges, nodes) if cyc}
    assert {r.component for r in found} == on and len(found) == len(on)
    succ = successors(edges)
    for r in found:
        assert r.path[0] == r.path[-1] == r.component and len(r.path) == r.length + 1 and len(set(r.path)) == r.length
        assert all(b in succ[a] for a, b in zip(r.path, r.path[1:], strict=False))
        level, steps = {r.component}, 0  # breadth first: no shorter way back
        while not steps or r.component not in level:
            level, steps = {w for v in level for w in succ.get(v, ())}, steps + 1
        assert steps == r.length


def test_nodes_with_loops_that_are_on_a_ring_later(spark):
    """3 and 5 are the ends of runs back to themselves, kept apart from their component by the colour of 1, and a ring once that is gone: both are in one component, and each node has one row."""
    edges = [(1, 2), (2, 1), (1, 3), (3, 4), (4, 3), (3, 5), (5, 3), (5, 6), (6, 5)]
    found = rows(components.all_components(*tables(spark, range(1, 7), edges)), "id", "component", "on_cycle")
    assert found == [(v, 1 if v < 3 else 3, True) for v in range(1, 7)]


def test_rounds_of_a_long_chain(spark):
    """A chain of 3,000 nodes with a ring of 1,000 behind it takes rounds by the logarithm of their lengths."""
    edges = [(i, i + 1) for i in range(3000)] + [(5000 + i, 5000 + (i + 1) % 1000) for i in range(1000)] + [(3000, 5000)]
    rounds = {}
    found = components.layers(*tables(spark, [*range(3001), *range(5000, 6000)], edges), rounds)
    print(rounds)
    assert sum(rounds.values()) < 60
    got = {r.id: (r.component, r.layer) for r in found.collect()}
    assert got[0] == (0, 3001) and got[3000] == (3000, 1) and got[5999] == (5000, 0)


def test_large_components_get_an_interval(spark, monkeypatch):
    monkeypatch.setattr(components, "SEARCH_NODES", 3)
    found = {r.id: r for r in components.depths(*tables(spark, range(6), [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5)])).collect()}
    assert not found[0].exact and found[0].low <= 5 <= found[0].high and found[4].exact and found[4].low == 1
    whole = pd.DataFrame([(a, b, None, None) for a in range(6) for b in range(6) if a != b], columns=["src", "dst", "low", "high"])
    assert {(r.low, r.high) for r in components.search_component((0,), whole, 10_000).itertuples()} == {(6, 6)}
    assert all(r.low < 6 <= r.high for r in components.search_component((0,), whole, 3).itertuples())
