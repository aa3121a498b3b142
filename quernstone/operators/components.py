"""Strongly connected components, layers, cycles and longest chains of graphs of any size, over tables.

Chains first: a node with one way in and one way out decides nothing, so each run of such nodes becomes one weighted edge. Where a run ends is found by pointer doubling,
in as many rounds as the length of the longest run has binary digits; a ring of such nodes shows by never ending. What is left branches.

Components of the rest: a bounded trim (nodes without a way in or out), then searches from all nodes at once: every node takes the smallest node that reaches
it as its colour, and each colour's own node searches back within its colour. What it meets is its component; all colours search in the same rounds. Both steps repeat on
what is left, chains again first.

Layers and depths go over the graph of components, chains contracted; a round settles every component whose dependencies are settled.

Each round is a table in shared storage. `rounds` (a dict), where given, gets the number of rounds of each kind.

Null ends and edges to nodes that are not in the node table are left out; parallel edges count once; a self loop puts its node on a cycle.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.graph import shared_folder

#: Rounds of trimming before each search; what is left after them is found by the search.
TRIM = 2
#: Nodes and edges up to which the chains of a component are searched, and the steps that a search may take. Above, a depth is given as an interval.
SEARCH_NODES, SEARCH_EDGES, SEARCH_STEPS = 256, 4096, 200_000


_open = threading.local()


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder. A checkpoint would keep the size estimates of all rounds before, which multiply with each join until planning takes longer than the work."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _open.tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of the tables that an analysis writes, only its result stays."""

    @wraps(f)
    def run(*args, **named) -> DataFrame:
        if getattr(_open, "tables", None) is not None:  # part of another analysis
            return f(*args, **named)
        _open.tables = []
        try:
            out = settled(f(*args, **named))
            for path in _open.tables[:-1]:
                at = out.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            return out
        finally:
            _open.tables = None

    return run


def count(rounds: dict | None, kind: str) -> None:
    if rounds is not None:
        rounds[kind] = rounds.get(kind, 0) + 1


def plain_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()


def inner_nodes(edges: DataFrame) -> DataFrame:
    """(id, into, out) of nodes with exactly one edge in, from `into`, and one out, to `out`."""
    ends = edges.select(F.col("src").alias("id"), F.lit(None).cast("long").alias("into"), F.col("dst").alias("out")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("into"), F.lit(None).cast("long").alias("out")))
    return ends.groupBy("id").agg(F.count("into").alias("n_in"), F.count("out").alias("n_out"), F.first("into", ignorenulls=True).alias("into"), F.first("out", ignorenulls=True).alias("out")).where("n_in = 1 AND n_out = 1").select("id", "into", "out")


def chains(edges: DataFrame, rounds: dict | None = None, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contracted edges (src, dst, steps), inner (id, head, tail, to_head, to_tail), rings (id, component)) of edges without loops.

    inner: the nodes of a run, the nodes before and behind it, and the steps to them. Nodes of `fixed` (id) are never inside a run."""
    inner = inner_nodes(edges)
    inner = settled(inner if fixed is None else inner.join(fixed.select("id"), "id", "left_anti"))
    at = settled(inner.select("id", F.col("into").alias("head"), F.lit(1).cast("long").alias("to_head"), F.col("out").alias("tail"), F.lit(1).cast("long").alias("to_tail"), F.least("id", "out").alias("least")))
    n, reached = inner.count(), 1
    while n and reached < 2 * n:
        # an end that is itself inside a run is replaced by that node's own end
        count(rounds, "chain")
        far = at.select(F.col("id").alias("tail"), F.col("tail").alias("t2"), F.col("to_tail").alias("d2"), F.col("least").alias("l2"))
        near = at.select(F.col("id").alias("head"), F.col("head").alias("h2"), F.col("to_head").alias("e2"))
        both = at.join(far, "tail", "left").join(near, "head", "left")
        new = both.select("id", F.coalesce("h2", "head").alias("head"), (F.col("to_head") + F.coalesce("e2", F.lit(0))).alias("to_head"), F.coalesce("t2", "tail").alias("tail"), (F.col("to_tail") + F.coalesce("d2", F.lit(0))).alias("to_tail"), F.least("least", F.coalesce("l2", "least")).alias("least"), (F.col("t2").isNotNull() | F.col("h2").isNotNull()).alias("moved"))
        new = settled(new)
        reached *= 2
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    # who still points at an inner node after as many doublings as there can be steps is on a ring
    closed = at.join(inner.select(F.col("id").alias("tail")), "tail", "left_semi")
    rings = settled(closed.select("id", F.col("least").alias("component")))
    runs = settled(at.join(rings.select("id"), "id", "left_anti").select("id", "head", "tail", "to_head", "to_tail"))
    skip = inner.select("id")
    kept = edges.join(skip, edges["src"] == skip["id"], "left_anti").join(skip, edges["dst"] == skip["id"], "left_anti").select("src", "dst", F.lit(1).cast("long").alias("steps"))
    # the first node of a run stands for the whole of it
    short = runs.where("to_head = 1").select(F.col("head").alias("src"), F.col("tail").alias("dst"), (F.col("to_tail") + 1).alias("steps"))
    return settled(kept.unionByName(short).groupBy("src", "dst").agg(F.max("steps").alias("steps"))), runs, rings


def trimmed(edges: DataFrame, times: int = TRIM, rounds: dict | None = None) -> DataFrame:
    """The edges between nodes that have a way in and a way out, looked at `times` times."""
    for _ in range(times):
        count(rounds, "trim")
        out, into = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = settled(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
    return edges


def colours(edges: DataFrame, rounds: dict | None = None) -> DataFrame:
    """(id, colour): the smallest node that reaches each node, itself included. Only nodes whose colour changed send it on."""
    own = settled(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("colour", F.col("id")))
    changed = own
    while True:
        count(rounds, "colour")
        sent = edges.join(changed.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
        new = settled(own.join(sent, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("changed")))
        changed, own = new.where("changed").select("id", "colour"), new.select("id", "colour")
        if changed.isEmpty():
            return own


def met_backwards(edges: DataFrame, coloured: DataFrame, rounds: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, component): the nodes of each colour that reach the colour's own node; and the edges inside colours between the others."""
    c = coloured
    inside = settled(edges.join(c.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst"))
    met = frontier = c.where("id = colour").select("id", F.col("colour").alias("component"))
    while True:
        count(rounds, "back")
        step = inside.join(frontier.select(F.col("id").alias("dst"), "component"), "dst").select(F.col("src").alias("id"), "component").distinct()
        frontier = settled(step.join(met.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        met = settled(met.unionByName(frontier))
    ids = met.select("id")
    return met, settled(inside.join(ids, inside["src"] == ids["id"], "left_anti").join(ids, inside["dst"] == ids["id"], "left_anti"))


@tidy
def strongly_connected(edges: DataFrame, rounds: dict | None = None) -> DataFrame:
    """(id, component) of all nodes in components of more than one; component is the smallest node."""
    left = settled(plain_edges(edges).where("src <> dst"))
    out = left.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    layers: list[DataFrame] = []
    while True:
        left = trimmed(left, TRIM, rounds)
        short, runs, rings = chains(left, rounds)
        out = out.unionByName(rings)
        layers.append(runs)
        loops = short.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")).distinct()
        left = settled(short.where("src <> dst").select("src", "dst"))
        # a node met alone is settled too: it is in no component, but for a run that leads back to it
        met = loops
        if not left.isEmpty():
            met, left = met_backwards(left, colours(left, rounds), rounds)
        # a node with a loop of an earlier round can be on a ring now: each keeps one component, the smallest
        out = settled(out.unionByName(loops).unionByName(met).groupBy("id").agg(F.min("component").alias("component")))
        if left.isEmpty():
            break
    # runs whose two ends are in one component are in it too; the innermost contraction is undone first
    for runs in reversed(layers):
        ends = out.select(F.col("id").alias("head"), F.col("component").alias("a")), out.select(F.col("id").alias("tail"), F.col("component").alias("b"))
        own = runs.join(ends[0], "head").join(ends[1], "tail").where("a = b").select("id", F.col("a").alias("component"))
        out = settled(out.unionByName(own))
    sizes = out.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    return out.join(sizes, "component").select("id", F.col("least").alias("component"))


@tidy
def all_components(nodes: DataFrame, edges: DataFrame, rounds: dict | None = None) -> DataFrame:
    """(id, component, on_cycle) of every node."""
    ids = nodes.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    e = within(ids, edges)
    loops = e.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop")).distinct()
    out = ids.join(strongly_connected(e, rounds), "id", "left").join(loops, "id", "left")
    return settled(out.select("id", F.coalesce("component", "id").alias("component"), (F.col("component").isNotNull() | F.col("loop").isNotNull()).alias("on_cycle")))


@tidy
def weak_parts(nodes: DataFrame, edges: DataFrame, rounds: dict | None = None) -> DataFrame:
    """(id, part) of every node and end of an edge: the smallest node of its weakly connected part. Large-star and small-star rounds in turn (Kiveris et al., 2014)."""
    plain = plain_edges(edges)
    ids = nodes.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).union(plain.select("src")).union(plain.select("dst")).distinct()
    e, before = settled(plain.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()), None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if mark == before or not mark.n:
            return ids.join(e.select(F.col("a").alias("id"), F.col("b").alias("part")), "id", "left").select("id", F.coalesce("part", "id").alias("part"))
        count(rounds, "weak")
        before = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settled(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = settled(large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def within(ids: DataFrame, edges: DataFrame) -> DataFrame:
    e = plain_edges(edges)
    return settled(e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))


def component_layers(parts: DataFrame, edges: DataFrame, rounds: dict | None = None) -> DataFrame:
    """(component, layer): 0 without dependencies, else 1 more than the highest layer depended on. Runs of components are contracted, so a chain takes a round, whatever its length."""
    of = parts.select("id", "component")
    e = edges.join(of.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    short, runs, _ = chains(settled(e), rounds)
    inner = runs.select(F.col("id").alias("component"))
    left = settled(parts.select("component").distinct().join(inner, "component", "left_anti"))
    done = left.select("component", F.lit(0).cast("long").alias("layer")).limit(0)
    waits = short
    while not left.isEmpty():
        count(rounds, "layer")
        free = left.join(waits.select(F.col("src").alias("component")).distinct(), "component", "left_anti")
        best = short.join(free.withColumnRenamed("component", "src"), "src", "left_semi").join(done.withColumnRenamed("component", "dst"), "dst").groupBy(F.col("src").alias("component")).agg(F.max(F.col("layer") + F.col("steps")).alias("layer"))
        now = settled(free.join(best, "component", "left").select("component", F.coalesce("layer", F.lit(0)).cast("long").alias("layer")))
        done = settled(done.unionByName(now))
        left = settled(left.join(now, "component", "left_anti"))
        waits = settled(waits.join(now.select(F.col("component").alias("dst")), "dst", "left_anti"))
    along = runs.join(done.select(F.col("component").alias("tail"), "layer"), "tail").select(F.col("id").alias("component"), (F.col("layer") + F.col("to_tail")).alias("layer"))
    return settled(done.unionByName(along))


@tidy
def layers(nodes: DataFrame, edges: DataFrame, rounds: dict | None = None) -> DataFrame:
    """(id, component, on_cycle, layer) of every node."""
    parts = all_components(nodes, edges, rounds)
    return parts.join(component_layers(parts, within(parts, edges), rounds), "component").select("id", "component", "on_cycle", "layer")


@tidy
def cycle_paths(nodes: DataFrame, edges: DataFrame, rounds: dict | None = None) -> DataFrame:
    """(component, length, path): a shortest cycle through the smallest node of each component, from it and back to it (the first node repeated, and the path begins with the smallest, so equal cycles are written alike).

    A breadth-first search inside all components at once from their smallest nodes keeps the smallest parent of each node; the first step back closes the cycle, and the parents are followed back."""
    parts = all_components(nodes, edges, rounds)
    e = within(parts, edges)
    smallest = parts.where("id = component").select(F.col("id").alias("src"))
    loops = e.where("src = dst").join(smallest, "src", "left_semi").select(F.col("src").alias("component"), F.lit(1).alias("length"), F.array("src", "dst").alias("path"))
    on = parts.where("on_cycle").select("id", "component")
    inside = settled(e.where("src <> dst").join(on.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(on.select(F.col("id").alias("dst"), F.col("component").alias("component")), "dst").where("a = component").select("src", "dst", "component"))
    looped = loops.select("component")
    frontier = on.where("id = component").join(looped, "component", "left_anti").select("id", "component")
    seen = settled(frontier.select("id", "component", F.lit(None).cast("long").alias("parent")))
    ends = frontier.select("component", F.col("id").alias("last"), F.lit(0).alias("level")).limit(0)
    level = 0
    while not frontier.isEmpty():
        level += 1
        count(rounds, "cycle")
        step = inside.join(frontier.select(F.col("id").alias("src"), "component"), ["src", "component"])
        back = step.where("dst = component").groupBy("component").agg(F.min("src").alias("last")).select("component", "last", F.lit(level).alias("level"))
        ends = settled(ends.unionByName(back))
        new = step.join(ends.select("component"), "component", "left_anti").groupBy(F.col("dst").alias("id"), "component").agg(F.min("src").alias("parent"))
        frontier = settled(new.join(seen.select("id"), "id", "left_anti"))
        seen = settled(seen.unionByName(frontier.select("id", "component", "parent")))
        frontier = frontier.select("id", "component")
    path = settled(ends.select("component", "level", F.col("last").alias("at"), F.array("last", "component").alias("path")))
    longest = path.agg(F.max("level").alias("n")).first().n or 0
    up = seen.select(F.col("id").alias("at"), "parent")
    for _ in range(1, longest):
        count(rounds, "cycle back")
        path = settled(path.join(up, "at", "left").select("component", "level", F.coalesce("parent", "at").alias("at"), F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path")))
    return loops.unionByName(path.select("component", F.col("level").alias("length"), "path"))


def longest_search(succ: dict, exits: dict, start: int, budget: int) -> tuple[int, bool, int]:
    """(steps, whether all chains were looked at, steps of the search) of the longest chain from a node; a step back onto the chain counts and ends it."""
    best, used = exits.get(start, 0), 0
    path, on, work = [start], {start}, [iter(succ.get(start, ()))]
    while work:
        if used >= budget:
            return best, False, used
        step = next(work[-1], None)
        used += 1
        if step is None:
            work.pop()
            on.discard(path.pop())
        elif step in on:
            best = max(best, len(path))
        else:
            best = max(best, len(path) + exits.get(step, 0))
            path.append(step)
            on.add(step)
            work.append(iter(succ.get(step, ())))
    return best, True, used


def search_component(key: tuple, df: pd.DataFrame, steps: int) -> pd.DataFrame:
    """The depths (low, high) from each node of one component of bounded size; rows without dst give the interval of what follows outside."""
    inner, outer = df[df["dst"].notna()], df[df["dst"].isna()]
    lows, highs = (dict(zip(outer["src"], outer[c].astype("int64"), strict=True)) for c in ("low", "high"))
    succ: dict = {}
    for a, b in zip(inner["src"], inner["dst"].astype("int64"), strict=True):
        succ.setdefault(a, []).append(b)
    n, out, budget, further = len(succ), [], steps, steps
    most = max(n, n - 1 + max(highs.values(), default=0))
    for v in sorted(succ):
        low, whole, used = longest_search(succ, lows, v, budget)
        budget -= used
        high = low
        if not whole and highs == lows:
            high = most
        elif highs != lows:
            high, whole, used = longest_search(succ, highs, v, further)
            further -= used
            high = high if whole else most
        out.append((v, key[0], low, max(low, high)))
    return pd.DataFrame(out, columns=["id", "component", "low", "high"]).astype("int64")


@tidy
def depths(nodes: DataFrame, edges: DataFrame, rounds: dict | None = None, most_nodes: int | None = None, most_edges: int | None = None) -> DataFrame:
    """(id, component, on_cycle, layer, low, high, exact): the steps of the longest chain from each node lie between low and high; where exact, they are equal.

    A step back onto the chain counts and ends it. Components of up to most_nodes (SEARCH_NODES) nodes and most_edges (SEARCH_EDGES) edges are searched, for SEARCH_STEPS steps in all; what is larger, or
    takes longer, gets an interval: at least a cycle or the way out, at most once through all its nodes."""
    most_nodes, most_edges = SEARCH_NODES if most_nodes is None else most_nodes, SEARCH_EDGES if most_edges is None else most_edges
    edges = settled(plain_edges(edges))
    lv = settled(layers(nodes, edges, rounds))
    part = lambda c, name: lv.select(F.col("id").alias(c), F.col("component").alias(name))
    e = settled(within(lv, edges).join(part("src", "a"), "src").join(part("dst", "b"), "dst"))
    sizes = lv.groupBy("component").agg(F.count("*").alias("nodes"), F.max("on_cycle").alias("on_cycle"))
    many = e.where("a = b").groupBy(F.col("a").alias("component")).agg(F.count("*").alias("edges"))
    sized = sizes.join(many, "component", "left").withColumn("searched", F.col("on_cycle") & (F.col("nodes") <= most_nodes) & (F.coalesce("edges", F.lit(0)) <= most_edges))
    rows = settled(lv.select("id", "component", "on_cycle").join(sized.select("component", "nodes", "searched"), "component"))
    short, runs, _ = chains(settled(e.where("a <> b").select("src", "dst")), rounds, rows.where("on_cycle"))
    # edges between components, with the components of both ends
    across = settled(short.join(part("src", "a"), "src").join(part("dst", "b"), "dst"))
    left = settled(rows.join(runs.select("id"), "id", "left_anti"))
    done = rows.select("id", "component", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).limit(0)
    waits, steps = across, SEARCH_STEPS
    zero = lambda c: F.coalesce(c, F.lit(0))
    while not left.isEmpty():
        count(rounds, "depth")
        free = settled(left.join(waits.select(F.col("a").alias("component")).distinct(), "component", "left_anti"))
        out = across.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(done.select(F.col("id").alias("dst"), "low", "high"), "dst")
        exits = settled(out.groupBy(F.col("src").alias("id")).agg(F.max(F.col("low") + F.col("steps")).alias("low"), F.max(F.col("high") + F.col("steps")).alias("high")))
        own = free.join(exits, "id", "left")
        plain = own.where("NOT on_cycle").select("id", "component", zero("low").alias("low"), zero("high").alias("high"))
        wide = own.where("on_cycle AND NOT searched")
        far = wide.groupBy("component").agg(F.max("high").alias("far"))
        loop = F.when(F.col("nodes") > 1, 2).otherwise(1)
        spans = wide.join(far, "component").select("id", "component", F.greatest(zero("low"), loop).cast("long").alias("low"), F.greatest(F.col("nodes"), F.col("nodes") - 1 + zero("far")).cast("long").alias("high"))
        ids = free.where("searched").select(F.col("id").alias("src"), "component")
        inner = e.where("a = b").join(ids, "src").select("component", "src", "dst", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
        outer = exits.withColumnRenamed("id", "src").join(ids, "src").select("component", "src", F.lit(None).cast("long").alias("dst"), "low", "high")
        searched = inner.unionByName(outer).groupBy("component").applyInPandas(lambda key, df: search_component(key, df, steps), "id long, component long, low long, high long")
        now = settled(plain.unionByName(spans).unionByName(searched))
        done = settled(done.unionByName(now))
        left = settled(left.join(now.select("id"), "id", "left_anti"))
        waits = settled(waits.join(now.select(F.col("id").alias("dst")), "dst", "left_anti"))
    along = runs.join(done.select(F.col("id").alias("tail"), "low", "high"), "tail").select("id", (F.col("low") + F.col("to_tail")).alias("low"), (F.col("high") + F.col("to_tail")).alias("high"))
    return lv.join(done.select("id", "low", "high").unionByName(along), "id").select("id", "component", "on_cycle", "layer", "low", "high", (F.col("low") == F.col("high")).alias("exact"))
