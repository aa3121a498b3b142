"""Graph analysis that needs a whole project's graph: components, cycles, depth, layers.

Each project is one group and so one task, bounded by max_edges: a project above the bound raises, and strongly_connected_large() takes any size.
"""

from __future__ import annotations

from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDGES = 5_000_000


def tarjan(successors: dict) -> list[list]:
    """Strongly connected components, without recursion, each sorted."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(successors):
        if root in index:
            continue
        work = [(root, iter(sorted(successors[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(successors.get(w, ())))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    out.append(sorted(part))
    return out


def strong_order(start: array, to: array) -> tuple[array, array]:
    """(order, begins): all nodes, component by component, each after all that it depends on; component i is order[begins[i]:begins[i + 1]].

    The same search as tarjan(), over places in arrays: node v depends on to[start[v]:start[v + 1]]."""
    n = len(start) - 1
    index, low, at, done = array("q", bytes(8 * n)), array("q", bytes(8 * n)), start[:n], bytearray(n)
    order, begins, stack, count = array("q"), array("q", [0]), [], 0
    for root in range(n):
        if index[root]:
            continue
        count += 1
        index[root] = low[root] = count
        stack.append(root)
        work = [root]
        while work:
            v = work[-1]
            p = at[v]
            if p < start[v + 1]:
                at[v] = p + 1
                w = to[p]
                if not index[w]:
                    count += 1
                    index[w] = low[w] = count
                    stack.append(w)
                    work.append(w)
                elif not done[w] and index[w] < low[v]:
                    low[v] = index[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == index[v]:
                w = -1
                while w != v:
                    w = stack.pop()
                    done[w] = 1
                    order.append(w)
                begins.append(len(order))
    return order, begins


def analyse(edges: list[tuple], nodes: list) -> list[tuple]:
    """(id, component, size, on_cycle, layer): component is its smallest id; layer is 0 without dependencies, else 1 + the largest layer below, on the graph of components."""
    succ: dict = {n: set() for n in nodes}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)
        succ.setdefault(b, set())
    parts = tarjan(succ)
    of = {v: i for i, p in enumerate(parts) for v in p}
    layer = [0] * len(parts)
    for i, p in enumerate(parts):  # components come after all that they depend on
        below = {of[w] for v in p for w in succ[v]} - {i}
        layer[i] = 1 + max(layer[j] for j in below) if below else 0
    return [(v, p[0], len(p), len(p) > 1 or v in succ[v], layer[i]) for i, p in enumerate(parts) for v in p]


def graph_analysis(nodes: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(project_id, id, component, size, on_cycle, layer) for graphs with a project_id."""
    rows = nodes.select("project_id", F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select("project_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        if len(df) > max_edges:
            raise ValueError(f"project {key[0]} has more than {max_edges} rows; use strongly_connected_large()")
        pairs = df[df["b"].notna()]
        out = analyse(list(zip(pairs["a"].astype("int64"), pairs["b"].astype("int64"), strict=True)), df.loc[df["b"].isna(), "a"].tolist())
        return pd.DataFrame([(key[0], *r) for r in out], columns=["project_id", "id", "component", "size", "on_cycle", "layer"])

    return rows.groupBy("project_id").applyInPandas(run, "project_id long, id long, component long, size long, on_cycle boolean, layer long")


def depth_first_cycles(edges: list[tuple]) -> list[list]:
    """Back edges of a depth-first search over sorted ids, each as the list of its nodes with the first repeated."""
    succ: dict = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)
    done, out = set(), []
    for root in sorted(succ):
        if root in done:
            continue
        path, at, work = [root], {root: 0}, [iter(sorted(succ[root]))]
        while work:
            for w in work[-1]:
                if w in at:
                    out.append([*path[at[w] :], w])
                elif w not in done:
                    at[w] = len(path)
                    path.append(w)
                    work.append(iter(sorted(succ.get(w, ()))))
                    break
            else:
                work.pop()
                v = path.pop()
                del at[v]
                done.add(v)
    return out


def strongly_connected_large(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes on cycles, for graphs of any size: nodes without a way in or out are trimmed, then forward and backward least labels are spread; nodes where both agree form a component."""
    from quernstone.operators.graph import checkpoint

    e, out = checkpoint(edges.select("src", "dst").where("src <> dst").distinct()), None
    while not e.isEmpty():
        while True:  # trim
            n = e.count()
            e = checkpoint(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
            e = checkpoint(e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if e.count() == n:
                break
        if not n:
            break
        labels = []
        for a, b in (("src", "dst"), ("dst", "src")):
            lab = checkpoint(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("l", F.col("id")))
            while True:
                sent = e.join(lab, e[a] == lab["id"]).groupBy(F.col(b).alias("id")).agg(F.min("l").alias("m"))
                new = checkpoint(lab.join(sent, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l")))
                same = new.join(lab.withColumnRenamed("l", "o"), "id").where("l <> o").isEmpty()
                lab = new
                if same:
                    break
            labels.append(lab)
        both = labels[0].withColumnRenamed("l", "f").join(labels[1].withColumnRenamed("l", "b"), "id")
        part = checkpoint(both.where("f = b").select("id", F.col("f").alias("component")))
        out = part if out is None else out.unionByName(part)
        left = both.where("f <> b").select("id", "f", "b")
        s, d = left.select(F.col("id").alias("src"), F.col("f").alias("sf"), F.col("b").alias("sb")), left.select(F.col("id").alias("dst"), F.col("f").alias("df"), F.col("b").alias("db"))
        e = checkpoint(e.join(s, "src").join(d, "dst").where("sf = df AND sb = db").select("src", "dst"))
    sized = out.withColumn("n", F.lit(1)) if out is not None else None
    if sized is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    many = out.groupBy("component").count().where("count > 1").select("component")
    return out.join(many, "component", "left_semi").select("id", "component")
