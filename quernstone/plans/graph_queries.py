"""Queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import components
from quernstone.operators import graph as g
from quernstone.operators import kernels as k
from quernstone.plans.registry import query
from quernstone.sources import views as v

CE = f"{v.COMPONENT}, {v.EDGE}"
CL = f"{v.COMPONENT}, {v.LATEST}"
DEG = f"""{CE}, o AS (SELECT src AS id, count(*) AS n_out FROM edge GROUP BY src), i AS (SELECT dst AS id, count(*) AS n_in FROM edge GROUP BY dst),
 deg AS (SELECT c.id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM component c LEFT JOIN o USING (id) LEFT JOIN i USING (id)),
 inst AS (SELECT *, round(CASE WHEN n_in + n_out = 0 THEN 0 ELSE n_out / (n_in + n_out)::DOUBLE END, 6) AS instability FROM deg)"""


def tables(spark, sf_dir):
    return v.component(spark, sf_dir), v.edge(spark, sf_dir)


def newest(spark, sf_dir):
    """Dependencies of the newest state as a table: analyses go over them many times, and each time would group all line items again."""
    return g.checkpoint(v.latest_edge(spark, sf_dir))


def latest(spark, sf_dir):
    return v.component(spark, sf_dir), newest(spark, sf_dir)


@query(f"WITH {CE} SELECT id, CASE WHEN lower(type) IN ('async_function', 'method', 'function') THEN 'function' WHEN lower(type) IN ('directory', 'module') THEN 'module' WHEN lower(type) IN ('class', 'interface', 'package') THEN lower(type) ELSE 'file' END AS kind FROM component")
def graph_nodes(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", g.node_kind(F.col("type")).alias("kind"))


DEPS = f"""{CE}, deps AS (SELECT a.project_id, e.src, CASE e.dst % 3 WHEN 0 THEN b.name WHEN 1 THEN b.path ELSE concat('pkg.', b.name) END AS dep FROM edge e JOIN component a ON a.id = e.src JOIN component b ON b.id = e.dst)"""


@query(f"""WITH {DEPS}, want AS (SELECT project_id, src, dep, 0 AS stage, concat('n:', dep) AS key FROM deps UNION ALL SELECT project_id, src, dep, 1, concat('p:', dep) FROM deps UNION ALL SELECT project_id, src, dep, 2, concat('n:', string_split(dep, '.')[-1]) FROM deps),
 offer AS (SELECT project_id, key, max(id) AS dst FROM (SELECT project_id, concat('n:', name) AS key, id FROM component UNION ALL SELECT project_id, concat('p:', path), id FROM component) GROUP BY ALL),
 hit AS (SELECT *, row_number() OVER (PARTITION BY src, dep ORDER BY stage, dst) AS r FROM want JOIN offer USING (project_id, key) WHERE src <> dst) SELECT src, dep, dst, stage FROM hit WHERE r = 1""")
def edge_resolution(spark, sf_dir):
    c, e = tables(spark, sf_dir)
    a = c.select(F.col("id").alias("src"), "project_id")
    b = c.select(F.col("id").alias("dst"), F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, F.col("path")).otherwise(F.concat(F.lit("pkg."), "name")).alias("dep"))
    return g.resolve(e.join(a, "src").join(b, "dst").select("project_id", "src", "dep"), c)


ODD = f"""{CL}, deps AS (SELECT DISTINCT a.project_id, e.src, CASE e.dst % 5 WHEN 0 THEN concat('import x', b.name) WHEN 1 THEN substring(b.name, 3) WHEN 2 THEN concat(b.language, '/', e.dst) WHEN 3 THEN concat('base://', b.path, '#') ELSE b.name END AS dep FROM latest e JOIN component a ON a.id = e.src JOIN component b ON b.id = e.dst)"""
FIVE = f"""{ODD}, cand AS (SELECT d.src, d.dep, c.id AS dst, CASE WHEN c.name = d.dep THEN 0 WHEN c.path = d.dep THEN 1 WHEN c.name = string_split(d.dep, '.')[-1] THEN 2 WHEN ends_with(c.name, d.dep) OR ends_with(d.dep, c.name) THEN 3
 WHEN contains(c.path, d.dep) OR contains(d.dep, c.path) THEN 4 END AS stage FROM deps d JOIN component c USING (project_id)), early AS (SELECT src, dep, stage, max(dst) AS dst FROM cand WHERE stage < 3 GROUP BY ALL),
 hit AS (SELECT *, row_number() OVER (PARTITION BY src, dep ORDER BY stage, dst) AS r FROM (SELECT * FROM early WHERE src <> dst UNION ALL SELECT src, dep, stage, dst FROM cand WHERE stage >= 3 AND src <> dst)), found AS (SELECT src, dep, dst, stage FROM hit WHERE r = 1)"""


def odd_strings(c, e):
    k = F.col("dst") % 5
    texts = [F.concat(F.lit("import x"), "name"), F.substr("name", F.lit(3)), F.concat_ws("/", "language", F.col("dst").cast("string")), F.concat(F.lit("base://"), "path", F.lit("#")), F.col("name")]
    dep = F
    for i, t in enumerate(texts):
        dep = dep.when(k == i, t)
    b = c.select(F.col("id").alias("dst"), "name", "language", "path")
    return e.join(b, "dst").join(c.select(F.col("id").alias("src"), "project_id"), "src").select("project_id", "src", dep.otherwise(None).alias("dep")).distinct()


@query(f"WITH {FIVE} SELECT * FROM found")
def edge_resolution_all(spark, sf_dir):
    """All five stages."""
    c, e = latest(spark, sf_dir)
    return g.resolve_all(odd_strings(c, e), c)


TYPE_OF = "CASE WHEN regexp_matches(lower(dep), 'extends|implements|inherits|super|base') THEN 'inheritance' WHEN regexp_matches(lower(dep), 'import|require|include|using') THEN 'import' WHEN regexp_matches(lower(dep), 'realizes|fulfills') THEN 'implementation' ELSE 'reference' END"
BUILT = f"""{FIVE}, typed AS (SELECT f.src, f.dst, f.dep, {TYPE_OF} AS type, round(least(2.0, 1 + CASE WHEN list_contains(c.tags, f.dep) THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lower(f.dep), 'os|sys|json|datetime|pathlib') THEN 0.2 ELSE 0 END + CASE WHEN contains(f.dep, '.') THEN 0 ELSE 0.3 END)::DOUBLE, 6) AS weight
 FROM found f JOIN component c ON c.id = f.dst), built AS (SELECT src, dst, type, arg_max(weight, dep) AS weight FROM typed GROUP BY ALL)"""


@query(f"WITH {BUILT} SELECT * FROM built")
def graph_build(spark, sf_dir):
    c, e = latest(spark, sf_dir)
    return g.build_edges(odd_strings(c, e), c.withColumn("exports", F.col("tags")))


@query(f"WITH {BUILT} SELECT * FROM built WHERE src % 10 = 0 OR dst % 10 = 0")
def incremental_build(spark, sf_dir):
    """The edges of an incremental build after every tenth component changed."""
    c, e = latest(spark, sf_dir)
    return g.changed_graph(odd_strings(c, e), c.withColumn("exports", F.col("tags")), c.where("id % 10 = 0"))[1]


@query(f"WITH {v.COMPONENT} SELECT id FROM component WHERE list_contains(tags, 'red')")
def array_membership(spark, sf_dir):
    """Components whose list of names has one."""
    return v.component(spark, sf_dir).where(F.array_contains("tags", "red")).select("id")


@query("""SELECT p_partkey AS id, CASE WHEN regexp_matches(lower(p_name), 'extends|implements|inherits|super|base') THEN 'inheritance' WHEN regexp_matches(lower(p_name), 'import|require|include|using') THEN 'import'
 WHEN regexp_matches(lower(p_name), 'realizes|fulfills') THEN 'implementation' ELSE 'reference' END AS edge_type,
 round(least(2.0, 1 + CASE WHEN list_contains(string_split(p_name, ' '), p_name) THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lower(p_name), 'os|sys|json|datetime|pathlib') THEN 0.2 ELSE 0 END + CASE WHEN contains(p_name, '.') THEN 0 ELSE 0.3 END)::DOUBLE, 6) AS weight FROM part""")
def edge_weight(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", g.edge_type(F.col("name")).alias("edge_type"), g.edge_weight(F.col("name"), F.col("tags")).alias("weight"))


@query("""SELECT p_partkey AS id, regexp_matches(lower(concat(p_name, ' ', p_type, '/', p_brand)), 'util|helper|common|shared|base|core|lib|tools|utils|misc') AS is_utility,
 regexp_matches(lower(concat(p_name, ' ', p_type, '/', p_brand)), 'main|index|app|server|start|init|bootstrap|run|__main__') AS is_entry_point FROM part""")
def name_flags(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", *g.name_flags(F.col("name"), F.col("path")))


@query(f"WITH {v.EDGE} SELECT dst AS id, list_sort(list(src)) AS dependents FROM edge GROUP BY dst")
def dependents(spark, sf_dir):
    return g.dependents(v.edge(spark, sf_dir))


@query(f"WITH {CE} SELECT src, dst FROM edge WHERE src IN (SELECT id FROM component WHERE id % 3 <> 0) AND dst IN (SELECT id FROM component WHERE id % 3 <> 0)")
def dangling_edges(spark, sf_dir):
    c, e = tables(spark, sf_dir)
    return g.with_both_ends(e, c.where("id % 3 <> 0"))


@query(f"WITH {DEG} SELECT id, n_out, n_in, n_in = 0 AS is_leaf, n_out = 0 AS is_root, n_in = 0 AND n_out = 0 AS is_isolated FROM deg")
def degree_flags(spark, sf_dir):
    return g.degrees(*tables(spark, sf_dir))


@query(f"""WITH {DEG} SELECT count(*) AS n_nodes, sum(n_out)::BIGINT AS n_edges, round(avg(n_in), 6) AS avg_in, round(avg(n_out), 6) AS avg_out, max(n_in) AS max_in, max(n_out) AS max_out,
 count_if(n_in = 0)::BIGINT AS leaves, count_if(n_out = 0)::BIGINT AS roots, count_if(n_in = 0 AND n_out = 0)::BIGINT AS isolated FROM deg""")
def degree_stats(spark, sf_dir):
    return g.statistics(*tables(spark, sf_dir))


@query(f"WITH {DEG} SELECT id, n_in AS ca, n_out AS ce, instability FROM inst")
def stability(spark, sf_dir):
    return g.instability(*tables(spark, sf_dir))


@query(f"""WITH {DEG} SELECT round(avg(n_in), 6) AS avg_ca, round(avg(n_out), 6) AS avg_ce, round(sum(n_out) / (sum(n_in) + sum(n_out))::DOUBLE, 6) AS total, round(avg(instability), 6) AS avg_instability,
 count_if(instability < 0.3)::BIGINT AS stable, count_if(instability > 0.7)::BIGINT AS unstable, count_if(instability < 0.2)::BIGINT AS very_stable, count_if(instability >= 0.2 AND instability < 0.5)::BIGINT AS fairly_stable,
 count_if(instability >= 0.5 AND instability < 0.8)::BIGINT AS fairly_unstable, count_if(instability >= 0.8)::BIGINT AS very_unstable FROM inst""")
def coupling(spark, sf_dir):
    return g.coupling(*tables(spark, sf_dir))


PACK = f"{CE}, pack AS (SELECT id, concat(type, '/', language) AS package FROM component)"


@query("SELECT concat(p_type, '/', p_brand) AS package, count(*) AS n, list_sort(list(DISTINCT p_brand)) AS languages, sum(CAST(floor(p_retailprice) AS BIGINT))::BIGINT AS lines, list_sort(list(p_partkey)) AS ids FROM part GROUP BY 1")
def package_rollup(spark, sf_dir):
    return g.packages(v.component(spark, sf_dir))


@query(f"WITH {PACK} SELECT a.package AS src_package, b.package AS dst_package, count(*) AS n FROM edge e JOIN pack a ON a.id = e.src JOIN pack b ON b.id = e.dst WHERE a.package <> b.package GROUP BY ALL")
def package_graph(spark, sf_dir):
    return g.package_graph(*tables(spark, sf_dir))


@query(f"WITH {CE} SELECT count(*) AS n_edges, round(avg(CASE WHEN a.language = b.language THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS cohesion FROM edge e JOIN component a ON a.id = e.src JOIN component b ON b.id = e.dst")
def cohesion(spark, sf_dir):
    return g.cohesion(*tables(spark, sf_dir))


def reach_sql(edge: str = "edge") -> str:
    """Strongly connected components, as a common table expression part(id, component, on_cycle), by mutual reach."""
    return f"""walk(start, id) AS (SELECT src, dst FROM {edge} UNION SELECT w.start, e.dst FROM walk w JOIN {edge} e ON e.src = w.id),
 part AS (SELECT c.id, coalesce(least(c.id, min(a.id)), c.id) AS component, count(a.id) > 0 AS on_cycle FROM component c LEFT JOIN (walk a JOIN walk b ON a.start = b.id AND a.id = b.start) ON a.start = c.id GROUP BY c.id)"""


#: All chains without a repeated node, each as the array of its nodes, and the longest from each node: a step back onto the chain counts one.
CHAINS = """chain(start, path) AS (SELECT src, [src, dst] FROM latest UNION ALL SELECT c.start, list_append(c.path, e.dst) FROM chain c JOIN latest e ON e.src = c.path[-1] WHERE NOT list_contains(c.path[:-2], c.path[-1])),
 deep AS (SELECT c.id, coalesce(max(len(chain.path)) - 1, 0)::BIGINT AS depth FROM component c LEFT JOIN chain ON start = c.id GROUP BY c.id)"""
#: Layers from nodes without dependents; what is on a cycle or behind one has none.
KAHN = """down(start, id, n) AS (SELECT src, dst, 1 FROM latest UNION SELECT d.start, e.dst, d.n + 1 FROM down d JOIN latest e ON e.src = d.id WHERE d.n < 60),
 kahn AS (SELECT c.id, coalesce(max(d.n), 0)::BIGINT AS layer FROM component c LEFT JOIN down d ON d.id = c.id WHERE c.id NOT IN (SELECT id FROM part WHERE on_cycle) AND c.id NOT IN (SELECT w.id FROM walk w JOIN part p ON p.id = w.start WHERE p.on_cycle) GROUP BY c.id)"""
LDEG = f"""o AS (SELECT src AS id, count(*) AS n_out FROM latest GROUP BY src), i AS (SELECT dst AS id, count(*) AS n_in FROM latest GROUP BY dst),
 deg AS (SELECT c.id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM component c LEFT JOIN o USING (id) LEFT JOIN i USING (id))"""
SHAPE = f"{CL}, {reach_sql('latest')}, {CHAINS}, {KAHN}, shape AS (SELECT (SELECT count(DISTINCT component) FROM part WHERE on_cycle) AS n_cycles, (SELECT max(depth) FROM deep) AS depth, (SELECT count(DISTINCT layer) FROM kahn) AS n_layers)"


@query(f"""WITH RECURSIVE {SHAPE}, {LDEG} SELECT 'circular_dependency' AS issue, 'high' AS severity, component AS id, count(*) AS n FROM part WHERE on_cycle GROUP BY component
 UNION ALL SELECT 'high_coupling', 'medium', id, n_out FROM deg WHERE n_out > 10 UNION ALL SELECT 'god_object', 'high', id, n_in FROM deg WHERE n_in > 15 AND n_out > 5 UNION ALL SELECT 'deep_hierarchy', 'low', -1, depth FROM shape WHERE depth > 7""")
def graph_issues(spark, sf_dir):
    return g.issues(*latest(spark, sf_dir)).withColumn("id", F.coalesce("id", F.lit(-1).cast("long")))


@query(f"WITH {DEG} SELECT id, 'high_coupling' AS issue FROM deg WHERE n_out > 10 UNION ALL SELECT id, 'god_object' FROM deg WHERE n_in > 15 AND n_out > 5")
def degree_issues(spark, sf_dir):
    """The two rules on degrees over all dependencies."""
    d = g.degrees(*tables(spark, sf_dir))
    return d.where("n_out > 10").select("id", F.lit("high_coupling").alias("issue")).unionByName(d.where("n_in > 15 AND n_out > 5").select("id", F.lit("god_object").alias("issue")))


def walk_sql(a: str, b: str, extra: str = "") -> str:
    return f"""r(start, id) AS (SELECT s.id, e.{b} FROM starts s JOIN edge e ON e.{a} = s.id UNION SELECT r.start, e.{b} FROM r JOIN edge e ON e.{a} = r.id {extra})"""


@query(f"""WITH RECURSIVE {v.LATEST}, starts AS (SELECT DISTINCT dst AS id FROM latest), {walk_sql("dst", "src").replace("edge", "latest")}, d AS (SELECT dst AS start, count(*) AS direct FROM latest GROUP BY dst), t AS (SELECT start, count(*) AS affected FROM r GROUP BY start)
 SELECT s.id AS start, coalesce(direct, 0) AS direct, coalesce(affected, 0) AS affected, greatest(coalesce(affected, 0) - coalesce(direct, 0), 0) AS indirect, coalesce(direct, 0) > 5 OR coalesce(affected, 0) > 20 AS critical
 FROM starts s LEFT JOIN d ON d.start = s.id LEFT JOIN t ON t.start = s.id""")
def impact(spark, sf_dir):
    """Of every component that others depend on."""
    e = newest(spark, sf_dir)
    return g.impact(e, e.select(F.col("dst").alias("id")))


@query(f"WITH {v.EDGE}, r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM edge) SELECT dst AS start, [src, dst] AS path FROM r WHERE r <= 20")
def critical_paths(spark, sf_dir):
    e = v.edge(spark, sf_dir)
    return g.critical_paths(e, e.select(F.col("dst").alias("id")))


@query(f"""WITH RECURSIVE {v.LATEST}, both_ways AS (SELECT src, dst FROM latest UNION SELECT dst, src FROM latest),
 r(start, id, level) AS (SELECT src, dst, 1 FROM both_ways UNION SELECT r.start, b.dst, r.level + 1 FROM r JOIN both_ways b ON b.src = r.id WHERE r.level < 4),
 m AS (SELECT start, id, min(level) AS level FROM r WHERE id <> start GROUP BY ALL) SELECT start, level, count(*) AS n, list_sort(list(id)) AS ids FROM m GROUP BY ALL""")
def neighbors(spark, sf_dir):
    """Up to distance 4, of every component that has any."""
    e = newest(spark, sf_dir)
    return g.neighbour_levels(e, e.select(F.explode(F.array("src", "dst")).alias("id")), 4)


@query(f"""WITH RECURSIVE {v.LATEST}, pair AS (SELECT min(src) AS a, max(dst) AS b FROM latest), r(start, id, level) AS (SELECT src, dst, 1 FROM latest UNION SELECT r.start, e.dst, r.level + 1 FROM r JOIN latest e ON e.src = r.id WHERE r.level < 30),
 d AS (SELECT start, id, min(level) AS level FROM r WHERE start <> id GROUP BY ALL), far AS (SELECT * FROM d ORDER BY level DESC, start, id LIMIT 1),
 f AS (SELECT start, id, 0 AS level FROM (SELECT DISTINCT start, start AS id FROM far) UNION ALL SELECT d.start, d.id, d.level FROM d JOIN far USING (start)),
 back(id, path, level) AS (SELECT id, [id], level FROM far UNION ALL SELECT p.id, list_prepend(p.id, b.path), p.level FROM back b CROSS JOIN LATERAL (SELECT min(e.src) AS id, b.level - 1 AS level FROM latest e JOIN f ON f.id = e.src WHERE e.dst = b.id AND f.level = b.level - 1) p WHERE b.level > 0)
 SELECT 'far' AS pair, path FROM back WHERE level = 0 UNION ALL SELECT 'same', [start] FROM far""")
def shortest_path(spark, sf_dir):
    """Between the two components that are farthest apart, from one to itself, and two that give no path: a missing component, and one step too few."""
    e = newest(spark, sf_dir)
    rows, *large = g.parted(e.select(F.col("src").alias("id")), e, g.SMALL_REACH)
    parts = (g.checkpoint(rows), *large)
    far = g.farthest(parts, 30).first()
    row = lambda name, *a: g.shortest_in_parts(parts, *a).select(F.lit(name).alias("pair"), "path")
    out = row("far", far.start, far.id, 99).unionByName(row("same", far.start, far.start))
    return out.unionByName(row("missing", far.start, -1)).unionByName(row("short", far.start, far.id, far.level - 1))


@query(f"""WITH RECURSIVE {v.EDGE}, s AS (SELECT min(src) AS id FROM edge), r(id, path) AS (SELECT (SELECT id FROM s), [(SELECT id FROM s)] UNION ALL
 SELECT e.dst, list_append(r.path, e.dst) FROM r JOIN edge e ON e.src = r.id WHERE len(r.path) < 4 AND NOT list_contains(r.path, e.dst)), t AS (SELECT max(id) AS id FROM r WHERE len(path) = 3)
 SELECT path FROM r WHERE id = (SELECT id FROM t) AND len(path) > 1""")
def simple_paths(spark, sf_dir):
    e = v.edge(spark, sf_dir)
    s = e.agg(F.min("src").alias("id")).first().id
    two = e.where(F.col("src") == s).select(F.col("dst").alias("m")).join(e, F.col("m") == F.col("src")).where(f"dst <> {s} AND dst <> m").agg(F.max("dst").alias("id")).first().id
    return g.simple_paths(e, s, two, 4)


@query(f"WITH RECURSIVE {CL}, {reach_sql('latest')} SELECT * FROM part")
def scc(spark, sf_dir):
    return g.components_of(*latest(spark, sf_dir))


@query(f"WITH RECURSIVE {CL}, {reach_sql('latest')} SELECT component, list_sort(list(id)) AS ids FROM part WHERE on_cycle GROUP BY component ORDER BY component LIMIT 5")
def cycles(spark, sf_dir):
    return g.dependency_cycles(*latest(spark, sf_dir))


CLOSURE = f"{v.EDGE}, starts AS (SELECT DISTINCT src AS id FROM edge), {walk_sql('src', 'dst')}"


@query(f"WITH RECURSIVE {CLOSURE}, mutual AS (SELECT a.start AS id, a.id AS other FROM r a JOIN r b ON a.start = b.id AND a.id = b.start) SELECT id, min(other) AS component FROM mutual GROUP BY id")
def cycle_nodes(spark, sf_dir):
    """Any size: label propagation over tables."""
    return k.strongly_connected_large(v.edge(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSURE}, mutual AS (SELECT a.start AS id, a.id AS other FROM r a JOIN r b ON a.start = b.id AND a.id = b.start) SELECT id, min(other) AS component FROM mutual GROUP BY id")
def strong_components(spark, sf_dir):
    """Components of all dependencies: chains contracted, then searches from all nodes at once."""
    return components.strongly_connected(v.edge(spark, sf_dir))


@query()
def chain_intervals(spark, sf_dir):
    """Component, layer and longest chain of every component over all dependencies; the chain as an interval where a component is too large to search."""
    return components.depths(*tables(spark, sf_dir))


@query()
def cycle_paths(spark, sf_dir):
    """One shortest cycle of each component of all dependencies, as a path."""
    return components.cycle_paths(*tables(spark, sf_dir))


@query(f"WITH RECURSIVE {SHAPE} SELECT * FROM kahn")
def layers_kahn(spark, sf_dir):
    return g.layers(*latest(spark, sf_dir)).select("id", F.col("layer").cast("long").alias("layer"))


#: Layers on the graph of components, by the longest walk over it.
LONGEST = """ce AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM latest e JOIN part a ON a.id = e.src JOIN part b ON b.id = e.dst WHERE a.component <> b.component),
 up(start, id, n) AS (SELECT src, dst, 1 FROM ce UNION SELECT u.start, e.dst, u.n + 1 FROM up u JOIN ce e ON e.src = u.id)"""


@query(f"WITH RECURSIVE {SHAPE}, {LONGEST}, top AS (SELECT start, max(n)::BIGINT AS layer FROM up GROUP BY start) SELECT p.id, coalesce(layer, 0) AS layer FROM part p LEFT JOIN top ON start = component")
def layers_longest(spark, sf_dir):
    return g.levels(*latest(spark, sf_dir)).select("id", "layer")


@query(f"WITH RECURSIVE {SHAPE} SELECT * FROM deep")
def longest_chain(spark, sf_dir):
    return g.levels(*latest(spark, sf_dir)).select("id", "depth")


SYNC = f"""{CE}, gone AS (SELECT id FROM component WHERE id % 10 = 0), kept AS (SELECT id FROM component WHERE id % 20 <> 10)"""


@query(f"WITH {SYNC}, e AS (SELECT src, dst FROM edge WHERE src % 10 <> 0 AND dst % 10 <> 0 UNION SELECT src, dst FROM edge WHERE src % 20 = 0) SELECT src, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def incremental_sync(spark, sf_dir):
    """Every tenth component changed: half came back with their dependencies, half were deleted."""
    c, e = tables(spark, sf_dir)
    return g.incremental_sync(c, e, c.where("id % 20 = 0"), e.where("src % 20 = 0"), g.changed_nodes(c, c.where("id % 10 = 0")))[1]


@query(f"WITH {v.COMPONENT} SELECT id FROM component WHERE id IN (5, 8) OR ends_with(path, '/12')")
def changed_nodes(spark, sf_dir):
    c = v.component(spark, sf_dir)
    paths = spark.createDataFrame([("./12",)], "path string").unionByName(c.where("id = 8").select(F.concat(F.lit("repo/"), "path").alias("path")))
    return g.changed_nodes(c, c.where("id = 5"), paths)


@query(f"WITH {DEG} SELECT sum(n_out)::BIGINT AS total, round(avg(n_out), 6) AS average, max(n_out) AS most, count_if(n_out = 0)::BIGINT AS without FROM deg")
def dependency_totals(spark, sf_dir):
    return g.dependency_totals(*tables(spark, sf_dir))


@query(f"WITH {DEG}, a AS (SELECT 'dependent' AS side, id, n_out AS n FROM deg ORDER BY n_out DESC, id LIMIT 5), b AS (SELECT 'used' AS side, id, n_in AS n FROM deg ORDER BY n_in DESC, id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b")
def most_connected(spark, sf_dir):
    return g.most_connected(*tables(spark, sf_dir))


@query(f"WITH RECURSIVE {SHAPE}, {LDEG} SELECT round(sum(n_out) / count(*)::DOUBLE, 6) AS density, (sum(n_out) - count(*) + 2)::BIGINT AS cyclomatic, (SELECT 2.0 * n_cycles + 0.5 * depth FROM shape)::DOUBLE AS structural FROM deg")
def graph_complexity(spark, sf_dir):
    return g.graph_complexity(*latest(spark, sf_dir))


@query(f"""WITH RECURSIVE {SHAPE}, {LDEG} SELECT round(least(greatest(100 - 30 * sum(n_out) / (sum(n_in) + sum(n_out))::DOUBLE - least(10 * sum(n_out) / count(*)::DOUBLE, 30) - least(5.0 * (SELECT n_cycles FROM shape), 20), 0), 100)::DOUBLE, 6) AS index FROM deg""")
def maintainability_index(spark, sf_dir):
    return g.maintainability_index(*latest(spark, sf_dir))


KINDS = ["class", "interface", "function", "struct", "file"]
NAMES = ["order_service", "public_api", "EventBus", "broker", "plugin_host", "loader", "base_model", "str_util", "helper", "thing"]
TYPED = f"""typed AS (SELECT c.id, c.project_id, (['{"', '".join(NAMES)}'])[1 + c.id % 10] AS name, (['{"', '".join(KINDS)}'])[1 + (c.id // 7) % 5] AS type FROM component c)"""


def typed(c):
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    return c.withColumn("name", pick(NAMES, F.col("id") % 10)).withColumn("type", pick(KINDS, F.floor(F.col("id") / 7) % 5))


LEVEL = """CASE WHEN type IN ('interface', 'abstract') OR name ILIKE '%base%' OR name ILIKE '%abstract%' THEN 'abstract' WHEN type IN ('class', 'struct') THEN 'implementation' WHEN name ILIKE '%util%' OR name ILIKE '%helper%' THEN 'utility' ELSE 'concrete' END"""


@query(f"WITH {v.COMPONENT}, {TYPED} SELECT project_id, list_sort(list(DISTINCT {LEVEL})) AS levels FROM typed GROUP BY project_id")
def abstraction_levels(spark, sf_dir):
    return g.abstraction_levels(typed(v.component(spark, sf_dir)))


def architecture_sql() -> str:
    some = lambda words: f"bool_or(regexp_matches(lower(name), '{words}'))"
    return f"""WITH RECURSIVE {SHAPE}, {LDEG}, {TYPED}, f AS (SELECT count(*) AS n, avg(n_out) AS mean, avg(CAST(n_out <= 2 AS INT)) AS apart, max(n_in) AS central, count(DISTINCT {LEVEL}) AS kinds, {some("service|api|controller|handler")} AS service,
 {some("api|endpoint")} AS api, {some("event|message|queue|publisher|subscriber|listener")} AS event, {some("mediator|broker|dispatcher|router")} AS broker, {some("plugin|extension|module|addon|component")} AS plugin,
 {some("registry|factory|loader|manager")} AS loader, bool_or(type = 'interface') AS interface FROM typed JOIN deg USING (id)), s AS (SELECT unnest([
 {{'architecture': 'microservices', 'o': 0, 'least': 0.7, 'score': service::INT * 0.3 + (mean < 3)::INT * 0.3 + (apart > 0.3)::INT * 0.2 + api::INT * 0.2}},
 {{'architecture': 'layered', 'o': -1, 'least': 0.6, 'score': CASE WHEN n_layers >= 3 THEN 0.4 WHEN n_layers >= 2 THEN 0.2 ELSE 0 END + CASE WHEN n_cycles = 0 THEN 0.3 WHEN n_cycles <= 0.1 * n THEN 0.1 ELSE 0 END + (kinds >= 3)::INT * 0.3}},
 {{'architecture': 'event_driven', 'o': -2, 'least': 0.6, 'score': event::INT * 0.4 + (mean < 2)::INT * 0.3 + broker::INT * 0.3}},
 {{'architecture': 'plugin', 'o': -3, 'least': 0.5, 'score': plugin::INT * 0.4 + interface::INT * 0.3 + loader::INT * 0.3}},
 {{'architecture': 'monolith', 'o': -4, 'least': 0.8, 'score': (mean > 5)::INT * 0.3 + (n_cycles > 0.2 * n)::INT * 0.3 + (central > 5)::INT * 0.2 + (depth > 5)::INT * 0.2}}], recursive := true) FROM f, shape)
 SELECT architecture, round(score, 6)::DOUBLE AS score, score >= least AND row_number() OVER (ORDER BY round(score, 6) DESC, o DESC) = 1 AS chosen FROM s"""


@query(architecture_sql())
def architecture_scores(spark, sf_dir):
    c, e = latest(spark, sf_dir)
    return g.architecture_scores(typed(c), e)


@query(f"""WITH RECURSIVE {SHAPE}, {LDEG}, one AS (SELECT count(*)::DOUBLE AS n_nodes, sum(n_out)::DOUBLE AS n_edges, round(avg(n_in), 6) AS avg_in, round(avg(n_out), 6) AS avg_out, max(n_in)::DOUBLE AS max_in, max(n_out)::DOUBLE AS max_out,
 count_if(n_in = 0)::DOUBLE AS leaves, count_if(n_out = 0)::DOUBLE AS roots, count_if(n_in = 0 AND n_out = 0)::DOUBLE AS isolated, (SELECT count(DISTINCT component)::DOUBLE FROM part) AS sccs,
 (SELECT max(n)::DOUBLE FROM (SELECT count(*) AS n FROM part GROUP BY component)) AS largest_scc, (SELECT n_cycles::DOUBLE FROM shape) AS cycles FROM deg), long AS (UNPIVOT one ON COLUMNS(*) INTO NAME measure VALUE value)
 SELECT measure, '' AS key, value FROM long UNION ALL SELECT 'nodes_by_type', type, count(*) FROM component GROUP BY type UNION ALL SELECT 'edges_by_type', CASE WHEN dst % 2 = 0 THEN 'import' ELSE 'reference' END, count(*) FROM latest GROUP BY ALL""")
def graph_statistics(spark, sf_dir):
    c, e = latest(spark, sf_dir)
    return g.graph_statistics(c, e.withColumn("type", F.when(F.col("dst") % 2 == 0, "import").otherwise("reference")))


STRINGS = f"""{CE}, deps AS (SELECT e.src, CASE e.dst % 4 WHEN 0 THEN CAST(e.dst AS VARCHAR) WHEN 1 THEN concat('lib.', b.name) WHEN 2 THEN concat(' ', b.language, '/', e.dst, ' ') ELSE b.name END AS dep FROM edge e JOIN component b ON b.id = e.dst)"""


def strings(c, e):
    k = F.col("dst") % 4
    dep = F.when(k == 0, F.col("dst").cast("string")).when(k == 1, F.concat(F.lit("lib."), "name")).when(k == 2, F.concat(F.lit(" "), "language", F.lit("/"), F.col("dst").cast("string"), F.lit(" "))).otherwise(F.col("name"))
    return e.join(c.select(F.col("id").alias("dst"), "name", "language").hint("merge"), "dst").select("src", dep.alias("dep"))


@query(f"""WITH {STRINGS}, ca AS (SELECT dep, count(*) AS ca FROM deps GROUP BY dep), ce AS (SELECT src, count(*) AS ce FROM deps GROUP BY src)
 SELECT c.id, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, round(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0 ELSE coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0))::DOUBLE END, 6)::DOUBLE AS instability
 FROM component c LEFT JOIN ca ON CAST(c.id AS VARCHAR) = dep LEFT JOIN ce ON src = c.id""")
def coupling_by_name(spark, sf_dir):
    c, e = tables(spark, sf_dir)
    return g.coupling_by_name(strings(c, e), c)


@query(f"""WITH {STRINGS}, pack AS (SELECT id, name, concat(type, '/', language) AS package FROM component), named AS (SELECT name, min(package) AS package FROM pack GROUP BY name),
 hit AS (SELECT DISTINCT p.package AS src_package, d.dep, (SELECT min(n.package) FROM named n WHERE ends_with(d.dep, n.name)) AS dst_package FROM deps d JOIN pack p ON p.id = d.src) SELECT DISTINCT src_package, dst_package FROM hit WHERE src_package <> dst_package""")
def dependency_packages(spark, sf_dir):
    c, e = tables(spark, sf_dir)
    return g.dependency_packages(strings(c, e), c)


@query(f"""WITH {STRINGS}, d AS (SELECT DISTINCT src, trim(dep) AS dep FROM deps), l AS (SELECT src, coalesce((SELECT c.id FROM component c WHERE CAST(c.id AS VARCHAR) = dep), (SELECT max(c.id) FROM component c WHERE c.name = dep),
 (SELECT min(c.id) FROM component c WHERE ends_with(c.path, dep))) AS dst FROM d) SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL""")
def chart_links(spark, sf_dir):
    c, e = tables(spark, sf_dir)
    return g.chart_links(strings(c, e), c)


@query(f"WITH {CE} SELECT p.id AS project, c.id, coalesce(e.dst, -1) AS dst FROM (SELECT DISTINCT project_id AS id FROM component UNION ALL SELECT 99) p JOIN component c ON c.project_id = p.id LEFT JOIN edge e ON e.src = c.id")
def project_components(spark, sf_dir):
    """Of all projects, and one that has no components."""
    c, e = tables(spark, sf_dir)
    projects = c.select(F.col("project_id").alias("id")).distinct().unionByName(spark.createDataFrame([(99,)], "id long"))
    return g.project_components(projects, c, e).withColumn("dst", F.coalesce("dst", F.lit(-1).cast("long")))
