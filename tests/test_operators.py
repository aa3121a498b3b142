"""Operators on small literal inputs, with the expected values of the specification."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions import exprs as x
from quernstone.operators import autocomplete, graph, kernels, logs, memory, profiling, registry, semantic, sqlguard, textscan


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i, f"{i}.py") for i in ids], "id long, path string")


def test_chain_of_three(spark):
    n, e = nodes(spark, [1, 2, 3]), edges(spark, [(1, 2), (2, 3)])
    s = graph.statistics(n, e).first()
    assert (s.n_nodes, s.n_edges) == (3, 2)
    i = graph.impact(e, n.where("id = 3").select("id")).first()
    assert (i.direct, i.affected, i.indirect, i.critical) == (1, 2, 1, False)
    assert graph.shortest_path(e, 1, 3).first().path == [1, 2, 3]
    assert graph.shortest_path(e, 3, 1).count() == 0
    assert graph.shortest_path(e, 2, 2).first().path == [2]
    assert graph.reach(e, n.where("id = 2").select("id"), depth=2, both=True).where("id <> 2").count() == 2


def test_incremental_equals_rebuild(spark):
    n, e = nodes(spark, range(1, 8)), edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (6, 7)])
    new = edges(spark, [(2, 5), (2, 99)])
    got_n, got_e = graph.incremental_sync(n, e, nodes(spark, [2]), new, graph.changed_nodes(n, n.where("id = 2").select("id"), spark.createDataFrame([("./6.py",)], "path string")))
    assert {r.id for r in got_n.collect()} == {1, 2, 3, 4, 5, 7}
    assert {tuple(r) for r in got_e.select("src", "dst").collect()} == {(3, 4), (4, 5), (5, 1), (2, 5)}


def test_cycle_counts_its_start(spark):
    e = edges(spark, [(1, 2), (2, 1), (3, 3), (4, 1)])
    r = {(a.start, a.id) for a in graph.reach(e, nodes(spark, [1, 3]).select("id")).collect()}
    assert r == {(1, 1), (1, 2), (3, 3)}
    assert {(a.id, a.layer) for a in graph.layers(nodes(spark, [1, 2, 3, 4, 5]), e).collect()} == {(4, 0), (5, 0)}


CASES = [[(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], [(i, i + 1) for i in range(1, 3000)], [(1, 2), (2, 1), (2, 3), (3, 2), (4, 1), (1, 5)]]


@pytest.mark.parametrize("pairs", CASES)
def test_components_by_closure(pairs):
    succ = {}
    for a, b in pairs:
        succ.setdefault(a, set()).add(b)

    def closure(v):
        seen, todo = set(), [v]
        while todo:
            for w in succ.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    ids = {v for p in pairs for v in p}
    out = {r[0]: r for r in kernels.analyse(pairs, [])}
    if len(ids) < 100:
        reach = {v: closure(v) for v in ids}
        for v in ids:
            own = {w for w in reach[v] if v in reach[w]} | {v}
            assert (out[v][1], out[v][2], out[v][3]) == (min(own), len(own), v in reach[v])
    for a, b in pairs:
        assert out[a][1] == out[b][1] or out[a][4] > out[b][4]


@pytest.mark.parametrize("pairs", [CASES[0], CASES[2], [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (6, 1), (6, 6)], [(1, 2), (1, 3), (2, 4), (3, 4)], [e for i in range(2, 15) for e in ((1, i), (i, 1))]])
@pytest.mark.parametrize("small", [True, False])
def test_longest_chains_and_layers(spark, pairs, small, monkeypatch):
    """Chains by search over simple paths, layers on the graph of components; by one task and by loops over tables."""
    monkeypatch.setattr(graph, "SMALL_GRAPH", 500_000 if small else 0)
    succ = {}
    for a, b in pairs:
        succ.setdefault(a, set()).add(b)

    def deep(v, seen):
        return max((1 if w in seen else 1 + deep(w, seen | {w}) for w in succ.get(v, ())), default=0)

    ids = sorted({v for p in pairs for v in p} | {99})
    out = {r.id: r for r in graph.levels(nodes(spark, ids), edges(spark, pairs)).collect()}
    assert {v: out[v].depth for v in ids} == {v: deep(v, {v}) for v in ids}
    plain = {r[0]: r for r in kernels.analyse(pairs, [99])}
    assert {v: (out[v].component, out[v].on_cycle, out[v].layer) for v in ids} == {v: (plain[v][1], plain[v][3], plain[v][4]) for v in ids}


def test_large_graph_components(spark):
    e = edges(spark, CASES[0])
    assert {tuple(r) for r in kernels.strongly_connected_large(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert kernels.depth_first_cycles(CASES[2]) == [[1, 2, 1], [2, 3, 2]]


def test_kernel_refuses_a_graph_over_its_bound(spark):
    e = edges(spark, CASES[0]).withColumn("project_id", F.lit(1).cast("long"))
    n = e.select("project_id", F.col("src").alias("id")).distinct()
    assert kernels.graph_analysis(n, e).count() == 7
    with pytest.raises(Exception, match="strongly_connected_large"):
        kernels.graph_analysis(n, e, 3).collect()


def test_resolution_order(spark):
    c = spark.createDataFrame([(1, 9, "util", "a/util.py"), (2, 9, "main", "a/main.py"), (3, 9, "util", "b/util.py"), (4, 8, "util", "z.py")], "id long, project_id long, name string, path string")
    deps = spark.createDataFrame([(9, 2, "util"), (9, 2, "a/util"), (9, 2, "pkg.util"), (9, 2, "main"), (9, 2, "b/util.py"), (9, 2, "xutil")], "project_id long, src long, dep string")
    assert {(r.dep, r.dst, r.stage) for r in graph.resolve(deps, c).collect()} == {("util", 3, 0), ("a/util", 1, 1), ("pkg.util", 3, 2), ("b/util.py", 3, 1)}
    left = deps.where("dep = 'xutil'")
    assert [(r.dst, r.stage) for r in graph.resolve_contains(left, c).collect()] == [(1, 3)]


def test_upsert_keeps_the_newest_match(spark):
    kind = "id long, content string, memory_type string, agent string, importance long, is_active boolean, project_id long, created_seq long"
    old = spark.createDataFrame([(1, " x ", "fact", "a", 3, True, 1, 1), (2, "x", "fact", "a", 2, True, 1, 5), (3, "x", "fact", "a", 9, False, 1, 9)], kind)
    new = spark.createDataFrame([(4, "x", "fact", "a", 7, True, 1, 10), (5, "y", "fact", "a", 1, True, 1, 11), (6, "y ", "fact", "a", 2, True, 1, 12)], kind)
    out = {r.id: (r.importance, r.copies, r.is_new) for r in memory.upsert(old, new).collect()}
    assert out == {2: (7, 3, False), 5: (2, 2, True)}


def test_vector_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 0.0])]
    m = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert [(r.id, r.similarity) for r in memory.vector_search(m, [2.0, 0.0], 4).collect()] == [(2, 1.0), (5, 1.0), (1, 0.0), (3, 0.0)]
    full = m.withColumns({"memory_type": F.lit("t"), "content": F.lit("c"), "importance": F.lit(1), "created_seq": F.col("id")})
    assert memory.hybrid_search(full, "  ", [1.0, 0.0]).count() == 0


def test_hash_embedding_matches_hashlib(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    slots = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("id"), memory.embed_slots(F.col("text")).alias("slots"))
    for row in memory.embedding_from_slots(slots).collect()[:10]:
        v = [0.0] * 768
        for i, t in enumerate(texts[row.id].lower().split()):
            h = int(hashlib.sha256(t.encode()).hexdigest(), 16)
            for j in range(8):
                v[(h + 7919 * j) % 768] += 1 / (1 + 0.1 * i)
        norm = sum(a * a for a in v) ** 0.5
        assert row.embedding == pytest.approx([a / norm for a in v], abs=1e-6)


def test_metadata_merge_keeps_old_values(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    row = spark.range(1).select(memory.merge_metadata(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"), F.lit("c"), F.lit(None).cast("string"))).alias("m")).first()
    assert row.m == {"a": "1", "b": "3"}


CODE = {
    1: ("python", "import os\n# password = 'x'\npassword = \"abc\"\nif a == None:\n    return 1\n    x = 2\n"), 2: ("javascript", "var a = 1\nif (a == b) { eval('x') }\nif (a == null) {}\n"),
    3: ("java", "try {} catch (Exception e) { }\nif (s == \"x\") { int a = 42; }\nint[] b = new int[10];\n"), 4: ("go", "token = 'secret'\nopen('../x')\nquery(\"SELECT\" + x)\n"), 5: ("python", ""), 6: ("python", None),
    7: ("python", "é😀 eval(x)\nexcept:\ndef f(a=[]):\nfor a in b:\n  for c in d:\n    for e in f:\n      s += 1\n"),
}


def test_scan_positions_match_re(spark):
    code = spark.createDataFrame([(i, lang, t) for i, (lang, t) in CODE.items()], "id long, language string, content string")
    got = {(r.id, r.rule, r.line, r.column, r.confidence) for r in textscan.scan_positions(code).collect()}
    want = set()
    for i, (lang, t) in CODE.items():
        for rule in textscan.RULES:
            if t and rule.language in (lang, "all"):
                for m in re.finditer(rule.pattern, t, re.I | re.M):
                    line = t.count("\n", 0, m.start()) + 1
                    whole = t.split("\n")[line - 1].strip()
                    c = textscan.confidence(rule) * (0.5 if whole.startswith(("#", "//")) else 1)
                    want.add((i, rule.name, line, m.start() - (t.rfind("\n", 0, m.start()) + 1) + 1, round(min(1, max(0.1, c)), 6)))
    assert got == want
    counts = {(r.id, r.rule): r.n for r in textscan.scan_counts(code).collect()}
    assert sum(counts.values()) == len(want)
    assert {r for _, r in counts} >= {"js_equality_operator", "memory_leak_pattern", "nested_loops", "java_empty_catch", "path_traversal"}


def test_disabled_rules_do_not_scan(spark):
    from dataclasses import replace

    code = spark.createDataFrame([(1, "python", "eval(x)")], "id long, language string, content string")
    assert textscan.scan_counts(code, tuple(replace(r, enabled=False) for r in textscan.RULES)).count() == 0


def test_guarded_sql(spark):
    spark.range(5).createOrReplaceTempView("agents")
    spark.range(5).createOrReplaceTempView("private_t")
    assert sqlguard.guarded_query(spark, "SELECT id FROM agents WHERE id > 2;", {"agents"}).count() == 2
    assert sqlguard.fetch(spark, "SELECT * FROM agents", {"agents"}, 5)[1] is False
    assert sqlguard.fetch(spark, "SELECT * FROM agents", {"agents"}, 4)[1] is True
    assert sqlguard.guarded_query(spark, "SELECT 'drop; it' AS a FROM agents", {"agents"}).count() == 5
    bad = ["SELECT * FROM agents, private_t", "SELECT * FROM private.secret", "DROP TABLE agents", "SELECT 1; SELECT 2", "SELECT * FROM agents UNION SELECT * FROM agents", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT (SELECT max(id) FROM private_t)", "SELECT * FROM agents WHERE id IN (SELECT id FROM private_t)", "SELECT * FROM (", "SELECT " + "1" * 2000, "insert into agents values (1)"]
    for sql in bad:
        with pytest.raises(sqlguard.Rejected):
            sqlguard.guarded_query(spark, sql, {"agents"})
    # what names a relation otherwise than by its name, or reads something else
    for sql in ("SELECT * FROM identifier('private_t')", "SELECT * FROM agents JOIN identifier('private' || '_t') ON true", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM agents", "SELECT * FROM read_files('/etc')", "SELECT * FROM range(3)", "SELECT * FROM agents WHERE id = :x", "SELECT spark_catalog.default.f(id) FROM agents"):
        with pytest.raises(sqlguard.Rejected):
            sqlguard.guarded_query(spark, sql, {"agents", "private", "t"})
    # what only looks like a relation stays as it is
    spark.createDataFrame([(1, "public.x"), (2, "x"), (3, "information_schema.columns é")], "id long, t string").createOrReplaceTempView("agents")
    for sql, ids in (
        ("SELECT id FROM public.agents WHERE t = 'public.x'", [1]), ("SELECT public.agents.id FROM Public . agents WHERE public.agents.t = 'x'", [2]), ("SELECT 'é😀 public.a' AS t, id FROM `public`.`agents` -- public.agents", [1, 2, 3]),
        ("SELECT id FROM public.agents WHERE t LIKE 'information_schema.columns%' AND id IN (SELECT id FROM public.agents)", [3]),
    ):
        assert sorted(r.id for r in sqlguard.guarded_query(spark, sql, {"agents"}).collect()) == ids
    spark.range(5).createOrReplaceTempView("agents")
    columns = sqlguard.guarded_query(spark, "SELECT column_name FROM INFORMATION_SCHEMA.Columns WHERE table_name = 'agents'", {"agents"})
    assert [r.column_name for r in columns.collect()] == ["id"]
    with pytest.raises(sqlguard.Rejected):
        sqlguard.guarded_query(spark, "SELECT * FROM information_schema__columns", {"agents"})


def test_framework_and_database_detection(spark):
    files = spark.createDataFrame([(1, "from fastapi import FastAPI\napp = FastAPI()"), (2, "REDIS=redis://x"), (3, None), (4, "plain")], "id long, content string")
    assert {(r.name, r.n_files) for r in profiling.detect(files, {**profiling.FRAMEWORKS, **profiling.DATABASES}).collect()} == {("fastapi", 1), ("redis", 1)}
    tech = spark.createDataFrame([("python", 0.5, "language"), ("make", 0.9, "build_tool")], "name string, confidence double, category string")
    assert profiling.overall_confidence(tech).first().confidence == pytest.approx(0.8)
    assert profiling.overall_confidence(tech.limit(0)).first().confidence == 0


def test_structural_query():
    assert registry.parse_structural("Public abstract async CLASS, simple and complex") == {"type": "class", "access_level": "public", "is_abstract": True, "is_async": True, "max_complexity": 5}


def test_intents_and_routes(spark):
    rows = spark.createDataFrame([("How to fix it",), ("vs",), ("nothing",), ("please review this",), ("remember me",)], "t string").select(semantic.intent(F.col("t")).alias("i"), logs.route(F.col("t")).alias("r")).collect()
    assert [r.i for r in rows] == ["get_example", "compare_approaches", "find_code", "find_code", "find_code"]
    assert [r.r for r in rows] == ["simple_qa", "simple_qa", "simple_qa", "full_pipeline", "memory_workflow"]


def test_logs_of_git(spark):
    log = spark.createDataFrame([("abc|Fix a|Ann",), ("bad line",)], "line string")
    assert [tuple(r) for r in logs.parse_git_log(log).collect()] == [("abc", "Fix a", "Ann")]
    status = spark.createDataFrame([("?? new.py",), (" M a.py",), ("D  b.py",)], "line string")
    assert {tuple(r) for r in logs.parse_git_status(status).collect()} == {("untracked", "new.py"), ("modified", "a.py"), ("deleted", "b.py")}


def test_due_projects_wait_for_their_cooldown(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    p = spark.createDataFrame([(1, False, 5), (2, True, 1), (3, False, 9)], "id long, is_active boolean, completed_at long")
    done = spark.createDataFrame([(3, "2024-01-01 00:55:00"), (1, "2024-01-01 00:10:00")], "id long, t string").select("id", F.col("t").cast("timestamp").alias("processed_at"))
    assert [r.id for r in logs.due_projects(p, done, now).collect()] == [2, 1]


def test_cursor_context(spark):
    text = "import os\nclass A:\n    def go(self):\n        val = 1\n        va"
    row = spark.createDataFrame([(text,)], "t string").select(autocomplete.before_cursor(F.col("t"), F.lit(4), F.lit(10)).alias("b")).select("b", *autocomplete.context(F.col("b"))).first()
    assert row.b == text and (row.prefix, row.variables, row.functions, row.classes, row.imports) == ("va", ["val"], ["go"], ["A"], ["os"])


def test_empty_words_and_zero_division(spark):
    r = spark.createDataFrame([("", " a  b ")], "a string, b string").select(F.size(x.words(F.col("a"))).alias("n"), F.size(x.words(F.col("b"))).alias("m"), x.ratio(F.lit(1), F.lit(0)).alias("z"), x.string_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert tuple(r) == (0, 2, 0.0, 0.0)
    assert x.terms("Find a the token_x, the-y ab") == ["find", "the", "token_x", "the-y"]


def test_numbers_of_zeros(spark):
    code = spark.createDataFrame([(1, "a = 00 + 000\nb = 007 + 0011 + 00000000000000000000012")], "id long, content string")
    assert [(r.line_number, r.found) for r in textscan.line_review(code).collect()] == [(2, "0011"), (2, "00000000000000000000012")]


def test_containment_by_rarest_piece(spark):
    """Either text in the other, against all pairs; few pairs are looked at."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd/.") for _ in range(rng.randint(1, 7)))
    parts = [(i, i % 2, word(), f"src/lib/{word()}/{word()}") for i in range(60)]
    deps = [(p, i, d) for i, p, *_ in parts for d in {word(), f"x{word()}", rng.choice(parts)[3][4:], rng.choice(parts)[3] + "#", ""}]
    c = spark.createDataFrame(parts, "id long, project_id long, name string, path string")
    got = {(r.src, r.dep): (r.stage, r.dst) for r in graph.resolve_contains(spark.createDataFrame(deps, "project_id long, src long, dep string"), c).collect()}
    want = {}
    for p, src, d in deps:
        hits = [(3, i) for i, q, name, _ in parts if q == p and i != src and d and (name.endswith(d) or d.endswith(name))] + [(4, i) for i, q, _, path in parts if q == p and i != src and d and (d in path or path in d)]
        if hits:
            want[src, d] = min(hits)
    assert got == want


def test_hours_passed_count_parts_of_a_second(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = ["2024-01-31 23:00:00", "2024-01-31 23:00:00.000001", "2024-01-25 00:00:00", "2024-01-25 00:00:00.5", "2024-02-01 00:00:00.5"]
    rows = spark.createDataFrame([(t,) for t in at], "t string").select("t", logs.since_buckets(F.col("t").cast("timestamp"), now).alias("age"))
    assert {r.t: r.age for r in rows.collect()} == dict(zip(at, ["today", "just now", "older", "this week", "just now"], strict=True))


def test_later_stages_leave_out_what_earlier_ones_find(spark):
    """All five stages against all pairs, as the SQL of edge_resolution_all has them: a component that an earlier stage finds is no hit of a later one, also if that stage led to the asking component itself."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab.") for _ in range(rng.randint(1, 4)))
    parts = [(i, i % 2, word(), f"{word()}/{word()}") for i in range(80)]
    deps = sorted({(p, i, d) for i, p, name, path in parts for d in (name, path, word(), f"x.{name}", rng.choice(parts)[2], path[1:]) if d})
    c = spark.createDataFrame(parts, "id long, project_id long, name string, path string")
    got = {(r.src, r.dep): (r.stage, r.dst) for r in graph.resolve_all(spark.createDataFrame(deps, "project_id long, src long, dep string"), c).collect()}
    want, changed = {}, 0
    for p, src, d in deps:
        stages: dict = {}
        for i, q, name, path in parts:
            if q == p:
                tests = [name == d, d in (path, re.sub(r"\.[^./]*$", "", path)), name == d.split(".")[-1], name.endswith(d) or d.endswith(name), d in path or path in d]
                if any(tests):
                    stages.setdefault(tests.index(True), []).append(i)
        hits = [(s, max(stages[s])) for s in (0, 1, 2) if s in stages and max(stages[s]) != src]
        hits = hits or [(s, i) for s in (3, 4) for i in stages.get(s, ()) if i != src]
        changed += not hits or bool(hits[0][0] > 2 and stages.keys() & {0, 1, 2})
        if hits:
            want[src, d] = min(hits)
    assert changed and got == want


def test_only_changed_contents_are_embedded(spark):
    """Digests are made of contents that differ, not in a filter of all changes, and once a token."""
    held = spark.createDataFrame([(i, f"text {i}", {"tag": "old"}, None) for i in range(6)], "id long, content string, metadata map<string,string>, embedding array<float>")
    changes = spark.createDataFrame([(1, "text 1", None), (2, "other words", {"tag": "new"}), (3, None, None), (4, " ", None)], "id long, content string, metadata map<string,string>")
    out = memory.updated(held, changes, 64)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "sha2" in x and "Filter" in x] and plan.count("sha2(") == 1
    got = {r.id: (r.content, r.metadata["tag"], r.embedding and sum(w != 0 for w in r.embedding)) for r in out.collect()}
    assert got == {0: ("text 0", "old", None), 1: ("text 1", "old", None), 2: ("other words", "new", got[2][2]), 3: ("text 3", "old", None), 4: (" ", "old", None), 5: ("text 5", "old", None)} and got[2][2] > 7


def test_texts_are_looked_up_under_long_pieces(spark):
    """Paths that differ in their last digits: under pieces of three characters each would be checked in a share of all, so the work grew with the square of the table."""
    paths = spark.range(1000, 3000).selectExpr("0L AS project_id", "concat('large/Brand#7/', id) AS path")
    asked = spark.range(1000, 3000).selectExpr("0L AS project_id", "concat('Brand#7/', id) AS dep").unionByName(spark.createDataFrame([(0, "7"), (0, "/1"), (0, "#7/"), (0, "x"), (1, "7"), (None, "7")], "project_id long, dep string"))
    assert graph.may_hold(asked.where("dep LIKE 'Brand%'"), paths, "dep", "path").count() <= 2 * 2000
    want = asked.join(paths, "project_id").where("contains(path, dep)").count()
    assert graph.held_by(asked, paths, "dep", "path").count() == want > 2000


def test_all_projects_have_their_components(spark, sf):
    from quernstone.plans import catalog

    got = {r.project for r in catalog.QUERIES["project_components"](spark, sf).select("project").distinct().collect()}
    assert got == {r.p for r in spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey % 7 AS p").distinct().collect()}


def test_chart_links_collect_no_table(spark, sf):
    from quernstone.plans import catalog

    plan = catalog.QUERIES["chart_links"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "l_orderkey" not in x]  # lines of orders are joined before


def test_changed_graph_resolves_once(spark):
    """The plan of an incremental build reads tables, so it doesn't grow with each use of the resolved edges."""
    c = spark.createDataFrame([(i, i % 2, f"n{i}", f"a/n{i}.py", ["x"]) for i in range(6)], "id long, project_id long, name string, path string, exports array<string>")
    deps = spark.createDataFrame([(i % 2, i, f"n{i - 2}") for i in range(2, 6)], "project_id long, src long, dep string")
    touched = graph.changed_graph(deps, c, c.where("id = 0"))[1]
    assert touched._jdf.queryExecution().optimizedPlan().toString().count("\n") < 40
    assert [(r.src, r.dst) for r in touched.collect()] == [(2, 0)]


def test_large_graphs_have_levels_of_tables(spark, monkeypatch):
    """Above SMALL_GRAPH the plan of levels is a table, whatever the number of rounds; a ring with a chain behind it and one before."""
    monkeypatch.setattr(graph, "SMALL_GRAPH", 0)
    pairs = [(i, i + 1) for i in range(1, 30)] + [(30, 21)]
    out = graph.levels(nodes(spark, range(1, 31)), edges(spark, pairs))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\n") <= 3
    assert {r.id: (r.component, r.on_cycle, r.layer, r.depth) for r in out.collect()} == {i: (i, False, 21 - i, 21 - i + 10) if i < 21 else (21, True, 0, 10) for i in range(1, 31)}
