"""Queries over logs, sessions, profiles and guarded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import logs as g
from quernstone.operators import memory as m
from quernstone.operators import profiling as p
from quernstone.operators import sqlguard
from quernstone.plans.literals import Literal
from quernstone.plans.registry import query
from quernstone.sources import views as v

ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(content, '{a}') THEN '{b}'" for a, b in g.ROUTES) + " ELSE 'simple_qa' END"


@query(f"WITH {v.MESSAGE} SELECT session_id, seq, {ROUTE} AS workflow FROM message")
def workflow_route(spark, sf_dir):
    return v.message(spark, sf_dir).select("session_id", "seq", g.route(F.col("content")).alias("workflow"))


@query(f"WITH {v.MESSAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, role) AS rn FROM message) SELECT session_id, seq, role, length(content) AS n_chars FROM r WHERE rn <= 3")
def session_messages(spark, sf_dir):
    return g.first_messages(v.message(spark, sf_dir), 3).select("session_id", "seq", "role", F.length("content").cast("long").alias("n_chars"))


@query("SELECT conv_id AS run_id, count(*) AS n_steps, list(role ORDER BY turn) AS steps FROM conversations GROUP BY conv_id")
def run_steps(spark, sf_dir):
    return g.run_steps(v.message(spark, sf_dir).select(F.col("session_id").alias("run_id"), F.col("seq").alias("step_index"), F.col("role").alias("name")))


@query(f"WITH {v.METRIC}, r AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY ts DESC, id DESC) AS rn FROM metric) SELECT component_id, metric FROM r WHERE rn = 1")
def latest_status(spark, sf_dir):
    return g.latest(v.metric(spark, sf_dir), ["component_id"], ["ts", "id"], "metric")


@query("SELECT event_type AS tool, count(*) AS n, count_if(event_type = 'error')::BIGINT AS errors, round(avg(value), 6) AS avg_duration, max(value) AS max_duration FROM events GROUP BY event_type")
def call_statistics(spark, sf_dir):
    m = v.metric(spark, sf_dir).select(F.col("metric").alias("tool"), F.col("value").alias("duration"), F.when(F.col("metric") == "error", "error").otherwise("success").alias("status"))
    return g.call_statistics(m)


@query("SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type")
def search_analytics(spark, sf_dir):
    return g.search_analytics(v.metric(spark, sf_dir))[0]


@query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def last_searches(spark, sf_dir):
    return g.search_analytics(v.metric(spark, sf_dir))[1].select("id")


@query("""WITH a AS (SELECT user_id % 7 AS project_id, event_type AS role, event_id AS id, ts, row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 1),
 roles AS (SELECT DISTINCT user_id % 7 AS project_id, r.role FROM events, (VALUES ('view'), ('error'), ('click'), ('auditor')) r(role)) SELECT project_id, role, coalesce(id, -1) AS agent_id, id IS NULL AS to_create FROM roles LEFT JOIN (SELECT * FROM a WHERE r = 1) USING (project_id, role)""")
def role_agents(spark, sf_dir):
    m = v.metric(spark, sf_dir).select((F.col("component_id") % 7).alias("project_id"), F.col("metric").alias("role"), "id", F.col("ts").alias("updated_at"), (F.col("value") > 1).alias("is_active"))
    roles = m.select("project_id", F.explode(F.array(*map(F.lit, ["view", "error", "click", "auditor"]))).alias("role")).distinct()
    found, to_make = g.roles_to_fill(roles, m)
    return found.withColumn("to_create", F.lit(False)).unionByName(to_make.withColumns({"agent_id": F.lit(-1).cast("long"), "to_create": F.lit(True)}))


@query("SELECT sum(event_id % 4)::BIGINT AS issues, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 6) AS avg_score, round(avg(CASE WHEN event_type = 'error' THEN NULL ELSE value END), 6) AS avg_valid FROM events")
def review_rollup(spark, sf_dir):
    m = v.metric(spark, sf_dir)
    return g.review_rollup(m.select((F.col("id") % 4).alias("issues"), F.when(F.col("metric") == "error", F.lit(None)).otherwise(F.col("value")).alias("score")))


@query("""WITH c AS (SELECT user_id AS key, value, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-31 00:00:00')
 SELECT key, value FROM c WHERE r = 1""")
def unexpired_keys(spark, sf_dir):
    m = v.metric(spark, sf_dir)
    c = m.select(F.col("component_id").alias("key"), "value", F.struct("ts", "id").alias("written_at"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return g.unexpired(c, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("SELECT event_id AS id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN 'today' WHEN h < 168 THEN 'this week' ELSE 'older' END AS age FROM (SELECT event_id, floor(epoch(TIMESTAMP '2024-02-01 00:00:00' - ts) / 3600) AS h FROM events)")
def timeline_buckets(spark, sf_dir):
    return v.metric(spark, sf_dir).select("id", g.since_buckets(F.col("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age"))


@query("""WITH a AS (SELECT DISTINCT concat(p_type, p_brand) AS name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT concat(p_type, p_brand) AS name FROM part WHERE p_partkey % 3 = 0)
 SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b,
 round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b))::DOUBLE, 6) AS jaccard""")
def stack_compare(spark, sf_dir):
    c = v.component(spark, sf_dir)
    return p.compare_stacks(c.where("id % 2 = 0").select(F.concat("type", "language").alias("name")), c.where("id % 3 = 0").select(F.concat("type", "language").alias("name")))


@query("SELECT p_type AS name, round(max(p_size / 50.0)::DOUBLE, 6) AS confidence, sum(p_partkey % 5)::BIGINT AS usage, count(*) AS n_files FROM part GROUP BY p_type")
def tech_merge(spark, sf_dir):
    c = v.component(spark, sf_dir)
    return p.merge_technologies(c.select(F.col("type").alias("name"), F.round(F.col("complexity") / 50, 6).alias("confidence"), (F.col("id") % 5).alias("usage"), "path")).select("name", "confidence", "usage", F.size("files").cast("long").alias("n_files"))


@query(f"WITH {v.COMPONENT}, parts AS (SELECT string_split(path, '/') AS p FROM component) SELECT DISTINCT array_to_string(p[1:i], '/') AS node, i AS depth FROM parts, (VALUES (1), (2), (3)) t(i)")
def file_tree(spark, sf_dir):
    return p.tree_nodes(v.component(spark, sf_dir))


@query(f"WITH {v.COMPONENT} SELECT project_id, string_agg(type || ':' || n, ',' ORDER BY n DESC, type) AS distribution FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, type) AS r FROM (SELECT project_id, type, count(*) AS n FROM component GROUP BY ALL)) WHERE r <= 8 GROUP BY project_id")
def component_distribution(spark, sf_dir):
    return p.distribution_text(v.component(spark, sf_dir))


@query("SELECT p_type AS type, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_type")
def guarded_sql(spark, sf_dir):
    """User SQL over an allowed view, checked on the parsed plan."""
    v.component(spark, sf_dir).createOrReplaceTempView("components")
    return sqlguard.guarded_query(spark, "SELECT type, count(*) AS n FROM components WHERE complexity > 25 GROUP BY type;", {"components"}, 1000)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").where("doc_id = 42").select("doc_id", "lang", "n_chars")


SEARCHES = "s AS (SELECT event_id AS id, event_type AS intent, concat('scope', user_id % 3) AS scope, CASE user_id % 2 WHEN 0 THEN 'go' ELSE 'python' END AS language, event_id % 9 AS n_results, ts FROM events)"


@query(f"""WITH {SEARCHES}, recent AS (SELECT id, row_number() OVER (ORDER BY ts DESC, id DESC) AS r FROM s) SELECT 'intent' AS measure, intent AS key, count(*)::DOUBLE AS value FROM s GROUP BY ALL UNION ALL SELECT 'scope', scope, count(*) FROM s GROUP BY ALL
 UNION ALL SELECT 'language', language, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM s UNION ALL SELECT 'avg_results', '', round(avg(n_results), 6) FROM s UNION ALL SELECT 'recent', CAST(id AS VARCHAR), r FROM recent WHERE r <= 10""")
def search_report(spark, sf_dir):
    u = F.col("component_id")
    s = v.metric(spark, sf_dir).select("id", F.col("metric").alias("intent"), F.concat(F.lit("scope"), (u % 3).cast("string")).alias("scope"), F.when(u % 2 == 0, "go").otherwise("python").alias("language"), (F.col("id") % 9).alias("n_results"), "ts")
    return g.search_report(s)


@query("SELECT user_id AS agent, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS session_id FROM events WHERE event_id % 5 <> 0 GROUP BY user_id")
def latest_session(spark, sf_dir):
    e = v.metric(spark, sf_dir)
    return g.latest_session(e.select(F.col("component_id").alias("agent"), F.col("id").alias("session_id"), F.col("ts").alias("created_at"), (F.col("id") % 5 != 0).alias("is_active")))


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 30")
def project_page(spark, sf_dir):
    """A limit beyond the bound is cut to 200."""
    return g.project_page(v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at")), 30, 5000).select("id")


@query("""WITH p AS (SELECT user_id AS id, max(ts) AS completed_at, user_id = 3 AS is_active FROM events GROUP BY user_id), done AS (SELECT user_id AS id, max(ts) AS at FROM events WHERE event_type = 'error' GROUP BY user_id)
 SELECT p.id FROM p LEFT JOIN done USING (id) WHERE done.at IS NULL OR done.at + INTERVAL 200000 SECOND <= TIMESTAMP '2024-01-31 00:00:00' ORDER BY is_active DESC, completed_at DESC, p.id LIMIT 10""")
def due_projects(spark, sf_dir):
    """Projects that the maintenance loop takes next."""
    e = v.metric(spark, sf_dir)
    projects = e.groupBy(F.col("component_id").alias("id")).agg(F.max("ts").alias("completed_at")).withColumn("is_active", F.col("id") == 3)
    done = e.where("metric = 'error'").groupBy(F.col("component_id").alias("id")).agg(F.max("ts").alias("processed_at"))
    return g.due_projects(projects, done, F.lit("2024-01-31 00:00:00").cast("timestamp"), 200_000).select("id")


DIFF = Literal(((1, "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n@@ -9 +10 @@\n-e\ndiff --git a/y/z.md b/y/w.md\n--- a/y/z.md\n+++ b/y/w.md\n@@ -1 +1 @@\n+q\n"), (2, ""), (3, None)), "id long, text string")


@query(Literal(((1, "x.py", 2, 2, 2), (1, "y/w.md", 1, 0, 1)), "id long, path string, n_added long, n_deleted long, n_hunks long").select())
def git_diff(spark, sf_dir):
    """The results were worked out by hand."""
    return g.parse_git_diff(DIFF.df(spark))


GIT = Literal((("abc1|Fix a|b|Ann", "log"), ("def2|Add|Bob", "log"), ("broken", "log"), (" M src/a.py", "status"), ("?? new.txt", "status"), ("D  old.py", "status"), ("A  b c.py", "status"), ("R  x -> y", "status"), ("", "status")), "line string, kind string")


@query(Literal((("log", "abc1", "Fix a", "b|Ann"), ("log", "def2", "Add", "Bob"), ("status", "modified", "src/a.py", ""), ("status", "untracked", "new.txt", ""), ("status", "deleted", "old.py", ""), ("status", "added", "b c.py", ""), ("status", "renamed", "x -> y", "")), "kind string, a string, b string, c string").select())
def git_log_and_status(spark, sf_dir):
    """The results were worked out by hand."""
    t = GIT.df(spark)
    log = g.parse_git_log(t.where("kind = 'log'")).select(F.lit("log").alias("kind"), F.col("hash").alias("a"), F.col("subject").alias("b"), F.col("author").alias("c"))
    return log.unionByName(g.parse_git_status(t.where("kind = 'status'")).select(F.lit("status").alias("kind"), F.col("state").alias("a"), F.col("path").alias("b"), F.lit("").alias("c")))


CHANGED = Literal(((1, ["./a.py", "a.py", " b\\c.py ", "/d", "", None, "././e"]), (2, [])), "id long, paths array<string>")


@query(Literal(((1, ["a.py", "b/c.py", "d", "e"]), (2, [])), "id long, paths array<string>").select())
def changed_paths(spark, sf_dir):
    """The results were worked out by hand."""
    return CHANGED.df(spark).select("id", g.changed_paths(F.col("paths")).alias("paths"))


@query("SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en FROM documents")
def documentation_count(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"))


STATEMENTS = (
    ("SELECT type FROM components", True), ("SELECT upper(type) FROM public.components WHERE id IN (SELECT id FROM components)", True), ("SELECT table_name FROM information_schema.columns", True), ("SELECT * FROM identifier('secretview')", False),
    ("SELECT * FROM components c JOIN identifier('secret' || 'view') s ON true", False), ("SELECT reflect('java.lang.System', 'getProperty', 'user.name') FROM components", False), ("SELECT * FROM read_files('/etc/passwd')", False), ("SELECT * FROM range(10)", False),
    ("SELECT * FROM `public.components`", False), ("SELECT * FROM parquet.`/etc`", False), ("SELECT * FROM secretview", False), ("SELECT (SELECT max(id) FROM secretview) FROM components", False), ("SELECT * FROM components, LATERAL (SELECT 1)", False),
    ("SELECT java_method('java.lang.Math', 'abs', 1) FROM components", False), ("SELECT * FROM components LATERAL VIEW explode(tags) t", False), ("SELECT * FROM VALUES (1) v", False), ("SELECT id FROM spark_catalog.default.components", False), ("SELECT exists(tags, t -> t = 'x') FROM components", True),
    ("SELECT * FROM components WHERE EXISTS (SELECT 1 FROM secretview)", False), ("TABLE components", False),
)


@query(Literal(tuple((i, ok) for i, (_, ok) in enumerate(STATEMENTS)), "statement int, accepted boolean").select())
def guarded_statements(spark, sf_dir):
    """Which statements the guard lets pass."""
    v.component(spark, sf_dir).createOrReplaceTempView("components")

    def accepted(sql: str) -> bool:
        try:
            sqlguard.check(spark, sql, {"components"}, sqlguard.METADATA_SCHEMAS)
        except sqlguard.Rejected:
            return False
        return True

    return spark.createDataFrame([(i, accepted(sql)) for i, (sql, _) in enumerate(STATEMENTS)], "statement int, accepted boolean")


@query(Literal((("components", "id", 1), ("components", "project_id", 2)), "table_name string, column_name string, ordinal_position int").select())
def information_schema(spark, sf_dir):
    """Metadata of the allowed views by guarded SQL."""
    v.component(spark, sf_dir).createOrReplaceTempView("components")
    return sqlguard.guarded_query(spark, "SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE column_name LIKE '%id'", {"components"})


@query("SELECT doc_id AS id FROM documents WHERE source = 'src3' AND lang = 'en'")
def lookup_by_path(spark, sf_dir):
    """Rows by equality on several columns; what is None does not filter."""
    return m.scoped(v.memory(spark, sf_dir, False), agent="src3", memory_type="en", active_only=False).select("id")
