"""Queries over files, technologies and architecture."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import profiling as p
from quernstone.plans.literals import Literal
from quernstone.plans.registry import query
from quernstone.sources import views as v

FILES = """files AS (SELECT doc_id AS id, concat(source, '/', lang, '/', CAST(doc_id AS VARCHAR), '.txt') AS path, strlen(text)::BIGINT AS size_bytes, lang AS language, doc_id % 97 = 0 AS is_binary, doc_id % 13 = 0 AS is_generated,
 doc_id % 5 = 0 AS is_test, doc_id % 11 = 0 AS is_config, doc_id % 7 = 0 AS is_documentation, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents)"""


def files(spark, sf_dir):
    d, k = v.table(spark, sf_dir, "documents"), F.col("doc_id")
    flags = {"is_binary": 97, "is_generated": 13, "is_test": 5, "is_config": 11, "is_documentation": 7}
    return d.select(
        k.alias("id"), F.concat(F.concat_ws("/", "source", "lang", k.cast("string")), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("lang").alias("language"), *[(k % n == 0).alias(c) for c, n in flags.items()],
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
    )


@query(f"""WITH {FILES}, l AS (SELECT language, count(*) AS n FROM files GROUP BY language) SELECT count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes, count_if(is_binary)::BIGINT AS is_binary, count_if(is_generated)::BIGINT AS is_generated, count_if(is_test)::BIGINT AS is_test,
 count_if(is_config)::BIGINT AS is_config, count_if(is_documentation)::BIGINT AS is_documentation, (SELECT language FROM l ORDER BY n DESC LIMIT 1) AS main_language, (SELECT count(*) FROM l) AS n_languages FROM files""")
def file_statistics(spark, sf_dir):
    return p.file_statistics(files(spark, sf_dir))


DIRS = f"""{FILES}, parts AS (SELECT string_split(path, '/') AS p, size_bytes AS b FROM files), rows AS (SELECT array_to_string(p[1:i], '/') AS directory, CASE WHEN i + 1 < len(p) THEN p[i + 1] END AS child, CASE WHEN i + 1 = len(p) THEN b END AS bytes
 FROM parts, range(1, 3) t(i) WHERE i < len(p)), d AS (SELECT directory, count(bytes) AS n_files, count(DISTINCT child) AS n_directories, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM rows GROUP BY directory)"""


@query(f"WITH {DIRS} SELECT * FROM d")
def directory_statistics(spark, sf_dir):
    return p.directory_statistics(files(spark, sf_dir))


@query(f"""WITH {DIRS}, top AS (SELECT * FROM d ORDER BY bytes DESC, directory LIMIT 10) SELECT 'directories' AS measure, '' AS key, count(*) AS value FROM d UNION ALL SELECT 'files', '', sum(n_files)::BIGINT FROM d UNION ALL SELECT 'subdirectories', '', sum(n_directories)::BIGINT FROM d
 UNION ALL SELECT 'bytes', '', sum(bytes)::BIGINT FROM d UNION ALL SELECT 'largest', directory, bytes FROM top UNION ALL SELECT 'files_in_largest', directory, n_files FROM top""")
def directory_totals(spark, sf_dir):
    return p.directory_totals(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT count(*) AS n_files, sum(n_lines)::BIGINT AS n_lines, round(sum(n_lines) / count(*)::DOUBLE, 6) AS avg_lines, round(sum(size_bytes) / count(*)::DOUBLE, 6) AS avg_bytes FROM files")
def lines_per_file(spark, sf_dir):
    return p.lines_per_file(files(spark, sf_dir))


@query(f"""WITH {FILES}, s AS (SELECT count(*) AS n_files, count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS n_directories, count_if(NOT is_binary)::BIGINT AS n_source, count(DISTINCT CASE WHEN NOT is_binary THEN language END) AS n_languages, max(len(string_split(path, '/')) - 1)::BIGINT AS depth,
 count_if(is_config)::BIGINT AS n_config, count_if(is_test)::BIGINT AS n_test, round(avg(size_bytes), 6) AS avg_bytes, round(count_if(is_test) / count_if(NOT is_binary)::DOUBLE, 6) AS test_ratio FROM files)
 SELECT *, least(greatest(1 + CASE WHEN n_files > 1000 THEN 2 WHEN n_files > 500 THEN 1 ELSE 0 END + CASE WHEN n_languages > 5 THEN 2 WHEN n_languages > 3 THEN 1 ELSE 0 END + CASE WHEN depth > 8 THEN 2 WHEN depth > 5 THEN 1 ELSE 0 END
 + CASE WHEN n_config > 20 THEN 1 ELSE 0 END - CASE WHEN test_ratio > 0.3 THEN 1 ELSE 0 END, 1), 10)::BIGINT AS score FROM s""")
def project_complexity(spark, sf_dir):
    return p.project_complexity(files(spark, sf_dir))


@query(f"WITH {FILES}, l AS (SELECT language, count(*) AS n, min(id) AS seen FROM files GROUP BY language) SELECT language, n, row_number() OVER (ORDER BY n DESC, seen) AS place FROM l")
def languages_by_use(spark, sf_dir):
    return p.languages_by_use(files(spark, sf_dir))


F_, T_ = False, True
#: id, project, path, language, binary, generated, documentation, test, text
TREE = Literal(
    (
        (1, 1, "app/main.py", "python", F_, F_, F_, F_, "from FastAPI import x\napp = FastAPI()\nDB = 'postgresql://h'"), (2, 1, "README.md", None, F_, F_, T_, F_, "react vue angular django flask express spring redis from fastapi"),
        (3, 1, "db.py", "python", F_, F_, F_, F_, "import redis"), (4, 1, ".env", None, F_, F_, F_, F_, "URL=redis://r"), (5, 1, "yarn.lock", None, F_, T_, F_, F_, "mongodb mysql"), (6, 1, "package.json", None, F_, F_, F_, F_, "{'react-dom': 1, 'express()': 2, 'mongoose': 3}"),
        (7, 1, "src/gen.ts", "typescript", F_, T_, F_, F_, "from 'react'"), (8, 1, "web/ui.tsx", "typescript", F_, F_, F_, F_, "import x from 'react'"), (9, 1, "tests/test_a.py", "python", F_, F_, F_, T_, "import pytest"), (10, 1, "spec/b.spec.js", "javascript", F_, F_, F_, T_, "describe('x', () => { it('y') })"),
        (11, 1, "Dockerfile", None, F_, F_, F_, F_, "FROM python"), (12, 1, "requirements.txt", None, F_, F_, F_, F_, "flask(\npsycopg"), (13, 1, "Gemfile", None, F_, F_, F_, F_, "rails.application"), (14, 1, "a/b/img.png", None, T_, F_, F_, F_, None), (15, 1, "lib/x.csproj", None, F_, F_, F_, F_, "<x/>"),
        (16, 2, "services/order-service/api.py", "python", F_, F_, F_, F_, "kubernetes grpc circuit-breaker kafka"), (17, 2, "gateway.yml", None, F_, F_, F_, F_, "ingress"), (18, 2, "docker-compose.yml", None, F_, F_, F_, F_, "services:"), (19, 2, "consul.hcl", None, F_, F_, F_, F_, "consul"),
        (20, 3, "models/user.py", "python", F_, F_, F_, F_, "class User"), (21, 3, "views/list.html", None, F_, F_, F_, F_, "x"), (22, 3, "controllers/c.py", "python", F_, F_, F_, F_, "interface inject"), (23, 3, "main.py", "python", F_, F_, F_, F_, "see app.py and main.py"), (24, 3, "vercel.json", None, F_, F_, F_, F_, "{}"),
    ),
    "id long, project_id long, path string, language string, is_binary boolean, is_generated boolean, is_documentation boolean, is_test boolean, content string",
)
DIRECTORIES = Literal(((1, "app"), (1, "web"), (2, "services"), (2, "services/order-service"), (2, "k8s"), (3, "models"), (3, "views"), (3, "controllers/"), (3, "src/view")), "project_id long, path string")
TECH = """SELECT category, name, count(*) AS n_files FROM found GROUP BY ALL"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(q)}, 'i')" for q in patterns) + ")"


def listed(names: list[str]) -> str:
    return "(" + ", ".join(map(quoted, names)) + ")"


def stack_sql() -> str:
    t, read = "lower(coalesce(content, ''))", "NOT (is_binary OR is_generated OR is_documentation)"
    rows = ["SELECT 'language' AS category, language AS name FROM f WHERE language IS NOT NULL"]
    rows += [f"SELECT 'framework', '{n}' FROM f WHERE {read} AND (lower(language) IN {listed(ls)} OR name IN {listed(ms)}) AND {matches(t, p.FRAMEWORKS[n])}" for n, (ls, ms) in p.FRAMEWORK_FILES.items()]
    rows += [f"SELECT 'database', '{n}' FROM f WHERE {read} AND name NOT IN {listed(p.LOCK_FILES)} AND (language IS NOT NULL OR name IN {listed(p.DATABASE_FILES)}) AND {matches(t, ps)}" for n, ps in p.DATABASES.items()]
    rows += [f"SELECT 'build_tool', '{n}' FROM f WHERE {matches('lower(path)', ps)}" for n, ps in p.BUILD_TOOLS.items()]
    rows += [f"SELECT 'test_tool', '{n}' FROM f WHERE is_test AND ({matches(t, ps)} OR {matches('lower(path)', ps)})" for n, ps in p.TEST_TOOLS.items()]
    rows += [f"SELECT 'package_manager', '{n}' FROM f WHERE {' OR '.join(f'ends_with(path, {quoted(e)})' for e in ends)}" for n, ends in p.PACKAGE_MANAGERS.items()]
    return " UNION ALL ".join(rows)


NAMED = "f AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM tree)"


@query(f"WITH {TREE.cte('tree')}, {NAMED}, found AS ({stack_sql()}) {TECH}")
def detected_stack(spark, sf_dir):
    return p.detect_stack(TREE.df(spark))


@query(f"""WITH tree AS (SELECT page_id AS id, concat('src/p', page_id, '.js') AS path, 'javascript' AS language, false AS is_binary, page_id % 7 = 0 AS is_generated, false AS is_documentation, page_id % 3 = 0 AS is_test, html AS content FROM pages UNION ALL
 SELECT id, path, language, is_binary, is_generated, is_documentation, is_test, content FROM ({TREE.select()})), {NAMED}, found AS ({stack_sql()}) {TECH}""")
def framework_detection(spark, sf_dir):
    """Over all pages as files, and the small tree."""
    k, no = F.col("page_id"), F.lit(False)
    pages = v.table(spark, sf_dir, "pages").select(k.alias("id"), F.concat(F.lit("src/p"), k.cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), no.alias("is_binary"), (k % 7 == 0).alias("is_generated"), no.alias("is_documentation"), (k % 3 == 0).alias("is_test"), F.col("html").alias("content"))
    return p.detect_stack(pages.unionByName(TREE.df(spark).drop("project_id")))


@query(Literal((("1", "microservices", 1), ("1", "monolith", 0), ("2", "microservices", 6), ("2", "event-driven", 1), ("3", "mvc", 6), ("3", "serverless", 3), ("3", "monolith", 1)), "project string, architecture string, points long").select() + " WHERE points > 0 AND project <> '1'")
def architecture_points(spark, sf_dir):
    """Projects 2 and 3 of the small tree; the results were worked out by hand."""
    tree, dirs = TREE.df(spark), DIRECTORIES.df(spark)
    of = lambda k: p.architecture_points(tree.where(f"project_id = {k}"), dirs.where(f"project_id = {k}")).withColumn("project", F.lit(str(k)))
    return of(2).unionByName(of(3))


def indicator_sql() -> str:
    like = lambda c, gs: " OR ".join(f"lower({c}) GLOB {quoted(g.lower())}" for g in gs) or "false"
    marks = [(a, i, n, w, f"bool_or(({like('path', fs)}) OR {matches(chr(99) + 'ontent', code) if code else 'false'})", f"bool_or({like('path', ds)})") for a, rows in p.INDICATORS.items() for i, (n, w, fs, ds, code) in enumerate(rows)]
    f = " UNION ALL ".join(f"SELECT project_id, '{a}' AS pattern, {i} AS ord, '{n}' AS name, {w} AS w, coalesce({x}, false) AS hit FROM tree GROUP BY project_id UNION ALL SELECT project_id, '{a}', {i}, '{n}', {w}, coalesce({y}, false) FROM dirs GROUP BY project_id" for a, i, n, w, x, y in marks)
    return f"""marks AS (SELECT project_id, pattern, ord, name, w, bool_or(hit) AS hit FROM ({f}) GROUP BY ALL), s AS (SELECT project_id, pattern, round(sum(CASE WHEN hit THEN w ELSE 0 END)::DOUBLE / sum(w)::DOUBLE, 6) AS score,
 coalesce(list(name ORDER BY ord) FILTER (hit), []) AS found FROM marks GROUP BY ALL) SELECT *, CASE WHEN score >= 0.9 THEN 'very_high' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'very_low' END AS level FROM s WHERE score >= 0.2"""


@query(f"WITH {TREE.cte('tree')}, {DIRECTORIES.cte('dirs')}, {indicator_sql()}")
def architecture_patterns(spark, sf_dir):
    return p.architecture_patterns(TREE.df(spark), DIRECTORIES.df(spark), 0.2)


CATALOGUE = [("Python", "language", 0.9, ["*.py"], [r"import\s+\w+", r"def\s+\w+"]), ("Docker", "build_tool", 0.8, ["dockerfile", "docker-compose"], [r"from\s+\w+"]), ("Redis", "database", 0.5, [], [r"redis", r"redis://", r"import\s+redis"]), ("Rare", "other", 0.1, ["consul"], [])]


def profile_sql() -> str:
    rows = []
    for name, category, base, names, patterns in CATALOGUE:
        test = " OR ".join(f"ends_with(name, {quoted(n[1:])})" if n.startswith("*") else f"contains(name, {quoted(n)})" for n in names)
        if names:
            rows.append(f"SELECT '{name}' AS name, '{category}' AS category, {base}::DOUBLE AS confidence, path FROM f WHERE {test}")
        if patterns:
            n = " + ".join(f"regexp_matches(coalesce(content, ''), {quoted(q)}, 'i')::INT" for q in patterns)
            rows.append(f"SELECT '{name}' AS name, '{category}' AS category, round(least(0.95, {base} + 0.05 * ({n}))::DOUBLE, 6), path FROM f WHERE {n} > 0")
    return " UNION ALL ".join(rows)


PROFILE = f"WITH {TREE.cte('tree')}, {NAMED}, r AS ({profile_sql()}), g AS (SELECT name, category, max(confidence) AS confidence, count(*) AS usage, list_sort(list(DISTINCT path)) AS files FROM r GROUP BY ALL)"


@query(f"{PROFILE} SELECT * FROM g WHERE confidence >= 0.3")
def technology_profile(spark, sf_dir):
    return p.technology_profile(TREE.df(spark), CATALOGUE)


@query(f"{PROFILE} SELECT round(least(1.0, avg(confidence) + CASE WHEN bool_or(category = 'language') AND bool_or(category = 'build_tool') THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence FROM g WHERE confidence >= 0.3")
def overall_confidence(spark, sf_dir):
    return p.overall_confidence(p.technology_profile(TREE.df(spark), CATALOGUE))


VERSIONED = Literal(((3, "Django==4.2.1"), (1, "none"), (2, "x\ndjango >= 3.1, django==5.0.0"), (4, "fastapi==0.1.2")), "id long, content string")


@query(Literal((("django", "5.0.0"), ("fastapi", "0.1.2"), ("vue", None)), "name string, version string").select())
def versions(spark, sf_dir):
    """In each file the first pattern that matches, in file order; the results were worked out by hand."""
    f = VERSIONED.df(spark)
    out = None
    for name in ("django", "fastapi", "vue"):
        row = p.first_version(f, name).select(F.lit(name).alias("name"), "version")
        out = row if out is None else out.unionByName(row)
    return out


STACK = Literal(
    (
        (1, "Python", "language", 9, F_, F_, F_), (1, "Rust", "language", 4, F_, F_, F_), (1, "FastAPI", "framework", 5, F_, T_, F_), (1, "React", "framework", 7, T_, F_, F_), (1, "PostgreSQL", "database", 3, F_, F_, F_), (1, "Redis", "database", 2, F_, F_, F_),
        (1, "MongoDB", "database", 2, F_, F_, F_), (1, "Docker", "container", 1, F_, F_, F_), (1, "Kubernetes", "orchestration", 1, F_, F_, F_), (1, "Vite", "build_tool", 1, F_, F_, F_), (1, "pytest", "testing", 1, F_, F_, F_), (1, "Prometheus", "monitoring", 1, F_, F_, F_),
        (2, "PHP", "language", 4, F_, F_, F_), (2, "Laravel", "framework", 3, F_, T_, T_), (2, "MySQL", "database", 1, F_, F_, F_), (2, "Podman", "container", 1, F_, F_, F_), (3, "Go", "language", 1, F_, F_, F_), (3, "Vercel", "deployment", 1, F_, F_, F_), (4, "Snyk", "security", 1, None, None, None),
    ),
    "project_id long, name string, category string, usage long, is_frontend boolean, is_backend boolean, is_full_stack boolean",
)


@query(Literal(
    (
        (1, 8, 100, "full_stack", "microservices", "container_orchestration", "Python", "React", "PostgreSQL", False), (2, 2, 45, "backend_only", "monolithic", "containerized", "PHP", "Laravel", "MySQL", False),
        (3, 1, 60, "library_or_tool", "serverless", "paas", "Go", None, None, True), (4, 1, 50, "unknown", "serverless", "traditional", None, None, None, True),
    ),
    "project_id long, complexity long, modernisation long, stack_type string, architecture string, deployment string, primary_language string, primary_framework string, primary_database string, is_serverless boolean",
).select())
def stack_profile(spark, sf_dir):
    """The results were worked out by hand."""
    return p.stack_profile(STACK.df(spark)).drop("n_container", "n_monitoring", "n_security", "n_testing")


@query(Literal(((1, "security", "high"), (1, "complexity", "medium"), (2, "security", "high"), (2, "monitoring", "medium"), (2, "testing", "high"), (2, "modernization", "medium"), (3, "security", "high"), (3, "monitoring", "medium"), (3, "testing", "high"), (4, "monitoring", "medium"), (4, "testing", "high")), "project_id long, kind string, priority string").select())
def stack_recommendations(spark, sf_dir):
    """The results were worked out by hand."""
    return p.stack_recommendations(p.stack_profile(STACK.df(spark)))


@query(Literal(
    (
        (1, 0, "project_summary", 9, "Project Shop (1) at /s. Architecture=layered. Languages=go, python. Frameworks=none. Databases=redis. BuildTools=none. Files=10. Lines=200. Components=5. Documentation=2."),
        (1, 1, "project_architecture", 8, "Architecture profile for Shop: type=layered; languages=go, python; frameworks=none; component_distribution=function:3, class:2; metadata_keys=a, b."),
        (1, 2, "database_structure", 7, "Database profile for Shop: detected_databases=redis; build_tools=none; architecture=layered. If detected_databases=none then no explicit database layer was found during static analysis."),
        (1, 3, "service_architecture", 7, "Service/component profile for Shop: component_distribution=function:3, class:2; total_component_types=3; total_components=5; languages=go, python; frameworks=none."),
        (2, 0, "project_summary", 9, "Project unknown (2) at unknown. Architecture=unknown. Languages=none. Frameworks=none. Databases=none. BuildTools=none. Files=0. Lines=0. Components=0. Documentation=0."),
        (2, 1, "project_architecture", 8, "Architecture profile for unknown: type=unknown; languages=none; frameworks=none; component_distribution=none; metadata_keys=none."),
        (2, 2, "database_structure", 7, "Database profile for unknown: detected_databases=none; build_tools=none; architecture=unknown. If detected_databases=none then no explicit database layer was found during static analysis."),
        (2, 3, "service_architecture", 7, "Service/component profile for unknown: component_distribution=none; total_component_types=0; total_components=0; languages=none; frameworks=none."),
    ),
    "id long, ord int, memory_type string, importance int, content string",
).select())
def project_memories(spark, sf_dir):
    return p.project_memories(spark.createDataFrame(SUMMARIES, SUMMARY))


SUMMARY = "id long, name string, path string, architecture_type string, languages array<string>, frameworks array<string>, databases array<string>, build_tools array<string>, total_files long, total_lines long, documentation_count long, components map<string,long>, metadata map<string,string>"
SUMMARIES = [(1, "Shop", "/s", "layered", ["go", " python", " "], [], ["redis"], None, 10, 200, 2, {"class": 2, "function": 3, "file": 0}, {"b": "1", "a": None}), (2, *[None] * 12)]
