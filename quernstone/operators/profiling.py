"""Technology and architecture profiling of file tables, and texts made from summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import exprs as x

#: Patterns whose match in a lower-cased file shows a framework.
FRAMEWORKS = {
    "react": [r"from\s+['\"]react['\"]", r"require\(['\"]react['\"]\)", r"react-dom", r"react-router"],
    "vue": [r"from\s+['\"]vue['\"]", r"require\(['\"]vue['\"]\)", r"createapp\(", r"@vue/"],
    "angular": [r"from\s+['\"]@angular/", r"@angular/", r"@component\(", r"@ngmodule\("],
    "fastapi": [r"from\s+fastapi", r"import\s+fastapi", r"fastapi\(", r"apirouter\("],
    "django": [r"from\s+django", r"import\s+django", r"django\.", r"manage\.py", r"wsgi\.py", r"asgi\.py"],
    "flask": [r"from\s+flask", r"import\s+flask", r"flask\("],
    "express": [r"require\(['\"]express['\"]\)", r"from\s+['\"]express['\"]", r"express\(\)"],
    "spring": [r"@SpringBootApplication", r"@RestController", r"@Service", r"org\.springframework", r"spring-boot"],
    "rails": [r"rails\.application", r"applicationrecord", r"activerecord::base", r"config/routes\.rb"],
}
#: Patterns whose match in a lower-cased file shows a database.
DATABASES = {
    "postgresql": [r"postgresql://", r"postgres://", r"psycopg", r"asyncpg", r"pg8000", r"\bpostgresql\b"],
    "mysql": [r"mysql://", r"mysql\+pymysql://", r"pymysql", r"mysql-connector", r"mysqldb", r"\bmysql\b"],
    "mongodb": [r"mongodb://", r"mongodb\+srv://", r"pymongo", r"mongoengine", r"mongoose", r"\bmongodb\b"],
    "redis": [r"redis://", r"import\s+redis", r"from\s+redis", r"ioredis", r"\bredis\b"],
    "sqlite": [r"sqlite://", r"sqlite3", r"\bsqlite\b", r"\.db\b", r"\.sqlite\b", r"\.sqlite3\b"],
    "elasticsearch": [r"elasticsearch://", r"elasticsearch", r"elastic-transport", r"from\s+elasticsearch", r"import\s+elasticsearch"],
}


def detect(files: DataFrame, patterns: dict[str, list[str]], least_files: int = 1) -> DataFrame:
    """(name, n_files): files in which a technology shows. The patterns of one technology are one alternation, so a file counts once."""
    t = F.lower("content")
    found = x.labels([(F.rlike(t, F.lit("(?i)" + "|".join(f"(?:{p})" for p in ps))), n) for n, ps in patterns.items()])
    return files.select("id", F.explode_outer(found).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= least_files)


#: Languages and manifest files in which a framework is looked for.
FRAMEWORK_FILES = {
    "react": (["javascript", "typescript"], ["package.json"]), "vue": (["javascript", "typescript"], ["package.json"]), "angular": (["javascript", "typescript"], ["package.json", "angular.json"]),
    "express": (["javascript", "typescript"], ["package.json"]), "fastapi": (["python"], ["requirements.txt", "pyproject.toml", "pipfile"]), "flask": (["python"], ["requirements.txt", "pyproject.toml", "pipfile"]),
    "django": (["python"], ["requirements.txt", "pyproject.toml", "pipfile", "manage.py"]), "spring": (["java", "kotlin"], ["pom.xml", "build.gradle", "build.gradle.kts"]), "rails": (["ruby"], ["gemfile", "gemfile.lock"]),
}
#: Files without a language in which databases are looked for, and files in which they are not.
DATABASE_FILES = [".env", ".env.example", "docker-compose.yml", "docker-compose.yaml", "requirements.txt", "pyproject.toml", "pipfile", "package.json", "pom.xml", "build.gradle", "build.gradle.kts"]
LOCK_FILES = ["poetry.lock", "pipfile.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
#: Patterns of paths that show a build tool.
BUILD_TOOLS = {
    "docker": [r"dockerfile", r"\.dockerfile$", r"docker-compose"], "webpack": [r"webpack\.config", r"webpack\.", r"\.webpackrc"], "vite": [r"vite\.config", r"vite\."], "gradle": [r"build\.gradle", r"gradle\.wrapper"],
    "maven": [r"pom\.xml", r"maven-", r"\.m2/"], "npm": [r"package\.json", r"npm-", r"\.npmrc"], "yarn": [r"yarn\.lock", r"yarn\.", r"\.yarnrc"], "pip": [r"requirements\.txt", r"pipfile", r"pyproject\.toml"],
    "cargo": [r"cargo\.toml", r"cargo\.lock"], "cmake": [r"cmakelists\.txt", r"cmake"], "makefile": [r"makefile", r"\.mk$", r"make\."],
}
#: Patterns of test files, in their text or path, that show a test tool.
TEST_TOOLS = {
    "pytest": [r"pytest", r"test_", r"_test\.py"], "jest": [r"jest", r"\.test\.js", r"\.spec\.js"], "mocha": [r"mocha", r"describe\(", r"it\("], "junit": [r"@Test", r"junit", r"testng"],
    "rspec": [r"rspec", r"describe\s+", r"it\s+"], "go-test": [r"testing\.T", r"func Test", r"\.go$"],
}
#: Ends of paths that show a package manager.
PACKAGE_MANAGERS = {
    "npm": ["package.json", "package-lock.json"], "yarn": ["yarn.lock", "package.json"], "pip": ["requirements.txt", "Pipfile", "pyproject.toml"], "conda": ["environment.yml", "conda.yml"], "cargo": ["Cargo.toml", "Cargo.lock"],
    "maven": ["pom.xml"], "gradle": ["build.gradle"], "composer": ["composer.json"], "nuget": ["packages.config", "*.csproj"], "go-mod": ["go.mod", "go.sum"],
}


def any_pattern(ps: list[str]) -> Column:
    return F.lit("(?i)" + "|".join(f"(?:{p})" for p in ps))


def detect_stack(files: DataFrame) -> DataFrame:
    """(category, name, n_files) of languages, frameworks, databases, build tools, test tools and package managers. files has path, language, content and the flags of a file.

    Frameworks are looked for in files of their languages and in their manifests, databases in source and some settings, never in lock files; neither in binary, generated or documentation files. One pass, one aggregation."""
    path, name, text = F.lower("path"), F.lower(F.regexp_extract("path", r"([^/]*)$", 1)), F.lower(F.coalesce("content", F.lit("")))
    read = ~(F.col("is_binary") | F.col("is_generated") | F.col("is_documentation"))
    tests = []
    for framework, (languages, manifests) in FRAMEWORK_FILES.items():
        tests.append(("framework", framework, read & (F.lower(F.coalesce("language", F.lit(""))).isin(languages) | name.isin(manifests)) & F.rlike(text, any_pattern(FRAMEWORKS[framework]))))
    databases = read & ~name.isin(LOCK_FILES) & ((F.coalesce("language", F.lit("")) != "") | name.isin(DATABASE_FILES))
    tests += [("database", d, databases & F.rlike(text, any_pattern(ps))) for d, ps in DATABASES.items()]
    tests += [("build_tool", t, F.rlike(path, any_pattern(ps))) for t, ps in BUILD_TOOLS.items()]
    tests += [("test_tool", t, F.col("is_test") & (F.rlike(text, any_pattern(ps)) | F.rlike(path, any_pattern(ps)))) for t, ps in TEST_TOOLS.items()]
    tests += [("package_manager", m, x.either([F.endswith("path", F.lit(e)) for e in ends])) for m, ends in PACKAGE_MANAGERS.items()]
    pair = lambda c, n: F.struct(F.lit(c).alias("category"), n.alias("name"))
    hits = F.array(F.when(F.coalesce("language", F.lit("")) != "", pair("language", F.col("language"))), *[F.when(test, pair(c, F.lit(n))) for c, n, test in tests])
    found = files.select(F.explode_outer(F.filter(hits, lambda h: h.isNotNull())).alias("h")).where("h IS NOT NULL")
    return found.groupBy("h.category", "h.name").agg(F.count("*").alias("n_files"))


def languages_by_use(files: DataFrame) -> DataFrame:
    """(language, n, place): the most frequent first, of equals the one seen first by id."""
    g = files.where("language IS NOT NULL AND language <> ''").groupBy("language").agg(F.count("*").alias("n"), F.min("id").alias("seen"))
    return g.select("language", "n", F.row_number().over(Window.orderBy(F.desc("n"), "seen")).cast("long").alias("place"))


#: Patterns in the text of files that speak for an architecture.
ARCHITECTURE_TEXT = {
    "microservices": [r"docker-compose", r"kubernetes", r"helm", r"istio", r"service-discovery", r"api-gateway", r"config-server", r"circuit-breaker", r"load-balancer"],
    "serverless": [r"serverless\.yml", r"serverless\.json", r"aws\-lambda", r"azure\-functions", r"google\-cloud\-functions", r"vercel\.json", r"netlify\.toml", r"firebase\.json"],
    "mvc": [r"models?/", r"views?/", r"controllers?/", r"Model\s+class", r"Controller\s+class", r"View\s+class", r"mvc", r"model-view-controller"],
    "monolith": [r"app\.py", r"main\.py", r"server\.js", r"index\.js", r"single-page", r"monolithic", r"all-in-one"],
    "event-driven": [r"kafka", r"rabbitmq", r"event-sourcing", r"cqrs", r"message-broker", r"pub-sub", r"event-bus"],
}
#: Files of serverless platforms, and parts of directory names of model, view and controller.
SERVERLESS_FILES = ["serverless.yml", "serverless.json", "vercel.json", "netlify.toml"]
MVC_PARTS = ["model", "view", "controller", "models", "views", "controllers"]


def architecture_points(files: DataFrame, directories: DataFrame, sampled: int = 50) -> DataFrame:
    """(architecture, points), for those with any: from directory names, platform files, the number of source files, and the text of the first files by id; the sample is the feature."""
    some = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    d = F.lower(F.regexp_extract("path", r"([^/]*)/?$", 1))
    dirs = directories.agg(some(F.contains(d, F.lit("service"))).alias("service"), some(x.contains_any(d, ["docker", "k8s", "kube"])).alias("box"), sum((some(F.contains(d, F.lit(w))) for w in MVC_PARTS), F.lit(0)).alias("mvc"))
    whole = files.agg(some(x.either([F.endswith("path", F.lit(e)) for e in SERVERLESS_FILES])).alias("less"), F.count_if(F.coalesce("language", F.lit("")) != "").alias("sources"))
    first = files.orderBy("id").limit(sampled).where(~(F.col("is_binary") | F.col("is_generated")))
    text = F.lower(F.coalesce("content", F.lit("")))
    read = first.agg(*[F.count_if(F.rlike(text, any_pattern(ps))).alias(f"t{i}") for i, ps in enumerate(ARCHITECTURE_TEXT.values())])
    one = dirs.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(read))
    c, rows = F.col, []
    micro = 3 * c("service") + 2 * c("box")
    base = {"microservices": micro, "serverless": 3 * c("less"), "mvc": F.when(c("mvc") >= 2, c("mvc")).otherwise(0), "monolith": F.when((c("sources") > 100) & (micro < 3), 2).otherwise(0), "event-driven": F.lit(0)}
    for i, a in enumerate(ARCHITECTURE_TEXT):
        rows.append(F.struct(F.lit(a).alias("architecture"), (base[a] + c(f"t{i}")).cast("long").alias("points")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("points > 0")


def technology_confidence(n_matches: Column, base: float = 0.5) -> Column:
    return F.least(F.lit(0.95), base + 0.05 * n_matches)


def matches_file(name: Column, pattern: str) -> Column:
    """A pattern that begins with * is an end of the name, others are a part of it."""
    return F.endswith(name, F.lit(pattern[1:])) if pattern.startswith("*") and "." in pattern else F.contains(name, F.lit(pattern))


def technology_profile(files: DataFrame, catalogue: list[tuple[str, str, float, list[str], list[str]]], least: float = 0.3) -> DataFrame:
    """(name, category, confidence, usage, files) from file names, at the base confidence, and from texts, where each pattern that matches adds 0.05, up to 0.95; below `least` goes. catalogue: (name, category, base, name patterns, text patterns)."""
    name, text = F.lower(F.regexp_extract("path", r"([^/]*)$", 1)), F.coalesce("content", F.lit(""))
    rows = []
    for tech, category, base, names, patterns in catalogue:
        row = lambda confidence: F.struct(F.lit(tech).alias("name"), F.lit(category).alias("category"), confidence.cast("double").alias("confidence"), F.col("path"))  # noqa: B023, E731
        if names:
            rows.append(F.when(x.either([matches_file(name, p) for p in names]), row(F.lit(base))))
        if patterns:
            n = sum((F.rlike(text, F.lit(f"(?i){p}")).cast("int") for p in patterns), F.lit(0))
            rows.append(F.when(n > 0, row(F.round(technology_confidence(n, base), 6))))
    found = files.select(F.explode_outer(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).where("r IS NOT NULL").select("r.*")
    g = found.groupBy("name", "category").agg(F.max("confidence").alias("confidence"), F.count("*").alias("usage"), F.array_sort(F.collect_set("path")).alias("files"))
    return g.where(F.col("confidence") >= least)


def merge_technologies(found: DataFrame) -> DataFrame:
    """One row per technology: highest confidence, summed usage, all files."""
    return found.groupBy("name").agg(F.max("confidence").alias("confidence"), F.sum("usage").alias("usage"), F.array_sort(F.collect_set("path")).alias("files"))


def overall_confidence(rows: DataFrame) -> DataFrame:
    """Mean confidence, 0 without any; 0.1 more, at most 1, with both a language and a build tool."""
    g = rows.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("c"), F.max((F.col("category") == "language").cast("int")).alias("l"), F.max((F.col("category") == "build_tool").cast("int")).alias("b"))
    return g.select(F.round(F.least(F.lit(1.0), F.col("c") + F.when((F.col("l") == 1) & (F.col("b") == 1), 0.1).otherwise(0.0)), 6).alias("confidence"))


#: Patterns whose first group is a version.
VERSIONS = {
    "python": [r"python\s+(\d+\.\d+)", r"python:\s*(\d+\.\d+)"], "node": [r"node\s*['\"]?(\d+\.\d+\.\d+)", r"node:\s*['\"]?(\d+\.\d+\.\d+)"], "npm": [r"npm\s*['\"]?(\d+\.\d+\.\d+)", r"\"npm\":\s*\"(\d+\.\d+\.\d+)"],
    "react": [r"\"react\":\s*\"(\d+\.\d+\.\d+)"], "vue": [r"\"vue\":\s*\"(\d+\.\d+\.\d+)"], "django": [r"django==(\d+\.\d+\.\d+)", r"django\s*>=\s*(\d+\.\d+)"], "fastapi": [r"fastapi==(\d+\.\d+\.\d+)", r"fastapi\s*>=\s*(\d+\.\d+)"],
}


def first_version(files: DataFrame, name: str) -> DataFrame:
    """One row: the version of a technology in the first file by id that shows one, by the first of its patterns that matches there; null without any."""
    hits = [F.nullif(F.regexp_extract("content", f"(?i){p}", 1), F.lit("")) for p in VERSIONS.get(name, [])]
    version = F.coalesce(*hits) if hits else F.lit(None).cast("string")
    return files.agg(F.min_by(version, F.when(version.isNotNull(), F.col("id"))).alias("version"))


def compare_stacks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(common, only_a, only_b, jaccard) of two sets of names, by one full outer join."""
    both = a.select("name").distinct().withColumn("a", F.lit(1)).join(b.select("name").distinct().withColumn("b", F.lit(1)), "name", "full")
    n = F.count_if
    c = both.agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), n(F.col("b").isNull()).alias("only_a"), n(F.col("a").isNull()).alias("only_b"))
    return c.withColumn("jaccard", F.round(x.ratio(F.col("common"), F.col("common") + F.col("only_a") + F.col("only_b")), 6))


def indicator_score(indicators: list[tuple[Column, float]]) -> list[Column]:
    """Matched weight over total weight, and its level."""
    total = sum(w for _, w in indicators)
    score = F.round(sum((F.when(c, w).otherwise(0.0) for c, w in indicators), F.lit(0.0)) / total, 6)
    return [score.alias("score"), x.bucket(score, [(0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")], "very_low").alias("level")]


#: Indicators of architecture patterns: weight, path globs, directory globs, patterns of code.
INDICATORS = {
    "Microservices": [
        ("service_boundaries", 0.3, ["*service*", "*/service/*", "*/services/*"], [r"service-\w+", r"\w+-service", "services/"], []),
        ("independent_deployment", 0.25, ["Dockerfile", "docker-compose.yml", "k8s/", "kubernetes/"], [], [r"docker", r"kubernetes", r"deployment"]),
        ("api_gateway", 0.15, ["gateway*", "api-gateway*", "ingress*"], [], [r"gateway", r"api.*gateway", r"ingress"]), ("service_discovery", 0.15, ["consul*", "eureka*", "etcd*"], [], [r"service.*discovery", r"consul", r"eureka"]),
        ("circuit_breaker", 0.1, ["circuit*", "breaker*", "hystrix*"], [], [r"circuit.*breaker", r"hystrix", r"resilience"]), ("inter_service_communication", 0.05, [], [], [r"rest.*client", r"http.*client", r"grpc", r"message.*queue"]),
    ],
    "Layered": [
        ("layer_separation", 0.3, ["*/controller/*", "*/service/*", "*/repository/*"], ["controller/", "service/", "repository/", "model/", "view/"], []), ("unidirectional_dependencies", 0.3, [], [], [r"layer.*dependency", r"unidirectional", r"top.*down"]),
        ("abstraction_layers", 0.2, ["*interface*", "*abstract*"], [], [r"interface", r"abstract", r"protocol"]), ("dependency_injection", 0.2, [], [], [r"inject", r"di\s*container", r"ioc"]),
    ],
    "MVC": [
        ("model_layer", 0.35, ["*model*", "*entity*"], ["model/", "models/", "entity/"], []), ("view_layer", 0.35, ["*view*", "*template*"], ["view/", "views/", "template/", "templates/"], []), ("controller_layer", 0.3, ["*controller*"], ["controller/", "controllers/"], []),
    ],
}


def architecture_patterns(files: DataFrame, directories: DataFrame, least: float = 0.5) -> DataFrame:
    """(project_id, pattern, score, level, found) of the patterns that reach `least`: the weight of the indicators that any file path, directory or text shows, over the weight of all."""
    glob = lambda c, ps: x.either([F.rlike(c, F.lit(x.glob_to_regex(p))) for p in ps])
    marks = [(p, n, w, files_, dirs, code) for p, rows in INDICATORS.items() for n, w, files_, dirs, code in rows]
    any_of = lambda c: F.max(c.cast("int"))
    f = files.groupBy("project_id").agg(*[any_of(glob(F.col("path"), fs) | (F.rlike(F.coalesce("content", F.lit("")), any_pattern(code)) if code else F.lit(False))).alias(f"f{i}") for i, (_, _, _, fs, _, code) in enumerate(marks)])
    d = directories.groupBy("project_id").agg(*[any_of(glob(F.col("path"), ds)).alias(f"d{i}") for i, (_, _, _, _, ds, _) in enumerate(marks)])
    hit = lambda i: F.greatest(F.coalesce(f"f{i}", F.lit(0)), F.coalesce(f"d{i}", F.lit(0))) == 1
    rows = []
    for pattern in INDICATORS:
        mine = [(i, n, w) for i, (p, n, w, *_) in enumerate(marks) if p == pattern]
        score = F.round(sum((F.when(hit(i), w).otherwise(0.0) for i, _, w in mine), F.lit(0.0)) / sum(w for _, _, w in mine), 6)
        rows.append(F.struct(F.lit(pattern).alias("pattern"), score.alias("score"), x.labels([(hit(i), n) for i, n, _ in mine]).alias("found")))
    level = x.bucket(F.col("score"), [(0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")], "very_low")
    return f.join(d, "project_id", "full").select("project_id", F.explode(F.array(*rows)).alias("r")).select("project_id", "r.*").where(F.col("score") >= least).withColumn("level", level)


#: Technologies that count as modern or as legacy.
MODERN = {
    "language": (["rust", "go", "typescript", "kotlin", "swift", "dart"], 10), "steady": (["python", "javascript", "java"], 5), "framework": (["react", "vue", "angular", "fastapi", "django", "flask", "express"], 10),
    "database": (["postgresql", "mongodb", "redis", "elasticsearch"], 5), "build_tool": (["webpack", "vite", "docker", "kubernetes"], 5), "legacy": (["php", "perl", "cobol", "fortran"], -20),
}
#: Categories of technologies.
CATEGORIES = ("language", "framework", "database", "build_tool", "container", "orchestration", "monitoring", "security", "testing", "communication", "deployment")


def stack_profile(rows: DataFrame) -> DataFrame:
    """One row per project: complexity (1 to 10), modernisation (0 to 100), stack, architecture and deployment type, and the most used language, framework and database. rows: project_id, name, category, usage, is_frontend, is_backend, is_full_stack."""
    n, c = F.lower("name"), F.col
    is_ = lambda k: F.col("category") == k
    some = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int")) == 1
    score = F.lit(0)
    for kind, (names, w) in MODERN.items():
        score = score + F.when(is_("language" if kind in ("steady", "legacy") else kind) & n.isin(names), w).otherwise(0)
    g = rows.groupBy("project_id").agg(
        F.count("*").alias("n"), *[F.count_if(is_(k)).alias(k) for k in CATEGORIES], F.sum(score).alias("modern"), *[F.max(F.when(is_(k), F.struct("usage", "name")))["name"].alias(f"primary_{k}") for k in ("language", "framework", "database")],
        some(is_("framework") & c("is_full_stack")).alias("full"), some(is_("framework") & c("is_frontend")).alias("front"), some(is_("framework") & c("is_backend")).alias("back"),
        some(is_("framework") & F.contains(n, F.lit("microservice"))).alias("micro"), some(c("category").isin("container", "orchestration") & n.isin("kubernetes", "docker", "helm")).alias("box"),
        some(is_("communication") & x.contains_any(n, ["gateway", "api"])).alias("gate"), some(is_("deployment") & n.isin("lambda", "functions", "serverless")).alias("fn"), some(is_("framework") & F.contains(n, F.lit("serverless"))).alias("less"),
        some(is_("deployment") & F.contains(n, F.lit("faas"))).alias("faas"), some(is_("deployment") & F.contains(n, F.lit("serverless"))).alias("dless"), some(is_("deployment") & x.contains_any(n, ["heroku", "vercel"])).alias("paas"),
    )
    step = lambda k, bounds: sum((F.when(F.col(k) > b, w).otherwise(0) for b, w in bounds), F.lit(0))
    complexity = 1 + step("n", [(5, 1), (10, 1), (20, 1)]) + step("language", [(1, 1), (3, 1)]) + step("database", [(1, 1), (2, 1)]) + F.when(c("orchestration") > 0, 2).when(c("container") > 0, 1).otherwise(0) + F.when((c("monitoring") > 2) | (c("security") > 2), 1).otherwise(0)
    modern = 50 + c("modern") + F.when(c("container") > 0, 15).otherwise(0) + F.when(c("orchestration") > 0, 10).otherwise(0)
    signs = c("micro").cast("int") + (c("database") > 2).cast("int") + c("box").cast("int") + c("gate").cast("int")
    serverless = c("fn") | c("less") | (c("container") == 0) | c("faas")
    monolithic = (c("database") <= 1) & (c("language") <= 2) & (c("full") | ~c("micro"))
    stack = F.when(c("front") & c("back") & (c("database") > 0), "full_stack").when(c("back") & (c("database") > 0), "backend_only").when(c("front"), "frontend_only").when(c("language") > 0, "library_or_tool").otherwise("unknown")
    architecture = F.when(signs >= 2, "microservices").when(serverless, "serverless").when(monolithic, "monolithic").when(c("framework") > 0, "framework_based")
    deployment = F.when(c("orchestration") > 0, "container_orchestration").when(c("container") > 0, "containerized").when(c("dless"), "serverless").when(c("paas"), "paas").otherwise("traditional")
    return g.select(
        "project_id", F.least(F.lit(10), complexity).cast("long").alias("complexity"), F.least(F.greatest(modern, F.lit(0)), F.lit(100)).cast("long").alias("modernisation"), stack.alias("stack_type"), architecture.alias("architecture"), deployment.alias("deployment"),
        "primary_language", "primary_framework", "primary_database", serverless.alias("is_serverless"), *[F.col(k).alias(f"n_{k}") for k in ("container", "monitoring", "security", "testing")],
    )


def stack_recommendations(profiles: DataFrame) -> DataFrame:
    """(project_id, kind, priority) of what a stack lacks or has too much of."""
    c = F.col
    rules = [
        (c("n_security") == 0, "security", "high"), (c("n_monitoring") == 0, "monitoring", "medium"), (c("n_testing") == 0, "testing", "high"), (c("modernisation") < 50, "modernization", "medium"),
        ((c("n_container") == 0) & ~c("is_serverless"), "containerization", "low"), (c("complexity") > 7, "complexity", "medium"),
    ]
    hit = F.filter(F.array(*[F.when(t, F.struct(F.lit(k).alias("kind"), F.lit(p).alias("priority"))) for t, k, p in rules]), lambda v: v.isNotNull())
    return profiles.select("project_id", F.explode(hit).alias("r")).select("project_id", "r.kind", "r.priority")


def tree_nodes(files: DataFrame) -> DataFrame:
    """(node, depth): every directory and file on the way to each path, once."""
    parts = F.split("path", "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), i.alias("depth")))
    return files.select(F.explode(nodes).alias("n")).select("n.node", "n.depth").distinct()


def distribution_text(components: DataFrame, most: int = 8) -> DataFrame:
    """type:count, the most frequent first."""
    counts = components.groupBy("project_id", "type").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "type"))).where(F.col("r") <= most)
    return top.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "type", "n"))), lambda s: F.concat_ws(":", s["type"], s["n"].cast("string"))), ",").alias("distribution"))


#: Type, importance and text of the memories of a project, in order; $ marks a value.
MEMORY_TEXTS = (
    ("project_summary", 9, "Project $name ($id) at $path. Architecture=$architecture. Languages=$languages. Frameworks=$frameworks. Databases=$databases. BuildTools=$build_tools. Files=$files. Lines=$lines. Components=$components. Documentation=$documentation."),
    ("project_architecture", 8, "Architecture profile for $name: type=$architecture; languages=$languages; frameworks=$frameworks; component_distribution=$distribution; metadata_keys=$metadata_keys."),
    ("database_structure", 7, "Database profile for $name: detected_databases=$databases; build_tools=$build_tools; architecture=$architecture. If detected_databases=none then no explicit database layer was found during static analysis."),
    ("service_architecture", 7, "Service/component profile for $name: component_distribution=$distribution; total_component_types=$types; total_components=$components; languages=$languages; frameworks=$frameworks."),
)


def project_memories(summary: DataFrame) -> DataFrame:
    """(id, ord, memory_type, importance, content): four memory texts per project, in a fixed order, from a summary row: name, path, architecture_type, languages, frameworks, databases, build_tools (arrays), total_files, total_lines, documentation_count,
    components (map of type to count) and metadata (map). What is missing reads unknown, none or 0; the distribution has the eight most frequent types."""
    import re

    unknown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    listed = lambda a: F.coalesce(F.nullif(F.array_join(F.filter(F.transform(a, lambda v: F.trim(v)), lambda v: v != ""), ", "), F.lit("")), F.lit("none"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    types = F.coalesce("components", F.create_map().cast("map<string,long>"))
    some = F.filter(F.map_entries(types), lambda e: e["value"] > 0)
    top = F.slice(F.array_sort(F.transform(some, lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("key")))), 1, 8)
    values = {
        "name": unknown("name"), "id": unknown("id"), "path": unknown("path"), "architecture": unknown("architecture_type"), **{c: listed(F.col(c)) for c in ("languages", "frameworks", "databases", "build_tools")},
        "files": number("total_files"), "lines": number("total_lines"), "documentation": number("documentation_count"), "types": F.size(types).cast("string"), "components": F.aggregate(some, F.lit(0).cast("long"), lambda n, e: n + e["value"]).cast("string"),
        "distribution": listed(F.transform(top, lambda t: F.concat(t["key"], F.lit(":"), (-t["o"]).cast("string")))), "metadata_keys": listed(F.array_sort(F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))),
    }
    text = lambda form: F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\$(\w+)", form))])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("memory_type"), F.lit(n).alias("importance"), text(form).alias("content")) for i, (k, n, form) in enumerate(MEMORY_TEXTS)])
    return summary.select("id", F.explode(rows).alias("m")).select("id", "m.*")


def file_statistics(files: DataFrame) -> DataFrame:
    n = F.count_if
    by = files.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n"))
    main = by.agg(F.max_by("language", F.struct(F.col("n"), F.lit(0))).alias("main_language"), F.count("*").alias("n_languages"))
    return files.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"), *[n(c).alias(c) for c in ("is_binary", "is_generated", "is_test", "is_config", "is_documentation")]).crossJoin(F.broadcast(main))


def directory_statistics(files: DataFrame) -> DataFrame:
    """(directory, n_files, n_directories, bytes) of direct files and direct subdirectories, for each directory below the root that holds a file or a directory."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory"), F.when(i + 1 < F.size(parts), F.element_at(parts, i + 1)).alias("child"), F.when(i + 1 == F.size(parts), F.col("size_bytes")).alias("bytes")))
    rows = files.where(F.size(parts) > 1).select(F.explode(steps).alias("s")).select("s.*")
    # subdirectories are counted once each, before they meet the files
    dirs = rows.where("child IS NOT NULL").select("directory", "child").distinct().groupBy("directory").agg(F.count("*").alias("n_directories"))
    own = rows.groupBy("directory").agg(F.count("bytes").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return own.join(dirs, "directory", "left").select("directory", "n_files", F.coalesce("n_directories", F.lit(0)).alias("n_directories"), "bytes")


def directory_totals(files: DataFrame, k: int = 10) -> DataFrame:
    """(measure, key, value): totals over all directories, and the k largest by bytes with their number of files; the limit is the feature."""
    d = directory_statistics(files)
    names = ("directories", "files", "subdirectories", "bytes")
    t = d.agg(F.count("*").alias("directories"), F.sum("n_files").alias("files"), F.sum("n_directories").alias("subdirectories"), F.sum("bytes").alias("bytes"))
    total = t.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("long") for n in names]))).alias("measure", "value")).select("measure", F.lit("").alias("key"), "value")
    top = d.orderBy(F.desc("bytes"), "directory").limit(k)
    return total.unionByName(top.select(F.lit("largest").alias("measure"), F.col("directory").alias("key"), F.col("bytes").alias("value"))).unionByName(top.select(F.lit("files_in_largest").alias("measure"), F.col("directory").alias("key"), F.col("n_files").alias("value")))


def project_complexity(files: DataFrame) -> DataFrame:
    """Counts, depth, test ratio, mean bytes and an additive score from 1 to 10, in one aggregation: files over 500 and 1,000, languages over 3 and 5, directory depth over 5 and 8, over 20 settings files; a test ratio over 0.3 lowers it."""
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    source = F.col("language").isNotNull() & ~F.col("is_binary")
    s = files.agg(
        F.count("*").alias("n_files"), F.countDistinct(directory).alias("n_directories"), F.count_if(source).alias("n_source"), F.countDistinct(F.when(source, F.col("language"))).alias("n_languages"), F.max(F.size(F.split("path", "/")) - 1).cast("long").alias("depth"),
        F.count_if("is_config").alias("n_config"), F.count_if("is_test").alias("n_test"), F.round(F.coalesce(F.avg("size_bytes"), F.lit(0.0)), 6).alias("avg_bytes"),
    ).withColumn("test_ratio", F.round(x.ratio(F.col("n_test"), F.col("n_source")), 6))
    step = lambda c, a, b: F.when(F.col(c) > b, 2).when(F.col(c) > a, 1).otherwise(0)
    score = 1 + step("n_files", 500, 1000) + step("n_languages", 3, 5) + step("depth", 5, 8) + F.when(F.col("n_config") > 20, 1).otherwise(0) - F.when(F.col("test_ratio") > 0.3, 1).otherwise(0)
    return s.withColumn("score", F.least(F.greatest(score, F.lit(1)), F.lit(10)).cast("long"))


def lines_per_file(files: DataFrame) -> DataFrame:
    """(n_files, n_lines, avg_lines, avg_bytes)."""
    return files.agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.round(x.ratio(F.sum("n_lines"), F.count("*")), 6).alias("avg_lines"), F.round(x.ratio(F.sum("size_bytes"), F.count("*")), 6).alias("avg_bytes"))
