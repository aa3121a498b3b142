"""Run logs, sessions, routing, retention and caches with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Routing rules, in order; the first match wins.
ROUTES = (
    (r"(?i)(remember|store|save|memorize|note|record)", "memory_workflow"), (r"(?i)(recall|retrieve|search|find|look\s*up|what\s+do\s+you\s+know)", "memory_workflow"),
    (r"(?i)(use\s+tool|execute|run\s+command|call\s+function|api)", "tool_workflow"), (r"(?i)(analyze|compare|evaluate|assess|review|comprehensive)", "full_pipeline"),
    (r"(?i)(parallel|multiple\s+perspectives|diverse|all\s+agents)", "parallel_analysis"),
)


def route(text: Column, default: str = "simple_qa", rules=ROUTES) -> Column:
    out = F
    for pattern, workflow in rules:
        out = out.when(F.rlike(text, F.lit(pattern)), workflow)
    return out.otherwise(default)


def first_messages(messages: DataFrame, n: int = 50) -> DataFrame:
    """The first n messages of each session. The limit is the feature; it is applied before the shuffle, too."""
    return messages.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "role"))).where(F.col("rn") <= n)


def run_steps(steps: DataFrame) -> DataFrame:
    """(run_id, n_steps, steps): all steps of each run, in order; the array is the output row."""
    return steps.groupBy("run_id").agg(F.count("*").alias("n_steps"), F.transform(F.sort_array(F.collect_list(F.struct("step_index", "name"))), lambda s: s["name"]).alias("steps"))


def latest_session(sessions: DataFrame) -> DataFrame:
    """(agent, session_id): the newest active session of each agent."""
    return sessions.where("is_active").groupBy("agent").agg(F.max_by("session_id", F.struct("created_at", "session_id")).alias("session_id"))


def project_page(projects: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the projects, the newest change first; the limit is held within 1 and 200."""
    return projects.orderBy(F.desc("updated_at"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 200))


def search_report(searches: DataFrame, last: int = 10) -> DataFrame:
    """(measure, key, value): the total, counts by intent, scope and language, the mean number of results, and the newest searches with their place; one pass makes all counters."""
    pair = lambda m, k: F.struct(F.lit(m).alias("measure"), k.alias("key"))
    counters = F.array(*[pair(c, F.col(c)) for c in ("intent", "scope", "language")], pair("total", F.lit("")))
    counts = searches.select(F.explode(counters).alias("c")).groupBy("c.measure", "c.key").agg(F.count("*").cast("double").alias("value"))
    mean = searches.agg(F.round(F.coalesce(F.avg("n_results"), F.lit(0.0)), 6).alias("value")).select(F.lit("avg_results").alias("measure"), F.lit("").alias("key"), "value")
    newest = searches.orderBy(F.desc("ts"), F.desc("id")).limit(last).agg(F.collect_list("id").alias("ids")).select(F.posexplode("ids").alias("i", "id"))
    return counts.unionByName(mean).unionByName(newest.select(F.lit("recent").alias("measure"), F.col("id").cast("string").alias("key"), (F.col("i") + 1).cast("double").alias("value")))


def latest(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the newest row of each group, by a partial aggregation."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def roles_to_fill(roles: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(role with its newest matching agent, roles for which one has to be made)."""
    newest = agents.where("is_active").groupBy("project_id", "role").agg(F.max_by("id", F.struct("updated_at", "id")).alias("agent_id"))
    return roles.join(newest, ["project_id", "role"]), roles.join(newest, ["project_id", "role"], "left_anti")


def call_statistics(calls: DataFrame) -> DataFrame:
    g = calls.groupBy("tool").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.avg("duration"), 6).alias("avg_duration"), F.max("duration").alias("max_duration"))
    return g


def search_analytics(events: DataFrame, last: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts by kind with the mean value, the newest rows)."""
    return events.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")), events.orderBy(F.desc("ts"), F.desc("id")).limit(last)


def review_rollup(reviews: DataFrame) -> DataFrame:
    """Sum of issues, and the mean score with failed reviews as 0 and without them."""
    return reviews.agg(F.sum("issues").alias("issues"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("avg_score"), F.round(F.avg("score"), 6).alias("avg_valid"))


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    """Rows of a key-value table whose time has not come; the newest value of a key wins."""
    live = cache.where(F.col("expires_at") > now)
    return latest(live, ["key"], ["written_at"], "value")


def due_projects(projects: DataFrame, processed: DataFrame, now: Column, cooldown_s: int = 600, limit: int = 10) -> DataFrame:
    """Projects whose last processing is at least the cooldown (30 s or more) ago, the active one first, then the newest."""
    wait = max(cooldown_s, 30)
    recent = processed.where(F.col("processed_at") + F.expr(f"INTERVAL {wait} SECONDS") > now).select("id")
    return projects.join(recent, "id", "left_anti").orderBy(F.desc("is_active"), F.desc("completed_at"), "id").limit(limit)


def since_buckets(ts: Column, now: Column) -> Column:
    """By whole hours passed; parts of a second count, so an hour less a microsecond is no hour yet."""
    hours = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 3_600_000_000)
    return F.when(hours < 1, "just now").when(hours < 24, "today").when(hours < 168, "this week").otherwise("older")


def parse_git_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """hash|subject|author lines."""
    p = F.split(F.col(line), r"\|", 3)
    return lines.where(F.size(p) == 3).select(p[0].alias("hash"), p[1].alias("subject"), p[2].alias("author"))


def parse_git_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """(state, path) from two-letter codes."""
    code = F.substr(line, F.lit(1), F.lit(2))
    state = F.when(code == "??", "untracked").when(F.contains(code, F.lit("D")), "deleted").when(F.contains(code, F.lit("A")), "added").when(F.contains(code, F.lit("R")), "renamed").otherwise("modified")
    return lines.where(F.length(line) > 3).select(state.alias("state"), F.substr(line, F.lit(4)).alias("path"))


def parse_git_diff(diffs: DataFrame, text: str = "text") -> DataFrame:
    """(id, path, n_added, n_deleted, n_hunks) of each file in unified diffs, cut at the file headers."""
    parts = F.filter(F.split(F.col(text), r"(?m)^(?=diff --git )"), lambda p: F.startswith(p, F.lit("diff --git ")))
    body = lambda p, mark, header: F.size(F.regexp_extract_all(p, F.lit(rf"(?m)^{mark}(?!{header})"), F.lit(0))).cast("long")
    one = lambda p: F.struct(F.regexp_extract(p, r"^diff --git a/\S+ b/(\S+)", 1).alias("path"), body(p, r"\+", r"\+\+ ").alias("n_added"), body(p, "-", "-- ").alias("n_deleted"), body(p, "@@ ", "$").alias("n_hunks"))
    return diffs.select("id", F.explode(F.transform(parts, one)).alias("d")).select("id", "d.*")


def changed_paths(paths: Column) -> Column:
    """Paths without blanks and repeats, in order: stripped, slashes turned, ./ and / at the start taken off."""
    bare = F.transform(paths, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"\\", "/"), r"^(\./)+|^/+", ""))
    return F.array_distinct(F.filter(bare, lambda p: F.coalesce(p != "", F.lit(False))))
