"""Quality and health scores, distributions, insights and metric trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import exprs as x

#: Bucket bounds, best first.
QUALITY_BUCKETS = ([(90, "excellent"), (70, "good"), (50, "fair")], "poor", True)
COMPLEXITY_BUCKETS = ([(5, "low"), (10, "medium"), (20, "high")], "very_high", False)
HEALTH_BUCKETS = ([(80, "excellent"), (60, "good"), (40, "fair")], "poor", True)
SCORE_BUCKETS = ([(90, "90-100"), (80, "80-89"), (70, "70-79"), (60, "60-69"), (50, "50-59")], "0-49", True)
LINE_BUCKETS = ([(50, "0-50"), (100, "51-100"), (200, "101-200"), (500, "201-500")], "501+", False)
COMPLEXITY_HISTOGRAM = ([(5, "0-5"), (10, "6-10"), (20, "11-20")], "21+", False)


def quality_score() -> Column:
    code = x.clamp((100 - 2 * F.col("complexity")) * 0.3 + F.col("maintainability") * 0.4 + (100 - 100 * F.col("debt")) * 0.3, 0, 100)
    rest = [(0.25, "doc_score"), (0.2, "coverage_frac"), (0.15, "security_score")]
    return F.round(x.clamp(0.4 * code + sum((w * x.clamp(100 * F.col(c), 0, 100) for w, c in rest), F.lit(0.0)), 0, 100), 6)


def health_score(instability: Column) -> Column:
    step = x.bucket(F.col("complexity"), [(5, "100"), (10, "80"), (20, "60")], "40", False).cast("double")
    parts = [(1 - instability) * 100, step, *[100 * F.col(c) for c in ("doc_score", "coverage_frac", "security_score")]]
    return F.round(x.clamp(sum(parts, F.lit(0.0)) / 5, 0, 100), 6)


def scored(components: DataFrame, instability: DataFrame) -> DataFrame:
    """Add instability, quality and health; instability has (id, instability), and components that it lacks have 0."""
    known = components.join(instability.select("id", "instability"), "id", "left").withColumn("instability", F.coalesce("instability", F.lit(0.0)))
    return known.withColumn("quality", quality_score()).withColumn("health", health_score(F.col("instability")))


def project_summary(rows: DataFrame) -> DataFrame:
    """(project_id, measure, key, value): means, counts by type and language, and how many are in each class of health. One pass makes all counters."""
    pair = lambda m, k: F.struct(F.lit(m).alias("measure"), k.alias("key"))
    bounds, rest, at_least = HEALTH_BUCKETS
    counters = F.array(pair("type", F.col("type")), pair("language", F.col("language")), pair("health", x.bucket(F.col("health"), bounds, rest, at_least)), pair("total", F.lit("")))
    counts = rows.select("project_id", F.explode(counters).alias("c")).groupBy("project_id", "c.measure", "c.key").agg(F.count("*").cast("double").alias("value"))
    means = rows.groupBy("project_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("quality", "complexity", "coverage_pct")])
    long = means.select("project_id", F.explode(F.create_map(*[y for c in ("quality", "complexity", "coverage_pct") for y in (F.lit(f"average_{c}"), F.col(c))])).alias("measure", "value"))
    return counts.unionByName(long.select("project_id", "measure", F.lit("").alias("key"), "value"))


def distribution(rows: DataFrame, value: str, buckets: tuple) -> DataFrame:
    """(bucket, n) with a row for each label, also where nothing falls."""
    bounds, rest, at_least = buckets
    labels = rows.sparkSession.createDataFrame([(b,) for _, b in bounds] + [(rest,)], "bucket string")
    counts = rows.groupBy(x.bucket(F.col(value), bounds, rest, at_least).alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(labels).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def project_metrics(rows: DataFrame) -> DataFrame:
    """Averages and counts beyond thresholds, per project, in one aggregation."""
    n = lambda c: F.count_if(c)
    q, c, t, d = (F.col(k) for k in ("quality", "complexity", "coverage_pct", "n_deps"))
    return rows.groupBy("project_id").agg(
        F.count("*").alias("n"), F.round(F.avg(q), 6).alias("avg_quality"), F.round(F.avg(c), 6).alias("avg_complexity"), F.round(F.avg(t), 6).alias("avg_coverage"), n(q > 80).alias("high_quality"), n(q < 50).alias("low_quality"),
        n(c > 15).alias("complex"), n(c <= 5).alias("simple"), n(t > 80).alias("well_tested"), n(t < 20).alias("untested"), n(d > 10).alias("many_deps"), n(d == 0).alias("no_deps"),
    )


def health_summary(rows: DataFrame) -> DataFrame:
    """Mean health, how many are in each class, and risk flags per project."""
    bounds, rest, at_least = HEALTH_BUCKETS
    level = x.bucket(F.col("health"), bounds, rest, at_least)
    out = rows.groupBy("project_id").agg(*[F.count_if(level == b).alias(b) for b in [n for _, n in bounds] + [rest]], F.avg("health").alias("h"), F.avg("complexity").alias("c"), F.avg("coverage_pct").alias("t"), x.ratio(F.count_if(F.col("quality") < 50), F.count("*")).alias("low"))
    flags = x.labels([(F.col("c") > 10, "high_complexity"), (F.col("t") < 50, "low_coverage"), (F.col("low") > 0.2, "low_quality")])
    return out.select("project_id", F.round("h", 6).alias("avg_health"), *[n for _, n in bounds], rest, flags.alias("risks"))


def insights(rows: DataFrame) -> DataFrame:
    """(id, rule, severity, confidence) for every rule that a component breaks: one pass over the rows."""
    rules = [
        (F.col("quality") < 50, "quality_issue", "high", 0.9), (F.col("complexity") > 15, "complexity_issue", "medium", 0.95), ((F.col("coverage_pct") < 50) & F.col("type").isin("class", "function"), "testing_issue", "medium", 0.8),
        (F.col("n_deps") > 10, "dependency_issue", "medium", 0.7), (F.col("security_score") < 0.5, "security_issue", "high", 0.85),
    ]
    hit = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(w).alias("confidence"))) for c, r, s, w in rules]), lambda v: v.isNotNull())
    return rows.select("id", F.explode(hit).alias("i")).select("id", "i.rule", "i.severity", "i.confidence")


def recommendations(rows: DataFrame) -> DataFrame:
    """(id, action, priority)."""
    heavy = F.coalesce(F.col("cpu_heavy"), F.lit(False)) | F.coalesce(F.col("memory_heavy"), F.lit(False))
    rules = [(F.col("quality") < 60, "quality", "high"), (F.col("doc_level").isin("none", "basic"), "documentation", "medium"), (F.col("coverage_pct") < 70, "testing", "high"), (heavy, "performance", "medium")]
    hit = F.filter(F.array(*[F.when(c, F.struct(F.lit(a).alias("action"), F.lit(p).alias("priority"))) for c, a, p in rules]), lambda v: v.isNotNull())
    return rows.select("id", F.explode(hit).alias("r")).select("id", "r.action", "r.priority")


def project_insights(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("project_id").agg(F.avg("quality").alias("q"), F.avg("coverage_pct").alias("t"), x.ratio(F.count_if(F.col("complexity") > 15), F.count("*")).alias("c"))
    marks = [(F.col("q") < 60, "quality_concern"), (F.col("q") < 70, "improve_quality"), (F.col("t") < 50, "coverage_concern"), (F.col("t") < 60, "improve_coverage"), (F.col("c") > 0.2, "complexity_concern")]
    return g.select("project_id", F.explode(x.labels(marks)).alias("insight"))


def class_labels() -> list[Column]:
    """Classes of complexity, stability and security, and the share of five documentation flags: docstring, examples, parameters (met where there are none), returns, exceptions."""
    flags = [F.col("has_docstring"), F.col("has_examples"), F.col("has_parameters") | (F.col("n_parameters") == 0), F.col("has_returns"), F.col("has_exceptions")]
    return [
        x.bucket(F.col("complexity"), [(5, "simple"), (10, "moderate"), (20, "complex")], "very_complex", False).alias("complexity_class"),
        x.bucket(F.col("instability"), [(0.2, "very_stable"), (0.5, "stable"), (0.8, "unstable")], "very_unstable", False).alias("stability_class"),
        x.bucket(100 * F.col("security_score"), [(90, "excellent"), (70, "good"), (50, "fair")], "poor").alias("security_class"),
        F.round(sum((f.cast("int") for f in flags), F.lit(0)) / 5, 6).alias("doc_completeness"),
    ]


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Count and percentage, one decimal. The total joins as one row, so no task gathers the groups' rows."""
    groups = rows.groupBy(by).agg(F.count("*").alias("n"))
    return groups.crossJoin(F.broadcast(rows.agg(F.count("*").alias("t")))).select(by, "n", F.round(F.col("n") * 100.0 / F.col("t"), 1).cast("double").alias("pct"))


def browser_health() -> Column:
    """100 less 50 times what the test ratio lacks to 0.8, 10 for each point of complexity over 7 and 20 more for each over 10, 5 for a single language and 10 for more than five; rounded half up, within 0 and 100."""
    t, c, n = (F.col(k).cast("double") for k in ("test_ratio", "complexity_score", "n_languages"))
    lost = F.greatest(0.8 - t, F.lit(0.0)) * 50 + F.greatest(c - 7, F.lit(0.0)) * 10 + F.greatest(c - 10, F.lit(0.0)) * 20 + F.when(n == 1, 5).when(n > 5, 10).otherwise(0)
    return x.clamp(F.floor(F.round(100 - lost, 9) + 0.5), 0, 100).cast("long")


def trend(metrics: DataFrame) -> DataFrame:
    """Last against previous value of each component and metric: change in per cent and its direction (5 % either way)."""
    w = Window.partitionBy("component_id", "metric").orderBy("ts", "id")
    back = Window.partitionBy("component_id", "metric").orderBy(F.desc("ts"), F.desc("id"))
    last = metrics.withColumn("prev", F.lag("value").over(w)).withColumn("r", F.row_number().over(back)).where("r = 1 AND prev IS NOT NULL")
    change = F.when(F.col("prev") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("value") - F.col("prev"), F.abs("prev")) * 100)
    out = last.withColumn("change", F.round(change, 6))
    return out.select("component_id", "metric", "value", "prev", "change", F.when(F.col("change") > 5, "improving").when(F.col("change") < -5, "declining").otherwise("stable").alias("direction"))


def percentile_rank(rows: DataFrame, value: str, by: str) -> DataFrame:
    """100 (index of the first equal value + 1) / n within each group. Distinct values are counted first, so a window sees them and not the rows."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(by)
    below = F.sum("__n").over(w.orderBy(value)) - F.col("__n")
    ranks = counts.withColumn("percentile", F.round((below + 1) * 100.0 / F.sum("__n").over(w), 6).cast("double")).drop("__n")
    return rows.join(ranks, (rows[by].eqNullSafe(ranks[by])) & (rows[value].eqNullSafe(ranks[value])), "left").drop(ranks[by]).drop(ranks[value])


def last_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """Keep the newest n rows of each group. The limit is the feature; the planner cuts each group before the shuffle too."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)
