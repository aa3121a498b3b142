"""Queries over quality, health and metric history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import graph as g
from quernstone.operators import quality as q
from quernstone.plans.registry import query
from quernstone.sources import views as v

CLAMP = lambda e: f"least(greatest({e}, 0.0), 100.0)"
INSTABILITY = f"""{v.COMPONENT}, {v.EDGE}, deps AS (SELECT src AS id, count(*) AS n_deps FROM edge GROUP BY src), uses AS (SELECT dst AS id, count(*) AS n_in FROM edge GROUP BY dst),
 unstable AS (SELECT c.*, coalesce(n_deps, 0) AS n_deps, round(CASE WHEN coalesce(n_deps, 0) + coalesce(n_in, 0) = 0 THEN 0 ELSE coalesce(n_deps, 0) / (coalesce(n_deps, 0) + coalesce(n_in, 0))::DOUBLE END, 6) AS instability FROM component c LEFT JOIN deps USING (id) LEFT JOIN uses USING (id))"""
SCORED = f"""{INSTABILITY}, scored AS (SELECT c.*,
 round({CLAMP(f"0.4 * {CLAMP('(100 - 2 * complexity) * 0.3 + maintainability * 0.4 + (100 - 100 * debt) * 0.3')} + 0.25 * {CLAMP('100 * doc_score')} + 0.2 * {CLAMP('100 * coverage_frac')} + 0.15 * {CLAMP('100 * security_score')}")}, 6) AS quality,
 round({CLAMP("((1 - instability) * 100 + CASE WHEN complexity <= 5 THEN 100 WHEN complexity <= 10 THEN 80 WHEN complexity <= 20 THEN 60 ELSE 40 END + 100 * doc_score + 100 * coverage_frac + 100 * security_score) / 5")}, 6) AS health
 FROM unstable c)"""


def scored(spark, sf_dir):
    c, i = v.component(spark, sf_dir), instability(spark, sf_dir)
    return q.scored(c.join(i.select("id", F.col("ce").alias("n_deps")), "id"), i)


def instability(spark, sf_dir):
    return g.instability(v.component(spark, sf_dir), v.edge(spark, sf_dir))


@query(f"WITH {SCORED} SELECT id, quality FROM scored")
def quality_score(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", q.quality_score().alias("quality"))


@query(f"WITH {SCORED} SELECT id, health FROM scored")
def health_score(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "health")


def dist_sql(value: str, buckets: tuple) -> str:
    bounds, rest, at_least = buckets
    case = " ".join(f"WHEN {value} {'>=' if at_least else '<='} {b} THEN '{n}'" for b, n in bounds)
    names = ", ".join(f"('{n}')" for n in [n for _, n in bounds] + [rest])
    return f"WITH {SCORED}, b AS (SELECT CASE {case} ELSE '{rest}' END AS bucket, count(*) AS n FROM scored GROUP BY 1) SELECT l.bucket, coalesce(n, 0) AS n FROM (VALUES {names}) l(bucket) LEFT JOIN b USING (bucket)"


def add_distribution(name: str, value: str, buckets: tuple) -> None:
    def run(spark, sf_dir):
        return q.distribution(scored(spark, sf_dir), value, buckets)

    run.__name__ = name
    query(dist_sql(value, buckets))(run)


for _name, _value, _buckets in (
    ("quality_dist", "quality", q.QUALITY_BUCKETS), ("complexity_dist", "complexity", q.COMPLEXITY_BUCKETS), ("score_dist", "quality", q.SCORE_BUCKETS),
    ("health_dist", "health", q.HEALTH_BUCKETS), ("line_histogram", "line_count", q.LINE_BUCKETS), ("complexity_histogram", "complexity", q.COMPLEXITY_HISTOGRAM),
):
    add_distribution(_name, _value, _buckets)


@query(f"""WITH {SCORED} SELECT project_id, count(*) AS n, round(avg(quality), 6) AS avg_quality, round(avg(complexity), 6) AS avg_complexity, round(avg(coverage_pct), 6) AS avg_coverage, count_if(quality > 80)::BIGINT AS high_quality,
 count_if(quality < 50)::BIGINT AS low_quality, count_if(complexity > 15)::BIGINT AS complex, count_if(complexity <= 5)::BIGINT AS simple, count_if(coverage_pct > 80)::BIGINT AS well_tested, count_if(coverage_pct < 20)::BIGINT AS untested,
 count_if(n_deps > 10)::BIGINT AS many_deps, count_if(n_deps = 0)::BIGINT AS no_deps FROM scored GROUP BY project_id""")
def project_metrics(spark, sf_dir):
    return q.project_metrics(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, g AS (SELECT project_id, count_if(health >= 80)::BIGINT AS excellent, count_if(health >= 60 AND health < 80)::BIGINT AS good, count_if(health >= 40 AND health < 60)::BIGINT AS fair, count_if(health < 40)::BIGINT AS poor, avg(health) AS h, avg(complexity) AS c, avg(coverage_pct) AS t, count_if(quality < 50) / count(*)::DOUBLE AS low FROM scored GROUP BY project_id)
 SELECT project_id, round(h, 6) AS avg_health, excellent, good, fair, poor, list_filter([CASE WHEN c > 10 THEN 'high_complexity' END, CASE WHEN t < 50 THEN 'low_coverage' END, CASE WHEN low > 0.2 THEN 'low_quality' END], lambda x: x IS NOT NULL) AS risks FROM g""")
def project_health(spark, sf_dir):
    return q.health_summary(scored(spark, sf_dir))


@query(f"""WITH {SCORED} SELECT project_id, 'type' AS measure, type AS key, count(*)::DOUBLE AS value FROM scored GROUP BY ALL UNION ALL SELECT project_id, 'language', language, count(*) FROM scored GROUP BY ALL UNION ALL SELECT project_id, 'total', '', count(*) FROM scored GROUP BY ALL
 UNION ALL SELECT project_id, 'health', CASE WHEN health >= 80 THEN 'excellent' WHEN health >= 60 THEN 'good' WHEN health >= 40 THEN 'fair' ELSE 'poor' END, count(*) FROM scored GROUP BY ALL
 UNION ALL SELECT project_id, 'average_quality', '', round(avg(quality), 6) FROM scored GROUP BY ALL UNION ALL SELECT project_id, 'average_complexity', '', round(avg(complexity), 6) FROM scored GROUP BY ALL
 UNION ALL SELECT project_id, 'average_coverage_pct', '', round(avg(coverage_pct), 6) FROM scored GROUP BY ALL""")
def project_summary(spark, sf_dir):
    return q.project_summary(scored(spark, sf_dir))


TYPE = "CASE id % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'file' END"


def typed(c):
    k = F.col("id") % 3
    return c.withColumn("type", F.when(k == 0, "class").when(k == 1, "function").otherwise("file"))


@query(f"""WITH {SCORED} SELECT id, 'quality_issue' AS rule, 'high' AS severity, 0.9::DOUBLE AS confidence FROM scored WHERE quality < 50 UNION ALL SELECT id, 'complexity_issue', 'medium', 0.95 FROM scored WHERE complexity > 15
 UNION ALL SELECT id, 'testing_issue', 'medium', 0.8 FROM scored WHERE coverage_pct < 50 AND {TYPE} <> 'file' UNION ALL SELECT id, 'dependency_issue', 'medium', 0.7 FROM scored WHERE n_deps > 10
 UNION ALL SELECT id, 'security_issue', 'high', 0.85 FROM scored WHERE security_score < 0.5""")
def component_insights(spark, sf_dir):
    return q.insights(typed(scored(spark, sf_dir)))


@query(f"""WITH {SCORED} SELECT id, 'quality' AS action, 'high' AS priority FROM scored WHERE quality < 60 UNION ALL SELECT id, 'documentation', 'medium' FROM scored WHERE doc_score < 0.4
 UNION ALL SELECT id, 'testing', 'high' FROM scored WHERE coverage_pct < 70 UNION ALL SELECT id, 'performance', 'medium' FROM scored WHERE complexity > 40 OR line_count > 1500""")
def component_recommendations(spark, sf_dir):
    level = F.when(F.col("doc_score") < 0.2, "none").when(F.col("doc_score") < 0.4, "basic").otherwise("good")
    return q.recommendations(scored(spark, sf_dir).withColumns({"doc_level": level, "cpu_heavy": F.col("complexity") > 40, "memory_heavy": F.when(F.col("line_count") > 1500, True)}))


@query(f"""WITH {SCORED}, g AS (SELECT project_id, avg(quality) AS q, avg(coverage_pct) AS t, count_if(complexity > 15) / count(*)::DOUBLE AS c FROM scored GROUP BY project_id)
 SELECT project_id, unnest(list_filter([CASE WHEN q < 60 THEN 'quality_concern' END, CASE WHEN q < 70 THEN 'improve_quality' END, CASE WHEN t < 50 THEN 'coverage_concern' END, CASE WHEN t < 60 THEN 'improve_coverage' END,
 CASE WHEN c > 0.2 THEN 'complexity_concern' END], lambda x: x IS NOT NULL)) AS insight FROM g""")
def project_insights(spark, sf_dir):
    return q.project_insights(scored(spark, sf_dir))


@query(f"""WITH {INSTABILITY} SELECT id, CASE WHEN complexity <= 5 THEN 'simple' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'complex' ELSE 'very_complex' END AS complexity_class,
 CASE WHEN instability <= 0.2 THEN 'very_stable' WHEN instability <= 0.5 THEN 'stable' WHEN instability <= 0.8 THEN 'unstable' ELSE 'very_unstable' END AS stability_class,
 CASE WHEN 100 * security_score >= 90 THEN 'excellent' WHEN 100 * security_score >= 70 THEN 'good' WHEN 100 * security_score >= 50 THEN 'fair' ELSE 'poor' END AS security_class,
 round((CAST(id % 2 = 0 AS INT) + CAST(id % 3 = 0 AS INT) + CAST(id % 5 = 0 OR id % 4 = 0 AS INT) + CAST(id % 7 = 0 AS INT) + CAST(id % 11 = 0 AS INT)) / 5.0::DOUBLE, 6) AS doc_completeness FROM unstable""")
def class_labels(spark, sf_dir):
    k = F.col("id")
    c = v.component(spark, sf_dir).join(instability(spark, sf_dir).select("id", "instability"), "id")
    flags = {"has_docstring": 2, "has_examples": 3, "has_parameters": 5, "has_returns": 7, "has_exceptions": 11}
    return c.withColumns({n: k % m == 0 for n, m in flags.items()}).withColumn("n_parameters", k % 4).select("id", *q.class_labels())


@query("SELECT p_type AS type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM part), 1)::DOUBLE AS pct FROM part GROUP BY p_type")
def type_shares(spark, sf_dir):
    return q.shares(v.component(spark, sf_dir), "type")


@query("""WITH s AS (SELECT p_partkey AS id, p_partkey % 11 / 10.0::DOUBLE AS t, 1.0 + p_size / 4.0 AS c, p_partkey % 8 AS n FROM part),
 l AS (SELECT id, CASE WHEN t < 0.8 THEN (0.8 - t) * 50 ELSE 0 END + CASE WHEN c > 7 THEN (c - 7) * 10 ELSE 0 END + CASE WHEN c > 10 THEN (c - 10) * 20 ELSE 0 END + CASE WHEN n = 1 THEN 5 ELSE 0 END + CASE WHEN n > 5 THEN 10 ELSE 0 END AS lost FROM s)
 SELECT id, greatest(0, least(100, floor(round(100 - lost, 9) + 0.5)))::BIGINT AS score FROM l""")
def browser_health(spark, sf_dir):
    c, k = v.component(spark, sf_dir), F.col("id")
    return c.select("id", (k % 11 / 10).alias("test_ratio"), (1 + F.col("complexity") / 4).alias("complexity_score"), (k % 8).alias("n_languages")).select("id", q.browser_health().alias("score"))


@query(f"""WITH {v.METRIC}, w AS (SELECT *, lag(value) OVER (PARTITION BY component_id, metric ORDER BY ts, id) AS prev, row_number() OVER (PARTITION BY component_id, metric ORDER BY ts DESC, id DESC) AS r FROM metric),
 c AS (SELECT *, round(CASE WHEN prev = 0 THEN 0 ELSE (value - prev) / abs(prev) * 100 END, 6) AS change FROM w WHERE r = 1 AND prev IS NOT NULL)
 SELECT component_id, metric, value, prev, change, CASE WHEN change > 5 THEN 'improving' WHEN change < -5 THEN 'declining' ELSE 'stable' END AS direction FROM c""")
def metric_trend(spark, sf_dir):
    return q.trend(v.metric(spark, sf_dir))


@query(f"WITH {v.COMPONENT} SELECT id, round(rank() OVER (PARTITION BY project_id ORDER BY complexity) * 100.0 / count(*) OVER (PARTITION BY project_id), 6)::DOUBLE AS percentile FROM component")
def percentile_rank(spark, sf_dir):
    return q.percentile_rank(v.component(spark, sf_dir), "complexity", "project_id").select("id", "percentile")


@query(f"WITH {v.METRIC}, w AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY ts DESC, id DESC) AS rn FROM metric) SELECT id, component_id, rn FROM w WHERE rn <= 10")
def last_n(spark, sf_dir):
    return q.last_n(v.metric(spark, sf_dir), ["component_id"], [F.desc("ts"), F.desc("id")], 10).select("id", "component_id", F.col("rn").cast("long").alias("rn"))
