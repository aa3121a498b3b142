"""Queries over the component registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import exprs as x
from quernstone.operators import likeness
from quernstone.operators import registry as r
from quernstone.plans.registry import query
from quernstone.sources import views as v

C = v.COMPONENT


@query(f"WITH {C} SELECT type, count(*) AS n FROM component GROUP BY type")
def component_by_type(spark, sf_dir):
    return v.component(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {C} SELECT language, count(*) AS n FROM component GROUP BY language")
def component_by_language(spark, sf_dir):
    return v.component(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n"))


@query(f"WITH {C} SELECT round(coalesce(avg(complexity), 0), 6) AS avg_complexity, max(complexity) AS max_complexity, min(complexity) AS min_complexity, count(*) AS n FROM component")
def component_complexity_stats(spark, sf_dir):
    c = v.component(spark, sf_dir)
    return c.agg(F.round(F.coalesce(F.avg("complexity"), F.lit(0.0)), 6).alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.min("complexity").alias("min_complexity"), F.count("*").alias("n"))


@query(f"WITH {C} SELECT project_id, type, count(*) AS n, round(avg(complexity), 6) AS avg_complexity FROM component GROUP BY project_id, type")
def summary_by_type(spark, sf_dir):
    return v.component(spark, sf_dir).groupBy("project_id", "type").agg(F.count("*").alias("n"), F.round(F.avg("complexity"), 6).alias("avg_complexity"))


@query(f"""WITH {C}, f AS (SELECT 'type' AS facet, type AS value FROM component UNION ALL SELECT 'language', language FROM component UNION ALL SELECT 'tag', t FROM (SELECT unnest(list_distinct(tags)) AS t FROM component) UNION ALL SELECT 'category', t FROM (SELECT unnest(list_distinct(categories)) AS t FROM component))
 SELECT facet, value, count(*) AS n FROM f GROUP BY facet, value""")
def component_facets(spark, sf_dir):
    return r.facets(v.component(spark, sf_dir))


@query("SELECT p_type AS type, p_brand AS language, count(*) AS n, grouping(p_type) AS g_type, grouping(p_brand) AS g_language FROM part GROUP BY CUBE (p_type, p_brand)")
def component_cube(spark, sf_dir):
    """Extension: cross-tabulated facets."""
    return v.component(spark, sf_dir).cube("type", "language").agg(F.count("*").alias("n"), F.grouping("type").cast("long").alias("g_type"), F.grouping("language").cast("long").alias("g_language"))


@query(f"WITH {C} SELECT id, name FROM component WHERE complexity <= 20 ORDER BY lower(name) DESC, id LIMIT 20 OFFSET 40")
def component_page(spark, sf_dir):
    return r.page(r.thresholds(v.component(spark, sf_dir), max_complexity=20), r.orderings()["name_desc"], 40, 20).select("id", "name")


@query(f"WITH {C} SELECT id FROM component WHERE name ILIKE '%red%' OR path ILIKE '%red%'")
def component_ilike(spark, sf_dir):
    return v.component(spark, sf_dir).where(r.ilike_any(["name", "path"], "red")).select("id")


@query(f"""WITH {C}, k AS (SELECT *, CASE id % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'async_function' ELSE 'other' END AS kind FROM component)
 SELECT id, CASE kind WHEN 'file' THEN 0 WHEN 'class' THEN 1 WHEN 'function' THEN 2 WHEN 'async_function' THEN 3 ELSE 9 END AS rank FROM k ORDER BY rank, path LIMIT 1""")
def type_rank_default(spark, sf_dir):
    k = F.when(F.col("id") % 5 == 0, "class").when(F.col("id") % 5 == 1, "function").when(F.col("id") % 5 == 2, "async_function").otherwise("other")
    return r.best_by_type(v.component(spark, sf_dir).withColumn("kind", k), "kind").select("id", "rank")


@query(f"WITH {C} SELECT id, list_has_any(tags, ['red', 'small']) AS any_of, list_has_all(tags, ['red', 'small']) AS all_of FROM component")
def tag_filters(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", r.any_tag("tags", ["red", "small"]).alias("any_of"), r.all_tags("tags", ["red", "small"]).alias("all_of"))


NAME = "SELECT min(p_name) FROM part"
SQL_EXACT = """round(least(1.0, CASE WHEN lower(name) = 'red' THEN 1.0 WHEN starts_with(lower(name), 'red') THEN 0.8 WHEN contains(lower(name), 'red') THEN 0.6 ELSE 0.0 END
 + CASE WHEN contains(lower(path), 'red') THEN 0.4 ELSE 0.0 END + list_sum([CASE WHEN lower(t) = 'red' THEN 0.5 WHEN contains(lower(t), 'red') THEN 0.3 ELSE 0.0 END for t in tags])::DOUBLE), 6)::DOUBLE"""


@query(f"WITH {C}, s AS (SELECT id, {SQL_EXACT} AS relevance FROM component) SELECT * FROM s WHERE relevance > 0")
def exact_relevance(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", r.exact_relevance("red").alias("relevance")).where("relevance > 0")


SIM = lambda a, b: f"(CASE WHEN length({a}) = 0 THEN 0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END)"
FUZZY_Q = "small gear"
SQL_FUZZY = f"""round(least(1.0, CASE WHEN {SIM("lower(name)", f"'{FUZZY_Q}'")} > 0.7 THEN 0.8 * {SIM("lower(name)", f"'{FUZZY_Q}'")} ELSE 0 END + CASE WHEN contains(lower(name), '{FUZZY_Q}') THEN 0.6 ELSE 0 END
 + CASE WHEN {SIM("lower(path)", f"'{FUZZY_Q}'")} > 0.6 THEN 0.4 * {SIM("lower(path)", f"'{FUZZY_Q}'")} ELSE 0 END
 + list_sum([CASE WHEN {SIM("lower(t)", f"'{FUZZY_Q}'")} > 0.7 THEN 0.3 * {SIM("lower(t)", f"'{FUZZY_Q}'")} ELSE 0 END for t in tags])), 6)"""


@query(f"WITH {C}, s AS (SELECT id, {SQL_FUZZY} AS relevance FROM component) SELECT * FROM s WHERE relevance > 0.1")
def fuzzy_relevance(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", r.fuzzy_relevance(FUZZY_Q).alias("relevance")).where("relevance > 0.1")


@query(f"""WITH {C}, s AS (SELECT id, round(CASE WHEN regexp_matches(name, '(?i)r[aei]d?') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(path, '(?i)r[aei]d?') THEN 0.3 ELSE 0 END
 + list_sum([CASE WHEN regexp_matches(t, '(?i)r[aei]d?') THEN 0.2 ELSE 0 END for t in list_concat(tags, categories)])::DOUBLE, 6)::DOUBLE AS relevance FROM component) SELECT * FROM s WHERE relevance > 0""")
def regex_search(spark, sf_dir):
    c = v.component(spark, sf_dir)
    return r.regex_search(c, "r[aei]d?").unionByName(r.regex_search(c, "r[aei")).select("id", "relevance")


@query(f"""WITH {C}, k AS (SELECT *, CASE id % 2 WHEN 0 THEN 'class' ELSE 'function' END AS kind, id % 3 = 0 AS is_async FROM component)
 SELECT id, round((CAST(kind = 'class' AS INT) + CAST(is_async AS INT) + CAST(complexity <= 5 AS INT)) / 3.0, 6)::DOUBLE AS relevance FROM k WHERE kind = 'class' OR is_async OR complexity <= 5""")
def structural_relevance(spark, sf_dir):
    k = v.component(spark, sf_dir).withColumn("type", F.when(F.col("id") % 2 == 0, "class").otherwise("function")).withColumn("is_async", F.col("id") % 3 == 0)
    return k.select("id", r.structural_relevance(r.parse_structural("simple async class")).alias("relevance")).where("relevance > 0")


HAS = lambda mark: f"""list_concat(CASE WHEN contains(lower(name), 'ring') THEN [{mark("Name", "name")}] ELSE [] END, CASE WHEN contains(lower(path), 'ring') THEN [{mark("Path", "path")}] ELSE [] END,
 [{mark("Tag", "t")} FOR t IN tags IF contains(lower(t), 'ring')], [{mark("Category", "t")} FOR t IN categories IF contains(lower(t), 'ring')])"""  # noqa: E731
REASON = lambda mark, value: f"'{mark} contains query'" if value != "t" else f"concat('{mark} ' || chr(39), t, chr(39) || ' matches query')"


@query(f"""WITH {C} SELECT id, {HAS(lambda m, c: f"concat('{m}: ', {c})")} AS highlights, {HAS(REASON)} AS reasons FROM component""")
def search_highlights(spark, sf_dir):
    return v.component(spark, sf_dir).select("id", *r.match_info("ring"))


def orders_sql() -> str:
    sql = {
        "relevance": "relevance DESC, id", "name_asc": "lower(name), id", "name_desc": "lower(name) DESC, id", "quality_desc": "quality DESC, id", "quality_asc": "quality, id", "complexity_asc": "complexity, id",
        "complexity_desc": "complexity DESC, id", "recent": "modified DESC, id",
    }
    return " UNION ALL ".join(f"(SELECT '{k}' AS part, 'id' AS facet, CAST(id AS VARCHAR) AS value, row_number() OVER (ORDER BY {o}) - 5 AS n FROM m ORDER BY {o} LIMIT 7 OFFSET 5)" for k, o in sql.items())


@query(f"""WITH {C}, m AS (SELECT *, {SQL_EXACT} AS relevance, maintainability AS quality, id * 7919 % 1000 AS modified FROM component WHERE complexity <= 40), hit AS (SELECT * FROM m WHERE relevance > 0),
 {orders_sql().join(["o AS (", ")"]).replace("FROM m ORDER", "FROM hit ORDER")}, f AS (SELECT 'type' AS facet, type AS value FROM hit UNION ALL SELECT 'language', language FROM hit UNION ALL SELECT 'tag', t FROM (SELECT unnest(list_distinct(tags)) AS t FROM hit)
 UNION ALL SELECT 'category', t FROM (SELECT unnest(list_distinct(categories)) AS t FROM hit)) SELECT * FROM o UNION ALL SELECT 'total', '', '', count(*) FROM hit UNION ALL SELECT 'facet', facet, value, count(*) FROM f GROUP BY facet, value""")
def search_response(spark, sf_dir):
    """A page in each of the eight orders, with the place of each row, the total and the facets of one search."""
    c = v.component(spark, sf_dir).withColumns({"relevance": r.exact_relevance("red"), "quality": F.col("maintainability"), "modified": F.col("id") * 7919 % 1000})
    hit = r.thresholds(c, max_complexity=40).where("relevance > 0")
    out = None
    for name in r.orderings():
        page, total, facets = r.search_response(hit, name, 5, 7)
        rows = page.agg(F.collect_list("id").alias("ids")).select(F.posexplode("ids").alias("i", "id")).select(F.lit(name).alias("part"), F.lit("id").alias("facet"), F.col("id").cast("string").alias("value"), (F.col("i") + 1).cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    out = out.unionByName(total.select(F.lit("total").alias("part"), F.lit("").alias("facet"), F.lit("").alias("value"), F.col("total").alias("n")))
    return out.unionByName(facets.select(F.lit("facet").alias("part"), "facet", "value", "n"))


@query(f"WITH {C}, f AS (SELECT name FROM component WHERE starts_with(lower(name), 's') ORDER BY name, id LIMIT 100) SELECT DISTINCT name FROM f ORDER BY name LIMIT 5")
def name_completions(spark, sf_dir):
    return r.completions(v.component(spark, sf_dir), "S")


@query(f"""WITH {C}, t AS (SELECT * FROM component WHERE id = 17), p AS (SELECT c.id, round(CASE WHEN c.type = t.type THEN 0.2 ELSE 0 END + CASE WHEN c.language = t.language THEN 0.15 ELSE 0 END
 + 0.25 * len(list_intersect(c.tags, t.tags))::DOUBLE / len(list_distinct(list_concat(c.tags, t.tags))) + 0.2 * len(list_intersect(c.categories, t.categories))::DOUBLE / len(list_distinct(list_concat(c.categories, t.categories)))
 + 0.1 * {SIM("lower(c.name)", "lower(t.name)")} + 0.1 * least(c.complexity, t.complexity) / greatest(c.complexity, t.complexity), 6) AS similarity
 FROM component c, t WHERE c.project_id = t.project_id AND c.id <> t.id) SELECT * FROM p WHERE similarity >= 0.3 ORDER BY similarity DESC, id LIMIT 10""")
def component_similarity(spark, sf_dir):
    return r.similar(v.component(spark, sf_dir), 17, 0.3)


@query(f"""WITH {C}, k AS (SELECT id, CASE WHEN id % 50 = 0 THEN '' ELSE name END AS name, type, CASE WHEN id % 40 = 0 THEN -1.0 ELSE complexity END AS complexity FROM component)
 SELECT id, list_filter([CASE WHEN name = '' THEN 'name is required' END, CASE WHEN complexity < 1 THEN 'complexity must be at least 1' END], lambda v: v IS NOT NULL) AS errors FROM k WHERE name = '' OR complexity < 1""")
def registration_errors(spark, sf_dir):
    c = v.component(spark, sf_dir)
    odd = c.withColumn("name", F.when(F.col("id") % 50 == 0, "").otherwise(F.col("name"))).withColumn("complexity", F.when(F.col("id") % 40 == 0, -1.0).otherwise(F.col("complexity")))
    return r.register(c, odd)[1].select("id", "errors")


@query(f"""WITH {C}, k AS (SELECT id, (['class', 'function', 'widget'])[1 + id % 3] AS type, (['public', 'secret', 'private', 'internal'])[1 + id % 4] AS access_level, id % 7 - 1 AS line_start, id % 5 AS line_end, complexity - 3 AS complexity, coverage_pct + 10 AS coverage_pct, 40 - maintainability AS maintainability FROM component),
 e AS (SELECT id, list_filter([CASE WHEN access_level = 'secret' THEN 'access level is not known' END, CASE WHEN line_start < 0 THEN 'line start must not be negative' END, CASE WHEN line_end < line_start THEN 'line end must not be before line start' END, CASE WHEN complexity < 1 THEN 'complexity must be at least 1' END,
 CASE WHEN coverage_pct > 100 THEN 'coverage must be within 0 and 100' END, CASE WHEN maintainability NOT BETWEEN 0 AND 100 THEN 'maintainability must be within 0 and 100' END, CASE WHEN type = 'widget' THEN 'type is not known' END], lambda v: v IS NOT NULL) AS errors FROM k) SELECT * FROM e WHERE len(errors) > 0""")
def validation_report(spark, sf_dir):
    """All checks of a component at once, over every component."""
    c, i = v.component(spark, sf_dir), F.col("id")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (i % n + 1).cast("int"))
    odd = c.withColumns({"type": pick(["class", "function", "widget"], 3), "access_level": pick(["public", "secret", "private", "internal"], 4), "line_start": i % 7 - 1, "line_end": i % 5, "complexity": F.col("complexity") - 3, "coverage_pct": F.col("coverage_pct") + 10, "maintainability": 40 - F.col("maintainability")})
    return r.register(odd, odd, types=r.COMPONENT_TYPES)[1].select("id", "errors")


@query(f"WITH {C} SELECT count(*) AS n, sum(CASE WHEN id % 2 = 0 AND id % 40 <> 0 THEN complexity + 1 ELSE complexity END) AS complexity FROM component")
def bulk_register(spark, sf_dir):
    c = v.component(spark, sf_dir)
    incoming = c.where("id % 2 = 0").withColumn("complexity", F.when(F.col("id") % 40 == 0, -1.0).otherwise(F.col("complexity") + 1))
    return r.register(c, incoming)[0].agg(F.count("*").alias("n"), F.sum("complexity").alias("complexity"))


@query(f"WITH {C} SELECT id, regexp_matches(path, '(?is)^pro.*/brand#1.*$') AS hit, regexp_matches(path, '(?is)^[ps][^tx].*#[2-4].*[0-46-9]$') AS classes FROM component")
def glob_match(spark, sf_dir):
    glob = lambda p: F.rlike("path", F.lit(x.glob_to_regex(p)))
    return v.component(spark, sf_dir).select("id", glob("pro*/brand#1*").alias("hit"), glob("[ps][!tx]*#[2-4]*[!5]").alias("classes"))


@query(f"""WITH {C}, p AS (SELECT t.id, c.id AS other, round(CASE WHEN c.type = t.type THEN 0.2 ELSE 0 END + CASE WHEN c.language = t.language THEN 0.15 ELSE 0 END
 + 0.25 * len(list_intersect(c.tags, t.tags))::DOUBLE / len(list_distinct(list_concat(c.tags, t.tags))) + 0.2 * len(list_intersect(c.categories, t.categories))::DOUBLE / len(list_distinct(list_concat(c.categories, t.categories)))
 + 0.1 * {SIM("lower(c.name)", "lower(t.name)")} + 0.1 * least(c.complexity, t.complexity) / greatest(c.complexity, t.complexity), 6) AS similarity
 FROM component c JOIN component t ON c.project_id = t.project_id AND c.id <> t.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other)::INT AS rank FROM p WHERE similarity >= 0.7)
 SELECT id, other, similarity, rank FROM r WHERE rank <= 10""")
def similar_components(spark, sf_dir):
    """The ten most similar components of every component."""
    return likeness.similar_components(v.component(spark, sf_dir))
