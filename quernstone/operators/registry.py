"""Component registry: filters, ranked searches, facets, paging, similarity, validation and bulk registration."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import exprs as x

#: Order in which kinds are preferred.
TYPE_RANK = {"file": 0, "class": 1, "function": 2, "async_function": 3}


def where_equal(components: DataFrame, **wanted) -> DataFrame:
    return components.where(x.both([F.col(k) == v for k, v in wanted.items() if v is not None]))


def ilike_any(columns: list[str], pattern: str) -> Column:
    """% and _ in the pattern are wildcards."""
    return x.either([F.ilike(F.col(c), F.lit(f"%{pattern}%")) for c in columns])


def thresholds(components: DataFrame, min_quality: float | None = None, max_complexity: float | None = None, min_coverage: float | None = None) -> DataFrame:
    tests = [(min_quality, F.col("quality") >= min_quality) if min_quality is not None else None, (max_complexity, F.col("complexity") <= max_complexity) if max_complexity is not None else None, (min_coverage, F.col("coverage_pct") >= min_coverage) if min_coverage is not None else None]
    return components.where(x.both([t[1] for t in tests if t]))


def any_tag(tags: str, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def all_tags(tags: str, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(tags))) == 0


def best_by_type(components: DataFrame, kind: str = "type") -> DataFrame:
    rank = F
    for k, r in TYPE_RANK.items():
        rank = rank.when(F.col(kind) == k, r)
    return components.withColumn("rank", rank.otherwise(9)).orderBy("rank", "path").limit(1)


def facets(components: DataFrame) -> DataFrame:
    """(facet, value, n) over type, language, tags and categories: one pass, one aggregation."""
    pairs = F.concat(F.array(F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")), F.struct(F.lit("language").alias("facet"), F.col("language").alias("value"))), F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))), F.transform(F.array_distinct("categories"), lambda t: F.struct(F.lit("category").alias("facet"), t.alias("value"))))
    return components.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def orderings() -> dict[str, list]:
    """The eight result orders, each made total by id."""
    name = F.lower("name")
    return {
        "relevance": [F.desc("relevance"), "id"], "name_asc": [name.asc(), "id"], "name_desc": [name.desc(), "id"], "quality_desc": [F.desc("quality"), "id"],
        "quality_asc": [F.asc("quality"), "id"], "complexity_asc": [F.asc("complexity"), "id"], "complexity_desc": [F.desc("complexity"), "id"], "recent": [F.desc("modified"), "id"],
    }


def exact_relevance(query: str) -> Column:
    q, name, path = F.lit(query.lower()), F.lower("name"), F.lower("path")
    tag = F.aggregate("tags", F.lit(0.0), lambda s, t: s + F.when(F.lower(t) == q, 0.5).when(F.contains(F.lower(t), q), 0.3).otherwise(0.0))
    base = F.when(name == q, 1.0).when(F.startswith(name, q), 0.8).when(F.contains(name, q), 0.6).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + F.when(F.contains(path, q), 0.4).otherwise(0.0) + tag), 6)


def fuzzy_relevance(query: str) -> Column:
    q, name, path = F.lit(query.lower()), F.lower("name"), F.lower("path")
    near, far = x.string_similarity(name, q), x.string_similarity(path, q)
    tag = F.aggregate("tags", F.lit(0.0), lambda s, t: s + F.when(x.string_similarity(F.lower(t), q) > 0.7, 0.3 * x.string_similarity(F.lower(t), q)).otherwise(0.0))
    score = F.when(near > 0.7, 0.8 * near).otherwise(0.0) + F.when(F.contains(name, q), 0.6).otherwise(0.0) + F.when(far > 0.6, 0.4 * far).otherwise(0.0) + tag
    return F.round(F.least(F.lit(1.0), score), 6)


def regex_search(components: DataFrame, pattern: str) -> DataFrame:
    """Rows with a relevance above 0; none for a pattern that is not a regular expression."""
    jvm = components.sparkSession.sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return components.withColumn("relevance", F.lit(0.0)).limit(0)
    return components.withColumn("relevance", regex_relevance(pattern)).where("relevance > 0")


def regex_relevance(pattern: str) -> Column:
    r = F.lit(f"(?i){pattern}")
    hit = lambda c, w: F.when(F.rlike(c, r), w).otherwise(0.0)
    return F.round(hit(F.col("name"), 0.5) + hit(F.col("path"), 0.3) + F.aggregate(F.concat("tags", "categories"), F.lit(0.0), lambda s, t: s + hit(t, 0.2)), 6)


def parse_structural(query: str) -> dict:
    """Criteria that a structural query names. The keywords and bounds."""
    q, out = query.lower(), {}
    for word in ("class", "function", "interface"):
        if word in q:
            out["type"] = word
            break
    for word in ("public", "private"):
        if word in q:
            out["access_level"] = word
            break
    out |= {f"is_{w}": True for w in ("abstract", "static", "async") if w in q}
    if "simple" in q:
        out["max_complexity"] = 5
    elif "complex" in q:
        out["min_complexity"] = 10
    return out


def structural_relevance(criteria: dict) -> Column:
    """Share of the criteria that a row meets; 0 without criteria."""
    met = []
    for k, v in criteria.items():
        met.append(F.col("complexity") <= v if k == "max_complexity" else F.col("complexity") >= v if k == "min_complexity" else F.col(k) == v)
    return F.lit(0.0) if not met else F.round(sum((F.when(c, 1.0).otherwise(0.0) for c in met), F.lit(0.0)) / len(met), 6)


def match_info(query: str) -> list[Column]:
    """(highlights, reasons): where a query stands in the name, the path, each tag and each category."""
    q = F.lit(query.lower())
    has = lambda c: F.contains(F.lower(c), q)
    one = lambda c, mark, reason: F.when(has(F.col(c)), F.array(F.struct(F.concat(F.lit(mark), F.col(c)).alias("h"), F.lit(reason).alias("r")))).otherwise(F.array().cast("array<struct<h:string,r:string>>"))
    each = lambda c, mark: F.transform(F.filter(c, has), lambda t: F.struct(F.concat(F.lit(f"{mark}: "), t).alias("h"), F.concat(F.lit(f"{mark} '"), t, F.lit("' matches query")).alias("r")))
    found = F.concat(one("name", "Name: ", "Name contains query"), one("path", "Path: ", "Path contains query"), each("tags", "Tag"), each("categories", "Category"))
    return [F.transform(found, lambda f: f["h"]).alias("highlights"), F.transform(found, lambda f: f["r"]).alias("reasons")]


def search_response(matches: DataFrame, order: str = "relevance", offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a page of the matches in one of the eight orders, one row with the total, facets); total and facets are those of all matches."""
    return page(matches, orderings()[order], offset, limit), matches.agg(F.count("*").alias("total")), facets(matches)


def completions(components: DataFrame, prefix: str, limit: int = 5, pool: int = 100) -> DataFrame:
    """Distinct names with a prefix, sorted, from the first `pool` matching rows by name."""
    first = components.where(F.startswith(F.lower("name"), F.lit(prefix.lower()))).orderBy("name", "id").limit(pool)
    return first.select("name").distinct().orderBy("name").limit(limit)


def similar(components: DataFrame, target: int, least: float = 0.7, limit: int = 10) -> DataFrame:
    """Components of the target's project that resemble it; weights .2 type, .15 language, .25 tags, .2 categories, .1 name, .1 complexity."""
    t = components.where(F.col("id") == target).select(*[F.col(c).alias(f"t_{c}") for c in ("id", "project_id", "name", "type", "language", "tags", "categories", "complexity")])
    pairs = components.join(F.broadcast(t), (F.col("project_id") == F.col("t_project_id")) & (F.col("id") != F.col("t_id")))
    high, low = F.greatest("complexity", "t_complexity"), F.least("complexity", "t_complexity")
    same = lambda c, w: F.when(F.col(c) == F.col(f"t_{c}"), w).otherwise(0.0)
    score = same("type", 0.2) + same("language", 0.15) + 0.25 * x.jaccard(F.col("tags"), F.col("t_tags")) + 0.2 * x.jaccard(F.col("categories"), F.col("t_categories")) + 0.1 * x.string_similarity(F.lower("name"), F.lower("t_name")) + 0.1 * F.when(high > 0, low / high).otherwise(0.0)
    return pairs.withColumn("similarity", F.round(score, 6)).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(limit).select("id", "similarity")


#: The kinds of components and their levels of access.
COMPONENT_TYPES = ["class", "function", "async_function", "method", "interface", "struct", "enum", "module", "package", "file", "variable", "constant", "type_alias"]
ACCESS_LEVELS = ["public", "private", "protected", "internal", "package_private"]


def validation_errors(columns: list[str], types: list[str] | None = None) -> Column:
    """Messages for what is missing or out of range; a check counts where the table has its column, and that of the type where types are given."""
    c = F.col
    checks = [
        ("name", c("name").isNull() | (c("name") == ""), "name is required"), ("type", c("type").isNull(), "type is required"), ("id", c("id").isNull(), "id is required"),
        ("access_level", c("access_level").isNull() | ~c("access_level").isin(ACCESS_LEVELS), "access level is not known"),
        ("line_start", c("line_start") < 0, "line start must not be negative"), ("line_end", c("line_end") < c("line_start"), "line end must not be before line start"),
        ("complexity", c("complexity") < 1, "complexity must be at least 1"), ("coverage_pct", ~c("coverage_pct").between(0, 100), "coverage must be within 0 and 100"),
        ("maintainability", ~c("maintainability").between(0, 100), "maintainability must be within 0 and 100"), ("line_count", c("line_count") < 0, "line_count must not be negative"),
    ]
    if types is not None:
        checks.append(("type", ~c("type").isin(types), "type is not known"))
    needs = {"line_end": {"line_start"}}
    return x.labels([(test, message) for name, test, message in checks if {name, *needs.get(name, ())} <= set(columns)])


def register(existing: DataFrame, incoming: DataFrame, key: str = "id", types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rejected rows with errors): valid rows replace those of the same key."""
    checked = incoming.withColumn("errors", validation_errors(incoming.columns, types))
    good = checked.where(F.size("errors") == 0).drop("errors")
    last = good.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("name")))).where("__r = 1").drop("__r")
    return existing.join(last.select(key), key, "left_anti").unionByName(last), checked.where(F.size("errors") > 0)
