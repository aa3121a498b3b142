"""Semantic retrieval over several corpora of embedded items: scoring, fusion, boosts, intents and pattern names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import exprs as x

#: Keywords of intents, in order; the first hit wins.
INTENTS = {
    "find_code": ["find", "search", "locate", "get code", "show me"], "learn_pattern": ["pattern", "design pattern", "architecture", "learn"], "get_example": ["example", "demo", "sample", "tutorial", "how to"],
    "understand_concept": ["explain", "what is", "understand", "concept", "meaning"], "solve_problem": ["solve", "fix", "implement", "how to", "problem"], "compare_approaches": ["compare", "difference", "vs", "versus", "alternative"],
}
#: Names of patterns that a query may mention.
PATTERN_NAMES = ["singleton", "factory", "builder", "prototype", "adapter", "decorator", "proxy", "composite", "flyweight", "facade", "bridge", "observer", "strategy", "command", "iterator", "mediator", "memento", "state", "template", "visitor", "chain", "repository", "mvc", "microservices", "cqrs", "event-driven", "saga", "circuit-breaker", "api-gateway"]
#: Boosts by the way a hit was found, and weights of the fused searches.
BOOSTS = {"pattern_exact": 0.2, "hybrid_pattern": 0.15, "context_aware": 0.1, "hybrid_context": 0.1, "similarity": 0.05}
WEIGHTS = {"semantic": 0.6, "pattern": 0.8, "context": 0.7}


def search(items: DataFrame, query: list[float], least: float = 0.5, kinds: list[str] | None = None, language: str | None = None, languages_of: str = "code") -> DataFrame:
    """(item_id, kind, score) at or over the threshold. The language only filters items of one kind."""
    q = F.array(*[F.lit(float(v)) for v in query])
    keep = [F.col("kind").isin(kinds)] if kinds else []
    if language:
        keep.append((F.col("kind") != languages_of) | (F.col("language") == language))
    return items.where(x.both(keep)).select("item_id", "kind", "language", F.round(x.cosine("embedding", q), 6).alias("score")).where(F.col("score") >= least)


def context_aware(hits: DataFrame, language: str | None = None) -> DataFrame:
    """With a language: only its items, and their score times 1.1."""
    return hits if language is None else hits.where(F.col("language") == language).withColumn("score", F.round(F.col("score") * 1.1, 8))


def fuse(parts: dict[str, DataFrame]) -> DataFrame:
    """(item_id, kind, score, origin): weighted scores, the best of each item; ties keep the part named first."""
    rows = None
    for i, (name, hits) in enumerate(parts.items()):
        part = hits.select("item_id", "kind", F.round(F.col("score") * WEIGHTS[name], 8).alias("score"), F.lit(name).alias("origin"), F.lit(-i).alias("ord"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("item_id", "kind").agg(F.max(F.struct("score", "ord", "origin")).alias("b")).select("item_id", "kind", "b.score", "b.origin")


def confidence(score: Column, match_type: Column, same_language: Column, intent: Column) -> Column:
    boost = F
    for k, v in BOOSTS.items():
        boost = boost.when(match_type == k, v)
    special = ((intent == "learn_pattern") & F.contains(match_type, F.lit("pattern"))) | ((intent == "get_example") & F.contains(match_type, F.lit("usage")))
    return F.round(F.least(F.lit(1.0), score + boost.otherwise(0.0) + F.when(same_language, 0.1).otherwise(0.0) + F.when(special, 0.15).otherwise(0.0)), 6)


def intent(text: Column) -> Column:
    t, out = F.lower(text), F
    for name, words in INTENTS.items():
        out = out.when(x.contains_any(t, words), name)
    return out.otherwise("find_code")


def mentioned_patterns(text: Column) -> Column:
    t = F.lower(text)
    return F.filter(F.array(*map(F.lit, PATTERN_NAMES)), lambda n: F.contains(t, n))


def pattern_hits(text: Column) -> Column:
    """(name, score) of the patterns that a text names; a name that stands there counts 1."""
    return F.transform(mentioned_patterns(text), lambda n: F.struct(n.alias("name"), F.lit(1.0).alias("score")))


def post_filter(hits: DataFrame, language: str | None = None, attribute: str | None = None, least: float | None = None) -> DataFrame:
    """Hits of a language, with an attribute, and with a weighted score of at least `least`; what is None does not filter."""
    keep = [F.coalesce(F.col("language") == language, F.lit(False))] if language is not None else []
    if attribute is not None:
        keep.append(F.col(attribute).isNotNull() if attribute in hits.columns else F.lit(False))
    return hits.where(x.both(keep + ([F.col("score") >= least] if least is not None else [])))


def by_confidence(hits: DataFrame, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """Hits of at least a confidence, the best first, cut at a limit."""
    out = hits.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "item_id")
    return out if limit is None else out.limit(limit)


def related(items: DataFrame, target: int, least: float = 0.7, limit: int = 3) -> DataFrame:
    """The items most similar to one of them, itself aside."""
    t = items.where(F.col("item_id") == target).select(F.col("embedding").alias("t"))
    scored = items.where(F.col("item_id") != target).crossJoin(F.broadcast(t.limit(1))).select("item_id", F.round(x.cosine("embedding", "t"), 6).alias("score"))
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), "item_id").limit(limit)


def detect_patterns(code: DataFrame, patterns: DataFrame, least: float = 0.7, max_patterns: int = 10_000) -> DataFrame:
    """(item_id, pattern_id, score): every item against every pattern of a catalogue, which is checked to be small before it is broadcast."""
    n = patterns.limit(max_patterns + 1).count()
    if n > max_patterns:
        raise ValueError(f"a catalogue of more than {max_patterns} patterns")
    p = F.broadcast(patterns.select("pattern_id", F.col("embedding").alias("p")))
    return code.join(p).select("item_id", "pattern_id", F.round(x.cosine("embedding", "p"), 6).alias("score")).where(F.col("score") >= least)


def embedding_id(owner: Column, kind: Column, text: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws(":", owner, kind, F.md5(text)), 256), F.lit(1), F.lit(32))


def embedding_text(parts: list[tuple[str, Column, int]]) -> Column:
    """Labelled parts, each cut at its cap, joined by bars; empty ones are left out."""
    return F.concat_ws(" | ", *[F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), F.substr(c, F.lit(1), F.lit(cap)))) for label, c, cap in parts])


def joined(values: Column, most: int | None = None) -> Column:
    return F.array_join(values if most is None else F.slice(values, 1, most), " | ")


def bars(*parts: Column) -> Column:
    """Parts that are not null, joined by bars."""
    return F.concat_ws(" | ", *parts)


def labelled(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), value))


def code_text(functions: Column, classes: Column, imports: Column, complexity: Column, code: Column) -> Column:
    """Text of code for its embedding; functions have name and args (as text), classes name and methods."""
    say = F.concat(
        F.transform(functions, lambda f: F.concat(F.lit("function "), f["name"], F.lit(" with args "), f["args"])), F.transform(classes, lambda c: F.concat(F.lit("class "), c["name"], F.lit(" with methods "), F.array_join(c["methods"], ", "))),
        F.transform(imports, lambda i: F.concat(F.lit("import "), i)), F.array(F.concat(F.lit("complexity "), complexity.cast("string")), F.concat(F.lit("code: "), F.substr(code, F.lit(1), F.lit(500)))),
    )
    return F.array_join(say, " | ")


def functionality_text(code: Column, language: Column) -> Column:
    """Comment lines and, for Python, names of functions and classes; the start of the code where there are none."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.rlike(s, F.lit("^(#|//|\"\"\"|\'\'\')")))
    named = lambda word, label: F.transform(F.regexp_extract_all(code, F.lit(rf"{word}\s+(\w+)"), F.lit(1)), lambda n: F.concat(F.lit(f"{label} "), n))
    found = F.concat(lines, F.when(language == "python", F.concat(named("def", "function"), named("class", "class"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(found) > 0, F.array_join(found, " | ")).otherwise(F.substr(code, F.lit(1), F.lit(500)))


def documentation_text(content: Column, sections: Column, examples: Column, summary: Column) -> Column:
    """Summary, ten sections, three examples cut at 100 characters, and the start of the content."""
    short = F.transform(F.slice(examples, 1, 3), lambda e: F.when(F.length(e) > 100, F.concat(F.substr(e, F.lit(1), F.lit(100)), F.lit("..."))).otherwise(e))
    return bars(labelled("Summary", summary), F.when(F.size(sections) > 0, F.concat(F.lit("Sections: "), joined(sections, 10))), F.when(F.size(examples) > 0, F.concat(F.lit("Code examples: "), joined(short))), F.concat(F.lit("Content: "), F.substr(content, F.lit(1), F.lit(500))))


def usage_text(code: Column, description: Column, kind: Column, context: Column, tags: Column, features: dict[str, Column]) -> Column:
    """Description, type, context, tags, features (five functions, three classes and imports) and the start of the code; empty parts are left out."""
    part = lambda label, v, most=None: F.when(F.size(v) > 0, F.concat(F.lit(f"{label}: "), joined(v, most)))
    return bars(
        labelled("Description", description), F.concat(F.lit("Type: "), kind), labelled("Context", context), part("Tags", tags), part("Patterns", features["patterns"]), part("Functions", features["functions"], 5), part("Classes", features["classes"], 3),
        part("Imports", features["imports"], 3), F.concat(F.lit("Code: "), F.substr(code, F.lit(1), F.lit(300))),
    )


def pattern_text(description: Column, intent: Column, motivation: Column, applicability: Column, examples: Column, implementations: Column) -> Column:
    """The parts of a pattern's description, its examples, and 200 characters of the first implementation."""
    fixed = [F.concat(F.lit(f"{label}: "), c) for label, c in (("Pattern", description), ("Intent", intent), ("Motivation", motivation), ("Applicability", applicability))]
    return bars(*fixed, F.when(F.size(examples) > 0, F.concat(F.lit("Examples: "), joined(examples))), F.when(F.size(implementations) > 0, F.concat(F.lit("Implementation: "), F.substr(F.element_at(implementations, 1), F.lit(1), F.lit(200)))))


def top_per_kind(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "item_id")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def corpus_statistics(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("language")).alias("languages"))
