"""Queries over embedded corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import semantic as s
from quernstone.plans.literals import Literal
from quernstone.plans.memory_queries import SQL_VECTOR, VECTOR
from quernstone.plans.registry import query
from quernstone.sources import views as v

OTHER = [((i * 5) % 13 - 6) / 10 for i in range(64)]
SQL_OTHER = f"CAST({OTHER} AS DOUBLE[])"
ITEMS = "items AS (SELECT vec_id AS item_id, CASE label % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'pattern' WHEN 2 THEN 'documentation' ELSE 'usage' END AS kind, CASE vec_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'java' END AS language, embedding FROM embeddings)"
SCORE = lambda q: f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {q}), 6)"


def items(spark, sf_dir):
    k, n = F.col("label") % 4, F.col("vec_id") % 3
    e = v.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.when(k == 0, "code").when(k == 1, "pattern").when(k == 2, "documentation").otherwise("usage").alias("kind"), F.when(n == 0, "python").when(n == 1, "go").otherwise("java").alias("language"), "embedding")


@query(f"WITH {ITEMS}, h AS (SELECT item_id, kind, language, {SCORE(SQL_VECTOR)} AS score FROM items WHERE kind <> 'code' OR language = 'go') SELECT * FROM h WHERE score >= 0.05")
def semantic_search(spark, sf_dir):
    return s.search(items(spark, sf_dir), VECTOR, 0.05, language="go")


@query(f"WITH {ITEMS}, h AS (SELECT item_id, kind, language, {SCORE(SQL_VECTOR)} AS score FROM items), f AS (SELECT * FROM h WHERE score >= 0.05 AND language = 'go') SELECT item_id, kind, language, round(score * 1.1, 8) AS score FROM f")
def context_boost(spark, sf_dir):
    return s.context_aware(s.search(items(spark, sf_dir), VECTOR, 0.05), "go")


@query(f"""WITH {ITEMS}, a AS (SELECT *, {SCORE(SQL_VECTOR)} AS sa, {SCORE(SQL_OTHER)} AS sb FROM items), u AS (SELECT item_id, kind, round(sa * 0.6, 8) AS score, 'semantic' AS origin, 0 AS o FROM a WHERE sa >= 0.05
 UNION ALL SELECT item_id, kind, round(sa * 0.8, 8), 'pattern', 1 FROM a WHERE sa >= 0.1 AND kind = 'pattern' UNION ALL SELECT item_id, kind, round(sb * 0.7, 8), 'context', 2 FROM a WHERE sb >= 0.05),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY score DESC, o) AS r FROM u) SELECT item_id, kind, score, origin FROM r WHERE r = 1""")
def hybrid_fusion(spark, sf_dir):
    i = items(spark, sf_dir)
    return s.fuse({"semantic": s.search(i, VECTOR, 0.05), "pattern": s.search(i, VECTOR, 0.1, ["pattern"]), "context": s.search(i, OTHER, 0.05)})


@query(f"""WITH {ITEMS}, h AS (SELECT item_id, kind, language, {SCORE(SQL_VECTOR)} AS score FROM items), f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, item_id) AS r FROM h WHERE score >= 0.0) SELECT item_id, kind, language, score FROM f WHERE r <= 5""")
def top_per_kind(spark, sf_dir):
    return s.top_per_kind(s.search(items(spark, sf_dir), VECTOR, 0.0), 5)


@query(f"WITH {ITEMS}, t AS (SELECT embedding AS t FROM items WHERE item_id = 7), h AS (SELECT item_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(t AS DOUBLE[])), 6) AS score FROM items, t WHERE item_id <> 7) SELECT * FROM h WHERE score > 0.2 ORDER BY score DESC, item_id LIMIT 3")
def related_items(spark, sf_dir):
    return s.related(items(spark, sf_dir), 7, 0.2)


@query(f"WITH {ITEMS}, p AS (SELECT item_id AS pattern_id, embedding AS p FROM items WHERE item_id < 25), h AS (SELECT item_id, pattern_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(p AS DOUBLE[])), 6) AS score FROM items, p WHERE kind = 'code') SELECT * FROM h WHERE score >= 0.2")
def pattern_detection(spark, sf_dir):
    i = items(spark, sf_dir)
    return s.detect_patterns(i.where("kind = 'code'"), i.where("item_id < 25").withColumnRenamed("item_id", "pattern_id"), 0.2)


@query(f"WITH {ITEMS} SELECT kind, count(*) AS n, list_sort(list(DISTINCT language)) AS languages FROM items GROUP BY kind")
def corpus_statistics(spark, sf_dir):
    return s.corpus_statistics(items(spark, sf_dir))


TYPES = "['pattern_exact', 'hybrid_pattern', 'context_aware', 'usage_similarity', 'similarity']"


@query(f"""WITH {ITEMS}, m AS (SELECT item_id, language, greatest({SCORE(SQL_VECTOR)}, 0.0) AS score, ({TYPES})[item_id % 5 + 1] AS mt, CASE item_id % 2 WHEN 0 THEN 'learn_pattern' ELSE 'get_example' END AS intent FROM items)
 SELECT item_id, round(least(1.0, score + CASE mt WHEN 'pattern_exact' THEN 0.2 WHEN 'hybrid_pattern' THEN 0.15 WHEN 'context_aware' THEN 0.1 WHEN 'similarity' THEN 0.05 ELSE 0 END + CASE WHEN language = 'go' THEN 0.1 ELSE 0 END
 + CASE WHEN intent = 'learn_pattern' AND contains(mt, 'pattern') OR intent = 'get_example' AND contains(mt, 'usage') THEN 0.15 ELSE 0 END), 6)::DOUBLE AS confidence FROM m""")
def confidence_boost(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ["pattern_exact", "hybrid_pattern", "context_aware", "usage_similarity", "similarity"])), (F.col("item_id") % 5 + 1).cast("int"))
    i = s.search(items(spark, sf_dir), VECTOR, -1.0)
    return i.select("item_id", s.confidence(F.greatest("score", F.lit(0.0)), kinds, F.col("language") == "go", F.when(F.col("item_id") % 2 == 0, "learn_pattern").otherwise("get_example")).alias("confidence"))


INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in s.INTENTS.items()) + " ELSE 'find_code' END"


@query(f"SELECT conv_id, turn, {INTENT} AS intent FROM conversations")
def intent_detect(spark, sf_dir):
    return v.table(spark, sf_dir, "conversations").select("conv_id", "turn", s.intent(F.col("text")).alias("intent"))


@query(f"SELECT conv_id, turn, list_filter({s.PATTERN_NAMES}, lambda n: contains(lower(text), n)) AS names FROM conversations")
def pattern_names(spark, sf_dir):
    return v.table(spark, sf_dir, "conversations").select("conv_id", "turn", s.mentioned_patterns(F.col("text")).alias("names"))


@query("SELECT doc_id, substring(sha256(concat_ws(':', source, lang, md5(text))), 1, 32) AS embedding_id FROM documents")
def embedding_ids(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select("doc_id", s.embedding_id(F.col("source"), F.col("lang"), F.col("text")).alias("embedding_id"))


@query("SELECT doc_id, concat_ws(' | ', concat('Language: ', lang), concat('Source: ', source), CASE WHEN length(text) > 0 THEN concat('Content: ', substring(text, 1, 500)) END) AS body FROM documents")
def embedding_texts(spark, sf_dir):
    parts = [("Language", F.col("lang"), 50), ("Source", F.col("source"), 50), ("Content", F.col("text"), 500)]
    return v.table(spark, sf_dir, "documents").select("doc_id", s.embedding_text(parts).alias("body"))


@query(f"SELECT conv_id, turn, list_transform(list_filter({s.PATTERN_NAMES}, lambda n: contains(lower(text), n)), lambda n: {{'name': n, 'score': 1.0::DOUBLE}}) AS hits FROM conversations")
def pattern_scores(spark, sf_dir):
    return v.table(spark, sf_dir, "conversations").select("conv_id", "turn", s.pattern_hits(F.col("text")).alias("hits"))


@query(f"WITH {ITEMS}, h AS (SELECT item_id, kind, language, {SCORE(SQL_VECTOR)} AS score FROM items), w AS (SELECT item_id, kind, language, round(score * 0.8, 8) AS score FROM h WHERE score >= 0.05) SELECT * FROM w WHERE language = 'java' AND score >= 0.1")
def post_filters(spark, sf_dir):
    h = s.search(items(spark, sf_dir), VECTOR, 0.05)
    w = h.withColumn("score", F.round(F.col("score") * s.WEIGHTS["pattern"], 8))
    return s.post_filter(w, "java", "kind", 0.1).unionByName(s.post_filter(w, attribute="docstring"))


@query(f"WITH {ITEMS}, h AS (SELECT item_id, {SCORE(SQL_VECTOR)} AS confidence FROM items) SELECT item_id, confidence, row_number() OVER (ORDER BY confidence DESC, item_id) AS place FROM h WHERE confidence >= 0.1 ORDER BY place LIMIT 20")
def confidence_order(spark, sf_dir):
    h = s.search(items(spark, sf_dir), VECTOR, -1.0).select("item_id", F.col("score").alias("confidence"))
    return s.by_confidence(h, 0.1, 20).agg(F.collect_list(F.struct("item_id", "confidence")).alias("h")).select(F.posexplode("h").alias("i", "h")).select("h.*", (F.col("i") + 1).cast("long").alias("place"))


@query(f"WITH {ITEMS}, h AS (SELECT item_id, kind, language, {SCORE(SQL_VECTOR)} AS score FROM items WHERE kind = 'documentation' AND language = 'go') SELECT * FROM h ORDER BY score DESC, item_id LIMIT 5")
def documentation_search(spark, sf_dir):
    """By kind and language, the best five."""
    return s.top_per_kind(s.search(items(spark, sf_dir), VECTOR, -1.0, ["documentation"], "go", "documentation"), 5)


TEXTS = Literal(
    ((1, "python", "# top\ndef f(a):\n  // x\nclass K: pass\n" + "z" * 600, "About f", ["a", "b"], ["x"] * 12, ["e" * 120, "short"]), (2, "go", "package m\nfunc g() {}", "", [], [], []), (3, "python", "y = 1", None, None, ["s"], ["e"])),
    "id long, language string, code string, about string, tags array<string>, sections array<string>, examples array<string>",
)
JOIN = lambda a, n=None: f"array_to_string({a}{f'[1:{n}]' if n else ''}, ' | ')"


@query(f"""WITH {TEXTS.cte("t")}, l AS (SELECT *, list_filter([regexp_replace(s, '^\\s+|\\s+$', '', 'g') FOR s IN string_split(code, chr(10))], lambda s: regexp_matches(s, '^(#|//)')) AS marks, regexp_extract_all(code, 'def\\s+(\\w+)', 1) AS fs, regexp_extract_all(code, 'class\\s+(\\w+)', 1) AS cs FROM t),
 n AS (SELECT *, list_concat(marks, CASE WHEN language = 'python' THEN list_concat([concat('function ', f) FOR f IN fs], [concat('class ', c) FOR c IN cs]) ELSE [] END) AS said FROM l)
 SELECT id, 'functionality' AS kind, CASE WHEN len(said) > 0 THEN {JOIN("said")} ELSE substring(code, 1, 500) END AS body FROM n
 UNION ALL SELECT id, 'documentation', concat_ws(' | ', CASE WHEN length(about) > 0 THEN concat('Summary: ', about) END, CASE WHEN len(sections) > 0 THEN concat('Sections: ', {JOIN("sections", 10)}) END,
  CASE WHEN len(examples) > 0 THEN concat('Code examples: ', {JOIN("[CASE WHEN length(e) > 100 THEN concat(substring(e, 1, 100), '...') ELSE e END FOR e IN examples[1:3]]")}) END, concat('Content: ', substring(code, 1, 500))) FROM t
 UNION ALL SELECT id, 'usage', concat_ws(' | ', CASE WHEN length(about) > 0 THEN concat('Description: ', about) END, 'Type: example', CASE WHEN len(tags) > 0 THEN concat('Tags: ', {JOIN("tags")}) END, CASE WHEN len(sections) > 0 THEN concat('Functions: ', {JOIN("sections", 5)}) END,
  CASE WHEN len(sections) > 0 THEN concat('Classes: ', {JOIN("sections", 3)}) END, concat('Code: ', substring(code, 1, 300))) FROM t
 UNION ALL SELECT id, 'pattern', concat_ws(' | ', concat('Pattern: ', language), concat('Intent: ', language), concat('Motivation: ', language), concat('Applicability: ', language), CASE WHEN len(examples) > 0 THEN concat('Examples: ', {JOIN("examples")}) END,
  CASE WHEN len(examples) > 0 THEN concat('Implementation: ', substring(examples[1], 1, 200)) END) FROM t
 UNION ALL SELECT id, 'code', array_to_string(list_concat([concat('function ', f, ' with args x') FOR f IN fs], [concat('class ', c, ' with methods a, b') FOR c IN cs], [concat('import ', e) FOR e IN coalesce(sections, [])], [concat('complexity ', id), concat('code: ', substring(code, 1, 500))]), ' | ') FROM l""")
def embedding_builders(spark, sf_dir):
    """The texts of the five kinds of embeddings."""
    t = TEXTS.df(spark)
    names = lambda p: F.regexp_extract_all("code", F.lit(p), F.lit(1))
    none = F.array().cast("array<string>")
    language, sections = F.col("language"), F.coalesce("sections", none)
    functions = F.transform(names(r"def\s+(\w+)"), lambda f: F.struct(f.alias("name"), F.lit("x").alias("args")))
    classes = F.transform(names(r"class\s+(\w+)"), lambda c: F.struct(c.alias("name"), F.array(F.lit("a"), F.lit("b")).alias("methods")))
    bodies = {
        "functionality": s.functionality_text(F.col("code"), language), "documentation": s.documentation_text(F.col("code"), F.col("sections"), F.col("examples"), F.col("about")),
        "usage": s.usage_text(F.col("code"), F.col("about"), F.lit("example"), F.lit(""), F.col("tags"), {"patterns": none, "functions": F.col("sections"), "classes": F.col("sections"), "imports": none}),
        "pattern": s.pattern_text(language, language, language, language, F.col("examples"), F.col("examples")), "code": s.code_text(functions, classes, sections, F.col("id"), F.col("code")),
    }
    return t.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("body")) for k, b in bodies.items()])).alias("b")).select("id", "b.*")
