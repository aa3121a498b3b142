"""Queries over code and text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quernstone.operators import textscan as t
from quernstone.plans.literals import Literal
from quernstone.plans.registry import query
from quernstone.sources import views as v

CODE = "code AS (SELECT page_id AS id, html AS content, CASE page_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'java' END AS language FROM pages)"
#: The one rule with a look-ahead, stated without it: what it must not find is an alternative of its own, and is left out of the matches.
AHEAD = {"js_equality_operator": (r"==(?:true|false|null)|==\s*", "true|false|null")}


def code(spark, sf_dir):
    p = F.col("page_id")
    return v.table(spark, sf_dir, "pages").select(p.alias("id"), F.col("html").alias("content"), F.when(p % 3 == 0, "python").when(p % 3 == 1, "javascript").otherwise("java").alias("language"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches_sql(r) -> tuple[str, str]:
    """(pattern as a literal, condition on a match m)."""
    pattern, unwanted = AHEAD.get(r.name, (r.pattern, None))
    return quoted(f"(?im){pattern}"), f"NOT regexp_matches(m, '(?i){unwanted}')" if unwanted else "true"


def of_language(r) -> str:
    return "true" if r.language == "all" else f"language = '{r.language}'"


def rule_sql(code: str = CODE) -> str:
    rows = " UNION ALL ".join(f"SELECT id, '{r.name}' AS rule, '{r.category}' AS category, '{r.severity}' AS severity, len(list_filter(regexp_extract_all(content, {matches_sql(r)[0]}), lambda m: {matches_sql(r)[1]}))::BIGINT AS n FROM code WHERE {of_language(r)}" for r in t.RULES)
    return f"{code}, hits AS ({rows})"


@query(f"WITH {rule_sql()} SELECT * FROM hits WHERE n > 0")
def rule_scan_counts(spark, sf_dir):
    return t.scan_counts(code(spark, sf_dir))


@query(f"WITH {rule_sql()}, n AS (SELECT severity, sum(n)::BIGINT AS n FROM hits WHERE n > 0 GROUP BY severity) SELECT s.severity, coalesce(n, 0) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN n USING (severity)")
def rule_severity_dist(spark, sf_dir):
    return t.severity_distribution(t.scan_counts(code(spark, sf_dir)))


@query(f"WITH {rule_sql()} SELECT id, greatest(100 - sum(n * CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END), 0)::BIGINT AS score FROM hits WHERE n > 0 GROUP BY id")
def review_score(spark, sf_dir):
    return t.review_score(t.scan_counts(code(spark, sf_dir)))


#: A hit and a miss for each rule, in the language it is for.
SNIPPETS = Literal(
    tuple(
        (i, lang, text)
        for i, (lang, text) in enumerate(
            [
                ("python", "def f():\n    return 1\n    x = 2\n"), ("python", "import os\nfrom a import b\n"), ("python", "try:\n  f()\nexcept :\n  pass\nexcept E: pass"), ("python", "x = eval (s)\n# eval(t)\nevaluate"),
                ("python", "PASSWORD = 'abc'\npassword = ''\npass_word='q'"), ("python", "if x == None or y != None: pass\nx is None"), ("python", "def g(a, b=[]): pass\ndef h(a=()): pass"),
                ("javascript", "eval('1');\nvar a = 1;\nlet b = 2;\nif (a == b) {}\nif (a==true) {}\nif (a == null) {}\nif (a === b) {}\nx()\n"), ("java", "try { f(); } catch (E e) { }\nint a = 17; int b = 5; int c = 123456789012;\nif (s == \"x\") {}"),
                ("go", "token = \"t0\"\nkey=''\n// secret = 'a'\n../x ../../y"), ("php", "query ('select ' + a)\nexecute(\"q\" + b)\nquery(a)"), ("c", "for a\n  for b\n    for c\n\nfor x\n y += 1\nfor z\n w + = 2\nnew int[5]"), ("python", ""), ("java", None),
            ]
        )
    ),
    "id long, language string, content string",
)


def positions_sql(code: str) -> str:
    """Offsets from the lengths of the matches and of what lies between them, as in the operator; lines and columns from the text before."""
    found = []
    for r in t.RULES:
        p, keep = matches_sql(r)
        start = "(list_sum([length(g) FOR g IN s[1:k]]) + coalesce(list_sum([length(h) FOR h IN w[1:k - 1]]), 0))::BIGINT"
        found.append(f"SELECT id, content AS c, '{r.name}' AS rule, '{r.category}' AS category, '{r.severity}' AS severity, {t.confidence(r)!r}::DOUBLE AS base, {start} AS a, w[k] AS m FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM (SELECT *, regexp_extract_all(content, {p}) AS w, regexp_split_to_array(content, {p}) AS s FROM code WHERE {of_language(r)})) WHERE {keep.replace('(m,', '(w[k],')}")
    return f"""{code}, raw AS ({" UNION ALL ".join(found)}), place AS (SELECT *, string_split(substring(c, 1, a), chr(10)) AS before FROM raw),
 issues AS (SELECT id, rule, category, severity, len(before)::INT AS line, (length(before[-1]) + 1)::INT AS "column", substring(c, greatest(a - 50, 0) + 1, a + length(m) - greatest(a - 50, 0) + 50) AS snippet,
 round(least(greatest(base * CASE WHEN regexp_matches(string_split(c, chr(10))[len(before)], '^\\s*(#|//)') THEN 0.5 ELSE 1.0 END, 0.1), 1.0), 6)::DOUBLE AS confidence FROM place)"""


TOP = "(SELECT * FROM issues ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence DESC, id, rule, line, \"column\" LIMIT 50)"


@query(f"WITH {positions_sql(CODE)} SELECT * FROM issues")
def rule_scan_positions(spark, sf_dir):
    return t.scan_positions(code(spark, sf_dir))


@query(f"WITH {positions_sql(SNIPPETS.cte('code'))} SELECT * FROM issues")
def rule_scan_snippets(spark, sf_dir):
    """Every rule with a hit and a miss."""
    return t.scan_positions(SNIPPETS.df(spark))


@query(f"WITH {positions_sql(CODE)} SELECT * FROM {TOP}")
def top_issues(spark, sf_dir):
    return t.top_issues(t.scan_positions(code(spark, sf_dir)))


@query(f"""WITH {positions_sql(SNIPPETS.cte('code'))}, top AS {TOP} SELECT 'severity' AS measure, s.severity AS key, count(top.id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN top USING (severity) GROUP BY ALL
 UNION ALL SELECT 'category', category, count(*) FROM top GROUP BY ALL UNION ALL SELECT 'total_issues', '', count(*) FROM issues""")
def issue_report(spark, sf_dir):
    return t.issue_report(t.scan_positions(SNIPPETS.df(spark)))


def table_sql(rules) -> str:
    return "(VALUES " + ", ".join(f"('{r.name}', '{r.category}', '{r.severity}', '{r.language}', {str(r.enabled).lower()})" for r in rules) + ") r(rule, category, severity, language, enabled)"


TOGGLED = tuple(replace(r, enabled=i % 4 != 0) for i, r in enumerate(t.RULES))


@query(f"SELECT language, category, severity, count(*) AS n, count_if(enabled)::BIGINT AS n_enabled FROM {table_sql(TOGGLED)} GROUP BY GROUPING SETS ((language), (category), (severity), ())")
def rule_statistics(spark, sf_dir):
    t.rule_table(spark, TOGGLED).createOrReplaceTempView("quernstone_rules")
    return spark.sql("SELECT language, category, severity, count(*) AS n, count_if(enabled) AS n_enabled FROM quernstone_rules GROUP BY GROUPING SETS ((language), (category), (severity), ())")


LINES = "lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)"


BARE = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
TOO_LARGE = "lambda x: length(ltrim(x, '0')) > 2 OR try_cast(ltrim(x, '0') AS INT) > 10"


def line_review_sql(lines: str) -> str:
    return f"""WITH {lines}, n AS (SELECT *, list_filter(regexp_extract_all(line, '\\b([0-9]{{2,}})\\b', 1), {TOO_LARGE}) AS nums FROM lines)
 SELECT id, line_number::INT AS line_number, 'long_line' AS issue, 'low' AS severity, 'style' AS category, CAST(length({BARE}) AS VARCHAR) AS found FROM n WHERE length({BARE}) > 120
 UNION ALL SELECT id, line_number::INT, 'todo', 'medium', 'maintainability', '' FROM n WHERE contains(line, 'TODO') OR contains(line, 'FIXME')
 UNION ALL SELECT id, line_number::INT, 'magic_number', 'low', 'maintainability', unnest(nums) FROM n WHERE NOT regexp_matches(lower(line), 'max|min|size|count|len')"""


def documents(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query(line_review_sql(LINES))
def line_review(spark, sf_dir):
    return t.line_review(documents(spark, sf_dir))


REVIEWED = Literal(
    (
        (1, "python", "x = 17 + 23 + 5\n# TODO 00011 12345678901234567890\nsize = 99\n" + "y" * 121 + "\n  " + "z" * 120 + "  \neval(x)\nexec(y)\nFIXME eval(10)"), (2, "java", "a = 100;"), (3, "go", ""),
        (4, "python", "for x in a:\n  while b:\n    if c: f(g(1))\n    for d in e: pass\n" * 3 + "class A: pass\nstruct B"), (5, "c", "if (a) { try { f(); } catch (e) {} }\nswitch (b) {}"),
    ),
    "id long, language string, content string",
)
REVIEW_LINES = f"{REVIEWED.cte('code')}, lines AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM code)"
EVAL = "SELECT id, line_number::INT AS line_number, 'eval_exec' AS issue, 'critical' AS severity, 'security' AS category FROM lines WHERE contains(line, 'eval(') OR contains(line, 'exec(')"


@query(line_review_sql(REVIEW_LINES))
def line_review_snippets(spark, sf_dir):
    return t.line_review(REVIEWED.df(spark))


@query(f"""WITH {REVIEW_LINES}, i AS (SELECT id, line_number, issue, severity, category FROM ({line_review_sql("z AS (SELECT 1)").replace("WITH z AS (SELECT 1), n", "WITH n", 1)}) UNION ALL {EVAL}),
 r AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, line_number, issue, id) AS r FROM i) SELECT id, line_number, issue, severity, category FROM r WHERE r <= 6""")
def review_order(spark, sf_dir):
    """The first six issues of the full and the basic review, the worst first."""
    code = REVIEWED.df(spark)
    return t.review_order(t.line_review(code).drop("found").unionByName(t.basic_review(code))).limit(6)


@query(f"""WITH {REVIEW_LINES}, i AS (SELECT id, severity, category FROM ({line_review_sql("z AS (SELECT 1)").replace("WITH z AS (SELECT 1), n", "WITH n", 1)}) UNION ALL SELECT id, severity, category FROM ({EVAL})),
 c AS (SELECT id, len(string_split(content, chr(10)))::BIGINT AS line_count, length(content)::BIGINT AS character_count, (id * 4 + 3)::BIGINT AS complexity_score, id % 2 AS functions, id % 3 AS classes, 1::BIGINT AS imports FROM code),
 g AS (SELECT c.*, count(i.id) AS issue_count, {", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in t.SEVERITY_RANK)}, {", ".join(f"count(*) FILTER (category = '{s}') AS n_{s}" for s in t.REVIEW_CATEGORIES)} FROM c LEFT JOIN i USING (id) GROUP BY ALL)
 SELECT *, greatest(100 - 20 * n_critical - 10 * n_high - 5 * n_medium - 2 * n_low - CASE WHEN complexity_score > 15 THEN 10 WHEN complexity_score > 10 THEN 5 ELSE 0 END - CASE WHEN functions > 0 AND n_documentation = 0 THEN 5 ELSE 0 END, 0)::BIGINT AS score FROM g""")
def review_metrics(spark, sf_dir):
    code, k = REVIEWED.df(spark), F.col("id")
    issues = t.line_review(code).drop("found").unionByName(t.basic_review(code))
    measured = code.withColumns({"complexities": F.array(k * 4, F.lit(1).cast("long"), F.lit(2).cast("long")), "functions": k % 2, "classes": k % 3, "imports": F.lit(1).cast("long")})
    return t.review_metrics(measured, issues)


def light_sql(code: str) -> str:
    n = lambda test: f"len(list_filter(string_split(content, chr(10)), lambda line: {test}))::BIGINT"
    return f"""WITH {code}, l AS (SELECT id, {n("true")} AS line_count, {n("length(" + BARE + ") > 120")} AS o, {n("contains(line, 'TODO') OR contains(line, 'FIXME')")} AS m, {n("contains(line, 'eval(') OR contains(line, 'exec(')")} AS h,
 {n("contains(line, 'if') OR contains(line, 'for') OR contains(line, 'while')")} AS complexity FROM code) SELECT id, line_count, o + m + h AS n_issues, complexity, greatest(100 - 5 * (o + m + h), 0) AS maintainability, greatest(100 - 20 * h - 10 * m - 5 * (o + m + h), 0) AS score FROM l"""


@query(light_sql("code AS (SELECT doc_id AS id, text AS content FROM documents)"))
def light_review(spark, sf_dir):
    return t.light_review(documents(spark, sf_dir), security=True)


@query(light_sql(REVIEWED.cte("code")))
def light_review_snippets(spark, sf_dir):
    return t.light_review(REVIEWED.df(spark), security=True)


WORD = lambda *ws: " + ".join(f"((length(content) - length(replace(content, '{w}', ''))) / {len(w)})::BIGINT" for w in ws)


@query(f"""WITH {REVIEWED.cte("snippets")}, code AS (SELECT id, content FROM snippets UNION ALL SELECT doc_id + 1000, text FROM documents),
 s AS (SELECT id, len(string_split(content, chr(10)))::BIGINT AS line_count, {WORD("for", "while")} AS nested_loops, {WORD("if", "switch")} AS conditional_statements, {WORD("(")} - ({WORD("if", "for", "while")}) AS function_calls,
 {WORD("class", "struct")} AS class_definitions, {WORD("try", "catch", "except")} AS exception_handling FROM code) SELECT *,
 list_filter([CASE WHEN nested_loops > 2 THEN 'High nesting detected' END, CASE WHEN conditional_statements > 5 THEN 'Complex conditional logic' END, CASE WHEN exception_handling = 0 AND line_count > 10 THEN 'No error handling' END], lambda x: x IS NOT NULL) AS smells,
 list_filter([CASE WHEN nested_loops > 1 THEN 'Iterator' END, CASE WHEN conditional_statements > 3 THEN 'Strategy' END, CASE WHEN class_definitions > 0 THEN 'Factory' END], lambda x: x IS NOT NULL) AS patterns FROM s""")
def snippet_smells(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("id", F.col("id") + 1000)
    return t.snippet_smells(REVIEWED.df(spark).select("id", "content").unionByName(d))


CHANGED = Literal((("a/x.py", "password = 'q'\nTODO\n" + "l" * 121, True), ("a/y.js", "ok", True), ("b/z.bin", "eval(", False), ("big.txt", "w" * 119 + "\n" + "w\n" * 6000, True), ("m.java", "class A {}", True), ("n.py", "def f():\n  " + 3 * "'" + "doc" + 3 * "'", True)), "path string, content string, checked boolean")


@query(Literal((("code_quality", "failed", 1, 2, "changed"), ("security_scan", "failed", 1, 0, "changed"), ("documentation", "failed", 2, 0, "changed"), ("code_quality", "passed", 0, 0, "clean"), ("security_scan", "passed", 0, 0, "clean"), ("documentation", "passed", 0, 0, "clean"), ("code_quality", "warning", 0, 1, "large"), ("security_scan", "passed", 0, 0, "large"), ("documentation", "failed", 1, 0, "large")), "hook string, status string, n_issues long, n_warnings long, files string").select())
def commit_checks(spark, sf_dir):
    """Three sets of changed files; the results were worked out by hand."""
    c = CHANGED.df(spark)
    clean = spark.createDataFrame([("docs/README.md", "fine", True)], "path string, content string, checked boolean")
    sets = (("changed", t.commit_checks(c, docstrings=True)), ("clean", t.commit_checks(clean)), ("large", t.commit_checks(c.where("path = 'big.txt'"))))
    out = [rows.withColumn("files", F.lit(name)) for name, rows in sets]
    return out[0].unionByName(out[1]).unionByName(out[2])


FEATURED = Literal(
    (
        (1, "python", "import os\nfrom sys import path\nclass A:\n    def __init__(self):\n        yield 1\n@deco\ndef f(x):\n    with x:\n        try:\n            pass\n        except E:\n            pass\n"),
        (2, "typescript", "import a from 'b'\nconst q = require('c')\nconst g = (x) => x\nfunction h() {}\nclass K { constructor() {} }\nasync function z() { await fetch('u') }\n" + "\n" * 20),
        (3, "java", "import java.util.List;\npublic class Foo extends Bar implements Baz {\n  public static int run(int a) { return a; }\n}"), (4, "perl", "sub try catch include class def"), (5, "python", "\n" * 51), (6, "javascript", "new Promise(r => r)\ntry { x } catch (e) {}"),
    ),
    "id long, language string, content string",
)


@query(Literal(
    (
        (1, "simple", ["__init__", "f"], ["A"], ["os", "path", "sys"], ["class", "method", "import", "exception_handling", "context_manager", "generator", "decorator"], ["def", "class", "import", "from", "try", "except", "with"]),
        (2, "moderate", ["g", "h", "z"], ["K"], ["b", "c"], ["class", "function", "async", "api_call"], ["function", "class", "const"]),
        (3, "simple", ["run"], ["Foo"], ["java.util.List"], ["class", "inheritance", "implementation"], []), (4, "simple", [], [], [], ["function", "class", "import", "exception_handling"], []),
        (5, "complex", [], [], [], [], []), (6, "simple", [], [], [], ["function", "exception_handling", "promise"], ["try", "catch"]),
    ),
    "id long, size_class string, functions array<string>, classes array<string>, imports array<string>, patterns array<string>, keywords array<string>",
).select())
def code_features(spark, sf_dir):
    """The results were worked out by hand."""
    return t.code_features(FEATURED.df(spark))


MARKDOWN = Literal(((1, "# T\n```py\na = 1\nb\n```\ntext `x` and `y\nz` `w`\n    one\n    two\n     \n\tthree\n"), (2, "```\nq```"), (3, ""), (4, "    solo")), "id long, content string")


@query(Literal(((1, ["a = 1\nb", " and ", " ", "one\ntwo", "three"]), (2, []), (3, []), (4, ["solo"])), "id long, examples array<string>").select())
def code_examples(spark, sf_dir):
    """The results were worked out by hand."""
    return MARKDOWN.df(spark).select("id", t.code_examples(F.col("content")).alias("examples"))


@query(f"WITH {LINES} " + " UNION ALL ".join(f"""SELECT id, line_number::INT AS line_number, '{m}' AS message FROM lines WHERE regexp_matches(line, '(?i){p.replace("'", "''")}')""" for p, m in t.SECURITY_LINES))
def secret_scan(spark, sf_dir):
    return t.security_review(v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query(r"""SELECT doc_id AS id, len(string_split(text, chr(10)))::BIGINT AS all_lines, len(list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> ''))::BIGINT AS code_lines,
 len(list_filter(regexp_split_to_array(text, '[ \t\n\f\r\v]+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents""")
def word_count(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *t.line_counts(F.col("text")))


def language_sql() -> str:
    score = lambda ps: " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in ps)
    cols = ", ".join(f"{{'n': {score(ps)}, 'o': {-i}, 'name': '{name}'}}" for i, (name, ps) in enumerate(t.LANGUAGE_PATTERNS.items()))
    return f"WITH s AS (SELECT page_id AS id, lower(html) AS t FROM pages), b AS (SELECT id, list_max([{cols}]) AS b FROM s) SELECT id, CASE WHEN b.n > 0 THEN b.name ELSE 'unknown' END AS language FROM b"


@query(language_sql())
def language_detect(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), t.detect_language(F.col("html")).alias("language"))


HEAD = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN regexp_extract(s, '{p}', {g})" for p, g in t.HEADINGS) + " END"


@query(f"SELECT doc_id AS id, list_filter([{HEAD} FOR s IN [trim(x, ' ') FOR x IN string_split(text, chr(10))]], lambda h: h IS NOT NULL) AS headings FROM documents")
def headings(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.headings(F.col("text")).alias("headings"))


@query(f"""WITH h AS (SELECT doc_id AS id, text, len(list_filter([{HEAD} FOR s IN [trim(x, ' ') FOR x IN string_split(text, chr(10))]], lambda h: h IS NOT NULL)) AS n FROM documents),
 c AS (SELECT id, round((least(length(text) / 5000.0, 1.0) + least(n / 20.0, 1.0) + least(len(regexp_extract_all(text, '(?s)```(?:\\w+)?\\n(.*?)\\n```', 1)) / 10.0, 1.0))::DOUBLE / 3, 6) AS value FROM h)
 SELECT id, value, CASE WHEN value < 0.3 THEN 'simple' WHEN value < 0.7 THEN 'moderate' ELSE 'complex' END AS label FROM c""")
def doc_complexity(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *t.doc_complexity(F.col("text")))


@query("""WITH s AS (SELECT doc_id AS id, array_to_string(list_filter([trim(x, ' ') FOR x IN string_split(text, chr(10))], lambda s: s <> '' AND NOT starts_with(s, '#'))[1:3], ' ') AS w FROM documents)
 SELECT id, CASE WHEN length(w) > 200 THEN concat(substring(w, 1, 200), '...') ELSE w END AS summary FROM s""")
def doc_summary(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.summary(F.col("text")).alias("summary"))


@query("SELECT page_id AS id, CASE WHEN contains(lower(url), 'api') THEN 'api' WHEN contains(lower(url), 'guide') THEN 'guide' WHEN contains(lower(url), 'tutorial') THEN 'tutorial' WHEN contains(lower(url), 'license') THEN 'license' WHEN contains(lower(url), 'changelog') THEN 'changelog' ELSE 'readme' END AS doc_type FROM pages")
def doc_type(spark, sf_dir):
    return v.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), t.doc_type(F.col("url")).alias("doc_type"))
