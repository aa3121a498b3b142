"""Rule scanning and review of code and text, and document statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import exprs as x


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    severity: str
    pattern: str
    language: str = "all"
    enabled: bool = True


#: The scan rules, in order. Patterns ignore case, and ^ and $ match at lines.
RULES = (
    Rule("python_unreachable_code", "logic", "medium", r"return\s+.*\n\s+.*", "python"),
    Rule("python_unused_import", "maintainability", "low", r"^import\s+\w+", "python"),
    Rule("python_bare_except", "logic", "high", r"except\s*:", "python"),
    Rule("python_eval_usage", "security", "critical", r"eval\s*\(", "python"),
    Rule("python_hardcoded_password", "security", "critical", r"password\s*=\s*[\"'][^\"']+[\"']", "python"),
    Rule("python_none_comparison", "logic", "medium", r"(==|!=)\s*None", "python"),
    Rule("python_mutable_default", "logic", "high", r"def\s+\w+\([^)]*=\s*\[", "python"),
    Rule("js_eval_usage", "security", "critical", r"eval\s*\(", "javascript"),
    Rule("js_equality_operator", "logic", "medium", r"==\s*(?!true|false|null)", "javascript"),
    Rule("js_var_declaration", "maintainability", "medium", r"\bvar\s+", "javascript"),
    Rule("js_missing_semicolon", "syntax", "low", r"[^;]\s*\n", "javascript"),
    Rule("java_empty_catch", "logic", "medium", r"catch\s*\([^)]+\)\s*\{\s*\}", "java"),
    Rule("java_magic_number", "maintainability", "low", r"\b\d{2,}\b", "java"),
    Rule("java_string_equality", "logic", "high", r"==\s*\"[^\"]*\"", "java"),
    Rule("hardcoded_secret", "security", "critical", r"(password|secret|token|key)\s*=\s*[\"'][^\"']+[\"']"),
    Rule("sql_injection", "security", "critical", r"(execute|query)\s*\(\s*['\"].*\+\s*"),
    Rule("path_traversal", "security", "high", r"\.\./"),
    Rule("nested_loops", "performance", "medium", r"for.*\n\s*for.*\n\s*for"),
    Rule("large_string_concatenation", "performance", "medium", r"for.*\n.*\+\s*="),
    Rule("memory_leak_pattern", "memory", "high", r"new\s+\w+\[.*\]"),
)
#: Line checks of the security review.
SECURITY_LINES = (
    (r"password\s*=\s*[\"'][^\"']+[\"']", "Hardcoded password"), (r"api_key\s*=\s*[\"'][^\"']+[\"']", "Hardcoded API key"), (r"secret\s*=\s*[\"'][^\"']+[\"']", "Hardcoded secret"),
    (r"token\s*=\s*[\"'][^\"']+[\"']", "Hardcoded token"), (r"eval\s*\(", "Use of eval()"), (r"exec\s*\(", "Use of exec()"), (r"shell\s*=\s*True", "Shell=True in subprocess"),
    (r"sql\s*\.\s*format\s*\(", "SQL injection risk"), (r"cursor\.execute\s*\(", "SQL injection risk"),
)
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
#: Patterns whose matches speak for a language.
LANGUAGE_PATTERNS = {
    "python": (r"python", r"py\s+", r"def\s+", r"import\s+", r"from\s+"), "javascript": (r"javascript", r"js\s+", r"function\s+", r"const\s+", r"let\s+"),
    "typescript": (r"typescript", r"ts\s+", r"interface\s+", r"type\s+"), "java": (r"java", r"public\s+class", r"private\s+", r"protected\s+"), "go": (r"go\s+", r"func\s+", r"package\s+", r"import\s+"),
    "rust": (r"rust", r"fn\s+", r"let\s+mut", r"use\s+"), "csharp": (r"c#", r"csharp", r"public\s+class", r"namespace\s+"), "cpp": (r"c\+\+", r"cpp", r"#include", r"std::"),
    "php": (r"php", r"\$\w+", r"function\s+\w+\s*\(", r"class\s+\w+"), "ruby": (r"ruby", r"def\s+", r"class\s+", r"module\s+"),
}
#: Section headings, first hit counts; the group is the title, or the line has none.
HEADINGS = ((r"^#+\s+(.+)$", 1), (r"^[A-Z][A-Z\s]+:$", 0), (r"^\d+\.\s+(.+)$", 1), (r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*:$", 0))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(i, r.name, r.category, r.severity, r.language, r.enabled) for i, r in enumerate(rules)], "ord int, rule string, category string, severity string, language string, enabled boolean")


def flags(pattern: str) -> str:
    """Case is ignored, ^ and $ match at lines, only \\n ends a line, and classes hold all of Unicode."""
    return f"(?imdU){pattern}"


def scan_counts(code: DataFrame, rules=RULES) -> DataFrame:
    """(id, rule, category, severity, n) for every enabled rule of the code's language or of all languages that matches. One pass; rules are columns, not rows."""
    hit = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.when((F.col("language") == r.language) | F.lit(r.language == "all"), F.regexp_count("content", F.lit(flags(r.pattern)))).otherwise(0).alias("n")) for r in rules if r.enabled]
    if not hit:
        return code.limit(0).select("id", *[F.lit("").alias(c) for c in ("rule", "category", "severity")], F.lit(0).cast("long").alias("n"))
    return code.select("id", F.explode_outer(F.filter(F.array(*hit), lambda h: h["n"] > 0)).alias("h")).where("h IS NOT NULL").select("id", "h.rule", "h.category", "h.severity", F.col("h.n").cast("long").alias("n"))


def confidence(rule: Rule) -> float:
    """Before the look at the line: by category, and less for patterns that repeat or are optional."""
    base = {"security": 0.9, "maintainability": 0.7}.get(rule.category, 0.8)
    return base * (0.9 if "?" in rule.pattern or "*" in rule.pattern else 1)


def scan_positions(code: DataFrame, rules=RULES, around: int = 50) -> DataFrame:
    """(id, rule, category, severity, line, column, snippet, confidence) of every match. The text is cut at the matches, so offsets need no Python; lines and columns start at 1."""

    def found(r: Rule):
        return lambda at: F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(confidence(r)).alias("base"), at["at"].alias("at"), at["end"].alias("end"))

    spans = []
    for r in rules:
        if not r.enabled:
            continue
        p = flags(r.pattern)
        pairs = F.arrays_zip(F.split("content", p, -1).alias("gap"), F.regexp_extract_all("content", F.lit(p), F.lit(0)).alias("hit"))
        step = lambda acc, t: F.struct((acc["at"] + F.length(t["gap"]) + F.length(t["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(t["gap"])).alias("at"), (acc["at"] + F.length(t["gap"]) + F.length(t["hit"])).alias("end")))).alias("out"))
        starts = F.aggregate(F.filter(pairs, lambda t: t["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,end:int>>").alias("out")), step, lambda a: a["out"])
        wanted = ((F.col("language") == r.language) | F.lit(r.language == "all")) & F.rlike("content", F.lit(p))
        spans.append(F.transform(F.when(wanted, starts).otherwise(F.array().cast("array<struct<at:int,end:int>>")), found(r)))
    rows = code.select("id", "content", F.explode_outer(F.concat(*spans)).alias("s")).where("s IS NOT NULL")
    before = F.substr("content", F.lit(1), F.col("s.at"))
    lines = F.split(before, "\n")
    line = F.concat(F.element_at(lines, -1), F.substring_index(F.substr("content", F.col("s.at") + 1), "\n", 1))
    comment = F.rlike(line, F.lit(r"^\s*(#|//)"))
    value = x.clamp(F.col("s.base") * F.when(comment, 0.5).otherwise(1.0), 0.1, 1.0)
    first = F.greatest(F.col("s.at") - around, F.lit(0))
    return rows.select("id", "s.rule", "s.category", "s.severity", F.size(lines).alias("line"), (F.length(F.element_at(lines, -1)) + 1).alias("column"), F.substr("content", first + 1, F.col("s.end") - first + around).alias("snippet"), F.round(value, 6).alias("confidence"))


def severity_rank(severity: Column) -> Column:
    out = F
    for k, n in SEVERITY_RANK.items():
        out = out.when(severity == k, n)
    return out.otherwise(0)


def top_issues(issues: DataFrame, limit: int = 50) -> DataFrame:
    return issues.orderBy(severity_rank(F.col("severity")).desc(), F.desc("confidence"), "id", "rule", "line", "column").limit(limit)


def severity_distribution(issues: DataFrame) -> DataFrame:
    """(severity, n) with zeros."""
    names = issues.sparkSession.createDataFrame([(s,) for s in SEVERITY_RANK], "severity string")
    return F.broadcast(names).join(issues.groupBy("severity").agg(F.sum("n").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def issue_report(issues: DataFrame, limit: int = 50) -> DataFrame:
    """(measure, key, n): severities, with zeros, and categories of the issues that the limit shows, and how many there are in all."""
    shown = top_issues(issues, limit).withColumn("n", F.lit(1))
    severities = severity_distribution(shown).select(F.lit("severity").alias("measure"), F.col("severity").alias("key"), F.col("n").cast("long").alias("n"))
    categories = shown.groupBy("category").agg(F.count("*").alias("n")).select(F.lit("category").alias("measure"), F.col("category").alias("key"), "n")
    return severities.unionByName(categories).unionByName(issues.agg(F.count("*").alias("n")).select(F.lit("total_issues").alias("measure"), F.lit("").alias("key"), "n"))


def line_review(code: DataFrame) -> DataFrame:
    """(id, line_number, issue, severity, category, found): lines over 120 characters, TODO and FIXME, and a row for each unnamed number of two digits or more that is 11 or above."""
    lines = code.select("id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    bare = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    # compared by length first, so that a number may have any length
    numbers = F.filter(F.regexp_extract_all("line", F.lit(r"\b([0-9]{2,})\b"), F.lit(1)), lambda n: (F.length(F.regexp_replace(n, "^0+(?=.)", "")) > 2) | (F.regexp_replace(n, "^0+(?=.)", "").try_cast("int") > 10))
    named = x.contains_any(F.lower("line"), ["max", "min", "size", "count", "len"])
    row = lambda issue, severity, category, found: F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), found.alias("found"))
    none = F.array().cast("array<struct<issue:string,severity:string,category:string,found:string>>")
    hits = F.concat(
        F.when(F.length(bare) > 120, F.array(row("long_line", "low", "style", F.length(bare).cast("string")))).otherwise(none),
        F.when(F.contains("line", F.lit("TODO")) | F.contains("line", F.lit("FIXME")), F.array(row("todo", "medium", "maintainability", F.lit("")))).otherwise(none),
        F.when(~named, F.transform(numbers, lambda n: row("magic_number", "low", "maintainability", n))).otherwise(none),
    )
    return lines.select("id", (F.col("i") + 1).alias("line_number"), F.explode(hits).alias("h")).select("id", "line_number", "h.*")


def basic_review(code: DataFrame) -> DataFrame:
    """(id, line_number, issue, severity, category) of lines that call eval or exec."""
    lines = code.select("id", F.posexplode(F.split("content", "\n")).alias("i", "line")).where(x.contains_any(F.col("line"), ["eval(", "exec("]))
    return lines.select("id", (F.col("i") + 1).alias("line_number"), F.lit("eval_exec").alias("issue"), F.lit("critical").alias("severity"), F.lit("security").alias("category"))


def review_order(issues: DataFrame) -> DataFrame:
    """Issues by severity, the worst first, then by line."""
    return issues.orderBy(severity_rank(F.col("severity")).desc(), "line_number", "issue", "id")


def security_review(code: DataFrame) -> DataFrame:
    """(id, line_number, message) of the security line checks; lines that match none are dropped in the same pass."""
    lines = code.select("id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return lines.select("id", (F.col("i") + 1).alias("line_number"), F.explode(x.labels([(F.rlike("line", F.lit(f"(?i){p}")), m) for p, m in SECURITY_LINES])).alias("message"))


def review_score(issues: DataFrame) -> DataFrame:
    """(id, score): 100 less 20, 10, 5 and 2 per issue by severity, at least 0."""
    cost = F.when(F.col("severity") == "critical", 20).when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).otherwise(2)
    return issues.groupBy("id").agg(F.greatest(100 - F.sum(cost * F.col("n")), F.lit(0)).cast("long").alias("score"))


#: Categories of review issues.
REVIEW_CATEGORIES = ("style", "logic", "security", "performance", "maintainability", "documentation", "testing")


def review_metrics(code: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, line_count, character_count, issue_count, n_<severity>, n_<category>, complexity_score, functions, classes, imports, score) per file. code has complexities (an array) and the counts of functions, classes and imports;
    the score is 100 less the issues' costs, 10 for a complexity over 15 or 5 over 10, and 5 for functions without a documentation issue, at least 0."""
    names = [*SEVERITY_RANK, *REVIEW_CATEGORIES]
    per = issues.groupBy("id").agg(F.count("*").alias("issue_count"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_RANK], *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in REVIEW_CATEGORIES])
    out = code.select("id", F.size(F.split("content", "\n")).cast("long").alias("line_count"), F.length("content").cast("long").alias("character_count"), F.aggregate("complexities", F.lit(0).cast("long"), lambda a, b: a + b).alias("complexity_score"), "functions", "classes", "imports").join(per, "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ["issue_count", *[f"n_{n}" for n in names]]})
    cost = 20 * F.col("n_critical") + 10 * F.col("n_high") + 5 * F.col("n_medium") + 2 * F.col("n_low") + F.when(F.col("complexity_score") > 15, 10).when(F.col("complexity_score") > 10, 5).otherwise(0)
    cost = cost + F.when((F.col("functions") > 0) & (F.col("n_documentation") == 0), 5).otherwise(0)
    return out.withColumn("score", F.greatest(100 - cost, F.lit(0)).cast("long"))


def light_review(code: DataFrame, security: bool = False) -> DataFrame:
    """(id, line_count, n_issues, complexity, maintainability, score): lines over 120 characters (low), TODO and FIXME (medium) and, on demand, eval and exec (high); complexity counts lines with if, for or while."""
    lines = F.split("content", "\n")
    n = lambda test: F.size(F.filter(lines, test)).cast("long")
    long = n(lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) > 120)
    todo, evil = n(lambda s: x.contains_any(s, ["TODO", "FIXME"])), n(lambda s: x.contains_any(s, ["eval(", "exec("])) if security else F.lit(0).cast("long")
    out = code.select("id", F.size(lines).cast("long").alias("line_count"), todo.alias("m"), evil.alias("h"), (long + todo + evil).alias("n_issues"), n(lambda s: x.contains_any(s, ["if", "for", "while"])).alias("complexity"))
    zero = F.lit(0).cast("long")
    return out.select("id", "line_count", "n_issues", "complexity", F.greatest(100 - 5 * F.col("n_issues"), zero).alias("maintainability"), F.greatest(100 - 20 * F.col("h") - 10 * F.col("m") - 5 * F.col("n_issues"), zero).alias("score"))


def snippet_smells(code: DataFrame) -> DataFrame:
    """Counts of plain words as signs of nesting, branching, calls, types and error handling, the smells that they show, and patterns that would help."""
    c = F.col("content")
    n = lambda *words: sum((x.occurrences(c, w) for w in words), F.lit(0))
    out = code.select(
        "id", F.size(F.split(c, "\n")).cast("long").alias("line_count"), n("for", "while").alias("nested_loops"), n("if", "switch").alias("conditional_statements"),
        (x.occurrences(c, "(") - n("if", "for", "while")).alias("function_calls"), n("class", "struct").alias("class_definitions"), n("try", "catch", "except").alias("exception_handling"),
    )
    smells = [(F.col("nested_loops") > 2, "High nesting detected"), (F.col("conditional_statements") > 5, "Complex conditional logic"), ((F.col("exception_handling") == 0) & (F.col("line_count") > 10), "No error handling")]
    helps = [(F.col("nested_loops") > 1, "Iterator"), (F.col("conditional_statements") > 3, "Strategy"), (F.col("class_definitions") > 0, "Factory")]
    return out.withColumn("smells", x.labels(smells)).withColumn("patterns", x.labels(helps))


#: Secrets that the commit checks look for.
HOOK_SECRETS = tuple(p for p, _ in SECURITY_LINES[:4])


def commit_checks(files: DataFrame, max_bytes: int = 10_000, max_line: int = 120, docstrings: bool = False) -> DataFrame:
    """(hook, status, n_issues, n_warnings) of the checks on changed files (path, content, checked): quality fails on long lines and warns of large files and TODO, security fails on secrets and eval, documentation on a missing README."""
    c, lines = F.col("content"), F.split("content", "\n")
    n = lambda test: F.size(F.filter(lines, test))
    on = lambda v: F.coalesce(F.sum(F.when(F.col("checked"), v).otherwise(0)), F.lit(0)).cast("long")
    secrets = sum((F.regexp_count(c, F.lit(f"(?i){p}")) for p in HOOK_SECRETS), F.lit(0)) + x.contains_any(c, ["eval(", "exec("]).cast("int")
    readme = F.coalesce(F.max(F.rlike(F.lower("path"), F.lit(r"readme\.(md|rst|txt)$")).cast("int")), F.lit(0))
    bare = F.rlike("path", F.lit(r"\.(py|js|ts|java)$")) & x.contains_any(c, ["def ", "class "]) & ~x.contains_any(c, ['"' * 3, "'" * 3])
    g = files.agg(
        on(n(lambda s: F.length(s) > max_line)).alias("long"), on((F.octet_length(c) > max_bytes).cast("int") + n(lambda s: x.contains_any(s, ["TODO", "FIXME"]))).alias("warn"), on(secrets).alias("secrets"),
        (1 - readme + (F.coalesce(F.sum(bare.cast("int")), F.lit(0)) if docstrings else F.lit(0))).cast("long").alias("docs"),
    )
    none = F.lit(0).cast("long")
    rows = F.array(*[F.struct(F.lit(h).alias("hook"), i.alias("n_issues"), w.alias("n_warnings")) for h, i, w in (("code_quality", F.col("long"), F.col("warn")), ("security_scan", F.col("secrets"), none), ("documentation", F.col("docs"), none))])
    status = F.when(F.col("n_issues") > 0, "failed").when(F.col("n_warnings") > 0, "warning").otherwise("passed")
    return g.select(F.explode(rows).alias("r")).select("r.*").select("hook", status.alias("status"), "n_issues", "n_warnings")


def needs(c: Column, words: list[str]) -> Column:
    return x.both([F.contains(c, F.lit(w)) for w in words])


#: Per language, (patterns of functions, classes, imports; whether functions and imports are sets; words that together show a code pattern; keywords).
FEATURES = {
    "python": (
        [r"def\s+(\w+)\s*\("], [r"class\s+(\w+)"], [r"import\s+(\w+)", r"from\s+(\w+)"], False, True,
        [("class", ["class ", "__init__"]), ("method", ["def ", "self"]), ("import", ["import ", "from "]), ("exception_handling", ["try:", "except"]), ("context_manager", ["with "]), ("generator", ["def ", "yield"]), ("decorator", ["@", "def "])],
        ["def", "class", "import", "from", "try", "except", "with", "if", "else", "for", "while"],
    ),
    "javascript": (
        [r"function\s+(\w+)", r"const\s+(\w+)\s*=\s*\("], [r"class\s+(\w+)"], [r"import.*from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"], True, True,
        [("class", ["class ", "constructor"]), ("function", ["function "]), ("async", ["async ", "await "]), ("exception_handling", ["try {", "catch"]), ("promise", ["Promise"]), ("api_call", ["fetch("])],
        ["function", "class", "const", "let", "var", "if", "else", "for", "while", "try", "catch"],
    ),
    "java": (
        [r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\("], [r"public\s+class\s+(\w+)"], [r"import\s+([^;]+);"], False, False,
        [("class", ["public class "]), ("interface", ["interface "]), ("inheritance", ["extends "]), ("implementation", ["implements "])], [],
    ),
    "other": ([], [], [], False, False, [("class", ["class"]), ("exception_handling", ["try", "catch"])], []),
}


def code_features(code: DataFrame) -> DataFrame:
    """(id, size_class, functions, classes, imports, patterns, keywords) of snippets; sets are sorted. Over 50 lines is complex, over 20 moderate."""
    c = F.col("content")
    language = F.when(F.col("language") == "typescript", "javascript").when(F.col("language").isin(*FEATURES), F.col("language")).otherwise("other")
    names = lambda ps: F.concat(F.array().cast("array<string>"), *[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in ps])
    of = {}
    for k, (functions, classes, imports, set_functions, set_imports, patterns, keywords) in FEATURES.items():
        sets = lambda a, yes: F.array_sort(F.array_distinct(a)) if yes else a
        tests = [(needs(c, ws), n) for n, ws in patterns]
        if k == "javascript":
            tests[1] = (x.contains_any(c, ["function ", "=> "]), "function")
        if k == "other":
            tests = [(x.contains_any(c, ["function", "def", "func"]), "function"), tests[0], (x.contains_any(c, ["import", "include"]), "import"), tests[1]]
        of[k] = F.struct(sets(names(functions), set_functions).alias("functions"), names(classes).alias("classes"), sets(names(imports), set_imports).alias("imports"), x.labels(tests).alias("patterns"), (x.labels([(F.contains(c, F.lit(w)), w) for w in keywords]) if keywords else F.array().cast("array<string>")).alias("keywords"))
    found = F
    for k, v in of.items():
        found = found.when(language == k, v)
    lines = F.size(F.split(c, "\n"))
    return code.select("id", F.when(lines > 50, "complex").when(lines > 20, "moderate").otherwise("simple").alias("size_class"), found.otherwise(None).alias("f")).select("id", "size_class", "f.*")


def line_counts(text: Column) -> list[Column]:
    lines = F.split(text, "\n")
    return [F.size(lines).cast("long").alias("all_lines"), F.size(F.filter(lines, lambda s: F.trim(s) != "")).cast("long").alias("code_lines"), F.size(x.words(text)).cast("long").alias("n_words")]


def detect_language(text: Column) -> Column:
    """The language with most pattern matches, the first of equals; 'unknown' without any."""
    t = F.lower(text)
    scores = F.array(*[F.struct(sum((F.regexp_count(t, F.lit(p)) for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, ps) in enumerate(LANGUAGE_PATTERNS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["name"]).otherwise("unknown")


def headings(text: Column) -> Column:
    """Titles of section headings, in order."""

    def title(line: Column) -> Column:
        out = F
        for p, group in HEADINGS:
            out = out.when(F.rlike(line, F.lit(p)), F.regexp_extract(line, p, group))
        return out.otherwise(None)

    return F.filter(F.transform(F.split(text, "\n"), lambda s: title(F.trim(s))), lambda t: t.isNotNull())


def code_blocks(text: Column) -> Column:
    """The bodies of fenced blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w+)?\n(.*?)\n```"), F.lit(1))


def code_examples(text: Column) -> Column:
    """Fenced blocks, then inline code of one line, then runs of indented lines; a blank indented line ends a run."""
    inline = F.filter(F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1)), lambda c: ~F.contains(c, F.lit("\n")))
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(?: {4}|\t)(.+)$"), F.lit(1)), lambda s: F.when(F.rlike(s, F.lit(r"^\s*$")), F.lit("\x00")).otherwise(s))
    runs = F.filter(F.transform(F.split(F.array_join(lines, "\n"), "\x00"), lambda s: F.btrim(s, F.lit("\n"))), lambda s: s != "")
    return F.concat(code_blocks(text), inline, runs)


def summary(text: Column) -> Column:
    """The first three lines that are not headers, cut at 200 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))
    whole = F.array_join(F.slice(lines, 1, 3), " ")
    return F.when(F.length(whole) > 200, F.concat(F.substr(whole, F.lit(1), F.lit(200)), F.lit("..."))).otherwise(whole)


def doc_complexity(text: Column) -> list[Column]:
    parts = [(F.length(text), 5000), (F.size(headings(text)), 20), (F.size(code_blocks(text)), 10)]
    value = F.round(sum((F.least(n / F.lit(float(d)), F.lit(1.0)) for n, d in parts), F.lit(0.0)) / 3, 6)
    return [value.alias("value"), F.when(value < 0.3, "simple").when(value < 0.7, "moderate").otherwise("complex").alias("label")]


def doc_type(path: Column) -> Column:
    p, out = F.lower(path), F
    for w in ("api", "guide", "tutorial", "license", "changelog"):
        out = out.when(F.contains(p, F.lit(w)), w)
    return out.otherwise("readme")
