"""Components in source files: a table function for Python (by its syntax tree), expressions for languages that patterns describe, manifests."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED = "path string, ok boolean, kind string, name string, line_start int, line_end int, complexity int, imports array<string>, error string"
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension)
#: Patterns of imports, functions and types by language: (imports, functions, types). The first group that is not empty is the name.
PATTERNS = {
    "javascript": (r"(?m)(?:import\s[^'\"\n]*['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]\s*\))", r"(?m)(?:function\s+(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>)", r"(?m)class\s+(\w+)"),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", r"(?m)(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(", r"(?m)(?:class|interface|enum)\s+(\w+)"),
    "go": (r"(?m)^\s*(?:import\s+)?\"([\w./-]+)\"", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", r"(?m)^type\s+(\w+)\s+(?:struct|interface)"),
    "rust": (r"(?m)^\s*use\s+([\w:]+)", r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", r"(?m)^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"),
}
PATTERNS["typescript"] = PATTERNS["javascript"]


def complexity(node: ast.AST) -> int:
    return 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(node))


def parse_python(path: str, text: str) -> list[tuple]:
    """Rows of PARSED: the file, then its classes, functions and async functions; a file that can't be parsed gives one row with the error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, False, "file", path, 1, 1, 0, [], str(e)[:200])]
    imports = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports.append("." * n.level + (n.module or ""))
    rows = [(path, True, "file", path, 1, text.count("\n") + 1, complexity(tree), list(dict.fromkeys(imports)), None)]
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function"}
    for n in ast.walk(tree):
        if type(n) in kinds:
            rows.append((path, True, kinds[type(n)], n.name, n.lineno, n.end_lineno, complexity(n), [], None))
    return rows


def python_components(files: DataFrame) -> DataFrame:
    """files: path, text. Arrow batches in, rows of PARSED out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for df in batches:
            rows = [r for p, t in zip(df["path"], df["text"], strict=True) for r in parse_python(p, t or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, PARSED)


def matched_names(text: Column, pattern: str, groups: int) -> Column:
    """First non-empty group of each match."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)) for g in range(groups)]
    if groups == 1:
        return F.filter(parts[0], lambda n: n != "")
    return F.filter(F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]), lambda s: F.coalesce(*[F.nullif(s[f"g{i}"], F.lit("")) for i in range(groups)])), lambda n: n.isNotNull())


def pattern_components(files: DataFrame, language: str) -> DataFrame:
    """(path, imports, functions, types, exports) by patterns; other languages give the file row alone. Go exports names with a capital."""
    if language not in PATTERNS:
        none = F.array().cast("array<string>")
        return files.select("path", none.alias("imports"), none.alias("functions"), none.alias("types"), none.alias("exports"))
    imports, functions, types = (F.array_distinct(matched_names(F.col("text"), p, re.compile(p).groups)) for p in PATTERNS[language])
    out = files.select("path", imports.alias("imports"), functions.alias("functions"), types.alias("types"))
    names = F.concat("functions", "types")
    return out.withColumn("exports", F.filter(names, lambda n: F.rlike(n, F.lit("^[A-Z]"))) if language == "go" else names)


def java_details(files: DataFrame) -> DataFrame:
    """(path, package, name, line, extends, implements) of each class in Java files; a file without a class gives one row with its package."""
    t = F.col("text")
    pattern = r"(?:public\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{\s,]+(?:\s*,\s*[^{\s,]+)*))?"
    group = lambda g: F.regexp_extract_all(t, F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(group(0).alias("whole"), group(1).alias("name"), group(2).alias("base"), group(3).alias("faces"), F.slice(F.split(t, pattern, -1), F.lit(1), F.size(group(0))).alias("gap"))
    package = F.nullif(F.trim(F.regexp_extract(t, r"package\s+([^;]+);", 1)), F.lit(""))
    # the line of a class is one more than the line feeds in all that lies before it
    before = lambda i: F.array_join(F.slice(F.transform(zipped, lambda z: F.concat(z["gap"], z["whole"])), F.lit(1), i), "")
    one = lambda z, i: F.struct(z["name"].alias("name"), (F.length(F.regexp_replace(F.concat(before(i), z["gap"]), r"[^\n]", "")) + 1).alias("line"), F.nullif(z["base"], F.lit("")).alias("extends"), F.filter(F.split(z["faces"], r"\s*,\s*"), lambda f: f != "").alias("implements"))
    return files.select("path", package.alias("package"), F.explode_outer(F.transform(zipped, one)).alias("c")).select("path", "package", "c.*")


def project_metadata(files: DataFrame) -> DataFrame:
    """(name, version, description): package.json before pyproject.toml before the first line of the README."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    t = F.col("text")
    toml = lambda k: F.nullif(F.regexp_extract(t, rf'(?m)^{k}\s*=\s*"([^"]*)"', 1), F.lit(""))
    rows = files.where(base.isin("package.json", "pyproject.toml", "README.md")).select(
        F.when(base == "package.json", 0).when(base == "pyproject.toml", 1).otherwise(2).alias("rank"), "path",
        *[F.when(base == "package.json", F.get_json_object(t, f"$.{k}")).when(base == "pyproject.toml", toml(k)).when(F.lit(k == "name"), F.trim(F.regexp_replace(F.substring_index(t, "\n", 1), "^#+", ""))).alias(k) for k in ("name", "version", "description")],
    )
    return rows.agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.struct("rank", F.length("path"), "path"))).alias(k) for k in ("name", "version", "description")])
