"""Source trees as tables: a Python data source that walks directories, and classification of files.

Spark's own file sources hide names that begin with _ or a dot; this one sees them. The walk is split by top-level entry, so readers share it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_FILE_BYTES = 10 * 1024 * 1024
#: Directories that are not entered, and signs of generated files.
IGNORED = frozenset([".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".idea", ".vscode", ".pytest_cache", ".mypy_cache"])
GENERATED = ["auto-generated", "autogenerated", "generated by", "do not edit", "@generated"]
#: Language by file extension.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".cs": "csharp",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".h": "cpp", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".dart": "dart", ".scala": "scala", ".lua": "lua",
}
CONFIG = (".json", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".env", ".properties")
DOCS = (".md", ".rst", ".txt", ".adoc")


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.limit = int(options.get("maxBytes", MAX_FILE_BYTES))

    def partitions(self):
        return [Part(os.path.join(self.root, n)) for n in sorted(os.listdir(self.root)) if n not in IGNORED] or [Part(self.root + "/.none")]

    def read(self, partition):
        todo = [partition.path]
        while todo:
            path = todo.pop()
            if os.path.islink(path) or not os.path.exists(path):
                continue
            if os.path.isdir(path):
                todo += [os.path.join(path, n) for n in sorted(os.listdir(path), reverse=True) if n not in IGNORED]
            elif os.path.getsize(path) <= self.limit:
                with open(path, "rb") as f:
                    yield os.path.relpath(path, self.root), os.path.getsize(path), f.read()


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, size_bytes long, content binary"

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, size_bytes, content) of a tree that all executors can reach; larger files are skipped."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", path).option("maxBytes", str(max_bytes)).load()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    return F.try_element_at(table, extension(path))


def classified(files: DataFrame) -> DataFrame:
    """Add extension, language, text and the flags of a file. Binary: a zero byte in the first 1024; generated: a sign in the first five lines."""
    p, content = F.lower("path"), F.col("content")
    binary = F.contains(F.substr(content, F.lit(1), F.lit(1024)), F.lit(b"\x00"))
    text = F.when(~binary, content.cast("string"))
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n"))
    ends = lambda names: F.coalesce(extension(F.col("path")).isin(*names), F.lit(False))
    out = files.withColumns({"extension": extension(F.col("path")), "language": language(F.col("path")), "is_binary": binary, "text": text})
    generated = F.lit(False)
    for w in GENERATED:
        generated = generated | F.coalesce(F.contains(head, F.lit(w)), F.lit(False))
    return out.withColumns({"is_generated": generated, "is_test": F.rlike(p, F.lit(r"(^|/)(tests?|spec|__tests__)/|(^|/)test_|_test\.|\.spec\.|\.test\.")), "is_config": ends(CONFIG) | F.rlike(p, F.lit(r"(^|/)(dockerfile|makefile|\.env)$")), "is_documentation": ends(DOCS)})
