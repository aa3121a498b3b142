"""Queries over source files, manifests and paths. Their inputs are small literal files; the results were worked out by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quernstone.operators import autocomplete, graph
from quernstone.plans.literals import Literal
from quernstone.plans.registry import query
from quernstone.sources import parsers, paths, snapshots, tree
from quernstone.sources import views as v

CODE = Literal(
    (
        ("pkg/core.py", "import os\nfrom a.b import c\n\nclass A:\n    async def go(self):\n        if x:\n            return 1\n\ndef f(a):\n    for i in a:\n        while i and a:\n            pass\n"), ("pkg/bad.py", "def (:"), ("pkg/__init__.py", ""),
        ("web/app.js", "import React from 'react'\nconst x = require(\"fs\")\nfunction go() {}\nconst run = async (a) => 1\nclass View {}\n"), ("M.java", "package a.b;\nimport java.util.List;\npublic class M extends N implements P, Q {\n public void run() {}\n}\nfinal class K {}\n"),
        ("m.go", "import \"fmt\"\nfunc Go() {}\nfunc hidden() {}\ntype T struct {}\n"), ("r.rs", "use std::io;\npub fn go() {}\nstruct S;\n"), ("x.rb", "class X; end"), ("gen.py", "# AUTO-GENERATED\nx = 1"), ("tests/test_a.py", "x = 1"), ("Dockerfile", "FROM x"),
        ("package.json", "{\"name\": \"web\", \"version\": \"2\"}"), ("pyproject.toml", "name = \"py\"\ndescription = \"d\"\n"), ("README.md", "# Title\ntext"), ("late.txt", "a\nb\nc\nd\ne\n@generated"), ("bin.dat", "a\x00b"), ("App.TSX", "let a"),
    ),
    "path string, text string",
)


def code(spark, *names):
    t = CODE.df(spark)
    return t.where(F.col("path").isin(*names)) if names else t


N = None
CLASSIFIED = (
    ("pkg/core.py", "python", 0, 0, 0, 0, 0), ("pkg/bad.py", "python", 0, 0, 0, 0, 0), ("pkg/__init__.py", "python", 0, 0, 0, 0, 0), ("web/app.js", "javascript", 0, 0, 0, 0, 0), ("M.java", "java", 0, 0, 0, 0, 0), ("m.go", "go", 0, 0, 0, 0, 0), ("r.rs", "rust", 0, 0, 0, 0, 0),
    ("x.rb", "ruby", 0, 0, 0, 0, 0), ("gen.py", "python", 0, 1, 0, 0, 0), ("tests/test_a.py", "python", 0, 0, 1, 0, 0), ("Dockerfile", N, 0, 0, 0, 1, 0), ("package.json", N, 0, 0, 0, 1, 0), ("pyproject.toml", N, 0, 0, 0, 1, 0), ("README.md", N, 0, 0, 0, 0, 1),
    ("late.txt", N, 0, 0, 0, 0, 1), ("bin.dat", N, 1, 0, 0, 0, 0), ("App.TSX", "typescript", 0, 0, 0, 0, 0),
)
FLAGS = ("is_binary", "is_generated", "is_test", "is_config", "is_documentation")


@query(Literal(CLASSIFIED, "path string, language string, " + ", ".join(f"{f} int" for f in FLAGS)).select())
def file_classification(spark, sf_dir):
    files = code(spark).select("path", F.length("text").cast("long").alias("size_bytes"), F.col("text").cast("binary").alias("content"))
    return tree.classified(files).select("path", "language", *[F.col(f).cast("int").alias(f) for f in FLAGS])


@query(Literal(
    (
        ("pkg/core.py", True, "file", "pkg/core.py", 1, 13, 5, ["os", "a.b"]), ("pkg/core.py", True, "class", "A", 4, 7, 2, []), ("pkg/core.py", True, "async_function", "go", 5, 7, 2, []), ("pkg/core.py", True, "function", "f", 9, 12, 4, []),
        ("pkg/bad.py", False, "file", "pkg/bad.py", 1, 1, 0, []), ("pkg/__init__.py", True, "file", "pkg/__init__.py", 1, 1, 1, []),
    ),
    "path string, ok boolean, kind string, name string, line_start int, line_end int, complexity int, imports array<string>",
).select())
def python_parser(spark, sf_dir):
    return parsers.python_components(code(spark, "pkg/core.py", "pkg/bad.py", "pkg/__init__.py")).drop("error")


@query(Literal(
    (
        ("web/app.js", ["react", "fs"], ["go", "run"], ["View"], ["go", "run", "View"]), ("M.java", ["java.util.List"], ["run"], ["M", "K"], ["run", "M", "K"]), ("m.go", ["fmt"], ["Go", "hidden"], ["T"], ["Go", "T"]), ("r.rs", ["std::io"], ["go"], ["S"], ["go", "S"]),
        ("x.rb", [], [], [], []),
    ),
    "path string, imports array<string>, functions array<string>, types array<string>, exports array<string>",
).select())
def pattern_parsers(spark, sf_dir):
    out = None
    for name, language in (("web/app.js", "javascript"), ("M.java", "java"), ("m.go", "go"), ("r.rs", "rust"), ("x.rb", "ruby")):
        rows = parsers.pattern_components(code(spark, name), language)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(Literal((("M.java", "a.b", "M", 3, "N", ["P", "Q"]), ("M.java", "a.b", "K", 6, None, [])), "path string, package string, name string, line int, extends string, implements array<string>").select())
def java_parser(spark, sf_dir):
    return parsers.java_details(code(spark, "M.java"))


@query(Literal((("web", "2", "d"),), "name string, version string, description string").select())
def project_manifest(spark, sf_dir):
    return parsers.project_metadata(code(spark))


@query("SELECT p_partkey % 3 AS project_id, count(*) AS n, sum(CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE p_size END)::BIGINT AS total FROM part GROUP BY 1")
def snapshot_sinks(spark, sf_dir):
    """Written in parts by project, one project replaced, then appended to a table of snapshots and exported as JSON lines, which are read back."""
    folder = f"{graph.shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    rows = v.table(spark, sf_dir, "part").select((F.col("p_partkey") % 3).alias("project_id"), F.col("p_size").cast("long").alias("size"))
    snapshots.replace_project(rows, f"{folder}/graph")
    snapshots.replace_project(rows.where("project_id = 1").withColumn("size", F.lit(1).cast("long")), f"{folder}/graph")
    held = snapshots.SnapshotTable(spark, f"{folder}/table")
    held.write(spark.read.parquet(f"{folder}/graph").where("project_id < 2").select(F.col("project_id").cast("long"), "size"))
    held.write(held.read().unionByName(rows.where("project_id = 2")))
    snapshots.export_json(held.read(), f"{folder}/json")
    return spark.read.schema("project_id long, size long").json(f"{folder}/json").groupBy("project_id").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


CURSOR = Literal(((1, "import os\nfrom a import b\nx = 1\nclass K:\n    async def go(self):\n        y = x\n        retu", 6, 12), (2, "abc", 0, 2), (3, "", 0, 0)), "id long, text string, line int, col int")


@query(Literal(((1, "retu", ["x", "y"], ["go"], ["K"], ["a", "os"]), (2, "ab", [], [], [], []), (3, "", [], [], [], [])), "id long, prefix string, variables array<string>, functions array<string>, classes array<string>, imports array<string>").select())
def cursor_context(spark, sf_dir):
    t = CURSOR.df(spark)
    before = t.select("id", autocomplete.before_cursor(F.col("text"), F.col("line"), F.col("col")).alias("b"))
    return before.select("id", *autocomplete.context(F.col("b")))


ASKED = Literal(
    (
        (1, ["/home/u/app/x", " file:///home/u/app/x ", "file://localhost/data/a%20b+c", "file:///C:/Users/q", "https://x.y/z", "", None, "/a/./b/../c//d/"]), (2, []), (3, ["file://srv/share/p"]),
    ),
    "id long, paths array<string>",
)


@query(Literal(((1, ["/home/u/app/x", "/data/a b+c", "/C:/Users/q", "/a/c/d"], ["/work/app/x", "/mnt/data/a b+c", "/C:/Users/q", "/a/c/d"]), (2, [], []), (3, ["/srv/share/p"], ["/srv/share/p"])), "id long, candidates array<string>, mapped array<string>").select())
def path_mapping(spark, sf_dir):
    maps = paths.parse_mappings("/home=/h, /home/u=/work, broken, /data/=/mnt/data, =x")
    return ASKED.df(spark).select("id", paths.candidates(F.col("paths")).alias("candidates")).withColumn("mapped", F.transform("candidates", lambda p: paths.mapped(p, maps)))
