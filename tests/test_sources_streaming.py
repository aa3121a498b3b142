"""Readers, parsers, snapshots and streams."""

from pyspark.sql import functions as F

from quernstone.operators import graph
from quernstone.sources import parsers, snapshots, tree
from quernstone.streaming import jobs

FILES = {
    "pkg/__init__.py": "", "pkg/.env": "REDIS=1", "pkg/core.py": "import os\nfrom a.b import c\n\nclass A:\n    async def go(self):\n        if x:\n            return 1\n", "pkg/bad.py": "def (:",
    "web/app.js": "import React from 'react'\nconst x = require(\"fs\")\nfunction go() {}\nconst run = async (a) => 1\nclass View {}\n", "M.java": "import java.util.List;\npublic class M { public void run() {} }\n",
    "m.go": "import \"fmt\"\nfunc Go() {}\nfunc hidden() {}\ntype T struct {}\n", "r.rs": "use std::io;\npub fn go() {}\nstruct S;\n", "x.rb": "class X; end", "node_modules/dep.js": "no", "package.json": '{"name": "web", "version": "2"}',
    "pyproject.toml": 'name = "py"\ndescription = "d"\n', "README.md": "# Title\ntext", "gen.py": "# AUTO-GENERATED\n", "tests/test_a.py": "x = 1",
}


def written(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "big.txt").write_text("x" * 3000)
    return str(tmp_path)


def test_tree_sees_hidden_names_and_skips_ignored(spark, tmp_path):
    files = tree.classified(tree.read_tree(spark, written(tmp_path), 2000)).cache()
    by = {r.path: r for r in files.collect()}
    assert set(by) == {n for n in FILES if "node_modules" not in n} | {"bin.dat"}
    assert by["bin.dat"].is_binary and not by["m.go"].is_binary and by["gen.py"].is_generated and by["tests/test_a.py"].is_test
    assert by["package.json"].is_config and by["README.md"].is_documentation and by["web/app.js"].language == "javascript" and by["bin.dat"].language is None
    meta = parsers.project_metadata(files).first()
    assert (meta.name, meta.version, meta.description) == ("web", "2", "d")
    rows = {(r.path, r.kind, r.name, r.ok) for r in parsers.python_components(files.where("language = 'python'")).collect()}
    assert {("pkg/core.py", "class", "A", True), ("pkg/core.py", "async_function", "go", True), ("pkg/bad.py", "file", "pkg/bad.py", False)} <= rows
    one = lambda lang: parsers.pattern_components(files.where(F.col("language") == lang), lang).first()
    js, go, java, rust = one("javascript"), one("go"), one("java"), one("rust")
    assert (js.imports, js.functions, js.types) == (["react", "fs"], ["go", "run"], ["View"])
    assert (go.imports, go.exports) == (["fmt"], ["Go", "T"])
    assert (java.imports, java.functions, java.types) == (["java.util.List"], ["run"], ["M"])
    assert (rust.imports, rust.functions, rust.types) == (["std::io"], ["go"], ["S"])
    assert one("ruby").functions == []


def test_snapshots_never_overwrite(spark, tmp_path):
    t = snapshots.SnapshotTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.write(spark.range(3))
    t.write(t.read().where("id > 0"))
    assert [r.id for r in t.read().orderBy("id").collect()] == [1, 2] and len(t.versions()) == 2


def test_replacing_one_project(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda p, n: spark.range(n).withColumn("project_id", F.lit(p))
    snapshots.replace_project(rows(1, 3).union(rows(2, 4)), path)
    snapshots.replace_project(rows(1, 1), path)
    assert {(r.project_id, r["count"]) for r in spark.read.parquet(path).groupBy("project_id").count().collect()} == {(1, 1), (2, 4)}


def test_stream_keeps_the_graph_in_step(spark, tmp_path):
    n, e = snapshots.SnapshotTable(spark, str(tmp_path / "n")), snapshots.SnapshotTable(spark, str(tmp_path / "e"))
    n.write(spark.range(1, 4))
    e.write(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    spark.createDataFrame([(2,)], "id long").write.parquet(str(tmp_path / "changes"))
    changes = spark.readStream.schema("id long").parquet(str(tmp_path / "changes"))
    after = lambda ids: (ids, spark.createDataFrame([(2, 1)], "src long, dst long"))
    jobs.sync_graph(changes, n, e, after, str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in e.read().collect()} == {(2, 1)}
    assert graph.statistics(n.read(), e.read()).first().n_nodes == 3


def test_expiring_state(spark, sf, tmp_path):
    stream = jobs.expiring_counts(jobs.event_stream(spark, f"{sf}/events.parquet").select("event_type"), "event_type")
    q = stream.writeStream.format("memory").queryName("ttl_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    want = {r.event_type: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()}
    try:
        # timeouts by processing time keep batches coming, so the query is never idle
        for _ in range(40):
            got = {r.key: r.n for r in spark.table("ttl_counts").collect()}
            if got == want:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert got == want
