import json
import os

import pytest

from loomgraph.plans.agent import Engine, prompt, truncated
from loomgraph.sources import jsongraph, repository
from loomgraph.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    files = {
        "main.go": "package main\n\nfunc main() {\n\thelper()\n}\n", "lib/util.go": "package lib\n\nfunc helper() {\n\tif true { }\n}\n",
        "app/a.py": "from .b import run\n\nclass A(Base):\n    def go(self):\n        run()\n", "app/b.py": "class Base:\n    def go(self):\n        pass\n\ndef run():\n    pass\n",
        "x.log": "no", "src/.gitignore": "*.tmp\n", "src/y.tmp": "no", ".gitignore": "*.log\n", "tests/t.go": "package t\n\nfunc T() {}\n", "bad.py": "def (:\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bin.dat").write_bytes(b"a\x00b")
    (root / ".git").mkdir()
    (root / ".git/config").write_text("x")
    (root / "sub").mkdir()
    (root / "sub/.git").write_text("gitdir: x")
    os.symlink(root / "main.go", root / "link.go")
    return str(root)


def test_walk(tree):
    w = repository.walk(tree)
    assert w.symlinks == 1 and not w.errors
    assert {p for p, d, _ in w.entries if not d} == {".gitignore", "main.go", "lib/util.go", "app/a.py", "app/b.py", "src/.gitignore", "tests/t.go", "bad.py", "bin.dat"}
    with pytest.raises(NotADirectoryError):
        repository.walk(tree + "/absent")


def test_ingest(spark, tree, tmp_path):
    g = repository.ingest(spark, tree, "demo", str(tmp_path / "out"))
    ids = lambda kind: {r["id"] for r in g.nodes(kind).collect()}
    assert ids("Function") == {"Function:main.go:main", "Function:lib/util.go:helper", "Function:app/a.py:go", "Function:app/b.py:go", "Function:app/b.py:run"}
    edges = {(r["rel_type"], r["src_id"], r["dst_id"]) for r in g.edges().collect()}
    assert ("CALLS", "Function:main.go:main", "Function:lib/util.go:helper") in edges
    assert ("INHERITS", "Class:app/a.py:A", "Class:app/b.py:Base") in edges
    assert ("OVERRIDES", "Function:app/a.py:go", "Function:app/b.py:go") in edges
    assert ("CONTAINS", "Repository:demo", "File:main.go") in edges and ("CONTAINS", "Folder:lib", "File:lib/util.go") in edges
    assert ("DEFINES", "File:main.go", "Function:main.go:main") in edges and ("HAS_METHOD", "Class:app/a.py:A", "Function:app/a.py:go") in edges
    files = {r["path"]: r for r in g.nodes("File").collect()}
    assert "bin.dat" not in files and files["main.go"]["lineCount"] == 5 and files["main.go"]["language"] == "go"
    assert {r["state"] for r in repository.changes(spark, tree, "demo", g.nodes("File")).where("path <> 'bin.dat'").collect()} == {"unchanged"}
    os.utime(f"{tree}/main.go", (2e9, 2e9))
    os.remove(f"{tree}/app/b.py")
    states = {r["path"]: r["state"] for r in repository.changes(spark, tree, "demo", g.nodes("File")).collect()}
    assert states["main.go"] == "changed" and states["app/b.py"] == "deleted"


def test_json_graph(spark, tmp_path):
    data = {"nodes": [{"id": "a", "labels": ["X"], "properties": {"n": "1"}}, {"id": "b", "labels": [], "properties": {}}, {"id": "a", "labels": ["Y"], "properties": {"n": "2"}}], "edges": [{"id": "e", "type": "T", "source_id": "a", "target_id": "b", "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(data))
    free = jsongraph.read_json_graph(spark, str(tmp_path / "g.json"))
    assert free.get_node("a").first()["properties"] == {"n": "2"}
    assert free.shortest_path("b", "a").first()["path"] == ["b", "a"]

    said = iter(["let me look\n```repl\nx = graph_get_node('a')['properties']['n']\nprint(x)\n```", "```repl\ngraph_get_node('zz')\n```", "nothing", "FINAL_VAR(x)"])
    seen = []
    engine = Engine(free, lambda system, messages: (seen.append(messages[-1]["content"]), next(said))[1])
    assert engine.run("what is n?") == "2"
    assert seen[1] == "2\n" and seen[2].startswith("[Error] KeyError") and "FINAL" in seen[3]
    assert "X" not in prompt(free) and "Y (1)" in prompt(free)
    with pytest.raises(RuntimeError):
        Engine(free, lambda *_: "hm", turns=2).run("x")
    with pytest.raises(ValueError):
        Engine(free, None)
    assert truncated("abcdefgh", 4) == "ab\n... [truncated, 8 total chars] ...\ngh"


def test_stream_upsert(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def put(n, rows):
        spark.createDataFrame(rows, "repo string, path string, text string, mtime string").selectExpr("repo", "path", "text", "CAST(mtime AS timestamp) AS mtime").coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_stream(incremental.changed_files(spark, source), target, state).awaitTermination()

    put(0, [("r", "a.go", "package a\n\nfunc x() {}\n", "2024-01-01 00:00:00"), ("r", "b.go", "package b\n", "2024-01-01 00:00:00")])
    put(1, [("r", "a.go", "package a\n\nfunc y() {}\n", "2024-01-02 00:00:00"), ("r", "b.go", "old", "2023-01-01 00:00:00")])
    got = {r["path"]: r["text"] for r in incremental.current(spark, target).collect()}
    assert got == {"a.go": "package a\n\nfunc y() {}\n", "b.go": "package b\n"}
    symbols = spark.read.parquet(f"{target}/symbols").where("v = 1").selectExpr("inline(symbols)")
    assert "y" in {r["name"] for r in symbols.collect()}


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = incremental.event_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()


def test_relative_imports_and_go_modules(spark, tmp_path):
    root = tmp_path / "r"
    files = {
        "web/a.ts": "import { run } from './b'\nimport { x } from './lib'\nexport function go() { run() }\n", "web/b.ts": "export function run() {}\n", "web/lib/index.ts": "export function x() {}\n",
        "go.mod": "module example.com/top\n\ngo 1.22\n", "main.go": "package main\n\nfunc main() {}\n", "svc/go.mod": "module example.com/svc\n", "svc/internal/db/db.go": "package db\n\nfunc Open() {}\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    g = repository.ingest(spark, str(root), "r")
    edges = {(r["rel_type"], r["src_id"], r["dst_id"].split(":")[1]) for r in g.edges("IMPORTS", "DEPENDS_ON").where("dst_id LIKE 'Module:%'").collect()}
    assert {("IMPORTS", "File:web/a.ts", "web/b.ts"), ("IMPORTS", "File:web/a.ts", "web/lib/index.ts")} <= edges
    assert {(k, d) for k, _, d in edges if k == "DEPENDS_ON"} == {("DEPENDS_ON", "web/b.ts"), ("DEPENDS_ON", "web/lib/index.ts")}
    mods = {r["path"]: (r["importPath"], r["visibility"]) for r in g.nodes("Module").where("language = 'go'").collect()}
    assert mods == {"main.go": ("example.com/top", "public"), "svc/internal/db/db.go": ("example.com/svc/internal/db", "internal")}


def test_several_repositories_in_one_store(spark, tree, tmp_path):
    out = str(tmp_path / "store")
    repository.ingest(spark, tree, "one", out)
    g = repository.ingest(spark, tree, "two", out)
    count = lambda g, repo: (g.nodes("Function").where(f"repo = '{repo}'").count(), g.edges().where(f"repo = '{repo}'").count())
    assert count(g, "one") == count(g, "two") and count(g, "one")[0] == 5


def test_reingest_reads_only_what_changed(spark, tree, tmp_path, monkeypatch):
    out = str(tmp_path / "store")
    repository.reingest(spark, tree, "demo", out)
    repository.ingest(spark, tree, "other", out)
    seen = []
    analyze = repository.analyze
    monkeypatch.setattr(repository, "analyze", lambda files: seen.append(sorted(r["path"] for r in files.collect())) or analyze(files))
    monkeypatch.setattr(repository.CodeGraph, "write", lambda *a: pytest.fail("nothing has changed"))
    _, counts = repository.reingest(spark, tree, "demo", out)
    assert set(counts) == {"unchanged"} and seen == [[]]
    monkeypatch.undo()
    monkeypatch.setattr(repository, "analyze", lambda files: seen.append(sorted(r["path"] for r in files.collect())) or analyze(files))
    with open(f"{tree}/main.go", "a") as f:
        f.write("\nfunc more() {\n\thelper()\n}\n")
    os.utime(f"{tree}/main.go", (2e9, 2e9))
    os.remove(f"{tree}/app/b.py")
    g, counts = repository.reingest(spark, tree, "demo", out)
    assert seen[-1] == ["main.go"] and counts["changed"] == 1 and counts["deleted"] == 1
    mine = {r["id"] for r in g.nodes("Function").where("repo = 'demo'").collect()}
    assert mine == {"Function:main.go:main", "Function:main.go:more", "Function:lib/util.go:helper", "Function:app/a.py:go"}
    assert g.edges("OVERRIDES").where("repo = 'demo'").count() == 0 and g.edges("OVERRIDES").where("repo = 'other'").count() == 1
    monkeypatch.undo()
    whole = repository.ingest(spark, tree, "demo")
    assert sorted(map(tuple, g.edges().where("repo = 'demo'").collect()), key=str) == sorted(map(tuple, whole.edges().collect()), key=str)
