import pytest
from pyspark.sql import functions as F

from loomgraph.operators import analytics, mutate, resolve, search, traverse, where
from loomgraph.operators.freeform import FreeGraph, refuse_commands
from loomgraph.plans.graph import CodeGraph


@pytest.fixture(scope="module")
def graph(spark):
    f = spark.createDataFrame(
        [("r", n, n, f"{n}.go", "go", c, ["d"] if n == "deco" else []) for n, c in (("main", 1), ("funcA", 7), ("funcB", 9), ("lone", 3), ("deco", 2))] + [("other", "x", "funcA", "x.go", "go", 1, [])],
        "repo string, id string, name string, path string, language string, cyclomaticComplexity int, decorators array<string>",
    )
    c = spark.createDataFrame([("r", n, n, "c.go") for n in ("Base", "Derived", "Iface")], "repo string, id string, name string, path string")
    e = spark.createDataFrame(
        [("r", "CALLS", "main", "funcA"), ("r", "CALLS", "funcA", "main"), ("r", "CALLS", "funcA", "funcB"), ("r", "INHERITS", "Derived", "Base"), ("r", "IMPLEMENTS", "Derived", "Iface")],
        "repo string, rel_type string, src_id string, dst_id string",
    )
    files = spark.createDataFrame([("r", p, p, p.rsplit("/", 1)[-1]) for p in ("cmd/main.go", "pkg/user.go", "pkg/db.go", "README")], "repo string, id string, path string, filename string")
    return CodeGraph(spark, {"Function": f, "Class": c, "File": files}, e)


def names(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_cycle(graph):
    assert names(traverse.callees(graph, "r", "main", 2), "name", "depth") == {("funcA", 1), ("funcB", 2)}
    assert names(traverse.callees(graph, "r", "main", 2, by="id"), "name", "depth") == {("funcA", 1), ("funcB", 2)}
    assert traverse.callees(graph, "other", "main", 3).count() == 0


def test_hierarchy(graph):
    assert names(traverse.hierarchy(graph, "r", "Derived", "up"), "name", "relation") == {("Base", "INHERITS"), ("Iface", "IMPLEMENTS")}
    assert names(traverse.hierarchy(graph, "r", "Base", "down"), "name") == {"Derived"}
    assert traverse.hierarchy(graph, "r", "Base", "sideways").count() == 0


def test_call_chain(graph):
    row = traverse.call_chain(graph, "r", "main", "funcB").first()
    assert (row["found"], row["depth"], row["path"]) == (True, 2, ["main", "funcA", "funcB"])
    assert traverse.call_chain(graph, "r", "funcB", "main").first()["found"] is False
    assert traverse.call_chain(graph, "r", "main", "main").first()["depth"] == 0


def test_shortest_path(graph):
    p = traverse.shortest_path(graph.edges(), "main", "funcB").first()
    assert (p["hops"], p["path"]) == (2, ["main", "funcA", "funcB"])
    assert traverse.shortest_path(graph.edges(), "main", "lone").count() == 0
    assert traverse.shortest_path(graph.edges(), "main", "main").count() == 0


@pytest.mark.parametrize(("depth", "clamped"), [(0, 1), (1, 1), (3, 3), (9, 3)])
def test_clamp(depth, clamped):
    assert traverse.clamp_depth(depth) == clamped


def test_dead_code(graph):
    assert names(analytics.dead_code(graph, "r"), "name") == {"lone", "deco", "Derived"}
    assert names(analytics.dead_code(graph, "r", exclude_decorated=True, exclude="lo*, ["), "name") == {"Derived"}


def test_search(graph):
    assert search.find_function(graph, "r", "funcA").count() == 1
    assert names(search.search_names(graph, "r", "func?"), "name") == {"funcA", "funcB"}
    assert names(search.search_names(graph, "r", "funcA and funcB"), "name") == {"funcA", "funcB"}
    assert search.search_names(graph, "r", "*").count() == 0
    assert names(search.find_file(graph, "r", "*.go"), "path") == {"cmd/main.go", "pkg/user.go", "pkg/db.go"}
    with pytest.raises(ValueError):
        search.find_function(graph, "", "x")


def test_repo_map(graph):
    m = analytics.repo_map(graph, "r").collect()
    assert [(r["dir"], [f["filename"] for f in r["files"]]) for r in m] == [(".", ["README"]), ("cmd", ["main.go"]), ("pkg", ["db.go", "user.go"])]


def test_complexity(graph):
    assert [r["name"] for r in analytics.most_complex(graph, "r").collect()] == ["funcB", "funcA"]
    assert analytics.most_complex(graph, "r", limit=0, min_complexity=0).count() == 5


def test_context(graph):
    c = analytics.symbol_context(graph, "r", "funcA").first()
    assert (c["callers"], c["callees"], c["siblings"]) == (["main"], ["funcB", "main"], [])
    assert analytics.symbol_context(graph, "r", "absent").count() == 0


def test_where(graph):
    assert names(where.find(graph, "Function", {"repository": {"name": "r"}, "calls_some": {"name": "funcB"}}), "id") == {"funcA"}
    assert names(where.find(graph, "Function", {"decorators_contains": "d"}), "id") == {"deco"}
    assert names(where.find(graph, "Class", {"inherits_NONE": {}}), "id") == {"Base", "Iface"}
    with pytest.raises(ValueError):
        where.find(graph, "Function", {"nope_gt": 1})


def test_pages(graph):
    f = graph.nodes("Function").where("repo = 'r'").select("id", "name")
    first = where.page(f, ["name"], 2)
    assert [(r["name"], r["has_next"]) for r in first.collect()] == [("deco", True), ("funcA", True)]
    assert [(r["name"], r["has_next"]) for r in where.page(f, ["name"], 9, ("lone",)).collect()] == [("main", False)]


def test_mutations(graph):
    g, count = mutate.delete_nodes(graph, "Function", {"name": "funcA", "repository": {"name": "r"}})
    assert tuple(count.first()) == (1, 3) and g.edges("CALLS").count() == 0
    g = mutate.connect(graph, "Function", "calls", {"name": "lone"}, {"name_in": ["main", "deco"]}, "direct")
    assert g.edges("CALLS").count() == 5
    assert mutate.connect(g, "Function", "calls", {"name": "lone"}, {"name": "main"}).edges("CALLS").count() == 5
    assert mutate.disconnect(g, "Function", "calls", {"name": "lone"}, {}).edges("CALLS").count() == 3
    g = mutate.delete_repository(graph, "r")
    assert g.nodes("Function").count() == 1 and g.edges().count() == 0


def test_round_trip(graph, spark, tmp_path):
    graph.write(str(tmp_path / "g"))
    back = CodeGraph.read(spark, str(tmp_path / "g"))
    assert back.nodes("Function").count() == 6 and back.edges("CALLS").count() == 3 and back.nodes("Module").count() == 0


def test_resolution(spark):
    symbols = spark.createDataFrame([("r", "main", "1"), ("r", "helper", "2"), ("r", "helper", "3")], "repo string, name string, id string")
    refs = spark.createDataFrame(
        [("r", "1", "main.go", "helper", "calls", False, None), ("r", "1", "main.go", "fmt.Println", "calls", False, None), ("r", "1", "src/m.ts", "./lib", "imports", False, None), ("r", "1", "main.go", "fmt", "imports", True, "fmt")],
        "repo string, from_id string, file_path string, to_name string, kind string, is_external boolean, external_import_path string",
    )
    files = spark.createDataFrame([("r", "src/lib/index.ts")], "repo string, path string")
    s = resolve.statistics(refs, symbols, files).first()
    assert (s["n_symbols"], s["n_references"], s["n_resolved"], s["n_unresolved"]) == (3, 3, 2, 1)
    assert resolve.resolved_edges(refs, symbols).count() == 0  # helper is ambiguous
    nodes, edges = resolve.external_references(refs)
    assert nodes.count() == edges.count() == 1


def test_freeform(graph, spark):
    free = FreeGraph.of(graph)
    assert {(r["what"], r["name"]): r["n"] for r in free.metadata().collect()}[("label", "Function")] == 6
    assert names(free.search("FUNCB"), "id") == {"funcB"}
    nodes, edges = free.neighbors("funcA", "CALLS")
    assert names(nodes, "id") == {"main", "funcA", "funcB"} and edges.count() == 3
    assert free.sql("SELECT count(*) AS n FROM nodes WHERE id = :x", {"x": "main"}).first()["n"] == 1
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a = 1", "CACHE TABLE nodes"):
        with pytest.raises(PermissionError):
            refuse_commands(spark, bad)
    with pytest.raises(KeyError):
        free.get_node("absent")
    with pytest.raises(LookupError):
        free.shortest_path("main", "lone")
    with pytest.raises(ValueError):
        free.neighbors("main", "x y")
    assert free.union(free).nodes.count() == free.nodes.count()


def test_merge_last_wins(spark):
    rows = spark.createDataFrame([("r", "f", "p", "old", 1), ("r", "f", "p", "new", 2)], "repo string, name string, path string, signature string, seq int")
    g = mutate.merge_nodes(CodeGraph(spark), "Function", rows, seq="seq")
    g = mutate.merge_nodes(g, "Function", rows.where("seq = 1").drop("seq"))
    assert [r["signature"] for r in g.nodes("Function").collect()] == ["old"]
    g = mutate.set_sources(g, spark.createDataFrame([("r", "f", "p", "x" * 7000)], "repo string, name string, path string, source string"))
    assert g.nodes("Function").select(F.length("source")).first()[0] == 6000
    g = mutate.upsert_repository(g, "r", "/x", F.lit("2024-01-01 00:00:00.5").cast("timestamp"))
    assert g.nodes("Repository").first()["lastIndexed"].microsecond == 0
