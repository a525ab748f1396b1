import io

import pytest

from loomgraph.plans.tools import Shell, Tools, Trace
from loomgraph.sources import repository


@pytest.fixture
def root(tmp_path):
    (tmp_path / "t/lib").mkdir(parents=True)
    (tmp_path / "t/a.py").write_text("from .b import run\n\nclass A(Base):\n    def go(self):\n        run()\n")
    (tmp_path / "t/b.py").write_text("class Base:\n    pass\n\ndef run():\n    inner()\n\ndef inner():\n    pass\n")
    return str(tmp_path / "t")


def test_tools(spark, root, tmp_path):
    t = Tools(repository.ingest(spark, root, "demo", str(tmp_path / "out")))
    assert len(t.names()) == 19
    some = {
        "name": "run", "pattern": "*.py", "query": "run", "path": "b.py", "names": "run, absent, A", "source_function": "go", "target_function": "inner",
    }
    got = {}
    for name in t.names():
        if name != "delete_repository":
            need = {k: some[k] for k, v in t.tools[name][1].items() if v is ...}
            got[name] = t.call(name, "demo", **need).collect()
    assert [r["name"] for r in got["get_callers"]] == ["go"] and [r["name"] for r in got["get_callees"]] == ["inner"]
    assert got["find_call_chain"][0]["found"] and got["find_call_chain"][0]["depth"] == 2
    assert [r["name"] for r in got["read_source"]] == ["run", "A"]
    assert {r["path"] for r in got["find_file"]} == {"a.py", "b.py"}
    assert not t.call("find_call_chain", "demo", source_function="go", target_function="absent").first()["found"]
    for bad in (lambda: t.call("absent", "demo"), lambda: t.call("find_file", "demo"), lambda: t.call("find_file", "", pattern="*"),
                lambda: t.call("find_file", "demo", pattern=""), lambda: t.call("get_repo_map", "demo", depth=1)):
        with pytest.raises(ValueError):
            bad()
    assert t.call("delete_repository", "demo").count() == 0 and t.call("find_function", "demo", name="run").count() == 0


def test_shell(spark, root, tmp_path):
    out, trace = io.StringIO(), Trace(str(tmp_path / "trace"))
    shell = Shell(spark, out, trace, str(tmp_path / "store"))
    shell.run(["", "help", f"ingest {root} demo", "list", "status", "nonsense", "delete absent", "ingest /absent x", "delete demo", "'", "list", "quit", "help"])
    said = out.getvalue().splitlines()
    assert said[0].startswith("ingest") and "3 Function" in said[1] and said[2] == "demo" and said[3].startswith("1 repositories")
    assert said[4].startswith("unknown command") and [s.startswith("error") for s in said[5:7]] == [True, True]
    assert said[7] == "deleted demo" and said[8].startswith("error") and len(said) == 9
    assert [x.split()[1] for x in (tmp_path / "trace").read_text().splitlines() if x.startswith("===")] == ["index", "analyze", "done", "index"]
