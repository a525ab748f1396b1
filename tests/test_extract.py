import pytest

from loomgraph.sources import extract


def complexity(language, text, name="f"):
    symbols, _ = extract.extractor(language)(text, f"x.{language}")
    return next(s["complexity"] for s in symbols if s["name"] == name)


def go(body):
    return complexity("go", "package p\n\nfunc f(a, b bool) {\n" + body + "\n}\n")


@pytest.mark.parametrize(("body", "n"), [
    ("", 1), ("if a { }", 2), ("for i := range x { }", 2), ("switch x {\ncase 1:\ncase 2:\ncase 3:\ndefault:\n}", 4),
    ("select {\ncase <-c:\ncase <-d:\n}", 3), ("if a && b { }", 3), ("if a || b { }", 3), ("switch v := x.(type) {\ncase int:\ncase string:\n}", 1),
    ("for { if a && b { }\nif a || b { } }", 6), ('s := "if for && ||" // if', 1),
])
def test_go_complexity(body, n):
    assert go(body) == n


@pytest.mark.parametrize("language", ["typescript", "javascript", "tsx"])
@pytest.mark.parametrize(("body", "n"), [
    ("", 1), ("if (a) {}", 2), ("for (const x of y) {}", 2), ("while (a) {}", 2), ("do { x() } while (a)", 2), ("switch (a) { case 1: break; case 2: break; default: }", 3),
    ("if (a && b) {}", 3), ("return a ?? b", 2), ("return a?.b", 2), ("try { } catch (e) { }", 2), ("return a ? 1 : 2", 2),
])
def test_script_complexity(language, body, n):
    assert complexity(language, "function f(a, b) {\n" + body + "\n}\n") == n


@pytest.mark.parametrize(("body", "n"), [
    ("pass", 1), ("if a: pass", 2), ("for x in a: pass", 2), ("while a: pass", 2), ("try:\n        pass\n    except E:\n        pass", 2),
    ("if a and b or c: pass", 4), ("if a:\n        pass\n    elif b:\n        pass", 3), ("assert a", 2),
])
def test_python_complexity(body, n):
    assert complexity("python", "def f(a, b):\n    " + body + "\n") == n


@pytest.mark.parametrize(("body", "n"), [
    ("", 1), ("if a\n  b\nend", 2), ("unless a\n b\nend", 2), ("while a\n b\nend", 2), ("until a\n b\nend", 2),
    ("case a\nwhen 1\nwhen 2\nwhen 3\nend", 4), ("begin\n a\nrescue\n b\nend", 2), ("if a && b || c\n d\nend", 4),
])
def test_ruby_complexity(body, n):
    assert complexity("ruby", "def f(a, b)\n" + body + "\nend\n") == n


def test_go_symbols_and_references():
    text = (
        'package shop\n\nimport (\n\t"fmt"\n\tdb "example.com/x/store"\n)\n\ntype Cart struct {\n\tBase\n\tn int\n}\n\ntype Item interface { Price() int }\n\n'
        "func (c *Cart) Add(x int) error {\n\tfmt.Println(x)\n\tc.save()\n\treturn db.Put(len(nil))\n}\n\nfunc helper() { run() }\n"
    )
    symbols, refs = extract.go(text, "shop/cart.go")
    assert [(s["name"], s["kind"]) for s in symbols] == [("shop", "module"), ("Add", "method"), ("helper", "function"), ("Cart", "struct"), ("Item", "interface")]
    add = symbols[1]
    assert (add["parent_name"], add["visibility"], add["signature"], add["line_number"], add["line_count"]) == ("Cart", "public", "func (c *Cart) Add(x int) error", 15, 5)
    calls = {(r["from_symbol"], r["to_name"], r["is_external"]) for r in refs if r["kind"] == "calls"}
    assert calls == {("Add", "Println", True), ("Add", "Put", True), ("helper", "run", False)}
    assert ("Cart", "Base") in {(r["from_symbol"], r["to_name"]) for r in refs if r["kind"] == "inherits"}


def test_typescript_symbols():
    text = "import { a as b } from './a'\nimport fs from 'fs'\n@Injectable()\nexport class S extends T implements U, V {\n  run(x: number): void {\n    b(x)\n  }\n}\nenum E { A }\nexport function go() { return 1 }\n"
    symbols, refs = extract.extractor("typescript")(text, "src/s.ts")
    got = {s["name"]: s for s in symbols}
    assert got["s"]["kind"] == "module" and got["s"]["module_kind"] == "esm"
    assert got["S"]["decorators"] == ["Injectable"] and got["E"]["kind"] == "class" and got["run"]["parent_name"] == "S" and got["go"]["visibility"] == "public"
    kinds = {(r["kind"], r["to_name"], r["is_external"]) for r in refs}
    assert {("inherits", "T", False), ("implements", "U", False), ("implements", "V", False), ("imports", "./a", False), ("imports", "fs", True), ("calls", "a", False)} <= kinds


def test_python_symbols():
    text = "import os.path\nfrom .m import x\n\n@dec\ndef _f(a):\n    g(a.h())\n\nclass C(Base):\n    def m(self):\n        pass\n"
    symbols, refs = extract.python(text, "pkg/mod.py")
    got = {s["name"]: s for s in symbols}
    assert got["mod"]["import_path"] == "pkg.mod" and got["_f"]["visibility"] == "private" and got["_f"]["decorators"] == ["dec"] and got["m"]["parent_name"] == "C"
    assert {(r["to_name"], r["kind"], r["is_external"]) for r in refs} == {
        ("os.path", "imports", True), ("x", "imports", False), ("g", "calls", False), ("h", "calls", False), ("Base", "inherits", False)
    }


def test_ruby_symbols():
    text = "require 'json'\nrequire_relative 'a/b'\nmodule M\n  class C < Base\n    def go\n      run(1)\n      stop\n    end\n    private\n    def self.hid\n    end\n  end\nend\n"
    symbols, refs = extract.ruby(text, "m.rb")
    got = {s["name"]: s for s in symbols}
    assert got["M"]["kind"] == "module" and got["C"]["parent_name"] == "M" and got["go"]["visibility"] == "public" and got["hid"]["visibility"] == "private"
    assert {("json", True), ("a/b", False), ("run", False), ("stop", False), ("Base", False)} == {(r["to_name"], r["is_external"]) for r in refs}
