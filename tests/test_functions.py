import pytest
from pyspark.sql import functions as F

from loomgraph.functions import names, paths


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "language"), [
    ("a.go", "go"), ("a.ts", "typescript"), ("a.tsx", "tsx"), ("a.js", "javascript"), ("a.jsx", "jsx"), ("a.py", "python"), ("a.rb", "ruby"),
    ("a.java", "java"), ("a.rs", "rust"), ("a.c", "c"), ("a.H", "c"), ("a.cpp", "cpp"), ("a.hpp", "cpp"), ("a.cc", "cpp"), ("a.xyz", ""), ("Makefile", ""),
])
def test_language(spark, path, language):
    assert one(spark, paths.detect_language(F.col("p")), p=path) == language


@pytest.mark.parametrize(("text", "n"), [("", 0), ("hello\n", 1), ("a\nb\nc\n", 3), ("line1\nline2", 2)])
def test_line_count(spark, text, n):
    assert one(spark, paths.line_count(F.col("t")), t=text) == n


@pytest.mark.parametrize(("path", "yes"), [
    ("test_models.py", True), ("models_test.py", True), ("tests/conftest.py", True), ("user_spec.rb", True), ("user_test.rb", True), ("a_test.go", True),
    ("x.test.ts", True), ("x.spec.tsx", True), ("src/contest.py", False), ("latest/a.go", False),
])
def test_test_files(spark, path, yes):
    assert one(spark, paths.is_test_file(F.col("p")), p=path) is yes


@pytest.mark.parametrize(("glob", "path", "yes"), [
    ("*.go", "main.go", True), ("*.go", "cmd/main.go", False), ("internal/*/config.go", "internal/x/config.go", True), ("main.?o", "main.go", True),
    ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[a", "a", False), ("a\\*", "a*", True), ("**", "a", True), ("a\\", "a", False),
])
def test_glob(spark, glob, path, yes):
    assert one(spark, paths.glob_match(F.col("p"), glob), p=path) is yes


@pytest.mark.parametrize(("q", "kind"), [
    ("*.go", "fuzzy"), ("src/**/*.ts", "fuzzy"), ("main.?o", "fuzzy"), ("cmd/main.go", "file"), ("src/utils/helpers.ts", "file"),
    ("getUserByID", "exact"), ("get_user_by_id", "exact"), ("HTTP handler for authentication", "exact"), ("", "exact"),
])
def test_classifier(spark, q, kind):
    assert names.classify_query(q) == kind
    assert one(spark, names.classify_query_column(F.col("q")), q=q) == kind


def test_similarity(spark):
    s = names.similarity(F.col("a"), F.col("b"))
    assert one(spark, s, a="getUser", b="getUser") == 1.0
    assert one(spark, s, a="getUser", b="getUserByID") == pytest.approx(1 - 4 / 11)
    assert one(spark, s, a="", b="") == 1.0
    assert one(spark, s, a="getUser", b="deleteItem") < 0.6


@pytest.mark.parametrize(("q", "bare"), [("get*Handler", "getHandler"), ("*.go", ".go"), ("*", ""), ("main.?o", "main.o"), ("get*User*By?ID", "getUserByID")])
def test_strip_wildcards(spark, q, bare):
    assert one(spark, names.strip_wildcards(F.col("q")), q=q) == bare


def test_paths(spark):
    assert one(spark, paths.dirname(F.col("p")), p="a") == "."
    assert one(spark, paths.parent(F.col("p")), p="a") == ""
    assert one(spark, paths.dirname(F.col("p")), p="/a") == "/"
    assert one(spark, paths.resolve_import(F.col("p"), F.lit("../lib/./x")), p="src/app/main.ts") == "src/lib/x"
    assert one(spark, paths.clean_path(F.col("p")), p="a/../..//b/") == "../b"
    assert one(spark, paths.normalize_module(F.col("p")), p="a/b.tsx") == "a/b"
    assert one(spark, paths.go_module_visibility(F.col("p")), p="x/internal") == "internal"
    assert one(spark, paths.is_go_stdlib(F.col("p")), p="net/http") is True
    assert one(spark, paths.is_external_import("typescript", F.col("p")), p="./x") is False


def test_binary(spark):
    df = spark.createDataFrame([(bytearray(b"@\x00"),), (bytearray(b"\x10\x01"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in df.select(paths.is_binary(F.col("c"))).collect()] == [True, False, False]


def test_texts(spark):
    assert one(spark, names.signature(F.col("t")), t="func A(x int) { y }") == "func A(x int)"
    assert one(spark, names.receiver_type(F.col("t")), t="(s *Server)") == "Server"
    assert one(spark, names.module_kind(F.col("t")), t="const a = 1") == "cjs"
    assert one(spark, names.ending_line(F.lit(3), F.lit(4))) == 6
    assert one(spark, names.to_int(F.col("t")), t="12.9") == 12
    assert one(spark, names.to_int(F.col("t")), t="x") == 0
    assert one(spark, names.truncate_middle(F.col("t"), 4), t="abcdefgh") == "ab\n... [truncated, 8 total chars] ...\ngh"


@pytest.mark.parametrize(("rules", "path", "is_dir", "yes"), [
    ([("", "*.log")], "a/b.log", False, True), ([("", "/b.log")], "a/b.log", False, False), ([("", "build/")], "build", True, True),
    ([("", "build/")], "build", False, False), ([("src", "*.tmp")], "src/x/a.tmp", False, True), ([("src", "*.tmp")], "lib/a.tmp", False, False),
    ([("", "*.log"), ("", "!keep.log")], "keep.log", False, False), ([("", "a/**/z")], "a/b/c/z", False, True), ([("", "a/**/z")], "a/z", False, True),
    ([("", "# x"), ("", "")], "x", False, False), ([("", "docs/*.md")], "docs/sub/a.md", False, False),
])
def test_ignore(rules, path, is_dir, yes):
    assert paths.ignored(path, is_dir, rules) is yes


def test_answers():
    assert names.final_answer("so FINAL(42)") == ("text", "42")
    assert names.final_answer("FINAL_VAR(x)") == ("var", "x")
    assert names.final_answer("```repl\nFINAL(1)\n```") is None
    assert names.code_blocks("```repl\na = 1\n```\n```python\nb\n```") == ["a = 1\n"]
