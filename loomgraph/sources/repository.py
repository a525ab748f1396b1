"""A source tree as a graph: walk, filter, parse, resolve; and what has changed since the last time."""
from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import names, paths
from loomgraph.operators import resolve
from loomgraph.plans.graph import CodeGraph
from loomgraph.sources import extract
from loomgraph.sources.manifest import incremental

#: Files whose lines say what to leave out, in every directory.
IGNORE_FILES = (".gitignore", ".indexignore")


@dataclass
class Walk:
    """What a walk met: (path, is_dir, mtime) of what stays, symlinks left out, entries that failed."""

    entries: list[tuple[str, bool, datetime]] = field(default_factory=list)
    symlinks: int = 0
    errors: list[str] = field(default_factory=list)


def walk(root: str, ignore_files=IGNORE_FILES) -> Walk:
    """A lexical walk by the driver; .git and submodules are left out, ignored directories are not entered."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    out = Walk()

    def visit(rel: str, rules: list[tuple[str, str]]) -> None:
        here = os.path.join(root, rel) if rel else root
        rules = list(rules)
        for name in ignore_files:
            try:
                with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                    rules += [(rel, line.rstrip("\n")) for line in f]
            except FileNotFoundError:
                pass
            except OSError as e:
                out.errors.append(f"{rel}/{name}: {e}")
        try:
            found = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError as e:
            out.errors.append(f"{rel}: {e}")
            return
        for e in found:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_symlink():
                    out.symlinks += 1
                    continue
                is_dir = e.is_dir()
                submodule = is_dir and os.path.isfile(os.path.join(e.path, ".git"))
                if (is_dir and e.name == ".git") or submodule or paths.ignored(path, is_dir, rules):
                    continue
                at = datetime.fromtimestamp(int(e.stat().st_mtime), timezone.utc)
            except OSError as x:
                out.errors.append(f"{path}: {x}")
                continue
            out.entries.append((path, is_dir, at))
            if is_dir:
                visit(path, rules)

    visit("", [])
    return out


def manifest(spark: SparkSession, root: str, repo: str, found: Walk | None = None) -> DataFrame:
    """(repo, path, is_dir, mtime) of a tree."""
    found = found or walk(root)
    rows = [(repo, *e) for e in found.entries]
    return spark.createDataFrame(rows, "repo string, path string, is_dir boolean, mtime timestamp")


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """files with their text, by Spark's binary source; binary files are dropped.

    The source skips names that begin with a dot or an underscore; those, such as
    __init__.py, are read where the walk was made.
    """
    base = "file:" + os.path.abspath(root) if "://" not in root else root
    hidden = [r["path"] for r in files.where(F.col("path").rlike(r"(?:^|/)[._]")).select("path").collect()]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    rel = F.url_decode(F.replace(F.regexp_replace("path", f"^{base.replace('.', '[.]')}/", ""), F.lit("+"), F.lit("%2B")))
    raw = raw.select(rel.alias("path"), "content")
    if hidden:
        rows = []
        for path in hidden:
            with open(os.path.join(root, path), "rb") as f:
                rows.append((path, bytearray(f.read())))
        raw = raw.unionByName(spark.createDataFrame(rows, "path string, content binary"))
    raw = raw.where(~paths.is_binary(F.col("content")))
    return files.join(raw, "path").withColumn("text", F.decode("content", "UTF-8")).drop("content")


def analyze(files: DataFrame) -> DataFrame:
    """(repo, path, symbols, refs) of files(repo, path, text); files that do not parse are dropped, as are tests and generated code."""
    df = files.withColumn("language", paths.detect_language(F.col("path")))
    p = F.col("path")
    df = df.where(F.col("language").isin(*extract._REGISTRY) & ~paths.is_test_file(p) & ~paths.is_generated_file(p))
    registry = dict(extract._REGISTRY)

    def run(batches):
        for pdf in batches:
            rows = []
            for repo, path, text, language in pdf[["repo", "path", "text", "language"]].itertuples(index=False):
                try:
                    symbols, refs = registry[language](text, path)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows.append((repo, path, symbols, refs))
            yield pd.DataFrame(rows, columns=["repo", "path", "symbols", "refs"])

    schema = f"repo string, path string, symbols array<struct<{_struct(extract.SYMBOL)}>>, refs array<struct<{_struct(extract.REF)}>>"
    return df.select("repo", "path", "text", "language").mapInPandas(run, schema)


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (c.strip().split(" ", 1) for c in ddl.split(", ")))


def facts_of(texts: DataFrame) -> DataFrame:
    """(repo, path, mtime, lineCount, goModule, symbols, refs) of files(repo, path, mtime, text): all that a graph needs of a text.

    goModule: the module line of a go.mod. Files that are not parsed have null symbols and refs.
    """
    parsed = analyze(texts)
    line = F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1)
    module = F.when((paths.basename(F.col("path")) == "go.mod") & (line != ""), line)
    own = texts.select("repo", "path", "mtime", paths.line_count(F.col("text")).alias("lineCount"), module.alias("goModule"))
    return own.join(parsed, ["repo", "path"], "left")


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of several symbols of one key the one that stands last in its file."""
    w = Window.partitionBy(*keys).orderBy(F.desc("startingLine"), F.desc("endingLine"))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _go_paths(modules: DataFrame, facts: DataFrame) -> DataFrame:
    """Modules of Go with importPath and visibility from the nearest go.mod above them."""
    mods = facts.where("goModule IS NOT NULL").select("repo", paths.parent(F.col("path")).alias("dir"), "goModule")
    parts = F.split(paths.parent(F.col("path")), "/")
    above = F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    near = modules.where("language = 'go'").select("repo", "id", F.explode(F.array_distinct(above)).alias("dir")).join(mods, ["repo", "dir"])
    near = near.groupBy("repo", "id").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "goModule")).alias("m")).select("repo", "id", "m.dir", "m.goModule")
    at = paths.go_import_path(F.col("goModule"), F.col("dir"), F.col("path"))
    out = modules.join(near, ["repo", "id"], "left").withColumn("importPath", F.coalesce(at, "importPath"))
    seen = F.when(F.col("language") == "go", paths.go_module_visibility(F.col("importPath"))).otherwise(F.col("visibility"))
    return out.withColumn("visibility", F.when(F.col("importPath").isNull(), F.col("visibility")).otherwise(seen)).drop("dir", "goModule")


def build(spark: SparkSession, repo: str, entries: DataFrame, facts: DataFrame) -> CodeGraph:
    """The graph of a repository from its manifest and what its files hold."""
    analyzed = facts.where("symbols IS NOT NULL")
    ident = lambda kind, *cols: F.concat_ws(":", F.lit(kind), *cols)
    folders = entries.where("is_dir").select("repo", ident("Folder", "path").alias("id"), "path", F.col("mtime").alias("lastUpdated"))
    files = facts.select(
        "repo", ident("File", "path").alias("id"), "path", paths.basename(F.col("path")).alias("filename"), paths.detect_language(F.col("path")).alias("language"),
        "lineCount", F.col("mtime").alias("lastUpdated"),
    )
    s = analyzed.select("repo", F.inline("symbols"))
    end = names.ending_line(F.col("line_number"), F.col("line_count")).cast("int").alias("endingLine")
    common = ["repo", "name", "path", "language", "visibility", F.col("line_number").alias("startingLine"), end]
    stored = names.truncate(F.col("source")).alias("source")
    key = ["repo", "name", "path"]
    functions = _last(s.where("kind IN ('function', 'method')").select(ident("Function", "path", "name").alias("id"), *common, "signature", stored, F.col("complexity").alias("cyclomaticComplexity"), "decorators", "parent_name"), key)
    classes = _last(s.where("kind IN ('class', 'struct', 'interface')").select(ident("Class", "path", "name").alias("id"), *common, "kind", stored, "decorators"), key)
    modules = _last(s.where("kind = 'module'").select(ident("Module", "path", "name").alias("id"), *common, F.col("import_path").alias("importPath"), F.col("module_kind").alias("kind")), key)
    modules = _go_paths(modules, facts)
    row = spark.createDataFrame([(repo, f"Repository:{repo}", repo)], "repo string, id string, name string")

    refs = analyzed.select("repo", F.inline("refs"))
    own = functions.select("repo", F.col("path").alias("file_path"), F.col("name").alias("from_symbol"), F.col("id").alias("own"))
    own = own.unionByName(classes.select("repo", F.col("path").alias("file_path"), F.col("name").alias("from_symbol"), F.col("id").alias("own"))).dropDuplicates(["repo", "file_path", "from_symbol"])
    refs = refs.join(own, ["repo", "file_path", "from_symbol"], "left").withColumn("from_id", F.coalesce("own", ident("File", "file_path"))).drop("own")
    known = functions.select("repo", "name", "id").unionByName(classes.select("repo", "name", "id")).unionByName(modules.select("repo", "name", "id"))
    resolved = resolve.resolved_edges(refs, known)
    resolved = resolved.unionByName(resolve.path_imports(refs, modules)).distinct()
    externals, external_edges = resolve.external_references(refs)

    def edge(df: DataFrame, rel: str, src, dst) -> DataFrame:
        return df.select("repo", F.lit(rel).alias("rel_type"), src.alias("src_id"), dst.alias("dst_id"))

    def inside(df: DataFrame) -> DataFrame:
        up = paths.parent(F.col("path"))
        src = F.when(up == "", ident("Repository", "repo")).otherwise(F.concat(F.lit("Folder:"), up))
        return edge(df, "CONTAINS", src, F.col("id"))

    in_file = F.concat(F.lit("File:"), F.col("path"))
    edges = inside(folders).unionByName(inside(files)).unionByName(resolved).unionByName(external_edges)
    edges = edges.unionByName(edge(functions, "DEFINES", in_file, F.col("id"))).unionByName(edge(classes, "DEFINES", in_file, F.col("id")))
    edges = edges.unionByName(edge(functions.where("parent_name IS NOT NULL"), "HAS_METHOD", ident("Class", "path", "parent_name"), F.col("id")))
    edges = edges.unionByName(edge(modules, "HAS_MODULE", ident("Repository", "repo"), F.col("id")))
    exported = s.where("kind = 'function' AND visibility = 'public'").select("repo", "path", "name")
    exports = modules.select("repo", "path", F.col("id").alias("m")).join(exported, ["repo", "path"]).select("repo", F.lit("EXPORTS").alias("rel_type"), F.col("m").alias("src_id"), ident("Function", "path", "name").alias("dst_id"))
    edges = edges.unionByName(exports)
    # A module depends on the modules that its file imports; a method overrides that of the same name in a direct base.
    holder = modules.select("repo", F.concat(F.lit("File:"), F.col("path")).alias("src_id"), F.col("id").alias("m"))
    imported = resolved.where("rel_type = 'IMPORTS' AND dst_id LIKE 'Module:%'")
    edges = edges.unionByName(imported.join(holder, ["repo", "src_id"]).select("repo", F.lit("DEPENDS_ON").alias("rel_type"), F.col("m").alias("src_id"), "dst_id").where("src_id <> dst_id"))
    methods = functions.where("parent_name IS NOT NULL").select("repo", "name", "id", ident("Class", "path", "parent_name").alias("cls"))
    up = resolved.where("rel_type = 'INHERITS'").select("repo", F.col("src_id").alias("cls"), F.col("dst_id").alias("base"))
    over = methods.join(up, ["repo", "cls"]).join(methods.select("repo", "name", F.col("id").alias("of"), F.col("cls").alias("base")), ["repo", "name", "base"])
    edges = edges.unionByName(over.select("repo", F.lit("OVERRIDES").alias("rel_type"), F.col("id").alias("src_id"), F.col("of").alias("dst_id")))
    tables = {"Repository": row, "Folder": folders, "File": files, "Module": modules, "Class": classes, "Function": functions, "ExternalReference": externals}
    member = None
    for kind in ("Folder", "File", "Module", "Class", "Function", "ExternalReference"):
        part = edge(tables[kind], "BELONGS_TO", F.col("id"), ident("Repository", "repo"))
        member = part if member is None else member.unionByName(part)
    edges = edges.unionByName(member).withColumn("call_type", F.when(F.col("rel_type") == "CALLS", "direct"))
    return CodeGraph(spark, tables | {"Function": functions.drop("parent_name")}, edges.dropDuplicates(["repo", "rel_type", "src_id", "dst_id"]))


def ingest(spark: SparkSession, root: str, repo: str, out: str | None = None) -> CodeGraph:
    """Index, analyse and resolve a tree; with out, the graph is written there, beside other repositories, and read back."""
    entries = manifest(spark, root, repo)
    texts = contents(spark, root, entries.where("NOT is_dir")).persist()
    facts = facts_of(texts).persist()  # each file is parsed once, whatever tables are made from it
    graph = build(spark, repo, entries, facts)
    if out:
        graph = _store(spark, graph, facts, out)
        facts.unpersist()
        texts.unpersist()
    return graph


def _store(spark: SparkSession, graph: CodeGraph, facts: DataFrame, out: str) -> CodeGraph:
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(f"{out}/facts")
    graph.write(out)
    return CodeGraph.read(spark, out)


def reingest(spark: SparkSession, root: str, repo: str, out: str) -> tuple[CodeGraph, dict[str, int]]:
    """The store at out brought up to the tree, and how many files were new, changed, deleted and unchanged.

    Only new and changed files are read and parsed; if there are none, and none was
    deleted, nothing is written. A repository that the store lacks is ingested whole.
    """
    try:
        old = spark.read.parquet(f"{out}/facts").where(F.col("repo") == repo)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is None or old.isEmpty():
        graph = ingest(spark, root, repo, out)
        return graph, {"new": graph.nodes("File").where(F.col("repo") == repo).count()}
    entries = manifest(spark, root, repo)
    files = entries.where("NOT is_dir")
    states = incremental(files, old.select("repo", "path", "mtime")).persist()
    fresh = states.where("state IN ('new', 'changed')").select("repo", "path")
    texts = contents(spark, root, files.join(fresh, ["repo", "path"], "left_semi")).persist()
    parsed = facts_of(texts).persist()
    binary = fresh.join(texts.select("repo", "path"), ["repo", "path"], "left_anti")  # read, and left out again
    counts = {r["state"]: r["count"] for r in states.join(binary, ["repo", "path"], "left_anti").groupBy("state").count().collect()}
    if not set(counts) - {"unchanged"}:
        return CodeGraph.read(spark, out), counts
    kept = old.join(states.where("state = 'unchanged'").select("repo", "path"), ["repo", "path"], "left_semi")
    facts = kept.select(*parsed.columns).unionByName(parsed).persist()
    facts.count()  # what is read from the store is held before the store is written
    return _store(spark, build(spark, repo, entries, facts), facts, out), counts


def changes(spark: SparkSession, root: str, repo: str, previous: DataFrame) -> DataFrame:
    """(repo, path, mtime, state) of the tree's files against the File nodes of the last run."""
    now = manifest(spark, root, repo).where("NOT is_dir")
    old = previous.where(F.col("repo") == repo).select("repo", "path", F.col("lastUpdated").alias("mtime"))
    return incremental(now, old)
