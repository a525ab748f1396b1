"""Dead code, complexity, statistics, maps and symbol context."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators.search import first_symbol
from loomgraph.operators.traverse import callees, callers
from loomgraph.plans.graph import CodeGraph, require


def _in(graph: CodeGraph, repo: str, kind: str) -> DataFrame:
    return graph.nodes(kind).where(F.col("repo") == repo)


def excluded(name: Column, globs: str) -> Column:
    """Whether a name matches one of the comma-separated globs; a malformed glob matches nothing."""
    out = F.lit(False)
    for g in (g.strip() for g in globs.split(",")):
        if g:
            out = out | paths.glob_match(name, g)
    return out


def dead_code(graph: CodeGraph, repo: str, exclude_decorated: bool = False, exclude: str = "", limit: int | None = 50) -> DataFrame:
    """(type, name, path, id): functions nobody calls and no class owns, classes nobody derives from, modules nobody imports."""
    require(repo=repo)

    def without(kind: str, *rels: str) -> DataFrame:
        used = graph.edges(*rels).where(F.col("repo") == repo).select(F.col("dst_id").alias("id"))
        return _in(graph, repo, kind).join(used, "id", "left_anti")

    functions = without("Function", "CALLS", "HAS_METHOD")
    functions = functions.where(~((F.coalesce("language", F.lit("")) == "go") & F.col("name").isin("main", "init")))
    if exclude_decorated:
        functions = functions.where(F.coalesce(F.size("decorators"), F.lit(0)) <= 0)
    out = None
    for rank, (kind, df) in enumerate((("function", functions), ("class", without("Class", "INHERITS", "IMPLEMENTS")), ("module", without("Module", "IMPORTS")))):
        df = df.where(~excluded(F.col("name"), exclude)).select(F.lit(rank).alias("rank"), F.lit(kind).alias("type"), "name", "path", "id")
        out = df if out is None else out.unionByName(df)
    if limit:
        out = out.orderBy("rank", "path", "name", "id").limit(limit)
    return out.drop("rank")


def complexity_of(graph: CodeGraph, repo: str, name: str) -> DataFrame:
    require(repo=repo, name=name)
    df = _in(graph, repo, "Function").where(F.col("name") == name)
    return df.select("name", "path", "id", F.coalesce("cyclomaticComplexity", F.lit(0)).alias("complexity"))


def most_complex(graph: CodeGraph, repo: str, limit: int = 10, min_complexity: int = 5) -> DataFrame:
    require(repo=repo)
    df = _in(graph, repo, "Function").select("name", "path", "id", F.coalesce("cyclomaticComplexity", F.lit(0)).alias("complexity"))
    df = df.where(F.col("complexity") >= min_complexity).orderBy(F.desc("complexity"), "path", "name", "id")
    return df.limit(limit) if limit > 0 else df


def repository_stats(graph: CodeGraph, repo: str) -> DataFrame:
    """(type, n): a row for each of the five counted node types, 0 included."""
    out = None
    for kind in ("File", "Folder", "Function", "Class", "Module"):
        df = _in(graph, repo, kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("type"), "n")
        out = df if out is None else out.unionByName(df)
    return out


def list_repositories(graph: CodeGraph) -> DataFrame:
    return graph.nodes("Repository").select("name").distinct().orderBy("name")


def symbol_counts(graph: CodeGraph, repo: str) -> DataFrame:
    """(path, n): functions and classes in each path."""
    symbols = _in(graph, repo, "Function").select("path").unionAll(_in(graph, repo, "Class").select("path"))
    return symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def repo_map_files(graph: CodeGraph, repo: str) -> DataFrame:
    """(dir, path, filename, symbols): each file with its directory ("." at the root) and number of symbols."""
    files = _in(graph, repo, "File").select("path", "filename").join(symbol_counts(graph, repo), "path", "left")
    return files.select(paths.dirname(F.col("path")).alias("dir"), "path", "filename", F.coalesce("n", F.lit(0)).alias("symbols"))


def repo_map(graph: CodeGraph, repo: str) -> DataFrame:
    """(dir, files, n_files, n_symbols): files of each directory, by name, dirs ascending."""
    f = repo_map_files(graph, repo)
    f = f.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("filename", "path", "symbols"))).alias("files"), F.count(F.lit(1)).alias("n_files"), F.sum("symbols").alias("n_symbols"))
    return f.orderBy("dir")


def file_overview(graph: CodeGraph, repo: str, path: str) -> DataFrame:
    require(repo=repo, path=path)
    cols = ("name", "startingLine", "endingLine", "visibility", "id")
    f = _in(graph, repo, "Function").where(F.col("path") == path).select(F.lit("function").alias("type"), *cols, "signature", "cyclomaticComplexity")
    c = _in(graph, repo, "Class").where(F.col("path") == path).select(F.lit("class").alias("type"), *cols)
    return f.unionByName(c, allowMissingColumns=True).orderBy("startingLine", "name", "id")


def symbol_context(graph: CodeGraph, repo: str, name: str) -> DataFrame:
    """One row: the symbol of a name, its callers, callees and siblings in the same file (names, ascending)."""
    require(repo=repo, name=name)
    spark = graph.spark
    symbol = first_symbol(graph, repo, spark.createDataFrame([(name,)], "name string"))

    def names_of(df: DataFrame, column: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_set("name")).alias(column))

    same = _in(graph, repo, "Function").select("name", "path").unionByName(_in(graph, repo, "Class").select("name", "path"))
    same = same.where(F.col("name") != name).join(symbol.select("path"), "path", "left_semi")
    is_function = F.col("type") == "function"
    out = symbol.withColumns({
        "callers": F.when(is_function, names_of(callers(graph, repo, name), "v").scalar()),
        "callees": F.when(is_function, names_of(callees(graph, repo, name), "v").scalar()),
        "siblings": names_of(same, "v").scalar(),
    })
    return out


def read_source(graph: CodeGraph, repo: str, names: str) -> DataFrame:
    """(position, type, name, path, source) of comma-separated names in the order given; unknown names are skipped."""
    wanted = [(i, n) for i, n in enumerate(x for x in (p.strip() for p in names.split(",")) if x)]
    df = graph.spark.createDataFrame(wanted, "position int, name string")
    return df.join(first_symbol(graph, repo, df), "name").select("position", "type", "name", "path", "source").orderBy("position")
