"""Search by name, path and content. Ties are broken by type, path and name, so limits are deterministic."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import names, paths
from loomgraph.plans.graph import CodeGraph, require

_HIT = ("type", "name", "path", "language", "score", "strategy")


def _symbols(graph: CodeGraph, repo: str, kinds=("Function", "Class")) -> DataFrame:
    """type, rank, name, path, language, source of the symbols of a repository."""
    out = None
    for rank, kind in enumerate(kinds):
        df = graph.nodes(kind).where(F.col("repo") == repo)
        source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
        df = df.select(F.lit(kind.lower()).alias("type"), F.lit(rank).alias("rank"), "id", "name", "path", "language", source.alias("source"))
        out = df if out is None else out.unionByName(df)
    return out


def _ranked(hits: DataFrame, limit: int | None) -> DataFrame:
    hits = hits.orderBy(F.desc("score"), "rank", "path", "name")
    return (hits.limit(limit) if limit else hits).select(*_HIT)


def _scored(df: DataFrame, score: Column | float, strategy: str) -> DataFrame:
    value = F.lit(score) if isinstance(score, float) else score
    return df.withColumns({"score": value, "strategy": F.lit(strategy)})


def find_function(graph: CodeGraph, repo: str, name: str) -> DataFrame:
    """Functions of exactly this name."""
    require(repo=repo, name=name)
    df = graph.nodes("Function").where((F.col("repo") == repo) & (F.col("name") == name))
    return df.select(F.lit("function").alias("type"), "name", "path", "language", "signature", F.lit(names.EXACT_SCORE).alias("score"), F.lit("exact").alias("strategy"))


def find_file(graph: CodeGraph, repo: str, pattern: str, enrich_up_to: int = 5) -> DataFrame:
    """Files whose path or base name matches a glob; with at most enrich_up_to of them, their symbols' names."""
    require(repo=repo, pattern=pattern)
    hit = paths.glob_match(F.col("path"), pattern) | paths.glob_match(paths.basename(F.col("path")), pattern)
    files = graph.nodes("File").where((F.col("repo") == repo) & hit).select("path", "filename", "language", "lineCount")
    few = files.agg(F.count(F.lit(1)).between(1, enrich_up_to)).scalar()
    symbols = _symbols(graph, repo).join(files.select("path").distinct(), "path", "left_semi").where(few)
    lists = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("s"))
    lists = lists.select("path", F.transform("s", lambda s: s["name"]).alias("symbols"))
    out = files.join(lists, "path", "left")
    return out.withColumns({"score": F.lit(names.FILE_SCORE), "strategy": F.lit("file")})


def exact_names(graph: CodeGraph, repo: str, name: str) -> DataFrame:
    hits = _symbols(graph, repo, ("Function", "Class", "Module")).where(F.col("name") == name)
    return _scored(hits, names.EXACT_SCORE, "exact")


def token_supplement(graph: CodeGraph, repo: str, query: str, limit: int = 10) -> DataFrame:
    """Symbols whose name is one of the query's words; the best hit for each path and name."""
    tokens = sorted(set(query.split()))
    hits = _symbols(graph, repo, ("Function", "Class", "Module")).where(F.col("name").isin(*tokens) if tokens else F.lit(False))
    hits = _scored(hits, names.EXACT_SCORE, "exact").groupBy("path", "name").agg(
        F.max("score").alias("score"), F.min(F.struct("rank", "type", "language", "strategy")).alias("s")
    )
    return _ranked(hits.select("path", "name", "score", "s.*"), limit or 10)


def fuzzy_names(graph: CodeGraph, repo: str, query: str, limit: int = 10) -> DataFrame:
    """Functions and classes by edit distance to the query without its wildcards; nothing for an empty rest."""
    bare = query.strip().replace("*", "").replace("?", "")
    hits = _symbols(graph, repo)
    # The distance is at least the difference in characters, which prunes most rows before the quadratic part.
    near = F.abs(F.length("name") - len(bare)) <= (1 - names.FUZZY_LEAST) * F.greatest(F.length("name"), F.lit(len(bare)))
    hits = hits.where(near & F.lit(bool(bare)))
    hits = _scored(hits, names.similarity(F.lit(bare), F.col("name")), "fuzzy").where(F.col("score") >= names.FUZZY_LEAST)
    return _ranked(hits, limit or 10)


def search_names(graph: CodeGraph, repo: str, query: str, limit: int = 10, strategy: str | None = None) -> DataFrame:
    """Dispatch by the kind of query; an exact query with a hit is not cut, one without is looked up word by word."""
    require(repo=repo, query=query)
    how = strategy or names.classify_query(query)
    if how == "fuzzy":
        return fuzzy_names(graph, repo, query, limit)
    if how == "file":
        hits = find_file(graph, repo, query.strip()).select(
            F.lit("file").alias("type"), F.lit(0).alias("rank"), F.col("filename").alias("name"), "path", "language", "score", "strategy"
        )
        return _ranked(hits, limit or 10)
    hits = exact_names(graph, repo, query.strip())
    none = hits.agg(F.count(F.lit(1)) == 0).scalar()
    words = token_supplement(graph, repo, query, limit or 10).where(none)
    return _ranked(hits, None).unionByName(words)


def search_code(graph: CodeGraph, repo: str, query: str, limit: int = 10) -> DataFrame:
    """Symbols whose stored source contains the query, functions first."""
    require(repo=repo, query=query)
    hits = _symbols(graph, repo).where(F.col("source").contains(query))
    hits = hits.groupBy("type", "name", "path").agg(F.min("rank").alias("rank"), F.min("language").alias("language"))
    return _ranked(_scored(hits, names.CONTENT_SCORE, "content"), limit or 10)


def first_symbol(graph: CodeGraph, repo: str, wanted: DataFrame | None = None) -> DataFrame:
    """The first symbol of each name, functions before classes, then by path."""
    df = _symbols(graph, repo)
    if wanted is not None:
        df = df.join(wanted.select("name").distinct(), "name", "left_semi")
    w = Window.partitionBy("name").orderBy("rank", "path", "id")
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "rank")
