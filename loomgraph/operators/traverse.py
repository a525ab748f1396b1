"""Traversals: bounded breadth-first search as unrolled joins, hierarchies, references, paths."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.graph import CodeGraph, require

#: The deepest traversal, the deepest call chain, hops of a path by default and at most.
MAX_DEPTH, MAX_CHAIN, DEFAULT_HOPS, MAX_HOPS = 3, 5, 6, 20


def clamp_depth(depth: int) -> int:
    return min(max(depth, 1), MAX_DEPTH)


def clamp_chain(depth: int) -> int:
    return depth if 1 <= depth <= MAX_CHAIN else MAX_CHAIN


def is_file_path(name: str) -> bool:
    import re

    return "/" in name or bool(re.search(r"\.[^./]+$", name))


def levels(start: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of what is reached from start(node) over pairs(a, b), start left out; depth: the first level.

    Each level is a semi join and a distinct, so a level costs what its frontier
    touches and never enumerates walks; the first level is a min at the end.
    """
    frontier, found = start.select("node"), None
    for d in range(1, depth + 1):
        frontier = pairs.join(frontier, pairs["a"] == frontier["node"], "left_semi").select(F.col("b").alias("node")).distinct()
        level = frontier.withColumn("depth", F.lit(d))
        found = level if found is None else found.unionByName(level)
    return found.groupBy("node").agg(F.min("depth").alias("depth")).join(start.select("node"), "node", "left_anti")


def _pairs(graph: CodeGraph, repo: str, rel_type: str, forward: bool) -> DataFrame:
    a, b = ("src_id", "dst_id") if forward else ("dst_id", "src_id")
    return graph.edges(rel_type).where(F.col("repo") == repo).select(F.col(a).alias("a"), F.col(b).alias("b"))


def hops(graph: CodeGraph, repo: str, kind: str, rel_type: str, name: str, depth: int = 1, forward: bool = True, by: str = "name") -> DataFrame:
    """(name, path, id, depth) of the nodes reached from those of a name (or an id, by="id").

    By name, homonyms are one node, seen at its first level; its path and id are
    the smallest of those met. By id, each node stands for itself.
    """
    require(repo=repo, name=name)
    depth = clamp_depth(depth)
    nodes = graph.nodes(kind).where(F.col("repo") == repo).select("id", "name", "path")
    pairs = _pairs(graph, repo, rel_type, forward)
    if by == "id":
        start = graph.spark.createDataFrame([(name,)], "node string")
        return levels(start, pairs, depth).join(nodes, F.col("node") == nodes["id"]).select("name", "path", "id", "depth")
    start = graph.spark.createDataFrame([(name,)], "node string")
    named = pairs.join(nodes.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a")
    named = named.join(nodes.select(F.col("id").alias("b"), F.col("name").alias("b_name"), "path"), "b")
    found = levels(start, named.select(F.col("a_name").alias("a"), F.col("b_name").alias("b")).distinct(), depth)
    # The rows that were met at the node's level come from names one level below.
    below = found.select(F.col("node").alias("a_name"), (F.col("depth") + 1).alias("depth"))
    below = below.unionByName(start.select(F.col("node").alias("a_name"), F.lit(1).alias("depth")))
    met = named.join(below, "a_name").join(found.select(F.col("node").alias("b_name"), "depth"), ["b_name", "depth"])
    return met.groupBy(F.col("b_name").alias("name"), "depth").agg(F.min(F.struct("path", "b")).alias("m")).select("name", "m.path", F.col("m.b").alias("id"), "depth")


def callers(graph: CodeGraph, repo: str, name: str, depth: int = 1, by: str = "name") -> DataFrame:
    return hops(graph, repo, "Function", "CALLS", name, depth, forward=False, by=by)


def callees(graph: CodeGraph, repo: str, name: str, depth: int = 1, by: str = "name") -> DataFrame:
    return hops(graph, repo, "Function", "CALLS", name, depth, forward=True, by=by)


def hierarchy(graph: CodeGraph, repo: str, name: str, direction: str = "both", depth: int = 1, by: str = "name") -> DataFrame:
    """(name, path, id, depth, relation, direction): up to bases and interfaces, down to what derives from the class."""
    ways = [("up", "INHERITS", True), ("up", "IMPLEMENTS", True), ("down", "INHERITS", False), ("down", "IMPLEMENTS", False)]
    out = None
    for rank, (way, rel, forward) in enumerate(ways):
        if direction not in (way, "both"):
            continue
        part = hops(graph, repo, "Class", rel, name, depth, forward, by)
        part = part.withColumns({"relation": F.lit(rel), "direction": F.lit(way), "rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        return graph.spark.createDataFrame([], "name string, path string, id string, depth int, relation string, direction string")
    first = out.groupBy("name", "path").agg(F.min(F.struct("rank", "id", "depth", "relation", "direction")).alias("m"))
    return first.select("name", "path", "m.id", "m.depth", "m.relation", "m.direction")


def dependencies(graph: CodeGraph, repo: str, name: str, depth: int = 1) -> DataFrame:
    """A file's imported modules, one hop; a module's dependencies over several."""
    if not is_file_path(name):
        return hops(graph, repo, "Module", "DEPENDS_ON", name, depth)
    files = graph.nodes("File").where((F.col("repo") == repo) & (F.col("path") == name)).select(F.col("id").alias("src_id"))
    modules = graph.nodes("Module").where(F.col("repo") == repo).select("id", "name", "path")
    hit = graph.edges("IMPORTS").where(F.col("repo") == repo).join(files, "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct()
    return hit.join(modules, "id").select("name", "path", "id", F.lit(1).alias("depth"))


def references(graph: CodeGraph, repo: str, name: str, compat: bool = True) -> DataFrame:
    """(name, path, id, relation): who refers to the functions, classes and modules of a name, one hop.

    compat: a module's row set is what it depends on; else what depends on it.
    """
    ways = [
        ("Function", "CALLS", False, "caller"), ("Function", "OVERRIDES", False, "overrider"), ("Class", "INHERITS", False, "child"),
        ("Class", "IMPLEMENTS", False, "implementor"), ("Module", "DEPENDS_ON", compat, "dependency" if compat else "dependent"),
    ]
    out = None
    for kind, rel, forward, label in ways:
        part = hops(graph, repo, kind, rel, name, 1, forward).drop("depth").withColumn("relation", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def _step(frontier: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paths (node, path) one hop longer; of several to a node the smallest."""
    grown = frontier.join(pairs, frontier["node"] == pairs["a"]).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
    return grown.groupBy("node").agg(F.min("path").alias("path"))


def call_chain(graph: CodeGraph, repo: str, source: str, target: str, max_depth: int = MAX_CHAIN) -> DataFrame:
    """(found, depth, path): a shortest directed chain of calls between ids, the smallest in order.

    Half of the hops go forward from the source and half backward from the
    target; the two reach sets are joined where they meet.
    """
    require(repo=repo, source=source, target=target)
    spark = graph.spark
    if source == target:
        return spark.createDataFrame([(True, 0, [source])], "found boolean, depth int, path array<string>")
    depth = clamp_chain(max_depth)
    forth, back = _pairs(graph, repo, "CALLS", True), _pairs(graph, repo, "CALLS", False)

    def reach(start: str, pairs: DataFrame, n: int) -> DataFrame:
        at = spark.createDataFrame([(start, [start])], "node string, path array<string>")
        every = at.withColumn("d", F.lit(0))
        for d in range(1, n + 1):
            at = _step(at, pairs)
            every = every.unionByName(at.withColumn("d", F.lit(d)))
        return every.groupBy("node").agg(F.min(F.struct("d", "path")).alias("m")).select("node", "m.*")

    a = reach(source, forth, (depth + 1) // 2)
    b = reach(target, back, depth // 2).select("node", F.col("d").alias("e"), F.col("path").alias("rest"))
    met = a.join(b, "node").select((F.col("d") + F.col("e")).alias("depth"), F.concat("path", F.slice(F.reverse("rest"), F.lit(2), F.size("rest"))).alias("path"))
    best = met.agg(F.min(F.struct("depth", "path")).alias("m")).select("m.*")
    return best.select(F.col("path").isNotNull().alias("found"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    return a.unionByName(a.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None, every: int = 4) -> DataFrame:
    """(hops, path): an undirected shortest path, the smallest in order; no row if there is none within the hops.

    Each level is cut against what was seen; every few levels the frontier is
    checkpointed so that the plan stays small, and the search stops at a hit.
    """
    spark = edges.sparkSession
    limit = min(max_hops if max_hops and max_hops > 0 else DEFAULT_HOPS, MAX_HOPS)
    pairs = both_ways(edges).distinct()
    at = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = at.select("node")
    none = spark.createDataFrame([], "hops int, path array<string>")
    if source == target:
        return none
    durable = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    for d in range(1, limit + 1):
        at = _step(at, pairs).join(seen, "node", "left_anti")
        at = at.checkpoint() if durable and d % every == 0 else at.persist()
        hit = at.where(F.col("node") == target).select(F.lit(d).alias("hops"), "path")
        state = at.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") == target).alias("hit")).first()
        if state["hit"]:
            return hit
        if not state["n"]:
            return none
        seen = seen.unionByName(at.select("node"))
    return none


def neighbors(nodes: DataFrame, edges: DataFrame, node: str, rel_type: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the edges at either end of a node, at most limit of them, and all nodes they touch."""
    from loomgraph.functions.names import is_identifier

    if rel_type is not None:
        if not is_identifier(rel_type):
            raise ValueError(f"not an edge type: {rel_type!r}")
        edges = edges.where(F.col("rel_type") == rel_type)
    near = edges.where((F.col("src_id") == node) | (F.col("dst_id") == node)).orderBy("rel_type", "src_id", "dst_id").limit(limit)
    ids = near.select(F.col("src_id").alias("id")).union(near.select("dst_id")).union(nodes.sparkSession.createDataFrame([(node,)], "id string")).distinct()
    return nodes.join(ids, "id", "left_semi"), near
