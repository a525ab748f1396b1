"""Mutations as functions from graph to graph: merge, update, delete, connect, disconnect."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.names import truncate
from loomgraph.operators.where import FIELDS, Relation, find
from loomgraph.plans.graph import NATURAL_KEYS, CodeGraph


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest seq of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_nodes(graph: CodeGraph, kind: str, rows: DataFrame, seq: str | None = None) -> CodeGraph:
    """Inserts rows or overwrites those with the same natural key; of several new rows the last by seq."""
    keys = NATURAL_KEYS[kind]
    if seq is not None:
        rows = last_wins(rows, keys, seq).drop(seq)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.concat_ws(":", F.lit(kind), *keys))
    old = graph.nodes(kind)
    kept = old.join(rows.select(*keys), keys, "left_anti")
    return graph.with_nodes(kind, kept.unionByName(rows, allowMissingColumns=True))


create_nodes = merge_nodes


def update_nodes(graph: CodeGraph, kind: str, where: dict, values: dict[str, Column]) -> tuple[CodeGraph, DataFrame]:
    """The graph with the values set where the filter holds, and the rows changed."""
    hit = find(graph, kind, where)
    changed = hit.withColumns(values)
    rest = graph.nodes(kind).join(hit.select("repo", "id"), ["repo", "id"], "left_anti")
    return graph.with_nodes(kind, rest.unionByName(changed)), changed


def delete_nodes(graph: CodeGraph, kind: str, where: dict) -> tuple[CodeGraph, DataFrame]:
    """The graph without the nodes and their edges, and (nodes_deleted, relationships_deleted)."""
    hit = find(graph, kind, where).select("repo", "id")
    gone = hit.distinct()
    left = graph.nodes(kind).join(hit, ["repo", "id"], "left_anti")
    edges = graph.edges()
    kept = edges
    for end in ("src_id", "dst_id"):
        kept = kept.join(gone.withColumnRenamed("id", end), ["repo", end], "left_anti")
    count = gone.agg(F.count(F.lit(1)).alias("nodes_deleted")).withColumn(
        "relationships_deleted", edges.agg(F.count(F.lit(1))).scalar() - kept.agg(F.count(F.lit(1))).scalar()
    )
    return graph.with_nodes(kind, left).with_edges(kept), count


_EDGE = ["repo", "rel_type", "src_id", "dst_id"]


#: Ids in a block of one side of a product; a cell of two blocks has about its square of pairs.
_BLOCK = 1024


def _pairs(a: DataFrame, b: DataFrame, have: DataFrame) -> DataFrame:
    """All pairs (repo, x, y) of a(repo, x) and b(repo, y) of one repository that are not in have(repo, x, y), once each.

    Both sides are dealt by hash into blocks. A cell of two blocks gets its x one a row, each with the y it has, and all
    its y in one row: only these are shuffled, by cell; the pairs come out of the last step and are nowhere dealt again.
    """
    a, b = (df.select("repo", F.col(c).cast("string").alias(c)).distinct() for df, c in ((a, "x"), (b, "y")))
    blocks = F.ceil(F.count(F.lit(1)) / _BLOCK)
    grid = F.broadcast(a.groupBy("repo").agg(blocks.alias("rows")).join(b.groupBy("repo").agg(blocks.alias("cols")), "repo"))  # two numbers a repository
    i, j = F.pmod(F.xxhash64("x"), "rows").alias("i"), F.pmod(F.xxhash64("y"), "cols").alias("j")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = a.join(grid, "repo").select("repo", "x", i, each("cols").alias("j"))
    had = have.join(b, ["repo", "y"], "left_semi").join(grid, "repo").groupBy("repo", "x", j).agg(F.collect_set("y").alias("had"))
    ys = F.concat(F.collect_list("y"), F.when(F.bool_or(F.col("y").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    right = b.join(grid, "repo").groupBy("repo", "rows", j).agg(ys.alias("ys")).select("repo", each("rows").alias("i"), "j", "ys")
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright, as the optimiser would merge partitions by their bytes before the pairs are made
    cell = ["repo", "i", "j"]
    cells = left.join(had, ["repo", "x", "j"], "left").repartition(n, *cell).join(right.repartition(n, *cell).hint("merge"), cell)
    return cells.select("repo", "x", F.explode(F.when(F.col("had").isNull(), F.col("ys")).otherwise(F.array_except("ys", "had"))).alias("y"))


def _link(graph: CodeGraph, rel: Relation, a: DataFrame, b: DataFrame, call_type: str | None = None) -> CodeGraph:
    """Adds the edges between all of a(repo, x) and all of b(repo, y) of one repository that the graph lacks."""
    src, dst = ("x", "y") if rel.outgoing else ("y", "x")
    have = graph.edges(rel.rel_type).select("repo", F.col("src_id").alias(src), F.col("dst_id").alias(dst))
    new = _pairs(a, b, have).select("repo", F.lit(rel.rel_type).alias("rel_type"), F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), F.lit(call_type).cast("string").alias("call_type"))
    return graph.with_edges(graph.edges().unionByName(new))


def connect(graph: CodeGraph, kind: str, field: str, on_from: dict, on_to: dict, call_type: str | None = None) -> CodeGraph:
    """Adds the edges of a field between all nodes of two filters that lack them.

    Both sides are filtered; the product is what the operation asks for.
    """
    rel = FIELDS[kind][field]
    a = find(graph, kind, on_from).select("repo", F.col("id").alias("x"))
    b = find(graph, rel.target, on_to).select("repo", F.col("id").alias("y"))
    return _link(graph, rel, a, b, call_type)


def disconnect(graph: CodeGraph, kind: str, field: str, on_from: dict, on_to: dict) -> CodeGraph:
    rel = FIELDS[kind][field]
    own, other = ("src_id", "dst_id") if rel.outgoing else ("dst_id", "src_id")
    a = find(graph, kind, on_from).select("repo", F.col("id").alias(own))
    b = find(graph, rel.target, on_to).select("repo", F.col("id").alias(other))
    hit = graph.edges(rel.rel_type).join(a, ["repo", own], "left_semi").join(b, ["repo", other], "left_semi")
    return graph.with_edges(graph.edges().join(hit.select(*_EDGE), _EDGE, "left_anti"))


def nested(graph: CodeGraph, kind: str, where: dict, changes: dict[str, dict]) -> CodeGraph:
    """Changes what is related to the nodes of a filter: {field: {"create": rows, "connect": filter, "disconnect": filter,
    "update": (filter, values), "delete": filter}}, in this order. The filters are over the related type; update,
    disconnect and delete touch only nodes that a node of the filter leads to, and all nodes stay in their repository.
    """
    for field, ops in changes.items():
        unknown = set(ops) - {"create", "connect", "disconnect", "update", "delete"}
        if unknown:
            raise ValueError(f"unknown change {sorted(unknown)}")
        rel = FIELDS[kind][field]
        own, other = ("src_id", "dst_id") if rel.outgoing else ("dst_id", "src_id")
        from_ = find(graph, kind, where).select("repo", F.col("id").alias("x"))
        if "create" in ops:
            rows = ops["create"]
            if "id" not in rows.columns:
                rows = rows.withColumn("id", F.concat_ws(":", F.lit(rel.target), *NATURAL_KEYS[rel.target]))
            graph = _link(merge_nodes(graph, rel.target, rows), rel, from_, rows.select("repo", F.col("id").alias("y")))
        if "connect" in ops:
            graph = connect(graph, kind, field, where, ops["connect"])
        if "disconnect" in ops:
            graph = disconnect(graph, kind, field, where, ops["disconnect"])

        def reached(inner: dict, graph: CodeGraph = graph) -> DataFrame:
            hit = graph.edges(rel.rel_type).join(from_.withColumnRenamed("x", own), ["repo", own], "left_semi").select("repo", F.col(other).alias("id")).distinct()
            return find(graph, rel.target, inner).join(hit, ["repo", "id"], "left_semi")

        if "update" in ops:
            changed = reached(ops["update"][0]).withColumns(ops["update"][1])
            rest = graph.nodes(rel.target).join(changed.select("repo", "id"), ["repo", "id"], "left_anti")
            graph = graph.with_nodes(rel.target, rest.unionByName(changed))
        if "delete" in ops:
            gone = reached(ops["delete"], graph).select("repo", "id")
            kept = graph.edges()
            for end in ("src_id", "dst_id"):
                kept = kept.join(gone.withColumnRenamed("id", end), ["repo", end], "left_anti")
            graph = graph.with_nodes(rel.target, graph.nodes(rel.target).join(gone, ["repo", "id"], "left_anti")).with_edges(kept)
    return graph


def created(before: CodeGraph, after: CodeGraph, kind: str) -> DataFrame:
    """One row: nodes_created of the type and relationships_created between two states of a graph."""
    nodes = after.nodes(kind).select("repo", "id").join(before.nodes(kind).select("repo", "id"), ["repo", "id"], "left_anti")
    edges = after.edges().select(*_EDGE).join(before.edges().select(*_EDGE), _EDGE, "left_anti")
    return nodes.agg(F.count(F.lit(1)).alias("nodes_created")).withColumn("relationships_created", edges.agg(F.count(F.lit(1))).scalar())


def bind_edges(left: DataFrame, right: DataFrame, facts: DataFrame, left_on: list[str], right_on: list[str], rel_type: str) -> DataFrame:
    """Edges of facts whose ends are looked up by natural keys: two equi-joins and a distinct."""
    a = left.select("repo", F.col("id").alias("src_id"), *(F.col(c).alias(f"from_{c}") for c in left_on))
    b = right.select("repo", F.col("id").alias("dst_id"), *(F.col(c).alias(f"to_{c}") for c in right_on))
    out = facts.join(a, ["repo", *(f"from_{c}" for c in left_on)]).join(b, ["repo", *(f"to_{c}" for c in right_on)])
    return out.select("repo", F.lit(rel_type).alias("rel_type"), "src_id", "dst_id").distinct()


def set_sources(graph: CodeGraph, sources: DataFrame) -> CodeGraph:
    """Sets source, cut to what is stored, on functions and classes by (repo, name, path)."""
    for kind in ("Function", "Class"):
        df = graph.nodes(kind)
        new = sources.select("repo", "name", "path", truncate(F.col("source")).alias("__source")).dropDuplicates(["repo", "name", "path"])
        df = df.join(new, ["repo", "name", "path"], "left").withColumn("source", F.coalesce("__source", "source")).drop("__source")
        graph = graph.with_nodes(kind, df)
    return graph


def set_complexity(graph: CodeGraph, values: DataFrame) -> CodeGraph:
    """Sets cyclomaticComplexity on functions by (repo, name, path)."""
    new = values.groupBy("repo", "name", "path").agg(F.max("complexity").cast("int").alias("__c"))
    df = graph.nodes("Function").join(new, ["repo", "name", "path"], "left")
    return graph.with_nodes("Function", df.withColumn("cyclomaticComplexity", F.coalesce("__c", "cyclomaticComplexity")).drop("__c"))


def upsert_repository(graph: CodeGraph, name: str, path: str, at: Column) -> CodeGraph:
    row = graph.spark.createDataFrame([(name, f"Repository:{name}", name, path)], "repo string, id string, name string, path string")
    return merge_nodes(graph, "Repository", row.withColumn("lastIndexed", F.date_trunc("second", at)))


def delete_repository(graph: CodeGraph, repo: str) -> CodeGraph:
    """The graph without a repository's nodes, its own node and all its edges: a filter on the partition column."""
    for kind in graph.tables:
        graph = graph.with_nodes(kind, graph.nodes(kind).where(F.col("repo") != repo))
    return graph.with_edges(graph.edges().where(F.col("repo") != repo))
