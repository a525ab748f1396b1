"""The free-form layer: nodes with labels and a property map, and read-only SQL over them."""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import traverse
from loomgraph.plans.graph import CodeGraph

NODES = "id string, labels array<string>, properties map<string,string>"
EDGES = "id string, type string, source_id string, target_id string, properties map<string,string>"


@dataclass(frozen=True)
class FreeGraph:
    """nodes(id, labels, properties) and edges(id, type, source_id, target_id, properties)."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(graph: CodeGraph) -> FreeGraph:
        """All typed nodes as one table; lists become comma-joined text."""
        nodes = None
        for kind in graph.tables:
            df = graph.nodes(kind)
            pairs = []
            for name, kind_of in df.dtypes:
                if name == "id":
                    continue
                value = F.array_join(name, ",") if kind_of.startswith("array") else F.col(name).cast("string")
                pairs += [F.lit(name), value]
            props = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
            part = df.select("id", F.array(F.lit(kind)).alias("labels"), props.alias("properties"))
            nodes = part if nodes is None else nodes.unionByName(part)
        e = graph.edges()
        ident = F.concat_ws("|", "rel_type", "src_id", "dst_id")
        props = F.map_filter(F.create_map(F.lit("callType"), F.col("call_type"), F.lit("repo"), F.col("repo")), lambda _, v: v.isNotNull())
        return FreeGraph(nodes, e.select(ident.alias("id"), F.col("rel_type").alias("type"), F.col("src_id").alias("source_id"), F.col("dst_id").alias("target_id"), props.alias("properties")))

    def _long(self) -> DataFrame:
        return self.edges.select(F.col("type").alias("rel_type"), F.col("source_id").alias("src_id"), F.col("target_id").alias("dst_id"), "id", "properties")

    def metadata(self) -> DataFrame:
        """(what, name, n): numbers of nodes and edges, of nodes by label, of edges by type."""
        total = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("name"), "n")
        labels = self.nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        types = self.edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        return (
            total(self.nodes, "nodes").unionByName(total(self.edges, "edges"))
            .unionByName(labels.select(F.lit("label").alias("what"), "name", "n")).unionByName(types.select(F.lit("type").alias("what"), "name", "n"))
        )

    def samples(self, n: int = 5) -> tuple[DataFrame, DataFrame]:
        return self.nodes.orderBy("id").limit(n), self.edges.orderBy("id").limit(n)

    def search(self, query: str, labels: list[str] | None = None, limit: int = 20) -> DataFrame:
        """Nodes with the query in any property, whatever its case."""
        df = self.nodes.where(F.exists(F.map_values("properties"), lambda v: F.lower(v).contains(query.lower())))
        if labels:
            df = df.where(F.arrays_overlap("labels", F.array(*(F.lit(x) for x in labels))))
        return df.orderBy("id").limit(limit if limit > 0 else 20)

    def get_node(self, ident: str) -> DataFrame:
        df = self.nodes.where(F.col("id") == ident)
        if df.isEmpty():
            raise KeyError(f"no node {ident!r}")
        return df

    def neighbors(self, ident: str, rel_type: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        self.get_node(ident)
        return traverse.neighbors(self.nodes, self._long(), ident, rel_type, limit if limit > 0 else 50)

    def shortest_path(self, source: str, target: str, max_hops: int | None = None) -> DataFrame:
        """(hops, path); KeyError for an unknown end, LookupError if there is no path."""
        self.get_node(source)
        self.get_node(target)
        found = traverse.shortest_path(self._long(), source, target, max_hops)
        if found.isEmpty():
            raise LookupError("no path")
        return found

    def union(self, other: FreeGraph) -> FreeGraph:
        """Both graphs; of several nodes or edges of one id and repository one stays, this graph's before the other's."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            repo = F.coalesce(F.col("properties")["repo"], F.lit("")).alias("__repo")
            mine = a.select("*", repo).dropDuplicates(["id", "__repo"])
            more = b.select("*", repo).dropDuplicates(["id", "__repo"]).join(mine.select("id", "__repo"), ["id", "__repo"], "left_anti")
            return mine.unionByName(more).drop("__repo")

        return FreeGraph(both(self.nodes, other.nodes), both(self.edges, other.edges))

    def sql(self, query: str, args: dict | None = None) -> DataFrame:
        """Read-only SQL over nodes and edges; commands, calls into Java and reads of files by path are refused."""
        spark = self.nodes.sparkSession
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")
        refuse_commands(spark, query)
        return spark.sql(query, args)


def refuse_commands(spark, query: str) -> None:
    """PermissionError unless the text parses to a query: no command, insert or DDL anywhere in its plan, subqueries
    included, no function that calls into Java or leaves the engine, and no relation but names of views.
    """
    # Anywhere in the text, a literal's included: comments between a name and its bracket must not hide it.
    bare = re.sub(r"/\*.*?\*/|--[^\n]*", " ", query, flags=re.S).replace("`", "").lower()
    if re.search(r"(?<![a-z0-9_])(?:try_)?(?:reflect|java_method|read_files|python_data_source)\s*\(", bare):
        raise PermissionError("functions that call into Java or read files are not allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getName()
        if ".command." in name or name.endswith("Command") or any(k in name for k in ("InsertInto", "CreateTable", "CreateView", "CreateNamespace", "Drop", "AlterTable", "Truncate", "MergeInto", "DeleteFrom", "UpdateTable", "SetCatalog", "CacheTable", "RefreshTable", "CallStatement", "CompoundBody")):
            raise PermissionError("only read-only queries are allowed")
        if name.endswith("UnresolvedRelation") and p.multipartIdentifier().size() > 1:
            raise PermissionError("only the views by their names are allowed")
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
