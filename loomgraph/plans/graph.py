"""The property graph as tables: a table for each node type, and one long table of edges.

Every node has (repo, id); ids are stable strings or keys, never made up while
running. edges: repo, rel_type, src_id, dst_id and, for calls, call_type. All
operators take a CodeGraph and give lazy DataFrames; nothing is collected.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node types and their columns; every type also has repo and id.
NODE_COLUMNS = {
    "Repository": "name string, path string, remoteUrl string, primaryLanguage string, lastIndexed timestamp",
    "Folder": "path string, lastUpdated timestamp",
    "File": "path string, filename string, language string, lineCount int, lastUpdated timestamp",
    "Module": "name string, path string, language string, importPath string, visibility string, kind string, startingLine int, endingLine int",
    "Class": "name string, path string, language string, kind string, visibility string, source string, startingLine int, endingLine int, decorators array<string>",
    "Function": "name string, path string, language string, signature string, visibility string, source string, startingLine int, endingLine int, cyclomaticComplexity int, decorators array<string>",
    "ExternalReference": "name string, importPath string",
}
NATURAL_KEYS = {
    "Repository": ["name"], "Folder": ["repo", "path"], "File": ["repo", "path"], "Module": ["repo", "name", "path"],
    "Class": ["repo", "name", "path"], "Function": ["repo", "name", "path"], "ExternalReference": ["repo", "name", "importPath"],
}
RELATIONS = ("CONTAINS", "BELONGS_TO", "DEFINES", "HAS_METHOD", "IMPORTS", "CALLS", "INHERITS", "IMPLEMENTS", "OVERRIDES", "DEPENDS_ON", "EXPORTS", "HAS_MODULE")
EDGES = "repo string, rel_type string, src_id string, dst_id string, call_type string"


def node_schema(kind: str) -> str:
    return f"repo string, id string, {NODE_COLUMNS[kind]}"


@dataclass(frozen=True)
class CodeGraph:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    edge_table: DataFrame | None = None

    def nodes(self, kind: str) -> DataFrame:
        """All nodes of a type, with every column of the type."""
        if kind not in NODE_COLUMNS:
            raise ValueError(f"unknown node type {kind!r}")
        df = self.tables.get(kind)
        if df is None:
            return self.spark.createDataFrame([], node_schema(kind))
        want = self.spark.createDataFrame([], node_schema(kind)).schema
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want))

    def edges(self, *rel_types: str) -> DataFrame:
        df = self.edge_table
        if df is None:
            return self.spark.createDataFrame([], EDGES)
        if "call_type" not in df.columns:
            df = df.withColumn("call_type", F.lit(None).cast("string"))
        df = df.select("repo", "rel_type", F.col("src_id").cast("string").alias("src_id"), F.col("dst_id").cast("string").alias("dst_id"), "call_type")
        return df.where(F.col("rel_type").isin(*rel_types)) if rel_types else df

    def with_nodes(self, kind: str, df: DataFrame) -> CodeGraph:
        return replace(self, tables=self.tables | {kind: df})

    def with_edges(self, df: DataFrame) -> CodeGraph:
        return replace(self, edge_table=df)

    def write(self, path: str) -> None:
        """One Parquet table a node type, partitioned by repo; edges by relation and repo.

        The repositories of this graph are replaced, others in the store stay.
        """
        tables = {kind: (self.nodes(kind), ["repo"]) for kind in self.tables} | {"edges": (self.edges(), ["repo", "rel_type"])}
        repos = {r["repo"] for df, _ in tables.values() for r in df.select("repo").distinct().collect()}  # names of repositories only
        for name, (df, by) in tables.items():
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{name}")
            kept = {tuple(r) for r in df.select(*by).distinct().collect()}
            self._drop_stale(f"{path}/{name}", by, repos, kept)

    def _drop_stale(self, path: str, by: list[str], repos: set[str], kept: set[tuple]) -> None:
        """Removes partitions of the repositories just written that have no rows any more."""
        jvm = self.spark._jvm
        unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        todo = [(root, ())]
        while todo:
            at, values = todo.pop()
            if len(values) == len(by):
                if values not in kept:
                    fs.delete(at, True)
                continue
            for status in fs.listStatus(at) if fs.exists(at) else ():
                name = status.getPath().getName()
                if name.startswith(f"{by[len(values)]}="):
                    value = unescape(name.split("=", 1)[1])
                    if values or value in repos:
                        todo.append((status.getPath(), (*values, value)))

    @staticmethod
    def read(spark: SparkSession, path: str, kinds=tuple(NODE_COLUMNS)) -> CodeGraph:
        tables = {}
        for kind in kinds:
            try:
                tables[kind] = spark.read.schema(node_schema(kind)).parquet(f"{path}/{kind}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return CodeGraph(spark, tables, spark.read.schema(EDGES).parquet(f"{path}/edges"))


def require(**named: str) -> None:
    """Raises ValueError for an empty required argument."""
    for name, value in named.items():
        if not value:
            raise ValueError(f"{name} is required")
