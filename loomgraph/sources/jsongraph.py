"""Property graphs in JSON: {"nodes": [...], "edges": [...]}; of repeated ids the last wins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.freeform import EDGES, NODES, FreeGraph


def _struct(ddl: str) -> str:
    import re

    return "array<struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl) + ">>"


def read_json_graph(spark: SparkSession, path: str) -> FreeGraph:
    raw = spark.read.schema(f"nodes {_struct(NODES)}, edges {_struct(EDGES)}").json(path, multiLine=True)

    def last(column: str) -> DataFrame:
        df = raw.select(F.posexplode(column).alias("pos", "x")).select("pos", "x.*")
        w = Window.partitionBy("id").orderBy(F.desc("pos"))
        return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "pos")

    return FreeGraph(last("nodes"), last("edges"))
