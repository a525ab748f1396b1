"""Changed files as a stream: each micro-batch is analysed and merged into the stored graph's file table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import paths
from loomgraph.sources.repository import analyze

FILES = "repo string, path string, text string, mtime timestamp"


def changed_files(spark: SparkSession, source: str) -> DataFrame:
    """A stream of (repo, path, text, mtime) rows from Parquet files as they appear."""
    return spark.readStream.schema(FILES).parquet(source)


def _latest(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo", "path").orderBy(F.desc("mtime"), F.desc("text"))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the newest version of each file under target/files, one version folder a batch, and its symbols beside it.

    A batch writes a new folder named after its number, so a batch that is run
    again overwrites its own work and nothing else.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = _latest(batch)
        before = current(spark, target, below=number)
        every = new if before is None else _latest(before.unionByName(new))
        every.write.mode("overwrite").parquet(f"{target}/files/v={number}")
        analyze(every).write.mode("overwrite").parquet(f"{target}/symbols/v={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The newest version of the file table, or the newest below a batch number."""
    try:
        every = spark.read.parquet(f"{target}/files")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    if below is not None:
        every = every.where(F.col("v") < below)
    newest = every.agg(F.max("v")).first()[0]
    return None if newest is None else every.where(F.col("v") == newest).drop("v")


def event_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows, late rows bounded by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


def languages(files: DataFrame) -> DataFrame:
    """Files of each language; a running count that works on streams and tables alike."""
    return files.groupBy(paths.detect_language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
