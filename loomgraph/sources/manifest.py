"""Manifests of files, and what changed between two of them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incremental(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(repo, path, mtime, state): new, changed, unchanged or deleted, by modification time to the second."""
    now = current.select("repo", "path", F.date_trunc("second", "mtime").alias("mtime"), F.lit(True).alias("__now"))
    old = previous.select("repo", "path", F.date_trunc("second", "mtime").alias("__old"))
    df = now.join(old, ["repo", "path"], "full")
    state = (
        F.when(F.col("__now").isNull(), "deleted").when(F.col("__old").isNull(), "new").when(F.col("mtime") > F.col("__old"), "changed").otherwise("unchanged")
    )
    return df.select("repo", "path", F.coalesce("mtime", "__old").alias("mtime"), state.alias("state"))
