"""What several operators share: the shared folder, sized joins, components."""
from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this many bytes, as written, may be broadcast.
BROADCAST_BYTES = 16 << 20

#: A key is hot if it holds over total / HOT_KEYS rows, so under HOT_KEYS keys are.
HOT_KEYS = 10_000

#: Tables written and not dropped yet.
_kept: list[Written] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one in local mode; elsewhere that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Written:
    """A table written to the shared folder: lineage ends here, lost executors cost nothing."""

    def __init__(self, df: DataFrame, label: str, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _kept.append(self)

    def bytes(self) -> int:
        fs, p = _fs(self.spark, self.path)
        return fs.getContentSummary(p).getLength()

    def drop(self) -> None:
        if self in _kept:
            _kept.remove(self)
            fs, p = _fs(self.spark, self.path)
            fs.delete(p, True)

    def sized(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """With a broadcast hint if its files are small enough; Spark shuffles it otherwise."""
        return F.broadcast(self.df) if self.bytes() <= limit else self.df


@contextmanager
def scratch():
    """Drops what was written inside, but for the tables handed to the function it gives: what a result still reads."""
    before, wanted = list(_kept), []
    yield lambda *tables: wanted.extend(tables)
    for table in [t for t in _kept if t not in before and t not in wanted]:
        table.drop()


def release(*wanted: Written) -> None:
    """Drops all tables still kept, but for those named. For callers that have used up what the operators returned."""
    for table in [t for t in _kept if t not in wanted]:
        table.drop()


def worker_state(key: str, make: Callable):
    """A value kept by a Python worker, such as a loaded model, until another is asked for: workers outlive stages."""
    kept = sys.__dict__.setdefault("_loomgraph_state", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def by_frequent_key(left: DataFrame, lookup: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join of left with lookup (one row a key, column count: its rows in left) that no hot key can skew.

    A key of over total / HOT_KEYS rows is dealt into parts of that many rows, and
    its row of lookup is copied for each. At most HOT_KEYS keys are hot, and only
    these keys with their parts are broadcast.
    """
    limit = max(1000, total // HOT_KEYS)
    parts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = F.broadcast(lookup.where(F.col(count) > limit).select(F.col(key), parts.alias("__parts")))
    copies = lookup.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    part = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__parts").cast("long")).cast("int"), F.lit(0))
    dealt = left.join(hot, key, "left").withColumn("__part", part).drop("__parts")
    return dealt.join(copies, [key, "__part"], how).drop("__part")


#: Rows that are worth a partition of their own between the steps of small tables.
ROWS_A_PART = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """In no more partitions than so many rows are worth: small tables would else be mostly files and tasks."""
    return df.coalesce(rows // ROWS_A_PART + 1)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b), both long; component: its smallest node.

    Alternating large-star and small-star steps; each round is written to the
    shared folder. Edges between equal nodes are dropped; no edges, no rows.
    """
    made = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = Written(made, "edges")
    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)]
    seen = tuple(state.df.agg(*mark).first())
    low = F.min("b").alias("m"), F.count(F.lit(1)).alias("n")
    for _ in range(max_rounds if seen[0] else 0):
        e, total = few(state.df, seen[0]), 2 * seen[0]
        both = e.union(e.select("b", "a")).toDF("a", "b")
        lows = few(both.groupBy("a").agg(*low).select("a", F.least("a", "m").alias("m"), "n"), total)
        met = few(by_frequent_key(both, lows, "a", "n", total), total)
        large = few(met.select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).distinct(), total)
        lows = few(large.groupBy("a").agg(*low), total)
        joined = few(by_frequent_key(large, lows, "a", "n", total), total)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = Written(few(small.union(lows.select("a", F.col("m").alias("b"))).distinct(), total), "edges")
        state.drop()
        state, before = after, seen
        seen = tuple(state.df.agg(*mark).first())
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    e = state.df
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


#: Rows whose texts a Python worker holds as objects at once.
TEXTS = 250


def parts_of(batches):
    """Batches in parts of TEXTS rows: what a worker makes of each row dies with its part."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), TEXTS):
            yield b.slice(at, TEXTS)


def strings(column) -> list[str]:
    """The texts of an Arrow column, null as empty, bytes that are no UTF-8 as U+FFFD."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast("binary").to_pylist()]
