import os
import pathlib
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import forest


def frame(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r], 0.0) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def exact(x, q, k):
    x = x.astype(np.float32).astype(float)
    s = x[q] @ x.T
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k]


@pytest.mark.parametrize(("held", "leaf"), [(1 << 16, 4096), (50, 4096), (1 << 16, 40), (120, 30)])
def test_recall_and_scores(spark, held, leaf):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    df = frame(spark, x)
    got = forest.nearest(df, df.where("vec_id % 50 = 0"), k=10, cell=100, held=held, leaf=leaf).toPandas()
    assert got.groupby("query_id").size().eq(10).all() and len(got) == 300
    hits = sum(len(set(g.vec_id) & set(exact(x, q, 10))) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 300
    x32 = x.astype(np.float32).astype(float)
    assert np.allclose(got.score, [(x32[a] * x32[b]).sum() for a, b in zip(got.query_id, got.vec_id, strict=True)], rtol=0, atol=1e-12)
    for _, g in got.sort_values("rank").groupby("query_id"):
        assert g.score.is_monotonic_decreasing and g["rank"].tolist() == list(range(1, 11))


def test_few_rows_ties_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in forest.nearest(df, df, k=20).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)]
    assert forest.nearest(df.limit(0), df, k=3).count() == 0


def test_many_equal_vectors(spark):
    x = np.concatenate([np.tile([1.0, 2.0, 3.0, 4.0], (400, 1)), np.random.default_rng(1).normal(size=(300, 4))])
    df = frame(spark, x)
    got = forest.nearest(df, df.where("vec_id = 10"), k=5, cell=50, leaf=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def test_equal_answers_for_any_order_of_rows(spark):
    x = np.random.default_rng(5).normal(size=(600, 8))
    df = frame(spark, np.concatenate([x, x[:200] * 1.5, x[:100]]), [*range(600), *range(200), *range(100)])
    ask = lambda d: sorted(map(tuple, forest.nearest(d, d.where("vec_id % 20 = 0"), k=5, cell=60, leaf=25).collect()))
    got = ask(df)
    assert got == ask(df.repartition(7)) == ask(df.orderBy(F.rand(3))) and len(got) == 30 * 5


def test_leaves_are_bounded_and_found_again():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 5000)] + 0.1 * rng.normal(size=(5000, 12))
    block = forest.Block(np.arange(5000), x, 200, 0.96, 10)
    assert max(len(r) for t in block.rows for r in t) <= 200 and all(sum(map(len, t)) == 5000 for t in block.rows)
    hits = seen = 0
    for i in range(0, 5000, 50):
        s = x @ x[i]
        s[i] = -np.inf
        _, of, _ = block.best(np.array([i]), x[i : i + 1], np.array([-np.inf]), 10)
        hits += len(set(of.tolist()) & set(np.argsort(-s)[:10].tolist()))
        seen += len(block.candidates(x[i], 10))
    assert hits >= 0.9 * 10 * 100 and seen < 0.5 * 5000 * 100


def test_workers_need_not_have_the_package(tmp_path):
    """In a session of its own, whose workers cannot import the package."""
    root = pathlib.Path(__file__).parent.parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from loomgraph.llm import forest
df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(100)], "vec_id long, embedding array<float>")
assert forest.nearest(df, df.where("vec_id % 10 = 0"), k=3, cell=20, leaf=10).count() == 30
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170)
    assert run.returncode == 0, run.stderr[-2000:]
