import duckdb
import pytest

from loomgraph import queries
from loomgraph.operators import mutate
from loomgraph.plans.graph import CodeGraph
from tests.oracle import same


def shuffled(spark):
    """Records that the stages so far wrote to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark._sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_connect_shuffles_no_pairs(spark):
    n = 300
    f = spark.range(2 * n).selectExpr("'r' AS repo", "CAST(id AS string) AS id", f"CAST(id < {n} AS int) AS cyclomaticComplexity")
    have = spark.range(n).selectExpr("'r' AS repo", "'CALLS' AS rel_type", "CAST(id AS string) AS src_id", f"CAST(id + {n} AS string) AS dst_id", "'old' AS call_type")
    g = mutate.connect(CodeGraph(spark, {"Function": f}, have), "Function", "calls", {"cyclomaticComplexity": 1}, {"cyclomaticComplexity": 0}, "direct")
    before = shuffled(spark)
    kinds = dict(map(tuple, (r.asDict().values() for r in g.edges("CALLS").groupBy("call_type").count().collect())))
    assert kinds == {"old": n, "direct": n * n - n}
    assert sum(v for k, v in shuffled(spark).items() if k not in before) < n * n / 4


@pytest.mark.parametrize("block", [2, 1024])
@pytest.mark.parametrize("field", ["calls", "calledBy"])
def test_connect_against_all_pairs(spark, monkeypatch, block, field):
    monkeypatch.setattr(mutate, "_BLOCK", block, raising=False)
    nodes = [(r, i, c) for r, k in (("r", 9), ("s", 5), ("one", 1)) for c in (1, 2) for i in [f"{c}{j}" for j in range(k)]]
    nodes = [x for x in nodes if x != ("one", "20", 2)] + [("r", "10", 1), ("r", "20", 2), ("r", None, 2), ("t", "20", 2)]
    old = [("r", "CALLS", "10", "21", "old"), ("r", "CALLS", "21", "10", "old"), ("s", "CALLS", "14", "24", "old"), ("r", "CALLS", "10", "x", "old"), ("r", "INHERITS", "10", "22", None), ("t", "CALLS", "10", "20", "old")]
    f = spark.createDataFrame(nodes, "repo string, id string, cyclomaticComplexity int")
    e = spark.createDataFrame(old, "repo string, rel_type string, src_id string, dst_id string, call_type string")
    g = mutate.connect(CodeGraph(spark, {"Function": f}, e), "Function", field, {"cyclomaticComplexity": 1}, {"cyclomaticComplexity": 2}, "new")
    want = {(r, "CALLS", *((x, y) if field == "calls" else (y, x))) for r, x, c in nodes for q, y, d in nodes if r == q and (c, d) == (1, 2)}
    want = sorted([*old, *((*w, "new") for w in want if w not in {o[:4] for o in old})], key=str)
    assert sorted(map(tuple, g.edges().collect()), key=str) == want


def test_connect_edges_with_odd_keys(spark, tmp_path):
    """Twice the same part, a part without a key, one that calls another that is not there."""
    con = duckdb.connect()
    part = "(1, 50), (1, 50), (NULL, 50), (2, 49), (NULL, 49), (3, 50), (4, 1)"
    con.execute(f"CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, 'n' || s AS p_name, 'Brand#1' AS p_brand, s::INT AS p_size, 'SMALL' AS p_type FROM (VALUES {part}) t(k, s)")
    line = "(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 9), (3, 1, 4), (3, 2, 2), (4, 1, 1), (4, 2, 1)"
    con.execute(f"CREATE TABLE lineitem AS SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, k::BIGINT AS l_partkey, 'R' AS l_returnflag FROM (VALUES {line}) t(o, n, k)")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    same(queries.QUERIES["connect_edges"](spark, str(tmp_path)), con, queries.ORACLES["connect_edges"])
