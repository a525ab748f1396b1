from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.llm import warc


def pages(spark, n):
    return spark.createDataFrame([(i, f"http://h/{i}", "é" * (i % 50), "c") for i in range(n)], "page_id long, url string, html string, hash string")


def test_audit_finds_what_differs(spark):
    a = warc.records(pages(spark, 600)).persist()
    b = a.where("id <> 511 AND id <> 599").withColumn("record", F.when(F.col("id").isin(0, 300), F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("record")))
    got = {(r["file"], r["node"]): r["seen"] for r in warc.audit(a, b).collect()}
    assert got == {(0, 0): "changed", (1, 300 - 256): "changed", (1, 255): "missing", (2, 599 - 512): "missing"}
    assert {r["seen"] for r in warc.audit(b, a).where("node = 255").collect()} == {"extra"}
    assert warc.audit(a, a).count() == 0


def test_records_and_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u\nv", ""), (2, "u\nv", ""), (None, "x", "y")], "page_id long, url string, html string")
    r = [x for x in warc.records(df).orderBy("offset").collect()]
    assert len(r) == 3 and r[0]["offset"] == 0 and r[1]["offset"] == r[0]["length"] and bytes(r[0]["record"]).startswith(b"WARC/1.1\r\n")
    head, _, body = bytes(r[1]["record"]).partition(b"\r\n\r\n")
    assert b"Content-Length: %d" % (len(body) - 4) in head
    empty = warc.records(df.limit(0))
    assert warc.audit(empty, empty).count() == 0
    assert warc.audit(warc.records(df), empty).count() == 3


def test_tree_root_depends_on_order(spark):
    a = warc.records(pages(spark, 20))
    t = warc.tree(a, 2)
    assert t.groupBy("level").count().count() == 3 and t.where("level = 2").count() == 1
    swapped = a.withColumn("offset", F.max("offset").over(Window.partitionBy("file")) - F.col("offset"))
    roots = [x.where("level = 2").first()["hash"] for x in (t, warc.tree(swapped, 2))]
    assert roots[0] != roots[1]


def test_only_children_of_differing_nodes_meet(spark):
    a = warc.records(pages(spark, 300))
    t = warc.tree(a, 3).persist()
    plan = warc.differing(t, t, 1, spark.createDataFrame([(0, 0, 0)], "file long, piece long, up long"))
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    full = next(i for i, x in enumerate(lines) if "Join FullOuter" in x)
    semi = [i for i, x in enumerate(lines) if "Join LeftSemi" in x]
    assert len(semi) == 2 and all(i > full and depth(lines[i]) > depth(lines[full]) for i in semi)


def test_a_hot_id_is_dealt_into_pieces(spark):
    rows = [(5, "u", "same")] * 3000 + [(5, "u", f"b{i}") for i in range(1500)] + [(i, "v", "x") for i in range(1000, 1300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = warc.records(df).persist()
    sizes = [r["count"] for r in a.groupBy("file", "piece").count().collect()]
    assert sum(sizes) == 4800 and max(sizes) <= 8 * warc.RECORDS and a.where("piece > 0").count() == 4500
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, warc.records(df.repartition(7)).collect()))
    assert warc.audit(a, a).count() == 0
    b = a.where("NOT (id = 5 AND offset = 0 AND piece = 1)")
    assert {r["piece"] for r in warc.audit(a, b).collect()} == {1}
