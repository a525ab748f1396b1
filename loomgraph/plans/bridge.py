"""The driver's tables projected into the graph model, so that every operator can be run and compared."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import names, paths
from loomgraph.plans.graph import CodeGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    start = (F.col("p_partkey") % 200 + 1).cast("int")
    return p.select(
        F.lit("parts").alias("repo"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit("pkg/"), "p_brand", F.lit(".go")).alias("path"), F.when(F.col("p_size") % 2 == 0, "go").otherwise("python").alias("language"),
        F.col("p_type").alias("signature"), F.when(F.col("p_size") > 25, "public").otherwise("package").alias("visibility"),
        F.concat(F.lit("func "), "p_name", F.lit(" returns "), "p_type").alias("source"), start.alias("startingLine"),
        names.ending_line(start, F.col("p_size")).cast("int").alias("endingLine"), F.col("p_size").alias("cyclomaticComplexity"),
        F.when(F.col("p_size") % 10 == 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("decorators"),
    )


def part_calls(spark: SparkSession, sf_dir: str, dense: bool = True) -> DataFrame:
    """Calls between the parts of neighbouring lines of an order; sparse: only from returned first lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a = li if dense else li.where("l_linenumber = 1 AND l_returnflag = 'R'")
    a = a.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("x"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("y"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).where("x <> y").select("x", "y").distinct()
    return pairs.select(F.lit("parts").alias("repo"), F.lit("CALLS").alias("rel_type"), F.col("x").cast("string").alias("src_id"), F.col("y").cast("string").alias("dst_id"), F.lit("direct").alias("call_type"))


def parts(spark: SparkSession, sf_dir: str, dense: bool = True) -> CodeGraph:
    """Functions from part, calls from lineitem, a class for each brand that owns its small parts."""
    f = part_functions(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    classes = brands.select(
        F.lit("parts").alias("repo"), F.concat(F.lit("b:"), "p_brand").alias("id"), F.col("p_brand").alias("name"),
        F.concat(F.lit("pkg/"), "p_brand", F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.lit("struct").alias("kind"),
        F.lit("public").alias("visibility"), F.concat(F.lit("type "), "p_brand").alias("source"), F.lit(1).alias("startingLine"), F.lit(1).alias("endingLine"),
    )
    owns = table(spark, sf_dir, "part").where("p_size <= 5").select(
        F.lit("parts").alias("repo"), F.lit("HAS_METHOD").alias("rel_type"), F.concat(F.lit("b:"), "p_brand").alias("src_id"), F.col("p_partkey").cast("string").alias("dst_id"), F.lit(None).cast("string").alias("call_type")
    )
    files = classes.select("repo", F.concat(F.lit("f:"), "path").alias("id"), "path", paths.basename(F.col("path")).alias("filename"), "language", F.lit(200).alias("lineCount"))
    return CodeGraph(spark, {"Function": f, "Class": classes, "File": files}, part_calls(spark, sf_dir, dense).unionByName(owns))


def classes(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Customers and suppliers inherit from nations, these from regions; customers implement segments."""
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))

    def cls(df: DataFrame, prefix: str, key: str, name: str, path: str) -> DataFrame:
        return df.select(F.lit("tpch").alias("repo"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(path).alias("path"), F.lit("class").alias("kind"))

    seg = c.select("c_mktsegment").distinct()
    nodes = cls(c, "c:", "c_custkey", "c_name", "customer").unionByName(cls(s, "s:", "s_suppkey", "s_name", "supplier"))
    nodes = nodes.unionByName(cls(n, "n:", "n_nationkey", "n_name", "nation")).unionByName(cls(r, "r:", "r_regionkey", "r_name", "region"))
    nodes = nodes.unionByName(cls(seg, "m:", "c_mktsegment", "c_mktsegment", "segment"))

    def edge(df: DataFrame, rel: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return df.select(F.lit("tpch").alias("repo"), F.lit(rel).alias("rel_type"), F.concat(F.lit(a), F.col(src).cast("string")).alias("src_id"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst_id"))

    edges = edge(c, "INHERITS", "c:", "c_custkey", "n:", "c_nationkey").unionByName(edge(s, "INHERITS", "s:", "s_suppkey", "n:", "s_nationkey"))
    edges = edges.unionByName(edge(n, "INHERITS", "n:", "n_nationkey", "r:", "n_regionkey")).unionByName(edge(c, "IMPLEMENTS", "c:", "c_custkey", "m:", "c_mktsegment"))
    return CodeGraph(spark, {"Class": nodes}, edges)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    return p.select(F.lit("web").alias("repo"), F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("id"), path.alias("path"), paths.basename(path).alias("filename"), F.lit("html").alias("language"), paths.line_count(F.col("html")).alias("lineCount"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("hrefs"))


def web(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Files from pages, modules from link targets; a page imports what it links, its first target depends on its second."""
    f = page_files(spark, sf_dir)
    links = f.select("id", F.posexplode("hrefs").alias("pos", "href"))
    modules = links.select("href").distinct().select(F.lit("web").alias("repo"), F.concat(F.lit("m:"), "href").alias("id"), F.translate("href", "/.", "").alias("name"), F.col("href").alias("path"))
    imports = links.select(F.lit("web").alias("repo"), F.lit("IMPORTS").alias("rel_type"), F.col("id").alias("src_id"), F.concat(F.lit("m:"), "href").alias("dst_id")).distinct()
    first, second = F.get("hrefs", F.lit(0)), F.get("hrefs", F.lit(1))
    depends = f.where(F.size("hrefs") > 1).where(first != second).select(F.lit("web").alias("repo"), F.lit("DEPENDS_ON").alias("rel_type"), F.concat(F.lit("m:"), first).alias("src_id"), F.concat(F.lit("m:"), second).alias("dst_id")).distinct()
    return CodeGraph(spark, {"File": f.drop("hrefs"), "Module": modules}, imports.unionByName(depends))


def page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from pages to link targets; targets with an accent or a dot count as external."""
    f = page_files(spark, sf_dir)
    links = f.select("repo", F.col("id").alias("from_id"), F.col("path").alias("file_path"), F.explode("hrefs").alias("href"))
    name = F.translate("href", "/", "")
    return links.select("repo", "from_id", "file_path", name.alias("to_name"), F.lit("imports").alias("kind"), name.rlike(r"\.").alias("is_external"), F.col("href").alias("external_import_path"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), "text")
