"""Reference resolution: names to symbols, and what that yields in edges and statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths


def multiplicity(symbols: DataFrame) -> DataFrame:
    """(repo, name, n): symbols of each name over all kinds."""
    return symbols.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))


def unique_targets(symbols: DataFrame) -> DataFrame:
    """Symbols whose name no other symbol of the repository has; the others are ambiguous."""
    once = multiplicity(symbols).where("n = 1").select("repo", "name")
    return symbols.join(once, ["repo", "name"], "left_semi")


def resolved_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, rel_type, src_id, dst_id) of internal references to unambiguous names. refs: repo, from_id, to_name, kind, is_external."""
    target = unique_targets(symbols).select("repo", F.col("name").alias("to_name"), F.col("id").alias("dst_id"))
    kinds = {
        "calls": "CALLS", "imports": "IMPORTS", "inherits": "INHERITS", "implements": "IMPLEMENTS",
        "overrides": "OVERRIDES", "depends_on": "DEPENDS_ON", "exports": "EXPORTS",
    }
    rel = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("kind"))
    hit = refs.where(~F.coalesce("is_external", F.lit(False))).join(target, ["repo", "to_name"])
    return hit.select("repo", rel.alias("rel_type"), F.col("from_id").alias("src_id"), "dst_id").where("rel_type IS NOT NULL").distinct()


def path_imports(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, rel_type, src_id, dst_id): IMPORTS edges of relative imports whose name is no symbol's, by the module's path or its index.

    refs: repo, from_id, file_path, to_name, kind, is_external. modules: repo, path, id.
    """
    at = paths.normalize_module(F.col("path"))
    known = modules.select("repo", at.alias("at"), F.col("id").alias("dst_id")).groupBy("repo", "at").agg(F.min("dst_id").alias("dst_id"))
    df = refs.where((F.col("kind") == "imports") & ~F.coalesce("is_external", F.lit(False)) & paths.is_relative_import(F.col("to_name")))
    df = df.withColumn("at", paths.normalize_module(paths.resolve_import(F.col("file_path"), F.col("to_name"))))
    df = df.join(known, ["repo", "at"], "left").withColumnRenamed("dst_id", "__own").withColumn("at", F.concat("at", F.lit("/index"))).join(known, ["repo", "at"], "left")
    out = df.select("repo", F.lit("IMPORTS").alias("rel_type"), F.col("from_id").alias("src_id"), F.coalesce("__own", "dst_id").alias("dst_id"))
    return out.where("dst_id IS NOT NULL").distinct()


def _marked(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Internal references with whether they resolve: by name, or as a relative import to a module's path or its index."""
    known = symbols.select("repo", F.col("name").alias("to_name")).distinct().withColumn("by_name", F.lit(True))
    modules = files.select("repo", paths.normalize_module(F.col("path")).alias("at")).distinct()
    own, index = modules.withColumn("by_path", F.lit(True)), modules.select("repo", F.col("at").alias("idx")).withColumn("by_index", F.lit(True))
    df = refs.where(~F.coalesce("is_external", F.lit(False)))
    relative = paths.is_relative_import(F.col("to_name"))
    at = F.when(relative, paths.normalize_module(paths.resolve_import(F.col("file_path"), F.col("to_name"))))
    df = df.withColumns({"at": at, "idx": F.concat(at, F.lit("/index"))})
    df = df.join(known, ["repo", "to_name"], "left").join(own, ["repo", "at"], "left").join(index, ["repo", "idx"], "left")
    return df.withColumn("resolved", F.coalesce("by_name", "by_path", "by_index", F.lit(False)))


def statistics(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: symbols, references, externals left out, resolved, and how many different names stay unresolved."""
    m = _marked(refs, symbols, files)
    out = m.agg(
        F.count(F.lit(1)).alias("n_references"),
        F.count_if("resolved").alias("n_resolved"),
        F.count_distinct(F.when(~F.col("resolved"), F.col("to_name"))).alias("n_unresolved"),
    )
    return out.withColumn("n_symbols", symbols.agg(F.count(F.lit(1))).scalar())


def unresolved_names(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    return _marked(refs, symbols, files).where(~F.col("resolved")).select("repo", "to_name").distinct()


def external_references(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): one node for each name and import path, with IMPORTS and CALLS edges to it."""
    df = refs.where("is_external").withColumn("importPath", F.coalesce("external_import_path", "to_name"))
    ident = F.concat_ws(":", F.lit("ExternalReference"), "repo", "to_name", "importPath")
    nodes = df.select("repo", ident.alias("id"), F.col("to_name").alias("name"), "importPath").dropDuplicates(["repo", "name", "importPath"])
    rel = F.when(F.col("kind") == "calls", "CALLS").otherwise("IMPORTS")
    return nodes, df.select("repo", rel.alias("rel_type"), F.col("from_id").alias("src_id"), ident.alias("dst_id")).distinct()
