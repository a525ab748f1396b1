"""The filter language: nested dicts to columns, and relationship predicates to semi and anti joins.

Suffixes: none (equality), _gt _gte _lt _lte, _contains, _startsWith, _endsWith,
_regex (whole string), _in, _nin, _not, _isNull; on list columns only equality,
_not, _contains, _in, _nin (any of) and _isNull. AND, OR, NOT, which may hold
relations too; <rel> or <rel>_some, _none, _all, _single with a nested filter over
related nodes, and repository with a filter over repositories. Null never matches,
as in Cypher, but for _isNull. Nodes are told apart by (repo, id) throughout.
"""
from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.graph import CodeGraph

_OPS = ("gte", "lte", "gt", "lt", "contains", "startsWith", "endsWith", "regex", "in", "nin", "not", "isNull")


@dataclass(frozen=True)
class Relation:
    """How a field leads to related nodes: the edge, which end the node is, and the type at the other end."""

    rel_type: str
    outgoing: bool
    target: str


#: Relationship fields by node type.
FIELDS = {
    "Function": {
        "calls": Relation("CALLS", True, "Function"), "calledBy": Relation("CALLS", False, "Function"),
        "overrides": Relation("OVERRIDES", True, "Function"), "overriddenBy": Relation("OVERRIDES", False, "Function"),
        "owner": Relation("HAS_METHOD", False, "Class"), "class": Relation("HAS_METHOD", False, "Class"),
        "module": Relation("EXPORTS", False, "Module"), "externalCalls": Relation("CALLS", True, "ExternalReference"),
        "definedIn": Relation("DEFINES", False, "File"),
    },
    "Class": {
        "inherits": Relation("INHERITS", True, "Class"), "inheritedBy": Relation("INHERITS", False, "Class"),
        "implements": Relation("IMPLEMENTS", True, "Class"), "implementedBy": Relation("IMPLEMENTS", False, "Class"),
        "methods": Relation("HAS_METHOD", True, "Function"), "definedIn": Relation("DEFINES", False, "File"),
    },
    "Module": {
        "dependsOn": Relation("DEPENDS_ON", True, "Module"), "dependedOnBy": Relation("DEPENDS_ON", False, "Module"),
        "importedBy": Relation("IMPORTS", False, "File"), "exports": Relation("EXPORTS", True, "Function"),
    },
    "File": {
        "imports": Relation("IMPORTS", True, "Module"), "externalImports": Relation("IMPORTS", True, "ExternalReference"),
        "definesFunctions": Relation("DEFINES", True, "Function"), "definesClasses": Relation("DEFINES", True, "Class"),
        "folder": Relation("CONTAINS", False, "Folder"),
    },
    "Folder": {"files": Relation("CONTAINS", True, "File"), "folders": Relation("CONTAINS", True, "Folder"), "parent": Relation("CONTAINS", False, "Folder")},
    "Repository": {"modules": Relation("HAS_MODULE", True, "Module"), "files": Relation("CONTAINS", True, "File"), "folders": Relation("CONTAINS", True, "Folder")},
    "ExternalReference": {"importedBy": Relation("IMPORTS", False, "File"), "calledBy": Relation("CALLS", False, "Function")},
}


def _split(key: str, columns: list[str]) -> tuple[str, str]:
    if key in columns:
        return key, "eq"
    name, _, op = key.rpartition("_")
    if op in _OPS and name in columns:
        return name, op
    raise ValueError(f"unknown filter {key!r}")


def condition(name: str, op: str, value, is_list: bool = False) -> Column:
    c = F.col(name)
    if op == "isNull":
        return c.isNull() if value else c.isNotNull()
    if is_list:
        values = F.array(*(F.lit(v) for v in value)) if isinstance(value, (list, tuple)) else None
        if op == "contains":
            return F.array_contains(c, value)
        if op in ("in", "nin"):
            hit = F.arrays_overlap(c, values)
            return hit if op == "in" else ~hit
        if op not in ("eq", "not"):
            raise ValueError(f"a list has no filter {op!r}")
        return c == values if op == "eq" else c != values
    return {
        "eq": lambda: c == F.lit(value), "not": lambda: c != F.lit(value), "gt": lambda: c > value, "gte": lambda: c >= value,
        "lt": lambda: c < value, "lte": lambda: c <= value, "contains": lambda: c.contains(value), "startsWith": lambda: c.startswith(value),
        "endsWith": lambda: c.endswith(value), "regex": lambda: c.rlike(f"^(?:{value})$"), "in": lambda: c.isin(*value), "nin": lambda: ~c.isin(*value),
    }[op]()


def predicate(where: dict, df: DataFrame, leaf=None) -> Column:
    """The column for a filter. leaf: gives the column for a key that names a relation, else None."""
    kinds = dict(df.dtypes)
    out = F.lit(True)
    for key, value in where.items():
        if key == "AND":
            part = F.lit(True)
            for w in value:
                part = part & predicate(w, df, leaf)
        elif key == "OR":
            part = F.lit(False)
            for w in value:
                part = part | predicate(w, df, leaf)
        elif key == "NOT":
            part = ~predicate(value, df, leaf)
        else:
            part = leaf(key, value) if leaf else None
            if part is None:
                name, op = _split(key, df.columns)
                part = condition(name, op, value, kinds[name].startswith("array"))
        out = out & part
    return out


def _relation(kind: str, key: str) -> tuple[Relation | None, str] | None:
    """The relation that a key names, None for the repository, and how it is meant."""
    if key == "repository":
        return None, "some"
    if key in FIELDS[kind]:
        return FIELDS[kind][key], "some"
    name, _, how = key.rpartition("_")
    if name in FIELDS[kind] and how.lower() in ("some", "none", "all", "single"):
        return FIELDS[kind][name], how.lower()
    return None


def related(graph: CodeGraph, rel: Relation | None, how: str, inner: dict | None) -> tuple[DataFrame, list[str], bool]:
    """(hits, keys, wanted): nodes whose keys are, or are not, among the hits fulfil the relation."""
    if rel is None:
        return find(graph, "Repository", inner).select(F.col("name").alias("repo")), ["repo"], True
    own, other = ("src_id", "dst_id") if rel.outgoing else ("dst_id", "src_id")
    if how == "all":  # none that does not match
        inner, how = {"NOT": inner or {}}, "none"
    targets = find(graph, rel.target, inner).select("repo", F.col("id").alias(other))
    hits = graph.edges(rel.rel_type).join(targets, ["repo", other], "left_semi").select("repo", F.col(own).alias("id"), F.col(other).alias("of"))
    if how == "single":
        hits = hits.groupBy("repo", "id").agg(F.count_distinct("of").alias("n")).where("n = 1")
    return hits.select("repo", "id"), ["repo", "id"], how != "none"


def find(graph: CodeGraph, kind: str, where: dict | None = None, sort: list[dict] | None = None) -> DataFrame:
    """Nodes of a type under a filter; relations become semi or anti joins, those within AND, OR and NOT marks that are joined."""
    df = graph.nodes(kind)
    plain, joins, marks = {}, [], []
    for key, value in (where or {}).items():
        rel = _relation(kind, key)
        if rel is None:
            plain[key] = value
        elif rel[0] is None and set(value) == {"name"}:
            df = df.where(F.col("repo") == value["name"])  # the partition column
        else:
            joins.append((*rel, value))

    def leaf(key: str, value) -> Column | None:
        rel = _relation(kind, key)
        if rel is None:
            return None
        hits, on, wanted = related(graph, *rel, value)
        name = f"__has{len(marks)}"
        marks.append((hits.distinct().withColumn(name, F.lit(True)), on))
        has = F.coalesce(F.col(name), F.lit(False))
        return has if wanted else ~has

    if plain:
        columns, holds = df.columns, predicate(plain, df, leaf)
        for hits, on in marks:
            df = df.join(hits, on, "left")
        df = df.where(holds).select(*columns)
    for rel, how, inner in joins:
        hits, on, wanted = related(graph, rel, how, inner)
        df = df.join(hits, on, "left_semi" if wanted else "left_anti")
    return order(df, sort) if sort else df


def order(df: DataFrame, sort: list[dict]) -> DataFrame:
    """[{field: "ASC" or "DESC"}, ...]; nulls last when ascending, first when descending."""
    keys = [F.col(f).asc_nulls_last() if d.upper() == "ASC" else F.col(f).desc_nulls_first() for s in sort for f, d in s.items()]
    return df.orderBy(*keys)


def page(df: DataFrame, key: list[str], first: int, after: tuple | None = None) -> DataFrame:
    """The next `first` rows after a key in key order, and whether more follow; key must be unique."""
    if after is not None:
        beyond = F.lit(False)
        same = F.lit(True)
        for k, v in zip(key, after, strict=True):
            beyond = beyond | (same & (F.col(k) > v))
            same = same & (F.col(k) == v)
        df = df.where(beyond)
    ahead = df.orderBy(*key).limit(first + 1)
    return ahead.withColumn("has_next", F.lit(ahead.agg(F.count(F.lit(1)) > first).scalar())).orderBy(*key).limit(first)


def cursor(values: tuple) -> str:
    """The opaque text for a key's values."""
    return base64.b64encode(json.dumps(list(values)).encode()).decode()


def cursor_page(df: DataFrame, key: list[str], first: int, after: str | None = None) -> DataFrame:
    """page() by cursors: the rows with cursor, has_next, has_previous and total_count, the count without any cursor."""
    at = tuple(json.loads(base64.b64decode(after))) if after else None
    total = df.agg(F.count(F.lit(1))).scalar()
    before = F.lit(False)
    if at is not None:  # whether any row is at the cursor or before it
        beyond, same = F.lit(False), F.lit(True)
        for k, v in zip(key, at, strict=True):
            beyond, same = beyond | (same & (F.col(k) > v)), same & (F.col(k) == v)
        before = df.where(~beyond).agg(F.count(F.lit(1)) > 0).scalar()
    parts = [F.concat(F.lit('"'), F.replace(F.replace(F.col(k).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) if t == "string" else F.col(k).cast("string") for k, t in ((k, dict(df.dtypes)[k]) for k in key)]
    text = F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    out = page(df, key, first, at)
    return out.withColumns({"cursor": F.base64(F.encode(text, "UTF-8")), "has_previous": F.lit(before), "total_count": F.lit(total)})


def connection(graph: CodeGraph, kind: str, field: str, first: int, sort: list[str], where: dict | None = None) -> DataFrame:
    """For each node the first related nodes by sort, one row each: src_id, position, node columns, edge columns."""
    from pyspark.sql import Window

    rel = FIELDS[kind][field]
    own, other = ("src_id", "dst_id") if rel.outgoing else ("dst_id", "src_id")
    nodes = find(graph, rel.target, where)
    rows = graph.edges(rel.rel_type).select("repo", F.col(own).alias("of"), F.col(other).alias("id"), "call_type").join(nodes, ["repo", "id"])
    w = Window.partitionBy("repo", "of").orderBy(*sort, "id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= first)
