"""Queries over the driver's tables, one for each operator of the engine, with their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import names, paths
from loomgraph.operators import analytics, mutate, resolve, search, traverse, where
from loomgraph.operators.freeform import FreeGraph
from loomgraph.plans import bridge
from loomgraph.plans.bridge import table
from loomgraph.sources.manifest import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Views that several oracles share.
_F = """f AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, 'pkg/' || p_brand || '.go' AS path, CASE WHEN p_size % 2 = 0 THEN 'go' ELSE 'python' END AS language,
  p_type AS signature, 'func ' || p_name || ' returns ' || p_type AS source, (p_partkey % 200 + 1)::INT AS s, p_size, p_type, p_brand,
  CASE WHEN p_size > 1 THEN (p_partkey % 200 + 1 + p_size - 1)::INT ELSE (p_partkey % 200 + 1)::INT END AS e FROM part)"""
_DENSE = """calls AS (SELECT DISTINCT a.l_partkey::VARCHAR AS a, b.l_partkey::VARCHAR AS b FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
_SPARSE = _DENSE.replace("WHERE", "WHERE a.l_linenumber = 1 AND a.l_returnflag = 'R' AND")
_P = r"""p AS (SELECT 'p:' || page_id AS id, regexp_extract(url, '://([^?#]*)', 1) AS path, html, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)"""
_H = """e AS (SELECT 'c:' || c_custkey AS a, 'n:' || c_nationkey AS b, 'INHERITS' AS rel FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'INHERITS' FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'INHERITS' FROM nation UNION ALL SELECT 'c:' || c_custkey, 'm:' || c_mktsegment, 'IMPLEMENTS' FROM customer),
  n AS (SELECT 'c:' || c_custkey AS id, c_name AS name, 'customer' AS path FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name, 'region' FROM region UNION ALL SELECT DISTINCT 'm:' || c_mktsegment, c_mktsegment, 'segment' FROM customer)"""


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _reach(edges: str, start: str, depth: int, forward: bool = True) -> str:
    a, b = ("a", "b") if forward else ("b", "a")
    return f"""WITH RECURSIVE {edges}, w(node, depth) AS (SELECT '{start}', 0 UNION SELECT c.{b}, w.depth + 1 FROM w JOIN calls c ON c.{a} = w.node WHERE w.depth < {depth}),
    r AS (SELECT node, min(depth)::INT AS depth FROM w GROUP BY node HAVING min(depth) > 0)"""


def _names(column: str) -> str:
    return f"coalesce(array_to_string(list_sort(list({column})), ','), '')"


# --- traversal -----------------------------------------------------------------------------------------------------------
@_query("callees_depth3", _reach(_DENSE + "," + _F, "1", 3) + " SELECT f.id, f.name, f.path, r.depth FROM r JOIN f ON f.id = r.node")
def callees_depth3(s, d):
    return traverse.callees(bridge.parts(s, d), "parts", "1", 3, by="id").select("id", "name", "path", "depth")


@_query("callers_depth2", _reach(_SPARSE + "," + _F, "7", 2, False) + " SELECT f.id, f.name, f.path, r.depth FROM r JOIN f ON f.id = r.node")
def callers_depth2(s, d):
    return traverse.callers(bridge.parts(s, d, dense=False), "parts", "7", 2, by="id").select("id", "name", "path", "depth")


@_query("callers_by_name", f"""WITH {_SPARSE}, {_F}, x AS (SELECT DISTINCT fa.name AS an, fb.name AS bn, fa.path, fa.id FROM calls JOIN f fa ON fa.id = a JOIN f fb ON fb.id = b),
  l1 AS (SELECT DISTINCT an AS name FROM x WHERE bn = 'red plate' AND an <> 'red plate'),
  l2 AS (SELECT DISTINCT an AS name FROM x JOIN l1 ON x.bn = l1.name WHERE an <> 'red plate' AND an NOT IN (SELECT name FROM l1)),
  m AS (SELECT an AS name, 1 AS depth, path, id FROM x WHERE bn = 'red plate' AND an <> 'red plate' UNION ALL SELECT an, 2, path, x.id FROM x JOIN l1 ON x.bn = l1.name JOIN l2 ON l2.name = x.an)
  SELECT name, depth, min(path) AS path FROM m GROUP BY name, depth""")
def callers_by_name(s, d):
    return traverse.callers(bridge.parts(s, d, dense=False), "parts", "red plate", 2).select("name", "depth", "path")


@_query("hierarchy_up", f"""WITH {_H}, l1 AS (SELECT b, rel FROM e WHERE a = 'c:1'), l2 AS (SELECT e.b, e.rel FROM l1 JOIN e ON e.a = l1.b AND e.rel = l1.rel)
  SELECT name, path, 1 AS depth, rel AS relation, 'up' AS direction FROM l1 JOIN n ON n.id = l1.b UNION ALL SELECT name, path, 2, rel, 'up' FROM l2 JOIN n ON n.id = l2.b""")
def hierarchy_up(s, d):
    return traverse.hierarchy(bridge.classes(s, d), "tpch", "Customer#000000001", "up", 2).drop("id")


@_query("hierarchy_both", f"""WITH {_H}, l1 AS (SELECT a, b FROM e WHERE rel = 'INHERITS' AND b = 'n:3'), l0 AS (SELECT b FROM e WHERE rel = 'INHERITS' AND a = 'n:3')
  SELECT name, path, 1 AS depth, 'INHERITS' AS relation, 'down' AS direction FROM l1 JOIN n ON n.id = l1.a UNION ALL SELECT name, path, 1, 'INHERITS', 'up' FROM l0 JOIN n ON n.id = l0.b""")
def hierarchy_both(s, d):
    return traverse.hierarchy(bridge.classes(s, d), "tpch", "NATION_3", "both", 1).drop("id")


_M = """m AS (SELECT DISTINCT 'm:' || h AS id, translate(h, '/.', '') AS name, h AS path FROM (SELECT unnest(hrefs) AS h FROM p)),
  dep AS (SELECT DISTINCT 'm:' || hrefs[1] AS a, 'm:' || hrefs[2] AS b FROM p WHERE len(hrefs) > 1 AND hrefs[1] <> hrefs[2]),
  nd AS (SELECT DISTINCT ma.name AS a, mb.name AS b, mb.path FROM dep JOIN m ma ON ma.id = dep.a JOIN m mb ON mb.id = dep.b)"""


@_query("module_dependencies", f"""WITH {_P}, {_M}, l1 AS (SELECT b AS name, 1 AS depth, min(path) AS path FROM nd WHERE a = 'The' AND b <> 'The' GROUP BY b),
  l2 AS (SELECT b AS name, 2 AS depth, min(nd.path) AS path FROM nd JOIN l1 ON nd.a = l1.name WHERE b <> 'The' AND b NOT IN (SELECT name FROM l1) GROUP BY b) SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def module_dependencies(s, d):
    return traverse.dependencies(bridge.web(s, d), "web", "The", 2).select("name", "depth", "path")


@_query("file_dependencies", f"""WITH {_P}, {_M} SELECT DISTINCT m.name, m.path FROM (SELECT unnest(hrefs) AS h FROM p WHERE path = (SELECT min(path) FROM p)) x JOIN m ON m.path = x.h""")
def file_dependencies(s, d):
    g = bridge.web(s, d)
    path = g.nodes("File").agg(F.min("path")).first()[0]
    return traverse.dependencies(g, "web", path).select("name", "path").distinct()


@_query("references_function", f"""WITH {_SPARSE}, {_F} SELECT fa.name, 'caller' AS relation, min(fa.path) AS path FROM calls JOIN f fa ON fa.id = a JOIN f fb ON fb.id = b
  WHERE fb.name = 'hot plate' AND fa.name <> 'hot plate' GROUP BY fa.name""")
def references_function(s, d):
    return traverse.references(bridge.parts(s, d, dense=False), "parts", "hot plate").select("name", "relation", "path")


@_query("references_class", f"WITH {_H} SELECT name, path, 'child' AS relation FROM e JOIN n ON n.id = e.a WHERE rel = 'INHERITS' AND b = 'r:2' UNION ALL SELECT name, path, 'implementor' FROM e JOIN n ON n.id = e.a WHERE rel = 'IMPLEMENTS' AND b = 'r:2'")
def references_class(s, d):
    return traverse.references(bridge.classes(s, d), "tpch", "ASIA").select("name", "path", "relation")


_CHAIN = """WITH RECURSIVE {e}, w(node, depth) AS (SELECT '{a}', 0 UNION SELECT c.b, w.depth + 1 FROM w JOIN calls c ON c.a = w.node WHERE w.depth < {n})
  SELECT min(depth) IS NOT NULL AS found, coalesce(min(depth), 0)::INT AS depth FROM w WHERE node = '{b}'"""


@_query("call_chain", _CHAIN.format(e=_DENSE, a="3", b="17", n=5))
def call_chain(s, d):
    return traverse.call_chain(bridge.parts(s, d), "parts", "3", "17", 5).select("found", "depth")


@_query("call_chain_sparse", _CHAIN.format(e=_SPARSE, a="5", b="11", n=5))
def call_chain_sparse(s, d):
    return traverse.call_chain(bridge.parts(s, d, dense=False), "parts", "5", "11", 5).select("found", "depth")


@_query("shortest_path", f"""WITH RECURSIVE {_SPARSE}, u AS (SELECT a, b FROM calls UNION SELECT b, a FROM calls), w(node, depth) AS (SELECT '1', 0 UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.node WHERE w.depth < 6)
  SELECT min(depth)::INT AS hops FROM w WHERE node = '9' HAVING min(depth) IS NOT NULL""")
def shortest_path(s, d):
    return traverse.shortest_path(bridge.part_calls(s, d, dense=False), "1", "9", 6).select("hops")


@_query("graph_neighbors", f"WITH {_SPARSE} SELECT a AS src_id, b AS dst_id FROM calls WHERE a = '7' OR b = '7' ORDER BY a, b LIMIT 50")
def graph_neighbors(s, d):
    free = FreeGraph.of(bridge.parts(s, d, dense=False))
    return free.neighbors("7", "CALLS", 50)[1].select("src_id", "dst_id")


@_query("graph_get_node", f"WITH {_F} SELECT id, name, p_size::VARCHAR AS complexity FROM f WHERE id = '12'")
def graph_get_node(s, d):
    free = FreeGraph.of(bridge.parts(s, d))
    return free.get_node("12").select("id", F.col("properties")["name"].alias("name"), F.col("properties")["cyclomaticComplexity"].alias("complexity"))


@_query("graph_metadata", f"""WITH {_SPARSE}, h AS (SELECT count(*) AS n FROM part WHERE p_size <= 5), c AS (SELECT count(*) AS n FROM calls), b AS (SELECT count(DISTINCT p_brand) AS n FROM part), f AS (SELECT count(*) AS n FROM part)
  SELECT 'nodes' AS what, '' AS name, f.n + 2 * b.n AS n FROM f, b UNION ALL SELECT 'edges', '', c.n + h.n FROM c, h UNION ALL SELECT 'label', 'Function', n FROM f UNION ALL SELECT 'label', 'Class', n FROM b
  UNION ALL SELECT 'label', 'File', n FROM b UNION ALL SELECT 'type', 'CALLS', n FROM c UNION ALL SELECT 'type', 'HAS_METHOD', n FROM h""")
def graph_metadata(s, d):
    return FreeGraph.of(bridge.parts(s, d, dense=False)).metadata()


@_query("graph_search", "SELECT p_partkey::VARCHAR AS id FROM part WHERE lower(p_name) LIKE '%red pl%' ORDER BY id LIMIT 20")
def graph_search(s, d):
    return FreeGraph.of(bridge.parts(s, d)).search("Red Pl", ["Function"], 20).select("id")


@_query("graph_samples", "SELECT p_partkey::VARCHAR AS id FROM part ORDER BY id LIMIT 5")
def graph_samples(s, d):
    g = bridge.parts(s, d)
    return FreeGraph.of(g.__class__(s, {"Function": g.tables["Function"]}, g.edge_table)).samples(5)[0].select("id")


@_query("graph_sql", "SELECT p_brand AS brand, count(*) AS n, avg(p_size) AS mean_size FROM part GROUP BY p_brand")
def graph_sql(s, d):
    free = FreeGraph.of(bridge.parts(s, d))
    return free.sql("SELECT substring_index(substring_index(properties['path'], '/', -1), '.', 1) AS brand, count(*) AS n, avg(CAST(properties['cyclomaticComplexity'] AS INT)) AS mean_size FROM nodes WHERE labels[0] = 'Function' GROUP BY 1")


@_query("graph_union", "SELECT count(DISTINCT p_partkey) AS n FROM part")
def graph_union(s, d):
    g = bridge.parts(s, d)
    one = FreeGraph.of(g.__class__(s, {"Function": g.tables["Function"]}, g.edge_table))
    return one.union(one).nodes.agg(F.count(F.lit(1)).alias("n"))


@_query("connection_page", f"WITH {_SPARSE}, {_F} SELECT a AS of, f.id, f.name, (row_number() OVER (PARTITION BY a ORDER BY f.name, f.id))::INT AS position FROM calls JOIN f ON f.id = b WHERE p_size > 10 QUALIFY row_number() OVER (PARTITION BY a ORDER BY f.name, f.id) <= 2")
def connection_page(s, d):
    return where.connection(bridge.parts(s, d, dense=False), "Function", "calls", 2, ["name"], {"cyclomaticComplexity_gt": 10}).select("of", "id", "name", "position")


# --- search --------------------------------------------------------------------------------------------------------------
@_query("find_function", f"WITH {_F} SELECT 'function' AS type, name, path, language, signature, 1.0::DOUBLE AS score, 'exact' AS strategy FROM f WHERE name = 'red plate'")
def find_function(s, d):
    return search.find_function(bridge.parts(s, d), "parts", "red plate")


@_query("find_file", r"""SELECT DISTINCT 'pkg/' || p_brand || '.go' AS path, 0.9::DOUBLE AS score, NULL::VARCHAR AS symbols FROM part WHERE regexp_full_match(p_brand, 'Brand#1[^/]*')""")
def find_file(s, d):
    return search.find_file(bridge.parts(s, d), "parts", "Brand#1*.go").select("path", "score", F.array_join("symbols", ",").alias("symbols"))


@_query("find_file_symbols", """SELECT 'pkg/Brand#7.go' AS path, array_to_string(list(name ORDER BY r, name), ',') AS symbols FROM (SELECT 0 AS r, p_name AS name FROM part WHERE p_brand = 'Brand#7' UNION ALL SELECT 1, 'Brand#7') HAVING count(*) > 0""")
def find_file_symbols(s, d):
    return search.find_file(bridge.parts(s, d), "parts", "Brand#7.go").select("path", F.array_join("symbols", ",").alias("symbols"))


@_query("search_exact", "SELECT 'function' AS type, p_name AS name, 'pkg/' || p_brand || '.go' AS path, 1.0::DOUBLE AS score, 'exact' AS strategy FROM part WHERE p_name = 'hot ring'")
def search_exact(s, d):
    return search.search_names(bridge.parts(s, d), "parts", "hot ring").drop("language")


@_query("search_tokens", "SELECT 'class' AS type, p_brand AS name, 1.0::DOUBLE AS score FROM part WHERE p_brand IN ('Brand#3', 'Brand#4') GROUP BY p_brand")
def search_tokens(s, d):
    return search.search_names(bridge.parts(s, d), "parts", "Brand#3 and Brand#4 nothing").select("type", "name", "score")


@_query("search_fuzzy", """SELECT name, round(score, 9) AS score FROM (SELECT p_name AS name, 1.0 - levenshtein('red plat', p_name)::DOUBLE / greatest(8, length(p_name)) AS score, 'pkg/' || p_brand || '.go' AS path FROM part)
  WHERE score >= 0.6 ORDER BY score DESC, path, name LIMIT 25""")
def search_fuzzy(s, d):
    return search.search_names(bridge.parts(s, d), "parts", "red plat*", 25).select("name", F.round("score", 9).alias("score"))


@_query("search_file_glob", "SELECT DISTINCT 'file' AS type, p_brand || '.go' AS name, 0.9::DOUBLE AS score FROM part WHERE p_brand = 'Brand#5'")
def search_file_glob(s, d):
    return search.search_names(bridge.parts(s, d), "parts", "pkg/Brand#5.go").select("type", "name", "score")


@_query("search_code", f"WITH {_F} SELECT DISTINCT 'function' AS type, name, path, 0.8::DOUBLE AS score FROM f WHERE contains(source, 'plate returns SMALL') ORDER BY path, name LIMIT 10")
def search_code(s, d):
    return search.search_code(bridge.parts(s, d), "parts", "plate returns SMALL", 10).select("type", "name", "path", "score")


@_query("search_document_text", "SELECT source AS repo, count(*) AS n FROM documents WHERE contains(substr(text, 1, 6000), 'the') GROUP BY source")
def search_document_text(s, d):
    stored = bridge.document_files(s, d).select("repo", names.truncate(F.col("text")).alias("source"))
    return stored.where(F.col("source").contains("the")).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@_query("query_classifier", r"""SELECT c_custkey AS k, CASE WHEN regexp_matches(q, '[*?]') THEN 'fuzzy' WHEN contains(q, '/') AND regexp_matches(q, '\.[^./]+$') THEN 'file' ELSE 'exact' END AS kind
  FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '*' WHEN 1 THEN 'src/' || c_name || '.go' WHEN 2 THEN 'a/' || c_name ELSE c_name END AS q FROM customer)""")
def query_classifier(s, d):
    k = F.col("c_custkey") % 4
    q = F.when(k == 0, F.concat("c_name", F.lit("*"))).when(k == 1, F.concat(F.lit("src/"), "c_name", F.lit(".go"))).when(k == 2, F.concat(F.lit("a/"), "c_name")).otherwise(F.col("c_name"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("k"), names.classify_query_column(q).alias("kind"))


# --- analytics -----------------------------------------------------------------------------------------------------------
@_query("dead_code", f"""WITH {_SPARSE}, {_F}, x AS (SELECT 0 AS r, 'function' AS type, name, path, id FROM f WHERE p_size > 5 AND id NOT IN (SELECT b FROM calls) UNION ALL SELECT DISTINCT 1, 'class', p_brand, path, 'b:' || p_brand FROM f)
  SELECT type, name, path, id FROM x WHERE NOT regexp_full_match(name, 'hot [^/]*')""")
def dead_code(s, d):
    return analytics.dead_code(bridge.parts(s, d, dense=False), "parts", exclude="hot *", limit=None)


@_query("dead_code_limited", f"""WITH {_SPARSE}, {_F} SELECT 'function' AS type, name, path, id FROM f WHERE p_size > 5 AND p_size % 10 <> 0 AND id NOT IN (SELECT b FROM calls) ORDER BY path, name, id LIMIT 50""")
def dead_code_limited(s, d):
    return analytics.dead_code(bridge.parts(s, d, dense=False), "parts", exclude_decorated=True)


@_query("most_complex", f"WITH {_F} SELECT id, name, path, p_size AS complexity FROM f WHERE p_size >= 5 ORDER BY p_size DESC, path, name, id LIMIT 10")
def most_complex(s, d):
    return analytics.most_complex(bridge.parts(s, d), "parts").select("id", "name", "path", "complexity")


@_query("complexity_of", f"WITH {_F} SELECT id, p_size AS complexity FROM f WHERE name = 'small ring'")
def complexity_of(s, d):
    return analytics.complexity_of(bridge.parts(s, d), "parts", "small ring").select("id", "complexity")


@_query("repository_stats", "SELECT 'Function' AS type, count(*) AS n FROM part UNION ALL SELECT 'Class', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'File', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'Folder', 0 UNION ALL SELECT 'Module', 0")
def repository_stats(s, d):
    return analytics.repository_stats(bridge.parts(s, d), "parts")


@_query("list_repositories", "SELECT DISTINCT source AS name FROM documents")
def list_repositories(s, d):
    repos = bridge.document_files(s, d).select("repo", F.col("repo").alias("name"), F.col("repo").alias("id"))
    return analytics.list_repositories(bridge.CodeGraph(s, {"Repository": repos}))


@_query("repo_map_files", "SELECT 'pkg' AS dir, 'pkg/' || p_brand || '.go' AS path, count(*) + 1 AS symbols FROM part GROUP BY p_brand")
def repo_map_files(s, d):
    return analytics.repo_map_files(bridge.parts(s, d), "parts").select("dir", "path", "symbols")


@_query("repo_map_dirs", f"""WITH {_P} SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, array_to_string(list(string_split(path, '/')[-1] ORDER BY string_split(path, '/')[-1]), ',') AS files,
  count(*) AS n_files, 0::BIGINT AS n_symbols FROM p GROUP BY 1""")
def repo_map_dirs(s, d):
    m = analytics.repo_map(bridge.web(s, d), "web")
    return m.select("dir", F.array_join(F.transform("files", lambda f: f["filename"]), ",").alias("files"), "n_files", "n_symbols")


@_query("file_overview", f"WITH {_F} SELECT 'function' AS type, name, s AS starting, e AS ending FROM f WHERE p_brand = 'Brand#9' UNION ALL SELECT 'class', 'Brand#9', 1, 1")
def file_overview(s, d):
    return analytics.file_overview(bridge.parts(s, d), "parts", "pkg/Brand#9.go").select("type", "name", F.col("startingLine").alias("starting"), F.col("endingLine").alias("ending"))


@_query("symbol_context", f"""WITH {_SPARSE}, {_F}, own AS (SELECT path FROM f WHERE name = 'red bolt' ORDER BY path LIMIT 1)
  SELECT 'red bolt' AS name, path, (SELECT {_names('DISTINCT fa.name')} FROM calls JOIN f fa ON fa.id = a JOIN f fb ON fb.id = b WHERE fb.name = 'red bolt' AND fa.name <> 'red bolt') AS callers,
  (SELECT {_names('DISTINCT fb.name')} FROM calls JOIN f fa ON fa.id = a JOIN f fb ON fb.id = b WHERE fa.name = 'red bolt' AND fb.name <> 'red bolt') AS callees,
  (SELECT {_names('DISTINCT n')} FROM (SELECT name AS n FROM f WHERE path IN (SELECT path FROM own) UNION ALL SELECT p_brand FROM f WHERE path IN (SELECT path FROM own)) WHERE n <> 'red bolt') AS siblings FROM own""")
def symbol_context(s, d):
    c = analytics.symbol_context(bridge.parts(s, d, dense=False), "parts", "red bolt")
    return c.select("name", "path", *(F.array_join(x, ",").alias(x) for x in ("callers", "callees", "siblings")))


@_query("read_source", f"WITH {_F}, w(position, name) AS (VALUES (0, 'hot gear'), (2, 'Brand#2'), (3, 'blue bolt')), x AS (SELECT 0 AS r, name, path, source, id FROM f UNION ALL SELECT 1, p_brand, path, 'type ' || p_brand, 'b' FROM f) SELECT position, name, min(path) AS path, arg_min(source, path || ' ' || id) AS source FROM w JOIN x USING (name) GROUP BY position, name")
def read_source(s, d):
    return analytics.read_source(bridge.parts(s, d), "parts", " hot gear, absent,Brand#2 ,, blue bolt").drop("type")


# --- filters, order, pages ------------------------------------------------------------------------------------------------
@_query("where_plain", """SELECT p_partkey::VARCHAR AS id FROM part WHERE (p_size >= 10 AND p_size < 40) AND (contains(p_name, 'red') OR p_type IN ('SMALL', 'LARGE') OR regexp_full_match(p_name, 'hot .*g.*')) AND NOT (p_name LIKE '%ring') AND p_brand <> 'Brand#3'""")
def where_plain(s, d):
    w = {"cyclomaticComplexity_gte": 10, "cyclomaticComplexity_lt": 40, "OR": [{"name_contains": "red"}, {"signature_in": ["SMALL", "LARGE"]}, {"name_regex": "hot .*g.*"}], "NOT": {"name_endsWith": "ring"}, "path_not": "pkg/Brand#3.go"}
    return where.find(bridge.parts(s, d), "Function", w).select("id")


@_query("where_lists", "SELECT p_partkey::VARCHAR AS id FROM part WHERE p_size % 10 = 0 AND (p_type = 'SMALL' OR p_brand IN ('Brand#1', 'Brand#2')) AND p_type NOT IN ('ECONOMY')")
def where_lists(s, d):
    w = {"OR": [{"decorators_contains": "SMALL"}, {"decorators_in": ["Brand#1", "Brand#2"]}], "signature_nin": ["ECONOMY"], "decorators_isNull": False}
    return where.find(bridge.parts(s, d), "Function", w).select("id")


@_query("where_some", f"WITH {_SPARSE}, {_F} SELECT DISTINCT fa.id FROM calls JOIN f fa ON fa.id = a JOIN f fb ON fb.id = b WHERE fb.p_size > 40 AND fa.language = 'go'")
def where_some(s, d):
    return where.find(bridge.parts(s, d, dense=False), "Function", {"language": "go", "calls_some": {"cyclomaticComplexity_gt": 40}}).select("id")


@_query("where_none", f"WITH {_SPARSE}, {_F} SELECT id FROM f WHERE id NOT IN (SELECT b FROM calls) AND p_size > 5")
def where_none(s, d):
    return where.find(bridge.parts(s, d, dense=False), "Function", {"calledBy_NONE": {}, "owner_none": {}}).select("id")


@_query("where_to_one", "SELECT p_partkey::VARCHAR AS id FROM part WHERE p_size <= 5 AND p_brand = 'Brand#6'")
def where_to_one(s, d):
    return where.find(bridge.parts(s, d, dense=False), "Function", {"owner": {"name": "Brand#6"}, "repository": {"name": "parts"}}).select("id")


@_query("sorted_top", f"WITH {_F} SELECT id, name FROM f ORDER BY name DESC, id LIMIT 15")
def sorted_top(s, d):
    return where.find(bridge.parts(s, d), "Function", sort=[{"name": "DESC"}, {"id": "ASC"}]).select("id", "name").limit(15)


@_query("keyset_page", f"WITH {_F} SELECT id, name, true AS has_next FROM f WHERE (name, id) > ('hot ring', '5') ORDER BY name, id LIMIT 10")
def keyset_page(s, d):
    return where.page(bridge.parts(s, d).nodes("Function").select("id", "name"), ["name", "id"], 10, ("hot ring", "5"))


# --- mutations -------------------------------------------------------------------------------------------------------------
@_query("merge_last_wins", "SELECT user_id::VARCHAR AS name, event_type AS path FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def merge_last_wins(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("path"), F.lit("ev").alias("repo"), F.struct("ts", "event_id").alias("seq"))
    return mutate.merge_nodes(bridge.CodeGraph(s), "Repository", e, seq="seq").nodes("Repository").select("name", "path")


@_query("merge_overwrites", f"WITH {_F} SELECT id, CASE WHEN p_size > 45 THEN 'merged' ELSE signature END AS signature FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name, path ORDER BY id) = 1)")
def merge_overwrites(s, d):
    g = bridge.parts(s, d)
    base = mutate.last_wins(g.nodes("Function").withColumn("seq", F.lit(0) - F.rank().over(Window.partitionBy("name", "path").orderBy("id"))), ["name", "path"], "seq").drop("seq")
    g = g.with_nodes("Function", base)
    return mutate.merge_nodes(g, "Function", base.where("cyclomaticComplexity > 45").withColumn("signature", F.lit("merged"))).nodes("Function").select("id", "signature")


@_query("update_nodes", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_name LIKE 'red%' THEN 'x' ELSE p_type END AS signature FROM part")
def update_nodes(s, d):
    return mutate.update_nodes(bridge.parts(s, d), "Function", {"name_startsWith": "red"}, {"signature": F.lit("x")})[0].nodes("Function").select("id", "signature")


@_query("delete_nodes", f"WITH {_SPARSE}, {_F}, x AS (SELECT id FROM f WHERE name LIKE 'hot%'), h AS (SELECT id FROM f WHERE p_size <= 5 AND name LIKE 'hot%') SELECT (SELECT count(*) FROM x) AS nodes_deleted, (SELECT count(*) FROM calls WHERE a IN (SELECT id FROM x) OR b IN (SELECT id FROM x)) + (SELECT count(*) FROM h) AS relationships_deleted")
def delete_nodes(s, d):
    return mutate.delete_nodes(bridge.parts(s, d, dense=False), "Function", {"name_startsWith": "hot"})[1]


@_query("connect_edges", f"WITH {_SPARSE}, {_F} SELECT a.id AS src_id, b.id AS dst_id FROM f a, f b WHERE a.p_size = 50 AND b.p_size = 49 UNION SELECT a, b FROM calls JOIN f ON f.id = a WHERE p_size = 50")
def connect_edges(s, d):
    g = bridge.parts(s, d, dense=False)
    own = g.nodes("Function").where("cyclomaticComplexity = 50").select("repo", F.col("id").alias("src_id"))
    g = g.with_edges(g.edges("CALLS").join(own, ["repo", "src_id"], "left_semi"))  # before the product, all of whose edges start there
    return mutate.connect(g, "Function", "calls", {"cyclomaticComplexity": 50}, {"cyclomaticComplexity": 49}, "direct").edges("CALLS").select("src_id", "dst_id")


@_query("disconnect_edges", f"WITH {_SPARSE}, {_F} SELECT a AS src_id, b AS dst_id FROM calls JOIN f ON f.id = a WHERE p_size <= 25")
def disconnect_edges(s, d):
    return mutate.disconnect(bridge.parts(s, d, dense=False), "Function", "calls", {"cyclomaticComplexity_gt": 25}, {}).edges("CALLS").select("src_id", "dst_id")


@_query("set_complexity", "SELECT p_partkey::VARCHAR AS id, coalesce(m, p_size)::INT AS complexity FROM part LEFT JOIN (SELECT p_name AS n, p_brand AS b, max(p_size) * 2 AS m FROM part WHERE p_size > 30 GROUP BY ALL) ON n = p_name AND b = p_brand")
def set_complexity(s, d):
    g = bridge.parts(s, d)
    new = g.nodes("Function").where("cyclomaticComplexity > 30").select("repo", "name", "path", (F.col("cyclomaticComplexity") * 2).alias("complexity"))
    return mutate.set_complexity(g, new).nodes("Function").select("id", F.col("cyclomaticComplexity").alias("complexity"))


@_query("delete_repository", "SELECT source AS repo, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source")
def delete_repository(s, d):
    g = bridge.CodeGraph(s, {"File": bridge.document_files(s, d)})
    return mutate.delete_repository(g, "src3").nodes("File").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@_query("bind_edges", "SELECT DISTINCT 'n:' || n_nationkey AS dst_id, 'r:' || r_regionkey AS src_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def bind_edges(s, d):
    c = bridge.classes(s, d).nodes("Class")
    facts = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = facts.select(F.lit("tpch").alias("repo"), F.col("r_name").alias("from_name"), F.lit("region").alias("from_path"), F.col("n_name").alias("to_name"), F.lit("nation").alias("to_path"))
    return mutate.bind_edges(c, c, facts, ["name", "path"], ["name", "path"], "CONTAINS").select("src_id", "dst_id")


# --- reference resolution ----------------------------------------------------------------------------------------------------
_R = r"""refs AS (SELECT id AS from_id, translate(h, '/', '') AS to_name, contains(h, '.') AS ext, h FROM (SELECT id, unnest(hrefs) AS h FROM p)),
  sym AS (SELECT DISTINCT 'm:' || h AS id, translate(h, '/.', '') AS name FROM (SELECT unnest(hrefs) AS h FROM p))"""


@_query("resolve_edges", f"WITH {_P}, {_R}, u AS (SELECT name, min(id) AS id FROM sym GROUP BY name HAVING count(*) = 1) SELECT DISTINCT from_id AS src_id, u.id AS dst_id FROM refs JOIN u ON u.name = to_name WHERE NOT ext")
def resolve_edges(s, d):
    return resolve.resolved_edges(bridge.page_refs(s, d), bridge.web(s, d).nodes("Module")).select("src_id", "dst_id")


@_query("resolve_statistics", f"WITH {_P}, {_R} SELECT (SELECT count(*) FROM sym) AS n_symbols, count(*) AS n_references, count(*) FILTER (to_name IN (SELECT name FROM sym)) AS n_resolved, count(DISTINCT to_name) FILTER (to_name NOT IN (SELECT name FROM sym)) AS n_unresolved FROM refs WHERE NOT ext")
def resolve_statistics(s, d):
    g = bridge.web(s, d)
    return resolve.statistics(bridge.page_refs(s, d), g.nodes("Module"), g.nodes("File"))


@_query("unresolved_names", f"WITH {_P}, {_R} SELECT DISTINCT to_name FROM refs WHERE NOT ext AND to_name NOT IN (SELECT name FROM sym WHERE length(name) > 4)")
def unresolved_names(s, d):
    g = bridge.web(s, d)
    return resolve.unresolved_names(bridge.page_refs(s, d), g.nodes("Module").where(F.length("name") > 4), g.nodes("File")).select("to_name")


@_query("external_references", f"WITH {_P}, {_R} SELECT to_name AS name, h AS import_path, count(DISTINCT from_id) AS n FROM refs WHERE ext GROUP BY ALL")
def external_references(s, d):
    nodes, edges = resolve.external_references(bridge.page_refs(s, d))
    return nodes.join(edges, nodes["id"] == edges["dst_id"]).groupBy("name", F.col("importPath").alias("import_path")).agg(F.count(F.lit(1)).alias("n"))


@_query("symbol_multiplicity", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name")
def symbol_multiplicity(s, d):
    return resolve.multiplicity(bridge.part_functions(s, d)).select("name", "n")


# --- scalar functions -------------------------------------------------------------------------------------------------------
@_query("path_functions", rf"""WITH {_P} SELECT id, string_split(path, '/')[-1] AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '(\.[^./]*)$', 1) AS ext, replace(regexp_replace(path, '\.[^./]*$', ''), '/', '.') AS dotted FROM p""")
def path_functions(s, d):
    p = F.col("path")
    return bridge.page_files(s, d).select("id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extension(p).alias("ext"), paths.dotted_module(p).alias("dotted"))


@_query("glob_filter", rf"WITH {_P} SELECT id FROM p WHERE regexp_full_match(path, '[^/]*/en/[1-5][^/]*')")
def glob_filter(s, d):
    return bridge.page_files(s, d).where(paths.glob_match(F.col("path"), "*/en/[1-5]*")).select("id")


@_query("resolve_import_paths", rf"""WITH {_P} SELECT id, regexp_extract(path, '^([^/]*)/', 1) || '/lib/x' AS target FROM p WHERE path LIKE '%/%/%' AND path NOT LIKE '%/%/%/%'""")
def resolve_import_paths(s, d):
    p = bridge.page_files(s, d).where("path LIKE '%/%/%' AND path NOT LIKE '%/%/%/%'")
    return p.select("id", paths.resolve_import(F.col("path"), F.lit(".././lib//y/../x")).alias("target"))


@_query("line_counts", r"SELECT 'd:' || doc_id AS id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::INT AS n FROM documents")
def line_counts(s, d):
    return bridge.document_files(s, d).select("id", paths.line_count(F.col("text")).alias("n"))


@_query("truncate_middle", "SELECT 'd:' || doc_id AS id, md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 50) || chr(10) || '... [truncated, ' || length(text) || ' total chars] ...' || chr(10) || right(text, 50) ELSE text END) AS digest FROM documents")
def truncate_middle(s, d):
    return bridge.document_files(s, d).select("id", F.md5(names.truncate_middle(F.col("text"), 100)).alias("digest"))


@_query("name_functions", r"""SELECT c_custkey AS k, CASE WHEN regexp_matches(c_name, '^\p{Lu}') THEN 'public' ELSE 'package' END AS go_visibility, regexp_matches(c_name, '\p{Ll}\p{Lu}|\p{Lu}\p{Ll}') AS camel, 'x/' || c_mktsegment || ':' || c_name AS key, c_name AS bare FROM customer""")
def name_functions(s, d):
    n = F.col("c_name")
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("k"), names.go_visibility(n).alias("go_visibility"), names.is_camel(n).alias("camel"),
        names.symbol_key(F.concat(F.lit("x/"), "c_mktsegment"), n).alias("key"), names.strip_wildcards(F.concat(F.lit("*"), n, F.lit("?"))).alias("bare"),
    )


@_query("language_detection", r"SELECT doc_id AS k, CASE doc_id % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'tsx' WHEN 2 THEN 'c' WHEN 3 THEN '' ELSE '' END AS language, doc_id % 5 = 4 AS is_test FROM documents")
def language_detection(s, d):
    k = F.col("doc_id") % 5
    path = F.when(k == 0, "a/b.GO").when(k == 1, "x.tsx").when(k == 2, "inc/y.h").when(k == 3, "Makefile").otherwise("tests/data.bin")
    return table(s, d, "documents").select(F.col("doc_id").alias("k"), paths.detect_language(path).alias("language"), paths.is_test_file(path).alias("is_test"))


@_query("incremental_manifest", """WITH prev AS (SELECT user_id, max(date_trunc('second', ts)) AS t FROM events WHERE event_id % 3 <> 0 GROUP BY user_id), cur AS (SELECT user_id, max(date_trunc('second', ts)) AS t FROM events WHERE user_id % 7 <> 0 GROUP BY user_id)
  SELECT 'u' || coalesce(c.user_id, p.user_id) AS path, CASE WHEN c.user_id IS NULL THEN 'deleted' WHEN p.user_id IS NULL THEN 'new' WHEN c.t > p.t THEN 'changed' ELSE 'unchanged' END AS state FROM cur c FULL JOIN prev p ON p.user_id = c.user_id""")
def incremental_manifest(s, d):
    e = table(s, d, "events")

    def manifest(df: DataFrame) -> DataFrame:
        return df.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")).agg(F.max(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("mtime")).withColumn("repo", F.lit("ev"))

    return incremental(manifest(e.where("user_id % 7 <> 0")), manifest(e.where("event_id % 3 <> 0"))).select("path", "state")


# --- several repositories in one graph -----------------------------------------------------------------------------------
def _two_repos(s, d):
    """Every part in two repositories under the same id; the calls of the second are those of the first, turned round."""
    g = bridge.parts(s, d)
    f, e = g.nodes("Function"), g.edges("CALLS")
    turned = e.select(F.lit("turned").alias("repo"), "rel_type", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "call_type")
    return g.__class__(s, {"Function": f.unionByName(f.withColumn("repo", F.lit("turned")))}, e.unionByName(turned))


_TWO = f"""WITH {_DENSE}, two AS (SELECT 'parts' AS repo, a, b FROM calls UNION ALL SELECT 'turned', b, a FROM calls)"""


@_query("where_some_two_repos", f"{_TWO} SELECT DISTINCT repo, a AS id FROM two JOIN part ON p_partkey::VARCHAR = b WHERE p_size = 1")
def where_some_two_repos(s, d):
    return where.find(_two_repos(s, d), "Function", {"calls_some": {"cyclomaticComplexity": 1}}).select("repo", "id")


@_query("where_or_relation", f"{_TWO}, h AS (SELECT DISTINCT repo, a AS id FROM two JOIN part ON p_partkey::VARCHAR = b WHERE p_size = 1), n AS (SELECT r.repo, p_partkey::VARCHAR AS id, p_size FROM part, (SELECT 'parts' AS repo UNION ALL SELECT 'turned') r) SELECT n.repo, n.id FROM n LEFT JOIN h ON h.repo = n.repo AND h.id = n.id WHERE h.id IS NOT NULL OR p_size > 45")
def where_or_relation(s, d):
    return where.find(_two_repos(s, d), "Function", {"OR": [{"calls_some": {"cyclomaticComplexity": 1}}, {"cyclomaticComplexity_gt": 45}]}).select("repo", "id")


@_query("delete_nodes_two_repos", f"{_TWO} SELECT repo, a AS src_id, b AS dst_id FROM two WHERE NOT (repo = 'parts' AND EXISTS (SELECT 1 FROM part WHERE p_size <= 5 AND p_partkey::VARCHAR IN (a, b)))")
def delete_nodes_two_repos(s, d):
    left, _ = mutate.delete_nodes(_two_repos(s, d), "Function", {"repository": {"name": "parts"}, "cyclomaticComplexity_lte": 5})
    return left.edges().select("repo", "src_id", "dst_id")
