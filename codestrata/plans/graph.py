"""Queries that build and ask the code graph, and that extract records from sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import names as N
from codestrata.operators import graph_build as B
from codestrata.operators import graph_query as G
from codestrata.operators import index as I
from codestrata.operators import scan as S
from codestrata.operators import traverse as T
from codestrata.parsing import definitions as D
from codestrata.parsing import records as P
from codestrata.plans.catalog import current, entries, files, jobs, repositories
from codestrata.sources.scratch import Scratch
from codestrata.sources.tables import read_table
from codestrata.streaming.incremental import delete_nodes


def _edges(spark, sf_dir) -> DataFrame:
    return B.merge_edges(read_table(spark, sf_dir, "graph_edges", "source_id", "target_id", "edge_type", "repository_id"))


def _nodes(spark, sf_dir) -> DataFrame:
    f, e = files(spark, sf_dir), entries(spark, sf_dir)
    parts = [
        B.repository_nodes(repositories(spark, sf_dir)), B.directory_nodes(S.ancestor_directories(f)), B.file_nodes(f), B.symbol_nodes(e, f),
    ]
    return B.merge_nodes(B.valid_nodes(reduce(DataFrame.unionByName, parts)))


def _known(spark, sf_dir) -> DataFrame:
    """Ids of all nodes, written once as both ends of the edges ask for them."""
    return Scratch(spark, "nodes").save(_nodes(spark, sf_dir).select("node_id"))


def _symbols(spark, sf_dir) -> DataFrame:
    return B.symbol_nodes(entries(spark, sf_dir), files(spark, sf_dir))


def node_counts(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("repository_id", "node_type").agg(F.count(F.lit(1)).alias("n_nodes"))


def contains_edges(spark, sf_dir):
    f = files(spark, sf_dir)
    rows = B.directory_edges(f, S.ancestor_directories(f)).unionByName(B.containment_edges(_symbols(spark, sf_dir)))
    return B.merge_edges(rows).select("source_id", "target_id", "edge_type")


def defines_edges(spark, sf_dir):
    return B.merge_edges(B.defines_edges(entries(spark, sf_dir))).select("source_id", "target_id", "edge_type")


def call_edges(spark, sf_dir):
    """Call records resolved to edges between index entries."""
    c = read_table(spark, sf_dir, "calls", "repository_id", "caller_name", "callee_name", "callee_object")
    return B.merge_edges(B.call_edges(c, entries(spark, sf_dir))).select("source_id", "target_id", "edge_type")


def edges_valid(spark, sf_dir):
    """Stored edges that the validator keeps."""
    return B.valid_edges(_edges(spark, sf_dir), _known(spark, sf_dir)).select("source_id", "target_id", "edge_type")


def graph_built(spark, sf_dir):
    """The whole build: containment, definitions and resolved calls, merged and validated; edges per type."""
    f, e = files(spark, sf_dir), entries(spark, sf_dir)
    c = read_table(spark, sf_dir, "calls", "repository_id", "caller_name", "callee_name", "callee_object")
    parts = [B.directory_edges(f, S.ancestor_directories(f)), B.containment_edges(B.symbol_nodes(e, f)), B.defines_edges(e), B.call_edges(c, e)]
    built = B.valid_edges(B.merge_edges(reduce(DataFrame.unionByName, parts)), _known(spark, sf_dir))
    return built.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"))


def neighbours_both(spark, sf_dir):
    return G.neighbours(_edges(spark, sf_dir), _symbols(spark, sf_dir), "both", ["CALLS", "INHERITS"])


def call_graph(spark, sf_dir):
    return G.subgraph(_edges(spark, sf_dir), _symbols(spark, sf_dir), ["CALLS"]).select("source_id", "target_id", "edge_type")


def unused(spark, sf_dir):
    return G.unused_functions(_symbols(spark, sf_dir), _edges(spark, sf_dir)).select("node_id")


def unused_compat(spark, sf_dir):
    return G.unused_functions(_symbols(spark, sf_dir), _edges(spark, sf_dir), literal=True).select("node_id")


def orphan_classes(spark, sf_dir):
    return G.orphan_classes(_symbols(spark, sf_dir), _edges(spark, sf_dir)).select("node_id")


def graph_counts(spark, sf_dir):
    return G.counts(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def k_hop_calls(spark, sf_dir):
    """Per caller: distinct symbols within two calls."""
    pairs = G.directed(G.of_types(_edges(spark, sf_dir), ["CALLS"]))
    starts = pairs.select(F.col("src").alias("start")).distinct()
    out = T.reach(pairs, starts, 2, Scratch(spark, "khop")).where("node <> start")
    return out.groupBy("start").agg(F.count(F.lit(1)).alias("n_reached"), F.max("depth").cast("bigint").alias("depth"))


def expand_inherits(spark, sf_dir):
    """All ancestors of each class, with their least distance."""
    pairs = G.directed(G.of_types(_edges(spark, sf_dir), ["INHERITS"]))
    starts = pairs.select(F.col("src").alias("start")).distinct()
    return T.reach(pairs, starts, 20, Scratch(spark, "expand")).where("node <> start").select("start", "node", F.col("depth").cast("bigint").alias("depth"))


def shortest_definition(spark, sf_dir):
    """Shortest way from each file to the deepest symbols that it contains or defines, over at most 4 edges."""
    e = G.of_types(_edges(spark, sf_dir), ["CONTAINS", "DEFINES"])
    pairs = G.directed(e)
    ends = e.where("edge_type = 'DEFINES'").select(F.col("source_id").alias("mid"), F.col("target_id").alias("target"))
    wanted = e.where("edge_type = 'CONTAINS'").select(F.col("source_id").alias("source"), F.col("target_id").alias("mid")).join(ends, "mid").select("source", "target")
    return T.shortest_paths(pairs, wanted, 4, Scratch(spark, "paths")).select("source", "target", F.col("hops").cast("bigint").alias("hops"), "path")


def cycles_calls(spark, sf_dir):
    """Cycles of two to four calls; ``cycles_calls_6`` has the longer ones too."""
    return _cycles_calls(spark, sf_dir, 4)


def cycles_calls_6(spark, sf_dir):
    """Cycles of two to six calls, the bound of the blueprint."""
    return _cycles_calls(spark, sf_dir, 6)


def _cycles_calls(spark, sf_dir, max_length: int) -> DataFrame:
    pairs = G.directed(G.of_types(_edges(spark, sf_dir), ["CALLS"]))
    return T.cycles(pairs, max_length, Scratch(spark, "cycles")).select(F.col("length").cast("bigint").alias("length"), "path")


#: Edges by which one node depends on another.
_DEPENDENCIES = ["CALLS", "EXPOSES_ROUTE", "IMPLEMENTS", "IMPORTS", "INHERITS"]


def has_cycle(spark, sf_dir):
    """Nodes left after peeling, 0 without a cycle: per edge type, and for the dependency edges of all types together."""
    e = _edges(spark, sf_dir)
    parts = []
    for kind, types in (("CALLS", ["CALLS"]), ("DEFINES", ["DEFINES"]), ("INHERITS", ["INHERITS"]), ("DEPENDENCIES", _DEPENDENCIES)):
        left = T.cyclic_nodes(G.directed(G.of_types(e, types)), Scratch(spark, "peel"))
        parts.append(left.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(kind).alias("edge_type"), "n_left"))
    return reduce(DataFrame.unionByName, parts)


def longest_chain(spark, sf_dir):
    pairs = G.directed(G.of_types(_edges(spark, sf_dir), ["INHERITS"]))
    return T.longest_chain(pairs, 20, Scratch(spark, "chain")).select(F.col("hops").cast("bigint").alias("hops"), "path")


def induced_classes(spark, sf_dir):
    n = _symbols(spark, sf_dir).where("node_type = 'Class'")
    return G.induced(_edges(spark, sf_dir), n).select("source_id", "target_id", "edge_type")


def delete_incremental(spark, sf_dir):
    """Edges that remain when the nodes of the IGNORED and FAILED files and of their symbols are deleted."""
    gone_files = files(spark, sf_dir).where("scan_status in ('IGNORED', 'FAILED')")
    gone = B.file_nodes(gone_files).select("node_id").unionByName(
        entries(spark, sf_dir).join(gone_files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("node_id"))
    )
    _, left = delete_nodes(_symbols(spark, sf_dir), _edges(spark, sf_dir), gone)
    return left.select("source_id", "target_id", "edge_type")


def library_of_objects(spark, sf_dir):
    """Package names of the objects that calls go to."""
    c = read_table(spark, sf_dir, "calls", "callee_object").where("callee_object is not null").distinct()
    return c.select("callee_object", N.library_name(F.col("callee_object")).alias("library"))


def _definitions(spark, sf_dir) -> DataFrame:
    return D.definitions(read_table(spark, sf_dir, "source_files"))


def parsed_functions(spark, sf_dir):
    f = D.functions(_definitions(spark, sf_dir))
    return f.select("file_id", "repository_id", "language", "function_name", "qualified_name", "is_method", "is_async", "visibility", "start_line", "signature")


def parsed_classes(spark, sf_dir):
    t = D.types(_definitions(spark, sf_dir)).withColumn("base_classes", F.array_join("base_classes", ","))
    return t.select("file_id", "repository_id", "language", "class_name", "qualified_name", "base_classes", "start_line")


def parsed_imports(spark, sf_dir):
    i = D.imports(read_table(spark, sf_dir, "source_files"))
    return i.select("file_id", "repository_id", "relative_path", "language", "module_path", "is_relative", "start_line")


def parsed_calls(spark, sf_dir):
    return D.calls(read_table(spark, sf_dir, "source_files"))


def parsed_routes(spark, sf_dir):
    """Routes that the sources declare or register, with their framework."""
    return D.routes(read_table(spark, sf_dir, "source_files"))


def parsed_import_names(spark, sf_dir):
    """Import statements of the sources with the names they bring in."""
    i = D.imports(read_table(spark, sf_dir, "source_files"))
    return i.select(*[F.array_join(c, ",").alias(c) if c in ("names", "aliases") else c for c in i.columns])


def parsed_notes(spark, sf_dir):
    """Comments and docstrings of the sources, with what they document."""
    return D.comments(read_table(spark, sf_dir, "source_files")).select("file_id", "kind", "start_line", "end_line", F.md5("text").alias("text_md5"), "symbol")


def parsed_comments(spark, sf_dir):
    """Runs of comment lines of the sources."""
    return P.comment_blocks(P.source_lines(read_table(spark, sf_dir, "source_files")))


def parsed_import_edges(spark, sf_dir):
    """Imports of the sources resolved to symbols or packages."""
    # extracted records are a table of their own, as every later step reads them
    i = Scratch(spark, "imports").save(parsed_imports(spark, sf_dir))
    e = entries(spark, sf_dir)
    libs = B.library_nodes(B.external_imports(i, e))
    return B.merge_edges(B.import_edges(i, e, libs)).select("source_id", "target_id", "edge_type")


def parsed_index(spark, sf_dir):
    """Types, functions, routes and other symbols of the sources as index entries, linked to their parents."""
    sources = read_table(spark, sf_dir, "source_files")
    d = Scratch(spark, "records").save(D.definitions(sources))
    null = F.lit(None).cast("string")
    plain = D.variables(d).select(
        "*", F.lit(False).alias("is_static"), F.lit(False).alias("is_async"), null.alias("signature"), null.alias("return_type"), null.alias("documentation"),
        F.col("start_line").alias("end_line"),
    )
    sets = [I.map_classes(D.types(d)), I.map_functions(D.functions(d)), I.map_routes(D.routes(sources)), I.map_symbols(plain)]
    linked = I.link_parents(I.index_entries(I.map_records(*sets)))
    return linked.select("id", "repository_id", "qualified_name", "symbol_type", "language", "parent_symbol_id")


def parsed_inherit_edges(spark, sf_dir):
    """Bases and interfaces of the types in the sources, resolved to the entries of the parsed index."""
    scratch = Scratch(spark, "inherits")
    e = scratch.save(parsed_index(spark, sf_dir))
    c = scratch.save(D.types(_definitions(spark, sf_dir)))
    return B.merge_edges(B.inheritance_edges(c, e).unionByName(B.implements_edges(c, e))).select("source_id", "target_id", "edge_type")


def parsed_recorded(spark, sf_dir):
    """What the texts say of every recorded function: names, scope, kind, lists, ends and signature."""
    recorded = read_table(spark, sf_dir, "function_definitions", "file_id", "function_name", "start_line").distinct()
    f = D.functions(_definitions(spark, sf_dir)).join(recorded, ["file_id", "function_name", "start_line"], "left_semi")
    return f.select(
        "file_id", "function_name", "start_line", "end_line", "qualified_name", "is_method", "is_constructor", "is_async", "is_static",
        F.array_join("parameters", ",").alias("parameters"), F.array_join("decorators", ",").alias("decorators"), "signature",
    )


def parsed_types(spark, sf_dir):
    """Classes, interfaces, enums, structs and records of the sources, with bases, interfaces, decorators and ends."""
    t = D.types(_definitions(spark, sf_dir))
    return t.select(*[F.array_join(c, ",").alias(c) if c in ("base_classes", "interfaces", "decorators") else c for c in t.columns])


def parsed_variables(spark, sf_dir):
    """Constants and variables of the sources."""
    return D.variables(_definitions(spark, sf_dir))


def parsed_documentation(spark, sf_dir):
    """Functions and types of the sources with a comment of their own, without its marks."""
    d = _definitions(spark, sf_dir).where("kind <> 'variable' and doc is not null")
    return d.select("file_id", "name", "start_line", D.documentation(F.col("doc"), F.col("language")).alias("documentation"))


def parsed_summary(spark, sf_dir):
    """Per source text: functions, types, variables, imports, calls and routes found in it."""
    src = read_table(spark, sf_dir, "source_files")
    d = _definitions(spark, sf_dir).select("file_id", "kind")
    rows = [d, *[t.select("file_id", F.lit(k).alias("kind")) for k, t in (("import", D.imports(src)), ("call", D.calls(src)), ("route", D.routes(src)))]]
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    per = reduce(DataFrame.unionByName, rows).groupBy("file_id").agg(
        *[n(k).alias(f"n_{k}s") for k in ("function", "variable", "import", "call", "route")], n("class").alias("n_classes")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in per.columns if c != "file_id"]
    return src.where("source is not null").select("file_id").join(per, "file_id", "left").select("file_id", *zero)


def job_states(spark, sf_dir):
    """Every repository with its index state: jobs seen, entries stored, or NOT_STARTED."""
    r = repositories(spark, sf_dir).select(F.col("id").alias("repository_id"))
    n = entries(spark, sf_dir).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_entries"))
    j = jobs(spark, sf_dir).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_jobs"))
    return r.join(n, "repository_id", "left").join(j, "repository_id", "left").select(
        "repository_id", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.when(F.coalesce("n_jobs", F.lit(0)) == 0, "NOT_STARTED").otherwise("COMPLETED").alias("state"),
    )


_NAMES = """node_counts contains_edges defines_edges call_edges edges_valid graph_built neighbours_both call_graph unused unused_compat orphan_classes graph_counts
k_hop_calls expand_inherits shortest_definition cycles_calls cycles_calls_6 has_cycle longest_chain induced_classes delete_incremental library_of_objects
parsed_recorded parsed_summary parsed_import_names parsed_notes parsed_types parsed_variables parsed_documentation parsed_functions parsed_classes parsed_imports parsed_calls parsed_routes parsed_comments parsed_import_edges parsed_index parsed_inherit_edges job_states"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_LABEL = "CASE " + " ".join(f"WHEN symbol_type = '{a}' THEN '{b}'" for a, b in N.NODE_LABELS.items()) + " ELSE 'Variable' END"
_BASE = "WITH RECURSIVE " + ",\n".join(
    [
        current("repository_files", "f"), current("symbol_index_entries", "e"), current("repositories", "r"),
        "g AS (SELECT source_id, edge_type, target_id, min(repository_id) AS repository_id FROM graph_edges GROUP BY 1, 2, 3)",
        "dp AS (SELECT repository_id, string_split(relative_path, '/') AS a FROM f)",
        "d AS (SELECT DISTINCT repository_id, array_to_string(a[1:k], '/') AS directory FROM (SELECT repository_id, a, unnest(range(1, len(a))) AS k FROM dp))",
        f"s AS (SELECT e.id AS node_id, {_LABEL} AS node_type, e.repository_id, name, qualified_name, coalesce(f.relative_path, '') AS file_path FROM e LEFT JOIN f ON e.file_id = f.id)",
        """n0 AS (SELECT 'repo:' || id AS node_id, 'Repository' AS node_type, id AS repository_id, string_split(full_name, '/')[-1] AS name, full_name AS qualified_name FROM r
  UNION ALL SELECT 'dir:' || repository_id || ':' || directory, 'Directory', repository_id, string_split(directory, '/')[-1], directory FROM d WHERE directory <> ''
  UNION ALL SELECT 'file:' || repository_id || ':' || relative_path, 'File', repository_id, string_split(relative_path, '/')[-1], relative_path FROM f
  UNION ALL SELECT node_id, node_type, repository_id, name, qualified_name FROM s)""",
        "n AS (SELECT node_id, max(node_type) AS node_type, max(repository_id) AS repository_id FROM n0 WHERE trim(node_id) <> '' AND trim(name) <> '' AND trim(qualified_name) <> '' GROUP BY 1)",
        "calls_e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM g WHERE edge_type = 'CALLS')",
        "inh AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM g WHERE edge_type = 'INHERITS')",
    ]
)
_ID3 = "SELECT source_id, target_id, edge_type"
SQL = {
    "node_counts": _BASE + " SELECT repository_id, node_type, count(*) AS n_nodes FROM n GROUP BY 1, 2",
    "contains_edges": _BASE + """ SELECT DISTINCT source_id, target_id, edge_type FROM (
SELECT 'repo:' || repository_id AS source_id, 'dir:' || repository_id || ':' || directory AS target_id, 'CONTAINS' AS edge_type FROM d WHERE directory <> ''
UNION ALL SELECT CASE WHEN regexp_extract(relative_path, '^(.*)/[^/]*$', 1) <> '' THEN 'dir:' || repository_id || ':' || regexp_extract(relative_path, '^(.*)/[^/]*$', 1) ELSE 'repo:' || repository_id END, 'file:' || repository_id || ':' || relative_path, 'CONTAINS' FROM f
UNION ALL SELECT 'file:' || repository_id || ':' || file_path, node_id, 'CONTAINS' FROM s WHERE file_path <> ''
UNION ALL SELECT node_id, 'file:' || repository_id || ':' || file_path, 'BELONGS_TO' FROM s WHERE file_path <> '')""",
    "defines_edges": _BASE + " SELECT DISTINCT c.parent_symbol_id AS source_id, c.id AS target_id, 'DEFINES' AS edge_type FROM e c JOIN e p ON c.parent_symbol_id = p.id",
    "call_edges": _BASE + """, q AS (SELECT repository_id, qualified_name, min(id) AS id FROM e GROUP BY 1, 2),
c AS (SELECT DISTINCT repository_id, caller_name, callee_name, callee_object FROM calls WHERE caller_name <> '' AND callee_name <> '')
SELECT DISTINCT a.id AS source_id, coalesce(b.id, b2.id) AS target_id, 'CALLS' AS edge_type FROM c
JOIN q a ON a.repository_id = c.repository_id AND a.qualified_name = c.caller_name
LEFT JOIN q b ON b.repository_id = c.repository_id AND b.qualified_name = c.callee_name
LEFT JOIN q b2 ON b2.repository_id = c.repository_id AND b2.qualified_name = concat_ws('.', nullif(c.callee_object, ''), c.callee_name)
WHERE coalesce(b.id, b2.id) IS NOT NULL""",
    "edges_valid": _BASE + f" {_ID3} FROM g WHERE (source_id <> target_id OR edge_type = 'CALLS') AND source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n)",
    "neighbours_both": _BASE + """, h AS (SELECT DISTINCT source_id, target_id, edge_type FROM g WHERE edge_type IN ('CALLS', 'INHERITS')),
x AS (SELECT source_id AS node_id, target_id AS neighbour_id, edge_type, 'outgoing' AS direction FROM h UNION ALL SELECT target_id, source_id, edge_type, 'incoming' FROM h)
SELECT x.* FROM x JOIN s a ON x.node_id = a.node_id JOIN s b ON x.neighbour_id = b.node_id WHERE a.repository_id = b.repository_id""",
    "call_graph": _BASE + " SELECT DISTINCT source_id, target_id, edge_type FROM g WHERE edge_type = 'CALLS' AND source_id IN (SELECT node_id FROM s) AND target_id IN (SELECT node_id FROM s)",
    "unused": _BASE + " SELECT node_id FROM s WHERE node_type IN ('Function', 'Method') AND node_id NOT IN (SELECT dst FROM calls_e)",
    "unused_compat": _BASE + " SELECT node_id FROM s WHERE node_type = 'Function' OR node_type = 'Method' AND node_id NOT IN (SELECT dst FROM calls_e)",
    "orphan_classes": _BASE + " SELECT node_id FROM s WHERE node_type = 'Class' AND node_id NOT IN (SELECT source_id FROM g UNION SELECT target_id FROM g)",
    "graph_counts": _BASE + " SELECT n.repository_id, count(DISTINCT n.node_id) AS n_nodes, count(g.source_id) AS n_edges FROM n LEFT JOIN g ON g.source_id = n.node_id GROUP BY 1",
    "k_hop_calls": _BASE + """, h AS (SELECT src AS start, dst AS node, 1 AS depth FROM calls_e UNION ALL SELECT a.src, b.dst, 2 FROM calls_e a JOIN calls_e b ON a.dst = b.src),
m AS (SELECT start, node, min(depth) AS depth FROM h WHERE node <> start GROUP BY 1, 2) SELECT start, count(*) AS n_reached, CAST(max(depth) AS BIGINT) AS depth FROM m GROUP BY 1""",
    "expand_inherits": _BASE + """, w AS (SELECT src AS start, dst AS node, 1 AS depth FROM inh UNION SELECT w.start, i.dst, w.depth + 1 FROM w JOIN inh i ON w.node = i.src WHERE w.depth < 20)
SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM w WHERE start <> node GROUP BY 1, 2""",
    "cycles_calls": _BASE + """, c AS (SELECT src, dst FROM calls_e WHERE src <> dst),
w AS (SELECT [src, dst] AS p FROM c WHERE src < dst UNION ALL SELECT list_append(w.p, c.dst) FROM w JOIN c ON w.p[-1] = c.src WHERE len(w.p) < 4 AND c.dst > w.p[1] AND NOT list_contains(w.p, c.dst))
SELECT CAST(len(p) AS BIGINT) AS length, array_to_string(p, ' > ') AS path FROM w JOIN c ON w.p[-1] = c.src AND c.dst = w.p[1]""",
    "induced_classes": _BASE + f" {_ID3} FROM g WHERE source_id IN (SELECT node_id FROM s WHERE node_type = 'Class') AND target_id IN (SELECT node_id FROM s WHERE node_type = 'Class')",
    "delete_incremental": _BASE + f""", x AS (SELECT * FROM f WHERE scan_status IN ('IGNORED', 'FAILED')),
z AS (SELECT 'file:' || repository_id || ':' || relative_path AS id FROM x UNION SELECT e.id FROM e JOIN x ON e.file_id = x.id)
{_ID3} FROM g WHERE source_id NOT IN (SELECT id FROM z) AND target_id NOT IN (SELECT id FROM z)""",
    "job_states": "WITH " + current("repositories", "r") + ", " + current("symbol_index_entries", "e") + ", " + current("file_parse_jobs", "j", "file_id") + """
, ne AS (SELECT repository_id, count(*) AS n FROM e GROUP BY 1), nj AS (SELECT repository_id, count(*) AS n FROM j GROUP BY 1)
SELECT r.id AS repository_id, coalesce(nj.n, 0) AS n_jobs, coalesce(ne.n, 0) AS n_entries, CASE WHEN nj.n IS NULL THEN 'NOT_STARTED' ELSE 'COMPLETED' END AS state
FROM r LEFT JOIN ne ON ne.repository_id = r.id LEFT JOIN nj ON nj.repository_id = r.id""",
    "library_of_objects": "SELECT DISTINCT callee_object, CASE WHEN callee_object LIKE '%/%' AND callee_object LIKE '%.%' THEN string_split(rtrim(callee_object, '/'), '/')[-1] ELSE regexp_extract(callee_object, '^[^./]*', 0) END AS library FROM calls WHERE callee_object IS NOT NULL",
}
_CORE = {k: SQL[k][len(_BASE):] for k in ("contains_edges", "defines_edges")}
_CALLS = SQL["call_edges"][len(_BASE):].split("\nSELECT DISTINCT", 1)
SQL["graph_built"] = _BASE + _CALLS[0] + f""", built AS ({_CORE["contains_edges"]} UNION {_CORE["defines_edges"]} UNION SELECT DISTINCT{_CALLS[1]})
SELECT edge_type, count(*) AS n_edges FROM built WHERE (source_id <> target_id OR edge_type = 'CALLS') AND source_id IN (SELECT node_id FROM n) AND target_id IN (SELECT node_id FROM n) GROUP BY 1"""
_PATHS = """, p AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM g WHERE edge_type IN ('CONTAINS', 'DEFINES')),
w AS (SELECT DISTINCT a.source_id AS source, b.target_id AS target FROM g a JOIN g b ON a.edge_type = 'CONTAINS' AND b.edge_type = 'DEFINES' AND a.target_id = b.source_id),
t AS (SELECT source, target, source AS node, source AS path, 0 AS hops FROM w
  UNION ALL SELECT t.source, t.target, p.dst, t.path || ' > ' || p.dst, t.hops + 1 FROM t JOIN p ON t.node = p.src WHERE t.hops < 4 AND t.node <> t.target),
h AS (SELECT source, target, hops, min(path) AS path, row_number() OVER (PARTITION BY source, target ORDER BY hops) AS k FROM t WHERE node = target GROUP BY 1, 2, 3)
SELECT source, target, CAST(hops AS BIGINT) AS hops, path FROM h WHERE k = 1"""
SQL["shortest_definition"] = _BASE + _PATHS
_KINDS = {"CALLS": ["CALLS"], "DEFINES": ["DEFINES"], "INHERITS": ["INHERITS"], "DEPENDENCIES": _DEPENDENCIES}
# what peeling leaves lies behind one cycle and before another, or on one
SQL["has_cycle"] = _BASE + ", x AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS edge_type, source_id AS s, target_id AS d FROM g WHERE edge_type IN ({', '.join(map(repr, v))})" for k, v in _KINDS.items()
) + """), q AS (SELECT edge_type, s, d FROM x UNION SELECT q.edge_type, q.s, x.d FROM q JOIN x ON q.edge_type = x.edge_type AND q.d = x.s),
c AS (SELECT edge_type, s AS n FROM q WHERE s = d),
l AS (SELECT q.edge_type, q.d AS n FROM q JOIN c ON q.edge_type = c.edge_type AND q.s = c.n INTERSECT SELECT q.edge_type, q.s FROM q JOIN c ON q.edge_type = c.edge_type AND q.d = c.n)
SELECT k.edge_type, count(l.n) AS n_left FROM (VALUES """ + ", ".join(f"('{k}')" for k in _KINDS) + ") k(edge_type) LEFT JOIN l ON l.edge_type = k.edge_type GROUP BY 1"
SQL["longest_chain"] = _BASE + """, p AS (SELECT src, dst FROM inh WHERE src <> dst),
t AS (SELECT DISTINCT src AS node, src AS path, 0 AS hops FROM p WHERE src NOT IN (SELECT dst FROM p)
  UNION ALL SELECT p.dst, t.path || ' > ' || p.dst, t.hops + 1 FROM t JOIN p ON t.node = p.src WHERE t.hops < 20)
SELECT CAST(hops AS BIGINT) AS hops, min(path) AS path FROM t WHERE hops = (SELECT max(hops) FROM t) GROUP BY 1"""
_LINES = r"""WITH src AS (SELECT file_id, repository_id, relative_path, language, replace(replace(source, chr(65279), ''), chr(13) || chr(10), chr(10)) AS body FROM source_files WHERE source IS NOT NULL),
ln AS (SELECT file_id, repository_id, relative_path, language, unnest(string_split(body, chr(10))) AS t, CAST(unnest(range(1, len(string_split(body, chr(10))) + 1)) AS INTEGER) AS start_line FROM src)"""
# the imports and types of the given sources begin a line of their own, so that lines alone tell them
SQL["parsed_imports"] = _LINES + r""", m AS (SELECT *, CASE
  WHEN language = 'Python' THEN coalesce(nullif(regexp_extract(t, '^\s*from\s+(\S+)\s+import\b', 1), ''), nullif(regexp_extract(t, '^\s*import\s+([\w.]+)\s*$', 1), ''))
  WHEN language IN ('JavaScript', 'TypeScript') THEN nullif(regexp_extract(t, '^\s*import\b[^''"]*[''"]([^''"]+)[''"]', 1), '')
  WHEN language = 'Java' THEN nullif(regexp_extract(t, '^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;', 1), '')
  WHEN language = 'Go' THEN nullif(regexp_extract(t, '^(?:import)?\s+(?:[\w.]+\s+)?"([^"]+)"\s*$', 1), '') END AS module_path FROM ln)
SELECT file_id, repository_id, relative_path, language, module_path, module_path LIKE '.%' AS is_relative, start_line FROM m WHERE module_path IS NOT NULL"""
SQL["parsed_classes"] = _LINES + r""", m AS (SELECT *, CASE
  WHEN language = 'Python' THEN regexp_extract(t, '^\s*class\s+(\w+)', 1)
  WHEN language = 'Go' THEN regexp_extract(t, '^type\s+(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b', 1)
  WHEN language = 'Java' THEN regexp_extract(t, '^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)', 1)
  ELSE regexp_extract(t, '^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)', 1) END AS class_name,
  CASE WHEN language = 'Python' THEN regexp_extract(t, '^\s*class\s+\w+\s*\(([^)]*)\)', 1) WHEN language <> 'Go' THEN regexp_extract(t, '\bextends\s+([\w.]+)', 1) ELSE '' END AS bases
  FROM ln WHERE language IN ('Python', 'Go', 'Java', 'JavaScript', 'TypeScript'))
SELECT file_id, repository_id, language, class_name, class_name AS qualified_name,
  array_to_string([trim(b) FOR b IN string_split(bases, ',') IF trim(b) <> '' AND NOT contains(b, '=')], ',') AS base_classes, start_line FROM m WHERE class_name <> ''"""
SQL["parsed_recorded"] = """SELECT DISTINCT file_id, function_name, start_line, end_line, qualified_name, is_method, is_constructor, is_async, is_static,
array_to_string(parameters, ',') AS parameters, array_to_string(decorators, ',') AS decorators, signature FROM function_definitions
WHERE file_id IN (SELECT file_id FROM source_files WHERE source IS NOT NULL)"""
SQL["cycles_calls_6"] = SQL["cycles_calls"].replace("len(w.p) < 4", "len(w.p) < 6")
