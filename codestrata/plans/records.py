"""Queries on registrations, deletions, ages, call records and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import files as X
from codestrata.functions import names as N
from codestrata.operators import graph_build as B
from codestrata.operators import graph_query as G
from codestrata.operators import traverse as T
from codestrata.operators.merge import keep_first
from codestrata.plans.catalog import current, entries, files, functions, repositories
from codestrata.sources.scratch import Scratch
from codestrata.sources.tables import read_table
from codestrata.streaming.incremental import delete_files


def registrations_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories registered after March 2021 whose address was not registered before."""
    r = read_table(spark, sf_dir, "repositories", "id", "github_url", "created_at")
    first = keep_first(r, ["github_url"], ["created_at", "id"])
    known = first.where("created_at < timestamp '2021-04-01'").select("github_url")
    return first.where("created_at >= timestamp '2021-04-01'").join(known, "github_url", "left_anti").select("id", "github_url")


def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: function records before and after the files that are not SCANNED any more are deleted."""
    fn = functions(spark, sf_dir).select("id", "repository_id", "file_id")
    gone = files(spark, sf_dir).where("scan_status <> 'SCANNED' or is_hidden or size_bytes < 1000").select(F.col("id").alias("file_id"))
    left = delete_files(fn, gone).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_left"))
    every = fn.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_before"))
    return every.join(left, "repository_id", "left").select("repository_id", "n_before", F.coalesce("n_left", F.lit(0)).alias("n_left"))


def file_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each file at the end of 2025, in words."""
    f = files(spark, sf_dir)
    return f.select("id", X.relative_time(F.col("updated_at"), F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("age"))


def calls_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: call records, and distinct (file, caller, callee, line)."""
    c = read_table(spark, sf_dir, "calls", "language", "file_id", "caller_name", "callee_name", "start_line")
    per = c.groupBy("language", "file_id", "caller_name", "callee_name", "start_line").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("language").agg(F.sum("n").cast("bigint").alias("n_calls"), F.count(F.lit(1)).alias("n_distinct"))


def edges_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per edge type: stored rows, and edges after the merge on (source, type, target)."""
    e = read_table(spark, sf_dir, "graph_edges", "source_id", "target_id", "edge_type", "repository_id")
    rows = e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_rows"))
    merged = B.merge_edges(e).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"))
    return rows.join(merged, "edge_type")


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct successors and predecessors of every node of the stored graph."""
    pairs = G.directed(read_table(spark, sf_dir, "graph_edges", "source_id", "target_id"))
    both = pairs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        pairs.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return both.groupBy("node").agg(F.sum("o").cast("bigint").alias("out_degree"), F.sum("i").cast("bigint").alias("in_degree"))


def qualified_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified name to id, the least id per file and name."""
    e = entries(spark, sf_dir).where("qualified_name is not null")
    return keep_first(e.select("file_id", "qualified_name", "id"), ["file_id", "qualified_name"], ["id"])


def function_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and language: constructors, methods, functions, async and public ones."""
    f = functions(spark, sf_dir)
    kind = F.when(F.col("is_constructor"), "constructor").when(F.col("is_method"), "method").otherwise("function")
    n = lambda c: F.count(F.when(c, 1))
    return f.withColumn("kind", kind).groupBy("repository_id", "language").agg(
        n(F.col("kind") == "constructor").alias("n_constructors"), n(F.col("kind") == "method").alias("n_methods"),
        n(F.col("kind") == "function").alias("n_functions"), n(F.col("is_async")).alias("n_async"), n(F.col("visibility") == "public").alias("n_public"),
    )


def repository_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository with its name, files, bytes and commonest language; zeros without files."""
    f = files(spark, sf_dir).where("scan_status = 'SCANNED'")
    per = f.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    top = keep_first(per.withColumn("m", -F.col("n")).select("repository_id", "m", "language"), ["repository_id"], ["m", "language"])
    tot = per.groupBy("repository_id").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    r = repositories(spark, sf_dir).select(F.col("id").alias("repository_id"), "full_name")
    return r.join(tot, "repository_id", "left").join(top.select("repository_id", F.col("language").alias("main_language")), "repository_id", "left").select(
        "repository_id", "full_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_files"), F.coalesce("b", F.lit(0)).cast("bigint").alias("total_bytes"), "main_language"
    )


def call_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between top-level names of a repository: how often each calls each other."""
    c = read_table(spark, sf_dir, "calls", "repository_id", "caller_name", "callee_object").where("caller_name is not null and callee_object is not null")
    head = lambda x: F.regexp_extract(N.strip(F.col(x)), r"^[^.]*", 0)
    rows = c.select("repository_id", head("caller_name").alias("source"), head("callee_object").alias("target")).where("source <> target")
    return rows.groupBy("repository_id", "source", "target").agg(F.count(F.lit(1)).alias("n_calls"))


def undirected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest way, whatever the direction of the edges, between the symbols that call the same symbol, over at most 2 calls."""
    e = G.of_types(read_table(spark, sf_dir, "graph_edges", "source_id", "target_id", "edge_type"), ["CALLS"])
    # the least and the greatest caller of each callee
    ends = e.groupBy("target_id").agg(F.min("source_id").alias("source"), F.max("source_id").alias("target")).where("source <> target")
    return T.shortest_paths(G.directed(e, "both"), ends, 2, Scratch(spark, "undirected")).select("source", "target", F.col("hops").cast("bigint").alias("hops"), "path")


_NAMES = "registrations_new delete_counts file_ages calls_distinct edges_merged degrees qualified_map function_kinds repository_manifest call_modules undirected_paths"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_FD = "fd AS (SELECT DISTINCT * EXCLUDE (parameters, decorators, created_at) FROM function_definitions), g AS (SELECT fd.* FROM fd JOIN f ON fd.file_id = f.id)"
_F = "WITH " + current("repository_files", "f")
SQL = {
    "registrations_new": "WITH k AS (SELECT id, github_url, created_at FROM (SELECT *, row_number() OVER (PARTITION BY github_url ORDER BY created_at, id) AS n FROM repositories) WHERE n = 1) SELECT id, github_url FROM k WHERE created_at >= TIMESTAMPTZ '2021-04-01 00:00:00+00'",
    "delete_counts": _F + ", " + _FD + ", x AS (SELECT id FROM f WHERE scan_status <> 'SCANNED' OR is_hidden OR size_bytes < 1000) SELECT repository_id, count(*) AS n_before, count(*) FILTER (file_id NOT IN (SELECT id FROM x)) AS n_left FROM g GROUP BY 1",
    "file_ages": _F + ", s AS (SELECT id, CAST(floor(epoch(TIMESTAMPTZ '2026-01-01 00:00:00+00')) - floor(epoch(updated_at)) AS BIGINT) AS s FROM f) SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM s",
    "calls_distinct": "SELECT language, CAST(sum(n) AS BIGINT) AS n_calls, count(*) AS n_distinct FROM (SELECT language, file_id, caller_name, callee_name, start_line, count(*) AS n FROM calls GROUP BY ALL) GROUP BY 1",
    "edges_merged": "SELECT edge_type, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_edges FROM (SELECT edge_type, source_id, target_id, count(*) AS n FROM graph_edges GROUP BY ALL) GROUP BY 1",
    "degrees": "WITH p AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT s AS node, 1 AS o, 0 AS i FROM p UNION ALL SELECT t, 0, 1 FROM p) GROUP BY 1",
    "qualified_map": "WITH " + current("symbol_index_entries", "e") + " SELECT file_id, qualified_name, min(id) AS id FROM e WHERE qualified_name IS NOT NULL GROUP BY 1, 2",
    "function_kinds": _F + ", " + _FD + " SELECT repository_id, language, count(*) FILTER (is_constructor) AS n_constructors, count(*) FILTER (is_method AND NOT is_constructor) AS n_methods, count(*) FILTER (NOT is_method AND NOT is_constructor) AS n_functions, count(*) FILTER (is_async) AS n_async, count(*) FILTER (visibility = 'public') AS n_public FROM g GROUP BY 1, 2",
    "repository_manifest": _F + ", " + current("repositories", "r") + ", p AS (SELECT repository_id, language, count(*) AS n, sum(size_bytes) AS b FROM f WHERE scan_status = 'SCANNED' GROUP BY 1, 2), t AS (SELECT repository_id, language FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, language) AS k FROM p) WHERE k = 1), s AS (SELECT repository_id, sum(n) AS n, sum(b) AS b FROM p GROUP BY 1) SELECT r.id AS repository_id, full_name, CAST(coalesce(s.n, 0) AS BIGINT) AS n_files, CAST(coalesce(s.b, 0) AS BIGINT) AS total_bytes, t.language AS main_language FROM r LEFT JOIN s ON s.repository_id = r.id LEFT JOIN t ON t.repository_id = r.id",
    "call_modules": r"WITH c AS (SELECT repository_id, regexp_extract(regexp_replace(caller_name, '^\s+|\s+$', '', 'g'), '^[^.]*', 0) AS source, regexp_extract(regexp_replace(callee_object, '^\s+|\s+$', '', 'g'), '^[^.]*', 0) AS target FROM calls WHERE caller_name IS NOT NULL AND callee_object IS NOT NULL) SELECT repository_id, source, target, count(*) AS n_calls FROM c WHERE source <> target GROUP BY ALL",
    "undirected_paths": """WITH c AS (SELECT DISTINCT source_id AS s, target_id AS t FROM graph_edges WHERE edge_type = 'CALLS'),
w AS (SELECT DISTINCT source, target FROM (SELECT min(s) AS source, max(s) AS target FROM c GROUP BY t) WHERE source <> target),
b AS (SELECT s AS src, t AS dst FROM c UNION SELECT t, s FROM c),
one AS (SELECT source, target, 1 AS hops, source || ' > ' || target AS path FROM w JOIN b ON b.src = source AND b.dst = target),
two AS (SELECT source, target, 2 AS hops, min(source || ' > ' || x.dst || ' > ' || target) AS path FROM w JOIN b x ON x.src = source JOIN b y ON y.src = x.dst AND y.dst = target GROUP BY 1, 2)
SELECT source, target, CAST(hops AS BIGINT) AS hops, path FROM one UNION ALL SELECT source, target, CAST(hops AS BIGINT), path FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.source = two.source AND one.target = two.target)""",
}
