"""Queries that look up many keys, page, validate, delete and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import graph_build as B
from codestrata.operators import graph_query as G
from codestrata.operators import index as I
from codestrata.operators import lookup as L
from codestrata.operators import traverse as T
from codestrata.operators.merge import keep_first, latest, numbered
from codestrata.plans.catalog import current, entries, files, functions, jobs, repositories
from codestrata.plans.graph import _BASE, _edges, _known, _nodes, _symbols
from codestrata.sources import records as R
from codestrata.sources.scratch import Scratch
from codestrata.sources.tables import read_table

#: Edges by which one part of a project needs another.
DEPENDS = ["DEPENDS_ON", "IMPORTS", "INHERITS"]
CLASS_KINDS = ["class", "enum", "interface", "struct"]


def lookup_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source name of the documents with the id and the address of its repository, null where it is not registered."""
    wanted = read_table(spark, sf_dir, "documents", "source").where("source is not null").distinct()
    r = repositories(spark, sf_dir)
    by_name = L.lookup(wanted, r, {"source": "full_name"}, "id", "repository_id")
    return L.lookup(by_name, r, {"repository_id": "id"}, "github_url", "github_url")


def lookup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file row of every source text, by id and by repository and path."""
    s = read_table(spark, sf_dir, "source_files", "file_id", "repository_id", "relative_path")
    f = files(spark, sf_dir)
    by_path = L.lookup(s, f, {"repository_id": "repository_id", "relative_path": "relative_path"}, "id", "id_by_path")
    return L.lookup(by_path, f, {"file_id": "id"}, "scan_status", "scan_status").select("file_id", "id_by_path", "scan_status")


def lookup_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest job of every file, null where the file has none."""
    f = files(spark, sf_dir).select(F.col("id").alias("file_id"))
    return L.lookup(L.lookup(f, jobs(spark, sf_dir), {"file_id": "file_id"}, "id", "job_id"), jobs(spark, sf_dir), {"file_id": "file_id"}, "parse_status", "parse_status")


def lookup_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index entry of every recorded function, by repository and qualified name."""
    wanted = read_table(spark, sf_dir, "function_definitions", "repository_id", "qualified_name").distinct()
    return L.lookup(wanted, entries(spark, sf_dir), {"repository_id": "repository_id", "qualified_name": "qualified_name"}, "id", "entry_id")


def lookup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of the source node of every edge, if it is a node of the edge's own repository."""
    wanted = _edges(spark, sf_dir).select("source_id", "repository_id").distinct()
    return L.lookup(wanted, _nodes(spark, sf_dir), {"source_id": "node_id", "repository_id": "repository_id"}, "node_type", "node_type")


def nodes_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least node of every qualified name of a repository."""
    s = _symbols(spark, sf_dir).where("qualified_name is not null")
    return keep_first(s.select("repository_id", "qualified_name", "node_id"), ["repository_id", "qualified_name"], ["node_id"])


def classes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of the classes, interfaces, enums and structs of Java in order of qualified name."""
    e = entries(spark, sf_dir).where(F.col("symbol_type").isin(CLASS_KINDS))
    return I.page(e, ["qualified_name", "id"], limit=500, language="Java").select("id", "symbol_type", "qualified_name")


def functions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages of functions of Go: methods, functions that are none, and both."""
    f = functions(spark, sf_dir)
    parts = [
        I.page(f, ["qualified_name", "id", "start_line"], limit=200, language="Go", is_method=flag).select(F.lit(name).alias("kind"), "id", "qualified_name", "start_line")
        for name, flag in (("methods", True), ("functions", False), ("all", None))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def neighbours_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 100 neighbours of every symbol, by edge type, direction and id."""
    n = G.neighbours(_edges(spark, sf_dir), _symbols(spark, sf_dir), "both", ["CALLS", "INHERITS"])
    return L.page_per(n, ["node_id"], ["edge_type", "direction", "neighbour_id"], 100)


def dir_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names come before each file in the listing of its directory."""
    path = F.regexp_replace(F.col("relative_path"), r"\\", "/")
    f = files(spark, sf_dir).where("scan_status = 'SCANNED'").select("id", "repository_id", F.regexp_extract(path, r"^(.*/)?[^/]*$", 1).alias("directory"), F.regexp_extract(path, r"[^/]*$", 0).alias("name"))
    f = f.withColumn("_scope", F.concat_ws(":", "repository_id", "directory")).withColumn("_order", F.concat("name", F.lit("\0"), "id"))
    return numbered(f, "_scope", "_order", "n_before").select("id", "directory", "name", F.col("n_before").cast("bigint").alias("n_before"))


def edges_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the validator drops, by type and reason."""
    gone = B.dropped_edges(_edges(spark, sf_dir), _known(spark, sf_dir))
    return gone.groupBy("edge_type", "reason").agg(F.count(F.lit(1)).alias("n_edges"))


def dependency_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the dependency edges whose ends are both there, each once, with its degrees."""
    e = Scratch(spark, "dependencies").save(G.subgraph(_edges(spark, sf_dir), _symbols(spark, sf_dir), DEPENDS))
    ends = e.select(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        e.select(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    n = ends.groupBy("node_id").agg(F.sum("o").cast("bigint").alias("n_out"), F.sum("i").cast("bigint").alias("n_in"))
    return n.join(_symbols(spark, sf_dir).select("node_id", "node_type"), "node_id")


def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of two to six dependency or call edges that hold at least one dependency."""
    e = _edges(spark, sf_dir)
    pairs = G.directed(G.of_types(e, DEPENDS))
    return T.cycles(pairs, 6, Scratch(spark, "dependencies")).select(F.col("length").cast("bigint").alias("length"), "path")


def trails_inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: what trails of up to two dependency edges reach, whatever their direction."""
    out = T.trails(G.of_types(_edges(spark, sf_dir), DEPENDS), 2, Scratch(spark, "trails"))
    return out.select("start", "node", F.col("hops").cast("bigint").alias("hops"))


def node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of every symbol node as text: those of its entry, then those of the function recorded under its name."""
    cols = ["id", "repository_id", "qualified_name", "documentation", "end_line", "is_async", "is_static", "return_type", "signature", "start_line", "visibility", "updated_at"]
    e = latest(read_table(spark, sf_dir, "symbol_index_entries", *cols), ["id"])
    rec = read_table(spark, sf_dir, "function_definitions", "repository_id", "qualified_name", "documentation", "end_line", "return_type", "signature", "start_line")
    rec = keep_first(rec, ["repository_id", "qualified_name"], ["start_line", "end_line", "signature", "return_type", "documentation"])
    named = rec.join(e.select("id", "repository_id", "qualified_name"), ["repository_id", "qualified_name"])
    merged = B.merge_properties(B.symbol_properties(e), B.symbol_properties(named))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|")
    return merged.select("node_id", F.md5(text).alias("properties_md5"), F.size("properties").cast("bigint").alias("n_properties"))


def parameters_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter lists as JSON text and read back."""
    f = read_table(spark, sf_dir, "function_definitions", "id", "parameters", "start_line").where("parameters is not null")
    text = F.to_json("parameters")
    return f.select("id", "start_line", text.alias("parameters_json"), F.size(F.from_json(text, "array<string>")).cast("bigint").alias("n_parameters")).distinct()


def delete_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left per table when the repositories that could not be cloned are deleted everywhere."""
    gone = repositories(spark, sf_dir).where("clone_status = 'FAILED'").select(F.col("id").alias("repository_id"))
    names = ["repository_files", "source_files", "file_parse_jobs", "function_definitions", "symbol_index_entries", "calls", "graph_edges"]
    left = L.delete_repositories({n: read_table(spark, sf_dir, n, "repository_id") for n in names}, gone)
    out = None
    for name, rows in left.items():
        per = rows.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_left")).withColumn("table_name", F.lit(name))
        out = per if out is None else out.unionByName(per)
    return out


def upsert_files_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows by repository and path after an upsert of the later ones; id and created_at of the earlier rows survive."""
    f = read_table(spark, sf_dir, "repository_files", "id", "repository_id", "relative_path", "size_bytes", "created_at", "updated_at")
    key = ["repository_id", "relative_path"]
    cut = F.lit("2024-06-01").cast("timestamp")
    old, new = (latest(rows, key) for rows in (f.where(F.col("updated_at") < cut), f.where(F.col("updated_at") >= cut)))
    return L.upsert_keeping(old, new, key, ["id", "created_at"]).select("id", "relative_path", "size_bytes", F.unix_micros("created_at").alias("created_us"))


def records_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and calls as record tables, after those of the repositories that could not be cloned were replaced by none."""
    scratch = Scratch(spark, "record-tables")
    kinds = {"functions": "function_definitions", "calls": "calls"}
    gone = scratch.save(repositories(spark, sf_dir).where("clone_status = 'FAILED'").select(F.col("id").alias("repository_id")))
    R.save_records({k: read_table(spark, sf_dir, t, "id", "repository_id", "file_id") for k, t in kinds.items()}, scratch.root)
    out = None
    for kind in kinds:
        rows = R.read_records(spark, scratch.root, kind)
        R.replace_repositories(spark, scratch.root, kind, rows.limit(0), gone)
        per = R.read_records(spark, scratch.root, kind).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_records")).withColumn("kind", F.lit(kind))
        out = per if out is None else out.unionByName(per)
    return out


_NAMES = """lookup_repositories lookup_files lookup_jobs lookup_entries lookup_nodes nodes_by_name classes_page functions_page neighbours_page dir_listing
edges_dropped dependency_subgraph dependency_cycles trails_inherits node_properties parameters_json delete_failed records_replaced upsert_files_kept"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_E = "WITH " + current("symbol_index_entries", "e")
_F = "WITH " + current("repository_files", "f")
_FD = "fd AS (SELECT DISTINCT * EXCLUDE (parameters, decorators, created_at) FROM function_definitions), gf AS (SELECT fd.* FROM fd JOIN f ON fd.file_id = f.id)"
_DEP = "dep AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM g WHERE edge_type IN ('DEPENDS_ON', 'IMPORTS', 'INHERITS'))"
_PAGE = "SELECT '{}' AS kind, id, qualified_name, start_line FROM (SELECT * FROM gf WHERE language = 'Go'{} ORDER BY qualified_name, id, start_line LIMIT 200)"
_PROPS = [
    ("documentation", "nullif(substring({d}documentation, 1, 500), '')"), ("end_line", "CAST({d}end_line AS VARCHAR)"), ("is_async", "CASE WHEN is_async THEN 'true' END"),
    ("is_static", "CASE WHEN is_static THEN 'true' END"), ("return_type", "nullif({d}return_type, '')"), ("signature", "nullif({d}signature, '')"),
    ("start_line", "CAST({d}start_line AS VARCHAR)"), ("visibility", "nullif(visibility, '')"),
]


def _property(name: str, text: str) -> str:
    own = text.format(d="e.")
    return f"coalesce({text.format(d='r.')}, {own})" if "{d}" in text else text.replace("is_", "e.is_").replace("(visibility", "(e.visibility")


SQL = {
    "lookup_repositories": "WITH " + current("repositories", "r") + """, n AS (SELECT full_name, min(id) AS id FROM r GROUP BY 1), u AS (SELECT id, min(github_url) AS github_url FROM r GROUP BY 1)
SELECT source, n.id AS repository_id, u.github_url FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) d LEFT JOIN n ON n.full_name = d.source LEFT JOIN u ON u.id = n.id""",
    "lookup_files": _F + """, p AS (SELECT repository_id, relative_path, min(id) AS id FROM f GROUP BY 1, 2)
SELECT s.file_id, p.id AS id_by_path, f.scan_status FROM source_files s LEFT JOIN p ON p.repository_id = s.repository_id AND p.relative_path = s.relative_path LEFT JOIN f ON f.id = s.file_id""",
    "lookup_jobs": _F + ", " + current("file_parse_jobs", "j", "file_id") + " SELECT f.id AS file_id, j.id AS job_id, j.parse_status FROM f LEFT JOIN j ON j.file_id = f.id",
    "lookup_entries": _E + """, q AS (SELECT repository_id, qualified_name, min(id) AS id FROM e GROUP BY 1, 2)
SELECT w.repository_id, w.qualified_name, q.id AS entry_id FROM (SELECT DISTINCT repository_id, qualified_name FROM function_definitions) w
LEFT JOIN q ON q.repository_id = w.repository_id AND q.qualified_name = w.qualified_name""",
    "lookup_nodes": _BASE + """ SELECT w.source_id, w.repository_id, n.node_type FROM (SELECT DISTINCT source_id, repository_id FROM g) w
LEFT JOIN n ON n.node_id = w.source_id AND n.repository_id = w.repository_id""",
    "nodes_by_name": _E + " SELECT repository_id, qualified_name, min(id) AS node_id FROM e WHERE qualified_name IS NOT NULL GROUP BY 1, 2",
    "classes_page": _E + " SELECT id, symbol_type, qualified_name FROM e WHERE symbol_type IN ('class', 'enum', 'interface', 'struct') AND language = 'Java' ORDER BY qualified_name, id LIMIT 500",
    "functions_page": _F + ", " + _FD + " " + " UNION ALL ".join(_PAGE.format(k, w) for k, w in (("methods", " AND is_method"), ("functions", " AND NOT is_method"), ("all", ""))),
    "neighbours_page": _BASE + """, h AS (SELECT DISTINCT source_id, target_id, edge_type FROM g WHERE edge_type IN ('CALLS', 'INHERITS')),
x AS (SELECT source_id AS node_id, target_id AS neighbour_id, edge_type, 'outgoing' AS direction FROM h UNION ALL SELECT target_id, source_id, edge_type, 'incoming' FROM h),
y AS (SELECT x.*, row_number() OVER (PARTITION BY x.node_id ORDER BY edge_type, direction, neighbour_id) AS k FROM x JOIN s a ON x.node_id = a.node_id JOIN s b ON x.neighbour_id = b.node_id WHERE a.repository_id = b.repository_id)
SELECT node_id, neighbour_id, edge_type, direction FROM y WHERE k <= 100""",
    "dir_listing": _F + r""", n AS (SELECT id, repository_id, regexp_extract(replace(relative_path, '\', '/'), '^(.*/)?[^/]*$', 1) AS directory, regexp_extract(replace(relative_path, '\', '/'), '[^/]*$', 0) AS name FROM f WHERE scan_status = 'SCANNED')
SELECT id, directory, name, row_number() OVER (PARTITION BY repository_id, directory ORDER BY name, id) - 1 AS n_before FROM n""",
    "edges_dropped": _BASE + """, x AS (SELECT edge_type, CASE WHEN coalesce(trim(source_id), '') = '' OR coalesce(trim(target_id), '') = '' THEN 'blank' WHEN source_id = target_id AND edge_type <> 'CALLS' THEN 'self loop'
  WHEN source_id NOT IN (SELECT node_id FROM n) THEN 'unknown source' WHEN target_id NOT IN (SELECT node_id FROM n) THEN 'unknown target' END AS reason FROM g)
SELECT edge_type, reason, count(*) AS n_edges FROM x WHERE reason IS NOT NULL GROUP BY 1, 2""",
    "dependency_subgraph": _BASE + """, h AS (SELECT DISTINCT source_id, target_id, edge_type FROM g WHERE edge_type IN ('DEPENDS_ON', 'IMPORTS', 'INHERITS') AND source_id IN (SELECT node_id FROM s) AND target_id IN (SELECT node_id FROM s)),
x AS (SELECT source_id AS node_id, 1 AS o, 0 AS i FROM h UNION ALL SELECT target_id, 0, 1 FROM h)
SELECT x.node_id, s.node_type, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM x JOIN s ON s.node_id = x.node_id GROUP BY 1, 2""",
    "dependency_cycles": _BASE + ", " + _DEP + """, c AS (SELECT src, dst FROM dep WHERE src <> dst),
w AS (SELECT [src, dst] AS p FROM c WHERE src < dst UNION ALL SELECT list_append(w.p, c.dst) FROM w JOIN c ON w.p[-1] = c.src WHERE len(w.p) < 6 AND c.dst > w.p[1] AND NOT list_contains(w.p, c.dst))
SELECT CAST(len(p) AS BIGINT) AS length, array_to_string(p, ' > ') AS path FROM w JOIN c ON w.p[-1] = c.src AND c.dst = w.p[1]""",
    "trails_inherits": _BASE + """, t AS (SELECT DISTINCT source_id, target_id, edge_type FROM g WHERE edge_type IN ('DEPENDS_ON', 'IMPORTS', 'INHERITS')),
k AS (SELECT *, row_number() OVER (ORDER BY source_id, target_id, edge_type) AS edge FROM t),
st AS (SELECT source_id AS src, target_id AS dst, edge FROM k UNION ALL SELECT target_id, source_id, edge FROM k WHERE source_id <> target_id),
x AS (SELECT src AS start, dst AS node, 1 AS hops FROM st UNION ALL SELECT a.src, b.dst, 2 FROM st a JOIN st b ON a.dst = b.src AND a.edge <> b.edge)
SELECT start, node, CAST(min(hops) AS BIGINT) AS hops FROM x GROUP BY 1, 2""",
    "node_properties": """WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, """ + ", ".join(
        f"{c} DESC NULLS LAST" for c in ("repository_id", "qualified_name", *[n for n, _ in _PROPS])
    ) + """) AS rn FROM symbol_index_entries WHERE id IS NOT NULL) WHERE rn = 1), rec AS (SELECT * FROM (SELECT repository_id, qualified_name, documentation, end_line, return_type, signature, start_line,
  row_number() OVER (PARTITION BY repository_id, qualified_name ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, signature NULLS FIRST, return_type NULLS FIRST, documentation NULLS FIRST) AS k FROM function_definitions) WHERE k = 1),
p AS (SELECT e.id AS node_id, [x FOR x IN [""" + ", ".join(f"'{n}=' || {_property(n, t)}" for n, t in _PROPS) + """] IF x IS NOT NULL] AS a
  FROM e LEFT JOIN rec r ON r.repository_id = e.repository_id AND r.qualified_name = e.qualified_name)
SELECT node_id, md5(array_to_string(a, '|')) AS properties_md5, CAST(len(a) AS BIGINT) AS n_properties FROM p""",
    "parameters_json": "SELECT DISTINCT id, start_line, CAST(to_json(parameters) AS VARCHAR) AS parameters_json, CAST(len(parameters) AS BIGINT) AS n_parameters FROM function_definitions WHERE parameters IS NOT NULL",
    "delete_failed": "WITH " + current("repositories", "r") + ", x AS (SELECT id FROM r WHERE clone_status = 'FAILED') " + " UNION ALL ".join(
        f"SELECT repository_id, '{t}' AS table_name, count(*) AS n_left FROM {t} WHERE repository_id IS NULL OR repository_id NOT IN (SELECT id FROM x) GROUP BY 1"
        for t in ("repository_files", "source_files", "file_parse_jobs", "function_definitions", "symbol_index_entries", "calls", "graph_edges")
    ),
    "records_replaced": "WITH " + current("repositories", "r") + ", x AS (SELECT id FROM r WHERE clone_status = 'FAILED') " + " UNION ALL ".join(
        f"SELECT repository_id, '{k}' AS kind, count(*) AS n_records FROM {t} WHERE repository_id IS NULL OR repository_id NOT IN (SELECT id FROM x) GROUP BY 1"
        for k, t in (("functions", "function_definitions"), ("calls", "calls"))
    ),
    "upsert_files_kept": """WITH ranked AS (SELECT *, updated_at < TIMESTAMPTZ '2024-06-01 00:00:00+00' AS is_old FROM repository_files WHERE updated_at IS NOT NULL),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, relative_path, is_old ORDER BY updated_at DESC, id DESC NULLS LAST, size_bytes DESC NULLS LAST, created_at DESC NULLS LAST) AS k FROM ranked) WHERE k = 1),
o AS (SELECT * FROM one WHERE is_old), n AS (SELECT * FROM one WHERE NOT is_old)
SELECT CASE WHEN o.relative_path IS NOT NULL THEN o.id ELSE n.id END AS id, coalesce(n.relative_path, o.relative_path) AS relative_path,
  CASE WHEN n.relative_path IS NOT NULL THEN n.size_bytes ELSE o.size_bytes END AS size_bytes, epoch_us(CASE WHEN o.relative_path IS NOT NULL THEN o.created_at ELSE n.created_at END) AS created_us
FROM o FULL JOIN n ON o.repository_id IS NOT DISTINCT FROM n.repository_id AND o.relative_path = n.relative_path""",
}
