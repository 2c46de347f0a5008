"""Queries p2, p3 and p4: skewed keys, orphan references, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import hierarchy as H
from codestrata.operators.merge import latest
from codestrata.operators.references import call_references, edge_references, node_lifetimes, orphan_references
from codestrata.operators.skew import compress, heavy_keys, weighted_percentiles, weighted_summary
from codestrata.sources.scratch import Scratch
from codestrata.sources.tables import read_table

HOT_SHARE = 0.04


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with more than 4 % of the rows of a table."""
    tables = {
        "repository_files": compress(read_table(spark, sf_dir, "repository_files", "repository_id", "id"), "repository_id", "id"),
        "calls": compress(read_table(spark, sf_dir, "calls", "repository_id", "callee_name"), "repository_id", "callee_name"),
    }
    return heavy_keys(tables, HOT_SHARE).select("table_name", F.col("key").alias("repository_id"))


def _percentiles(weighted: DataFrame, names: dict[float, str]) -> DataFrame:
    rows = weighted_percentiles(weighted, list(names))
    picks = [F.max(F.when(F.col("percentage") == p, F.col("value"))).alias(n) for p, n in names.items()]
    return rows.groupBy(F.col("key").alias("_pkey")).agg(*picks)


def p2_repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: rows, bytes, distinct files, the commonest extension, percentiles of the size."""
    f = read_table(spark, sf_dir, "repository_files", "repository_id", "id", "extension", "size_bytes")
    f = f.where(F.col("repository_id").isNotNull())
    ids = weighted_summary(compress(f, "repository_id", "id")).select("key", "n_rows", F.col("n_distinct").alias("n_files"))
    ext = weighted_summary(compress(f, "repository_id", "extension")).select(
        F.col("key").alias("_ekey"), F.col("mode").alias("top_extension"), F.col("mode_rows").alias("top_extension_rows")
    )
    sizes = compress(f, "repository_id", "size_bytes")
    total = sizes.groupBy(F.col("key").alias("_skey")).agg(
        F.coalesce(F.sum(F.col("value") * F.col("weight")), F.lit(0)).cast("bigint").alias("total_bytes")
    )
    pct = _percentiles(sizes, {0.5: "median_bytes", 0.95: "p95_bytes"})
    return (
        ids.join(ext, F.col("key") == F.col("_ekey")).join(total, F.col("key") == F.col("_skey"))
        .join(pct, F.col("key") == F.col("_pkey"), "left")
        .select(
            F.col("key").alias("repository_id"), "n_rows", "n_files", "total_bytes", "top_extension", "top_extension_rows",
            "median_bytes", "p95_bytes",
        )
    )


def p2_repository_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: call rows, distinct callees, the most called name, percentiles of the line."""
    c = read_table(spark, sf_dir, "calls", "repository_id", "callee_name", "start_line")
    c = c.where(F.col("repository_id").isNotNull())
    callees = weighted_summary(compress(c, "repository_id", "callee_name"))
    pct = _percentiles(compress(c, "repository_id", "start_line"), {0.5: "median_line", 0.99: "p99_line"})
    return callees.join(pct, F.col("key") == F.col("_pkey"), "left").select(
        F.col("key").alias("repository_id"), "n_rows", F.col("n_distinct").alias("n_callees"),
        F.col("mode").alias("top_callee"), F.col("mode_rows").alias("top_callee_rows"), "median_line", "p99_line",
    )


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = call_references(
        read_table(spark, sf_dir, "calls"), read_table(spark, sf_dir, "external_names")
    ).unionByName(edge_references(read_table(spark, sf_dir, "graph_edges")))
    parents = node_lifetimes(
        read_table(spark, sf_dir, "symbol_index_entries"), read_table(spark, sf_dir, "removed_symbols"),
        read_table(spark, sf_dir, "repository_files"), read_table(spark, sf_dir, "repositories"),
    )
    return orphan_references(spark, refs, parents)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references, one row per id and field."""
    return _orphans(spark, sf_dir).select("table_name", "record_id", "field_name").distinct()


def p3_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references (distinct ids) per table, field and month of created_at."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    rows = _orphans(spark, sf_dir).select("table_name", "field_name", month, "record_id").distinct()
    return rows.groupBy("table_name", "field_name", "month").agg(F.count(F.lit(1)).alias("n_orphans"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "parent_symbol_id", "name", "updated_at"]
    return latest(read_table(spark, sf_dir, "symbol_index_entries", *cols), ["id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries on or below a loop of parents."""
    return H.loops(spark, _entries(spark, sf_dir), "id", "parent_symbol_id").select("entry_id", "cycle_id")


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current entry with root, depth, nested-set range, number of descendants and path."""
    out = H.hierarchy(spark, _entries(spark, sf_dir), "id", "parent_symbol_id", "name")
    return out.withColumnsRenamed({"left": "set_left", "right": "set_right"})


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of an entry and one of its descendants, with their distance; entries on or below loops have none."""
    # paths are not asked for, and blank names keep them short
    rows = _entries(spark, sf_dir).withColumn("name", F.lit(""))
    tree = H.hierarchy(spark, rows, "id", "parent_symbol_id", "name").where("cycle_id is null")
    tree = Scratch(spark, "tree").save(tree.select("entry_id", "root_id", "depth", "left", "right", "n_descendants"))
    return H.descendants(tree, tree.select("entry_id"))


def p4_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per loop: entries on it and entries below it."""
    rows = H.loops(spark, _entries(spark, sf_dir), "id", "parent_symbol_id")
    return rows.groupBy("cycle_id").agg(
        F.sum(F.when(F.col("on_loop"), 1).otherwise(0)).cast("bigint").alias("n_on_loop"),
        F.sum(F.when(F.col("on_loop"), 0).otherwise(1)).cast("bigint").alias("n_below"),
    )


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_repository_files, p2_repository_calls, p3_found, p3_orphans_by_month, p4_found, p4_hierarchy, p4_descendants, p4_loops)
}

_P3 = r"""
WITH ext AS (SELECT DISTINCT language, name, kind FROM external_names),
c AS (
  SELECT id, repository_id, language, created_at,
    nullif(regexp_replace(caller_name, '^\s+|\s+$', '', 'g'), '') AS caller,
    nullif(regexp_replace(callee_name, '^\s+|\s+$', '', 'g'), '') AS callee,
    nullif(regexp_replace(callee_object, '^\s+|\s+$', '', 'g'), '') AS object
  FROM calls),
refs AS (
  SELECT 'calls' AS table_name, id AS record_id, 'caller_name' AS field_name, repository_id AS r, caller AS k, CAST(NULL AS VARCHAR) AS k2, created_at AS ts
  FROM c WHERE caller IS NOT NULL AND caller NOT IN ('<module>', '<class>', '<package>')
  UNION ALL
  SELECT 'calls', id, 'callee_name', repository_id, callee, object || '.' || callee, created_at
  FROM c WHERE callee IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM ext WHERE ext.language = c.language AND ext.kind = 'object' AND ext.name = c.object)
    AND NOT (object IS NULL AND EXISTS (SELECT 1 FROM ext WHERE ext.language = c.language AND ext.kind = 'callable' AND ext.name = c.callee))
  UNION ALL
  SELECT 'graph_edges', edge_id, 'target_id', '', target_id, NULL, created_at FROM graph_edges WHERE target_id IS NOT NULL),
parents AS (
  SELECT r, k, min(born) AS born, CAST(NULL AS TIMESTAMP WITH TIME ZONE) AS died FROM (
    SELECT repository_id AS r, qualified_name AS k, created_at AS born FROM symbol_index_entries
    UNION ALL SELECT '', id, created_at FROM symbol_index_entries
    UNION ALL SELECT '', 'file:' || repository_id || ':' || relative_path, created_at FROM repository_files
    UNION ALL SELECT '', 'repo:' || id, created_at FROM repositories) GROUP BY r, k
  UNION ALL SELECT repository_id, qualified_name, created_at, removed_at FROM removed_symbols WHERE removed_at IS NOT NULL
  UNION ALL SELECT '', entry_id, created_at, removed_at FROM removed_symbols WHERE removed_at IS NOT NULL),
alive AS (
  SELECT DISTINCT table_name, record_id, field_name FROM refs JOIN parents p
    ON refs.r = p.r AND refs.k = p.k AND p.born <= ts AND (p.died IS NULL OR ts < p.died)
  UNION SELECT DISTINCT table_name, record_id, field_name FROM refs JOIN parents p
    ON refs.r = p.r AND refs.k2 = p.k AND p.born <= ts AND (p.died IS NULL OR ts < p.died)),
orphan AS (
  SELECT DISTINCT refs.table_name, refs.record_id, refs.field_name, strftime(ts, '%Y-%m') AS month FROM refs
  ANTI JOIN alive ON refs.table_name = alive.table_name AND refs.record_id = alive.record_id AND refs.field_name = alive.field_name)
"""

_CURRENT = """
cur AS (SELECT id, parent_symbol_id, name FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_symbol_id DESC NULLS LAST, name DESC NULLS LAST) AS rn
  FROM symbol_index_entries WHERE id IS NOT NULL) WHERE rn = 1),
link AS (SELECT c.id, c.name, p.id AS parent FROM cur c LEFT JOIN cur p ON c.parent_symbol_id = p.id),
placed AS (
  SELECT id, id AS root, 0 AS depth, coalesce(name, '') AS path FROM link WHERE parent IS NULL
  UNION ALL SELECT l.id, p.root, p.depth + 1, p.path || '/' || coalesce(l.name, '') FROM link l JOIN placed p ON l.parent = p.id),
stuck AS (SELECT id, parent FROM link WHERE id NOT IN (SELECT id FROM placed)),
walk AS (
  SELECT id AS start, id AS here, [id] AS seen, false AS closed FROM stuck
  UNION ALL SELECT w.start, s.parent, list_append(w.seen, s.parent), list_contains(w.seen, s.parent)
  FROM walk w JOIN stuck s ON w.here = s.id WHERE NOT w.closed),
ends AS (SELECT start, here, seen[list_position(seen, here):len(seen) - 1] AS members FROM walk WHERE closed),
cyc AS (SELECT start AS entry_id, list_min(members) AS cycle_id, list_contains(members, start) AS on_loop FROM ends)
"""

SQL = {
    "p2_found": """
SELECT table_name, repository_id FROM (
  SELECT 'repository_files' AS table_name, repository_id, count(*) AS n, sum(count(*)) OVER () AS total FROM repository_files GROUP BY repository_id
  UNION ALL SELECT 'calls', repository_id, count(*), sum(count(*)) OVER () FROM calls GROUP BY repository_id)
WHERE repository_id IS NOT NULL AND n > 0.04 * total""",
    "p2_repository_files": """
WITH f AS (SELECT * FROM repository_files WHERE repository_id IS NOT NULL),
e AS (SELECT repository_id, extension, n FROM (SELECT repository_id, extension, count(*) AS n,
  row_number() OVER (PARTITION BY repository_id ORDER BY count(*) DESC, extension) AS rn FROM f WHERE extension IS NOT NULL GROUP BY repository_id, extension) WHERE rn = 1),
a AS (SELECT repository_id, count(*) AS n_rows, count(DISTINCT id) AS n_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes,
  quantile_disc(size_bytes, 0.5) AS median_bytes, quantile_disc(size_bytes, 0.95) AS p95_bytes FROM f GROUP BY repository_id)
SELECT a.repository_id, n_rows, n_files, total_bytes, e.extension AS top_extension, coalesce(e.n, 0) AS top_extension_rows, median_bytes, p95_bytes
FROM a LEFT JOIN e ON a.repository_id = e.repository_id""",
    "p2_repository_calls": """
WITH f AS (SELECT * FROM calls WHERE repository_id IS NOT NULL),
e AS (SELECT repository_id, callee_name, n FROM (SELECT repository_id, callee_name, count(*) AS n,
  row_number() OVER (PARTITION BY repository_id ORDER BY count(*) DESC, callee_name) AS rn FROM f WHERE callee_name IS NOT NULL GROUP BY repository_id, callee_name) WHERE rn = 1),
a AS (SELECT repository_id, count(*) AS n_rows, count(DISTINCT callee_name) AS n_callees,
  quantile_disc(start_line, 0.5) AS median_line, quantile_disc(start_line, 0.99) AS p99_line FROM f GROUP BY repository_id)
SELECT a.repository_id, n_rows, n_callees, e.callee_name AS top_callee, coalesce(e.n, 0) AS top_callee_rows, median_line, p99_line
FROM a LEFT JOIN e ON a.repository_id = e.repository_id""",
    "p3_found": _P3 + "SELECT table_name, record_id, field_name FROM orphan",
    "p3_orphans_by_month": _P3
    + "SELECT table_name, field_name, month, count(DISTINCT record_id) AS n_orphans FROM orphan GROUP BY 1, 2, 3",
    "p4_found": f"WITH RECURSIVE {_CURRENT} SELECT entry_id, cycle_id FROM cyc",
    "p4_loops": f"WITH RECURSIVE {_CURRENT} SELECT cycle_id, count(*) FILTER (WHERE on_loop) AS n_on_loop, count(*) FILTER (WHERE NOT on_loop) AS n_below FROM cyc GROUP BY 1",
    "p4_descendants": f"""WITH RECURSIVE {_CURRENT},
up AS (SELECT id AS descendant_id, parent AS a, CAST(1 AS BIGINT) AS distance FROM link WHERE parent IS NOT NULL AND id IN (SELECT id FROM placed)
  UNION ALL SELECT u.descendant_id, l.parent, u.distance + 1 FROM up u JOIN link l ON u.a = l.id WHERE l.parent IS NOT NULL)
SELECT a AS ancestor_id, descendant_id, distance FROM up""",
    "p4_hierarchy": f"""WITH RECURSIVE {_CURRENT},
up AS (SELECT id AS descendant, id AS a FROM placed UNION ALL SELECT u.descendant, l.parent FROM up u JOIN link l ON u.a = l.id WHERE l.parent IS NOT NULL),
size AS (SELECT a AS id, count(*) AS n FROM up GROUP BY a),
off AS (SELECT l.id, l.parent, CASE WHEN l.parent IS NULL THEN 0 ELSE 1 + coalesce(sum(s.n) OVER (PARTITION BY l.parent ORDER BY l.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS o
  FROM link l JOIN size s ON l.id = s.id),
lft AS (SELECT u.descendant AS id, CAST(sum(o.o) AS BIGINT) AS l FROM up u JOIN off o ON u.a = o.id GROUP BY 1)
SELECT p.id AS entry_id, k.parent AS parent_id, p.root AS root_id, CAST(p.depth AS BIGINT) AS depth, l.l AS set_left, l.l + s.n - 1 AS set_right,
  s.n - 1 AS n_descendants, p.path, CAST(NULL AS VARCHAR) AS cycle_id
FROM placed p JOIN link k ON p.id = k.id JOIN size s ON p.id = s.id JOIN lft l ON p.id = l.id
UNION ALL SELECT c.entry_id, s.parent, NULL, -1, -1, -1, -1, NULL, c.cycle_id FROM cyc c JOIN stuck s ON c.entry_id = s.id""",
}
