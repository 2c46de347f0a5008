"""Nodes and edges of the code graph, from index entries, files and record sets.

Every resolution is an equi-join on (repository_id, name); a fallback name is a second left join and
a coalesce.  Nothing is broadcast by hand: adaptive execution sees the sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import names as N

NODE_COLUMNS = ["node_id", "node_type", "repository_id", "name", "qualified_name", "language", "file_path"]
EDGE_COLUMNS = ["source_id", "target_id", "edge_type", "repository_id"]


def repo_id(repository: Column) -> Column:
    return F.concat(F.lit("repo:"), repository)


def dir_id(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("dir:"), repository, F.lit(":"), path)


def file_node_id(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("file:"), repository, F.lit(":"), path)


def library_id(repository: Column, name: Column) -> Column:
    return F.concat(F.lit("lib:"), repository, F.lit(":"), name)


def _node(rows: DataFrame, node: Column, label: Column | str, name: Column, qualified: Column, language: Column | None = None, path: Column | None = None) -> DataFrame:
    blank = F.lit("")
    return rows.select(
        node.alias("node_id"), (F.lit(label) if isinstance(label, str) else label).alias("node_type"), F.col("repository_id"), name.alias("name"),
        qualified.alias("qualified_name"), F.coalesce(language if language is not None else blank, blank).alias("language"),
        F.coalesce(path if path is not None else blank, blank).alias("file_path"),
    )


def repository_nodes(repositories: DataFrame) -> DataFrame:
    rows = repositories.withColumn("repository_id", F.col("id"))
    short = F.element_at(F.split("full_name", "/"), -1)
    return _node(rows, repo_id(F.col("id")), "Repository", short, F.col("full_name"), F.col("language"))


def directory_nodes(directories: DataFrame) -> DataFrame:
    d = F.col("directory")
    return _node(directories, dir_id(F.col("repository_id"), d), "Directory", F.col("name"), d, path=d)


def file_nodes(files: DataFrame) -> DataFrame:
    p = F.col("relative_path")
    return _node(files, file_node_id(F.col("repository_id"), p), "File", F.element_at(F.split(p, "/"), -1), p, F.col("language"), p)


def symbol_nodes(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries with the path of their file, '' where the file is not there."""
    paths = files.select(F.col("id").alias("file_id"), F.col("relative_path").alias("_path"))
    rows = entries.join(paths, "file_id", "left")
    return _node(rows, F.col("id"), N.node_label(F.col("symbol_type")), F.col("name"), F.col("qualified_name"), F.col("language"), F.col("_path"))


def library_nodes(imports: DataFrame) -> DataFrame:
    """External packages, once per repository; empty names give none."""
    rows = imports.select("repository_id", N.library_name(F.col("module_path")).alias("library")).where("library <> ''").distinct()
    return _node(rows, library_id(F.col("repository_id"), F.col("library")), "ExternalLibrary", F.col("library"), F.col("library"))


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose id, qualified name and name are not blank."""
    filled = [F.coalesce(F.length(N.strip(F.col(c))) > 0, F.lit(False)) for c in ("node_id", "qualified_name", "name")]
    return nodes.where(reduce(Column.__and__, filled))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes; only CALLS may be a self-loop."""
    known = nodes.select("node_id").distinct()
    rows = edges.where((F.col("source_id") != F.col("target_id")) | (F.col("edge_type") == "CALLS"))
    rows = rows.join(known.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    return rows.join(known.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, type, target)."""
    return edges.groupBy("source_id", "edge_type", "target_id").agg(F.min("repository_id").alias("repository_id"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id; the greatest row wins, so the result does not depend on order."""
    rest = [c for c in NODE_COLUMNS if c != "node_id"]
    out = nodes.groupBy("node_id").agg(F.max(F.struct(*rest)).alias("n"))
    return out.select("node_id", *[F.col(f"n.{c}").alias(c) for c in rest])


def _edge(rows: DataFrame, source: Column, target: Column, kind: str | Column) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(source.alias("source_id"), target.alias("target_id"), k.alias("edge_type"), F.col("repository_id"))


def containment_edges(symbols: DataFrame) -> DataFrame:
    """File CONTAINS symbol and symbol BELONGS_TO file; ``symbols`` are nodes with a file_path."""
    rows = symbols.where("file_path <> ''")
    f = file_node_id(F.col("repository_id"), F.col("file_path"))
    return _edge(rows, f, F.col("node_id"), "CONTAINS").unionByName(_edge(rows, F.col("node_id"), f, "BELONGS_TO"))


def directory_edges(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Repository CONTAINS every directory; a file's directory, or the repository, CONTAINS the file."""
    repo = repo_id(F.col("repository_id"))
    dirs = _edge(directories, repo, dir_id(F.col("repository_id"), F.col("directory")), "CONTAINS")
    above = files.withColumn("directory", F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)).join(
        directories.select("repository_id", "directory", F.lit(True).alias("_there")), ["repository_id", "directory"], "left"
    )
    source = F.when(F.col("_there"), dir_id(F.col("repository_id"), F.col("directory"))).otherwise(repo)
    return dirs.unionByName(_edge(above, source, file_node_id(F.col("repository_id"), F.col("relative_path")), "CONTAINS"))


def defines_edges(entries: DataFrame) -> DataFrame:
    """Parent DEFINES child where both are there."""
    up = entries.select(F.col("id").alias("parent_symbol_id"))
    return _edge(entries.join(up, "parent_symbol_id", "left_semi"), F.col("parent_symbol_id"), F.col("id"), "DEFINES")


def _names(entries: DataFrame, name: str, node: str) -> DataFrame:
    """(repository_id, name, node): a qualified name stands for the least id that has it."""
    return entries.groupBy("repository_id", F.col("qualified_name").alias(name)).agg(F.min("id").alias(node))


def _resolve(rows: DataFrame, entries: DataFrame, wanted: list[Column], node: str) -> DataFrame:
    """``rows`` with ``node``: the entry of the first wanted name that exists, or null."""
    found = []
    for i, name in enumerate(wanted):
        key, at = f"_key{i}", f"_{node}{i}"
        rows = rows.withColumn(key, name).join(_names(entries, key, at), ["repository_id", key], "left")
        found.append(at)
    return rows.withColumn(node, F.coalesce(*found))


def call_edges(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Caller CALLS callee: the caller must resolve; a callee by its name, else by ``object.name``."""
    rows = calls.where("caller_name is not null and caller_name <> '' and callee_name is not null and callee_name <> ''")
    rows = rows.select("repository_id", "caller_name", "callee_name", "callee_object").distinct()
    rows = _resolve(rows, entries, [F.col("caller_name")], "source").where("source is not null")
    dotted = F.concat_ws(".", F.nullif(F.col("callee_object"), F.lit("")), "callee_name")
    rows = _resolve(rows, entries, [F.col("callee_name"), dotted], "target").where("target is not null")
    return _edge(rows, F.col("source"), F.col("target"), "CALLS")


def inheritance_edges(classes: DataFrame, entries: DataFrame) -> DataFrame:
    """Class INHERITS base: the base by its name, else by ``class.base``."""
    rows = classes.select("repository_id", "qualified_name", F.explode("base_classes").alias("base")).where("base <> ''")
    rows = _resolve(rows, entries, [F.col("qualified_name")], "source").where("source is not null")
    rows = _resolve(rows, entries, [F.col("base"), F.concat_ws(".", "qualified_name", "base")], "target").where("target is not null")
    return _edge(rows, F.col("source"), F.col("target"), "INHERITS")


def implements_edges(classes: DataFrame, entries: DataFrame) -> DataFrame:
    """Class IMPLEMENTS interface, by exact name."""
    rows = classes.select("repository_id", "qualified_name", F.explode("interfaces").alias("base")).where("base <> ''")
    rows = _resolve(rows, entries, [F.col("qualified_name")], "source").where("source is not null")
    rows = _resolve(rows, entries, [F.col("base")], "target").where("target is not null")
    return _edge(rows, F.col("source"), F.col("target"), "IMPLEMENTS")


def internal_prefixes(entries: DataFrame) -> DataFrame:
    """(repository_id, prefix): every dotted prefix of every qualified name, so that a prefix test is an equi-join."""
    parts = F.split("qualified_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    return entries.where("qualified_name <> ''").select("repository_id", F.explode(prefixes).alias("prefix")).distinct()


def external_imports(imports: DataFrame, entries: DataFrame) -> DataFrame:
    """Imports that are neither relative nor a prefix of a name of the repository."""
    p = F.col("module_path")
    rows = imports.where(~F.col("is_relative") & ~p.startswith(".") & ~p.startswith("/"))
    return rows.join(internal_prefixes(entries).withColumnRenamed("prefix", "module_path"), ["repository_id", "module_path"], "left_anti")


def import_edges(imports: DataFrame, entries: DataFrame, libraries: DataFrame) -> DataFrame:
    """File IMPORTS symbol or USES_LIBRARY package: relative modules by their bare name, others exact, else the library."""
    p = F.col("module_path")
    relative = F.col("is_relative") | p.startswith(".") | p.startswith("/")
    bare = F.when(relative, F.regexp_replace(p, r"^\.+", "")).otherwise(p)
    rows = _resolve(imports.withColumn("relative", relative), entries, [bare], "symbol")
    lib = library_id(F.col("repository_id"), N.library_name(p))
    known = libraries.select(F.col("node_id").alias("_lib"))
    rows = rows.withColumn("_lib", F.when(~F.col("relative"), lib)).join(known.withColumn("_has", F.lit(True)), "_lib", "left")
    source = file_node_id(F.col("repository_id"), F.col("relative_path"))
    target = F.coalesce("symbol", F.when(F.col("_has"), F.col("_lib")))
    kind = F.when(F.col("symbol").isNotNull(), "IMPORTS").otherwise("USES_LIBRARY")
    return _edge(rows.withColumn("target", target).where("target is not null"), source, F.col("target"), kind)


def route_edges(routes: DataFrame, entries: DataFrame) -> DataFrame:
    """File EXPOSES_ROUTE route, and route CALLS its handler where the handler is a symbol."""
    node = N.route_node_id(F.col("repository_id"), F.col("http_method"), F.col("path"))
    exposed = _edge(routes, file_node_id(F.col("repository_id"), F.col("relative_path")), node, "EXPOSES_ROUTE")
    handled = _resolve(routes, entries, [F.col("handler_name")], "handler").where("handler is not null")
    return exposed.unionByName(_edge(handled, node, F.col("handler"), "CALLS"))


def route_nodes(routes: DataFrame) -> DataFrame:
    """One ApiRoute node per repository, method and path: the record that comes first by file and line."""
    key = ["repository_id", "http_method", "path"]
    rest = [c for c in ("relative_path", "start_line", "language", "handler_name") if c in routes.columns]
    first = routes.where("http_method is not null and path is not null").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_first"))
    rows = first.select(*key, "_first.relative_path", "_first.language")
    node = N.route_node_id(F.col("repository_id"), F.col("http_method"), F.col("path"))
    label = F.concat_ws(" ", "http_method", "path")
    return _node(rows, node, "ApiRoute", label, label, F.col("language"), F.col("relative_path"))


#: Properties of a symbol node beside its fixed columns.
NODE_PROPERTIES = ["documentation", "end_line", "is_async", "is_static", "return_type", "signature", "start_line", "visibility"]


def symbol_properties(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(node_id, properties): what is known of each symbol beside its fixed columns; blank values give no property.

    Documentation is cut to 500 characters; flags are given where they are true.
    """
    pairs = []
    for c in NODE_PROPERTIES:
        if c not in rows.columns:
            continue
        text = F.substring(c, 1, 500) if c == "documentation" else F.when(F.col(c), "true") if c.startswith("is_") else F.col(c).cast("string")
        pairs.append(F.struct(F.lit(c).alias("key"), F.nullif(text, F.lit("")).alias("value")))
    held = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    return rows.select(F.col(id_col).alias("node_id"), held.alias("properties"))


def merge_properties(older: DataFrame, newer: DataFrame) -> DataFrame:
    """(node_id, properties) of both; where both have a property of a node the newer value stays.  Ids are unique in each."""
    new = newer.select(F.col("node_id").alias("_id"), F.col("properties").alias("_new"))
    both = older.join(new, F.col("node_id") == F.col("_id"), "full_outer")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, fresh = F.coalesce("properties", empty), F.coalesce("_new", empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k))
    return both.select(F.coalesce("node_id", "_id").alias("node_id"), F.map_concat(kept, fresh).alias("properties"))


def dropped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge, reason) columns of the edges that the validator drops: blank end, self-loop, unknown source or unknown target, the first that holds."""
    known = nodes.select("node_id").distinct()
    src = known.select(F.col("node_id").alias("source_id"), F.lit(True).alias("_s"))
    dst = known.select(F.col("node_id").alias("target_id"), F.lit(True).alias("_t"))
    blank = lambda c: F.coalesce(F.length(N.strip(F.col(c))), F.lit(0)) == 0
    reason = (
        F.when(blank("source_id") | blank("target_id"), "blank").when((F.col("source_id") == F.col("target_id")) & (F.col("edge_type") != "CALLS"), "self loop")
        .when(F.col("_s").isNull(), "unknown source").when(F.col("_t").isNull(), "unknown target")
    )
    return edges.join(src, "source_id", "left").join(dst, "target_id", "left").withColumn("reason", reason).where("reason is not null").drop("_s", "_t")
