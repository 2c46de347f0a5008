"""Record sets to the symbol index: mapping, collisions, parent links, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import names as N
from codestrata.operators.merge import batched_upsert_winners, keep_first

ENTRY_COLUMNS = [
    "id", "repository_id", "file_id", "language", "symbol_type", "name", "qualified_name", "display_name", "module_name", "namespace",
    "signature", "return_type", "visibility", "is_static", "is_async", "is_exported", "is_deprecated", "documentation", "start_line",
    "end_line", "relative_path",
]


def entry_id(repository: Column, qualified: Column) -> Column:
    """Ids follow from the key, so that a rebuild gives the same rows."""
    return F.sha2(F.concat_ws("::", repository, qualified), 256)


def _entry(rows: DataFrame, symbol_type: Column, name: Column, namespace: Column | None = None, flags: bool = False) -> DataFrame:
    qualified = N.or_else(F.col("qualified_name"), N.qualified(F.col("relative_path"), F.col("language"), name))
    doc = F.col("documentation")
    null = F.lit(None).cast("string")
    return rows.withColumn("_q", qualified).select(
        entry_id(F.col("repository_id"), F.col("_q")).alias("id"), "repository_id", "file_id", "language", symbol_type.alias("symbol_type"),
        name.alias("name"), F.col("_q").alias("qualified_name"), N.display_name(F.col("_q")).alias("display_name"),
        N.module_prefix(F.col("_q"), name).alias("module_name"), (namespace if namespace is not None else null).alias("namespace"),
        (F.col("signature") if flags else null).alias("signature"), (F.col("return_type") if flags else null).alias("return_type"),
        "visibility", (F.col("is_static") if flags else F.lit(False)).alias("is_static"),
        (F.col("is_async") if flags else F.lit(False)).alias("is_async"), (F.col("visibility") == "public").alias("is_exported"),
        N.is_deprecated(doc).alias("is_deprecated"), doc.alias("documentation"), "start_line", "end_line", "relative_path",
    )


def map_functions(functions: DataFrame) -> DataFrame:
    """Function records (with relative_path) to index entries: constructor before method before function."""
    kind = F.when(F.col("is_constructor"), "constructor").when(F.col("is_method"), "method").otherwise("function")
    return _entry(functions, kind, F.col("function_name"), flags=True)


def map_classes(classes: DataFrame) -> DataFrame:
    """Class records (class_name, class_kind, ...) to index entries."""
    return _entry(classes, F.col("class_kind"), F.col("class_name"))


def map_routes(routes: DataFrame) -> DataFrame:
    """Route records to index entries, the first per name in a file; the framework is the namespace."""
    named = routes.withColumn("qualified_name", N.route_name(F.col("handler_name"), F.col("http_method"), F.col("path")))
    first = keep_first(named, ["file_id", "qualified_name"], ["start_line"])
    rows = first.withColumn("visibility", F.lit("public")).withColumn("documentation", F.lit(None).cast("string")).withColumn("end_line", F.col("start_line"))
    return _entry(rows, F.lit("route"), F.col("handler_name"), namespace=F.col("framework"))


def map_symbols(symbols: DataFrame) -> DataFrame:
    """Constants, variables and fields (variable_name, symbol_type, ...) to index entries."""
    return _entry(symbols, F.col("symbol_type"), F.col("variable_name"), flags=True)


def map_records(*entry_sets: DataFrame) -> DataFrame:
    """Entry sets in order of authority, each entry with the rank of its set; later sets lose names that an earlier one has in the same file."""
    ranked = [df.select(ENTRY_COLUMNS).withColumn("source_rank", F.lit(i)) for i, df in enumerate(entry_sets)]
    return keep_first(reduce(DataFrame.unionByName, ranked), ["file_id", "qualified_name"], ["source_rank", "start_line"])


def index_entries(entries: DataFrame, batch_size: int = 20) -> DataFrame:
    """One entry per (repository_id, qualified_name) by the batch policy: first in a batch of files, last batch overall."""
    return batched_upsert_winners(entries, "repository_id", "relative_path", ["repository_id", "qualified_name"], ["source_rank", "start_line"], batch_size)


def link_parents(entries: DataFrame) -> DataFrame:
    """``entries`` with parent_symbol_id: the entry of the repository named like this one minus its last segment."""
    up = entries.select("repository_id", F.col("qualified_name").alias("_parent_name"), F.col("id").alias("_parent"))
    named = entries.drop("parent_symbol_id").withColumn("_parent_name", N.parent_name(F.col("qualified_name")))
    return named.join(up, ["repository_id", "_parent_name"], "left").withColumn("parent_symbol_id", F.col("_parent")).drop("_parent_name", "_parent")


def search(entries: DataFrame, query: str, mode: str = "prefix", language: str | None = None, symbol_type: str | None = None, limit: int = 50) -> DataFrame:
    """Top ``limit`` entries by qualified name whose name starts with or equals ``query`` or whose qualified name holds it, without case."""
    q = query.lower()
    name, qualified = F.lower("name"), F.lower("qualified_name")
    hit = {"exact": name == q, "qualified": qualified.like(f"%{q}%")}.get(mode, name.like(f"{q}%"))
    rows = entries.where(hit)
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if symbol_type is not None:
        rows = rows.where(F.col("symbol_type") == symbol_type)
    return rows.orderBy("qualified_name", "id").limit(limit)


def page(rows: DataFrame, order: list[str], limit: int = 500, offset: int = 0, **filters: object) -> DataFrame:
    """A page in a total order; filters with a null value are left out."""
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order).offset(offset).limit(limit)
