"""Column functions on qualified names, modules, libraries and routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.files import slashed

# Node label of each symbol type.
NODE_LABELS = {
    "class": "Class",
    "function": "Function",
    "method": "Method",
    "constructor": "Constructor",
    "variable": "Variable",
    "constant": "Constant",
    "enum": "Enum",
    "interface": "Interface",
    "struct": "Struct",
    "module": "Module",
    "package": "Package",
    "route": "ApiRoute",
    "decorator": "Property",
    "annotation": "Property",
}


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def or_else(c: Column, other: Column) -> Column:
    """``other`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def module_of(path: Column, language: Column) -> Column:
    """Path without extension, its separators slashes or backslashes; dotted, except for Go, which gets slashes."""
    stem = F.regexp_replace(slashed(path), r"(?<=[^/])\.[^./]*$", "")
    dotted = F.array_join(F.filter(F.split(stem, "/"), lambda p: (p != "") & (p != ".")), ".")
    return F.when(F.lower(language) == "go", stem).otherwise(dotted)


def qualified(path: Column, language: Column, *parts: Column) -> Column:
    """Module and name parts, the empty ones left out."""
    return F.array_join(F.filter(F.array(module_of(path, language), *parts), lambda p: p.isNotNull() & (p != "")), ".")


def normalise(name: Column) -> Column:
    """Trimmed, without dots at the ends, runs of dots collapsed."""
    return F.regexp_replace(F.regexp_replace(strip(name), r"^\.+|\.+$", ""), r"\.{2,}", ".")


def is_valid(name: Column) -> Column:
    return F.coalesce(strip(name).rlike(r"^[\p{L}\p{N}_.\-/()*]+$"), F.lit(False))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def module_prefix(name: Column, short: Column) -> Column:
    """``name`` without its ``.short`` suffix; null where it does not end so."""
    suffix = F.concat(F.lit("."), short)
    return F.when((name != short) & name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - F.length(suffix)))


def display_name(name: Column) -> Column:
    """The last two segments."""
    return F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0)


def parent_name(name: Column) -> Column:
    """The name minus its last segment; null for a single segment."""
    return F.nullif(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lit(""))


def is_deprecated(documentation: Column) -> Column:
    d = documentation
    return F.coalesce(d.contains("deprecated") | d.contains("@Deprecated") | d.contains("DEPRECATED"), F.lit(False))


def library_name(module: Column) -> Column:
    """Package of an import path: the last segment of a URL-like path, else what stands before the first dot or slash."""
    tail = F.element_at(F.split(F.regexp_replace(module, "/+$", ""), "/"), -1)
    head = F.regexp_extract(module, r"^[^./]*", 0)
    return F.when(module.contains("/") & module.contains("."), tail).otherwise(head)


def route_name(handler: Column, method: Column, path: Column) -> Column:
    return F.concat_ws(".", handler, method, F.replace(path, F.lit("/"), F.lit("|")))


def route_node_id(repository: Column, method: Column, path: Column) -> Column:
    return F.concat(F.lit("route:"), repository, F.lit(":"), F.upper(method), F.lit("."), F.replace(path, F.lit("/"), F.lit("|")))


def node_label(symbol_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in NODE_LABELS.items() for v in p]), symbol_type), F.lit("Variable"))
