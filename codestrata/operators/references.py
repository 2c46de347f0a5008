"""References of the code tables, as input of :mod:`codestrata.operators.orphans`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.orphans import FILTER_BITS, key_filter, orphans
from codestrata.sources.scratch import Scratch

#: Callers that stand for "no enclosing symbol" (fixed values).
PLACEHOLDER_CALLERS = ["<module>", "<class>", "<package>"]
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_SEP = "\x1f"


def trimmed(name: str) -> Column:
    """The column without white space at its ends; null where nothing is left."""
    return F.nullif(F.btrim(F.col(name), F.lit(_SPACE)), F.lit(""))


def call_references(calls: DataFrame, external_names: DataFrame) -> DataFrame:
    """(table_name, record_id, field_name, key, key2, at) for callers and callees of project symbols.

    Left out: null or blank names, placeholder callers, callees on an external object, and
    external callables called without an object.  ``key2`` is the callee with its object.
    ``external_names`` is a list of the languages' own names (bounded, broadcast).
    """
    names = external_names.select(
        F.col("language").alias("_lang"), F.col("name").alias("_name"), F.col("kind").alias("_kind")
    ).distinct()
    c = calls.select(
        F.col("id").alias("record_id"), "repository_id", "language", F.col("created_at").alias("at"),
        trimmed("caller_name").alias("caller"), trimmed("callee_name").alias("callee"),
        trimmed("callee_object").alias("object"),
    )
    scoped = lambda n: F.concat(F.lit("q:"), F.col("repository_id"), F.lit(_SEP), n)
    callers = c.where(F.col("caller").isNotNull() & ~F.col("caller").isin(PLACEHOLDER_CALLERS)).select(
        F.lit("calls").alias("table_name"), "record_id", F.lit("caller_name").alias("field_name"),
        scoped(F.col("caller")).alias("key"), F.lit(None).cast("string").alias("key2"), "at",
    )
    external = (F.col("language") == F.col("_lang")) & (
        ((F.col("_kind") == "object") & (F.col("object") == F.col("_name")))
        | ((F.col("_kind") == "callable") & F.col("object").isNull() & (F.col("callee") == F.col("_name")))
    )
    callees = (
        c.where(F.col("callee").isNotNull())
        .join(F.broadcast(names), external, "left_anti")
        .select(
            F.lit("calls").alias("table_name"), "record_id", F.lit("callee_name").alias("field_name"),
            scoped(F.col("callee")).alias("key"),
            F.when(F.col("object").isNotNull(), scoped(F.concat_ws(".", "object", "callee"))).alias("key2"), "at",
        )
    )
    return callers.unionByName(callees)


def edge_references(edges: DataFrame) -> DataFrame:
    """The same columns for ``graph_edges.target_id``; a null target is no reference."""
    return edges.where(F.col("target_id").isNotNull()).select(
        F.lit("graph_edges").alias("table_name"), F.col("edge_id").alias("record_id"),
        F.lit("target_id").alias("field_name"), F.concat(F.lit("i:"), "target_id").alias("key"),
        F.lit(None).cast("string").alias("key2"), F.col("created_at").alias("at"),
    )


def node_lifetimes(
    entries: DataFrame, removed: DataFrame, files: DataFrame, repositories: DataFrame
) -> DataFrame:
    """(key, born, died) of everything that a reference can name.

    Index entries, files and repositories live from their earliest row on; removed
    entries in [created_at, removed_at).
    """
    never = F.lit(None).cast("timestamp").alias("died")
    qname = F.concat(F.lit("q:"), "repository_id", F.lit(_SEP), "qualified_name").alias("key")
    born = F.col("created_at").alias("born")
    standing = [
        entries.select(qname, born),
        entries.select(F.concat(F.lit("i:"), "id").alias("key"), born),
        files.select(F.concat(F.lit("i:file:"), "repository_id", F.lit(":"), "relative_path").alias("key"), born),
        repositories.select(F.concat(F.lit("i:repo:"), "id").alias("key"), born),
    ]
    lasting = (
        reduce(DataFrame.unionByName, standing)
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("born").alias("born"))
        .select("key", "born", never)
    )
    died = F.col("removed_at").alias("died")
    gone = [
        removed.select(qname, born, died),
        removed.select(F.concat(F.lit("i:"), "entry_id").alias("key"), born, died),
    ]
    return lasting.unionByName(
        reduce(DataFrame.unionByName, gone).where(F.col("key").isNotNull() & F.col("died").isNotNull()).distinct()
    )


def orphan_references(
    spark: SparkSession, refs: DataFrame, parents: DataFrame, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(table_name, record_id, field_name, at) of references whose ``key`` and ``key2`` both have no living target.

    Few references fail on their first key; those are written once and tried with the second.  One filter
    serves both.
    """
    scratch = Scratch(spark, "orphans")
    parents = scratch.save(parents)
    held = key_filter(parents, "key", scratch, filter_bits)
    first = scratch.save(orphans(refs, parents, "key", "at", held=held))
    single = first.where(F.col("key2").isNull())
    second = orphans(first.where(F.col("key2").isNotNull()), parents, "key2", "at", held=held)
    return single.unionByName(second).select("table_name", "record_id", "field_name", "at")
