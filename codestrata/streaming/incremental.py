"""Re-processing of the files that changed.

The batch functions replace the rows of some files and keep all others; the streaming wrapper runs
them per micro-batch and writes the new state as a new version, so that a restarted batch writes
the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codestrata.operators.index import link_parents
from codestrata.sources.records import read_records, replace_repositories


def replace_files(table: DataFrame, fresh: DataFrame, file_ids: DataFrame) -> DataFrame:
    """``table`` with the rows of the files in ``file_ids`` replaced by ``fresh``; files without fresh rows are deleted."""
    kept = table.join(file_ids.select("file_id").distinct(), "file_id", "left_anti").select(table.columns)
    return kept.unionByName(fresh.select(table.columns))


def delete_files(table: DataFrame, file_ids: DataFrame) -> DataFrame:
    """``table`` without the rows of some files."""
    return table.join(file_ids.select("file_id").distinct(), "file_id", "left_anti").select(table.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in ``gone`` (node_id) and without the edges at them, in either direction."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    left = left.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti").select(nodes.columns), left.select(edges.columns)


def reindex(entries: DataFrame, fresh: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Index entries after some files were parsed again; all parent links are made anew."""
    return link_parents(replace_files(entries, fresh, file_ids))


def stream_reindex(
    changes: DataFrame, path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], spark: SparkSession
) -> StreamingQuery:
    """Apply a stream of changed sources to the index at ``{path}/v{n}``.

    ``parse`` turns changed sources (with a file_id) into entries.  Each micro-batch reads the version
    before its own number and writes its own, so a batch that runs twice gives the same table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        entries = spark.read.parquet(f"{path}/v{number}")
        reindex(entries, parse(batch), batch).write.mode("overwrite").parquet(f"{path}/v{number + 1}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_reindex_repositories(
    changes: DataFrame, root: str, kind: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], spark: SparkSession
) -> StreamingQuery:
    """Apply a stream of changed sources (repository_id, file_id) to the record table ``{root}/{kind}`` in place.

    Only the buckets of the repositories in a micro-batch are read and overwritten.  A batch that runs twice finds its
    files replaced already and gives the same rows.
    """

    def apply(batch: DataFrame, number: int) -> None:
        touched = batch.select("repository_id").distinct()
        before = read_records(spark, root, kind).join(touched, "repository_id", "left_semi")
        replace_repositories(spark, root, kind, reindex(before, parse(batch), batch), touched)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
