"""File trees to file rows, and the statistics, manifests and trees made from them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import files as X
from codestrata.sources.scratch import Scratch


_LISTED = "path string, is_dir boolean, size_bytes bigint, last_modified timestamp"


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path, or a URI such as hdfs, s3 or gs), and the folder in it."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _children_of(root: str):
    """Entries of each directory; ignored directories are not entered, symbolic links are skipped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ignored = set(X.IGNORED_DIRECTORIES)
        system, _ = _file_system(root)
        local = isinstance(system, fs.LocalFileSystem)
        for pdf in parts:
            rows = []
            for directory in pdf["path"]:
                try:
                    entries = system.get_file_info(fs.FileSelector(directory))
                except OSError:
                    continue
                for e in entries:
                    is_dir = e.type == fs.FileType.Directory
                    if (is_dir and e.base_name in ignored) or (local and os.path.islink(e.path)):
                        continue
                    known = e.type in (fs.FileType.File, fs.FileType.Directory)
                    at = pd.Timestamp(e.mtime_ns, unit="ns") if known and e.mtime_ns else None
                    rows.append((e.path, is_dir, e.size if known else None, at))
            out = pd.DataFrame(rows, columns=["path", "is_dir", "size_bytes", "last_modified"])
            yield out.astype({"size_bytes": "Int64", "last_modified": "datetime64[us]"})

    return run


def _read_udf(root: str):
    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        system, _ = _file_system(root)

        def read(path: str | None) -> bytes | None:
            try:
                with system.open_input_stream(path) as f:
                    return f.read()
            except (OSError, TypeError):
                return None

        for paths in parts:
            yield paths.map(read)

    return run


def scan_tree(spark: SparkSession, root: str, repository_id: str, max_bytes: int = X.MAX_FILE_BYTES) -> DataFrame:
    """One row per file below ``root`` (a path or URI that all executors reach), as :func:`file_rows` describes them.

    Directories are listed level by level, each level spread over the executors.  Contents are read only
    for files of a readable size and extension; the status of all others follows from path and length.
    Spark's own file source is not used, as it passes over names that begin with a dot or an underscore.
    """
    root = root.rstrip("/")
    scratch = Scratch(spark, "scan")
    base = _file_system(root)[1]
    level = spark.createDataFrame([(base,)], "path string")
    found = []
    for _ in range(X.MAX_DEPTH + 1):
        # a directory is little data and much waiting: one task for every few of them
        listed = scratch.save(level.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(_children_of(root), _LISTED))
        found.append(listed.where("not is_dir"))
        level = listed.where("is_dir").select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionByName, found)
    clean = F.col("path")
    read = _read_udf(root)
    wanted = (F.col("size_bytes") <= max_bytes) & ~X.extension(X.file_name(clean)).isin(X.IGNORED_EXTENSIONS)
    rows = files.select(
        F.lit(repository_id).alias("repository_id"), F.substring(clean, len(base) + 2, 1 << 20).alias("relative_path"),
        clean.alias("absolute_path"), read(F.when(wanted, clean)).alias("content"), "size_bytes", "last_modified",
    )
    return file_rows(rows, max_bytes)


def file_rows(listed: DataFrame, max_bytes: int = X.MAX_FILE_BYTES) -> DataFrame:
    """Metadata rows of listed files (repository_id, relative_path, absolute_path, content, size_bytes, last_modified).

    Files in ignored directories or deeper than the depth limit leave no row.  The first rule that
    applies decides: ignored extension (IGNORED, size 0), unreadable (FAILED), too large (IGNORED),
    else SCANNED with language, MIME type, binary flag and hash.
    """
    depth = F.size(F.split("relative_path", "/")) - 1
    rows = listed.where(~X.in_ignored_directory(F.col("relative_path")) & (depth <= X.MAX_DEPTH))
    name = X.file_name(F.col("relative_path"))
    rows = rows.withColumn("file_name", name).withColumn("extension", X.extension(F.col("file_name")))
    ignored = F.col("extension").isin(X.IGNORED_EXTENSIONS)
    failed = F.col("size_bytes").isNull()
    large = F.col("size_bytes") > max_bytes
    status = F.when(ignored | large, F.lit("IGNORED")).when(failed, F.lit("FAILED")).otherwise(F.lit("SCANNED"))
    rows = rows.withColumn("scan_status", F.when(ignored, F.lit("IGNORED")).otherwise(status))
    scanned = F.col("scan_status") == "SCANNED"
    rows = rows.withColumn("is_binary", scanned & X.is_binary(F.col("extension"), F.col("content")))
    return rows.select(
        F.sha2(F.concat_ws("::", "repository_id", "relative_path"), 256).alias("id"), "repository_id", "relative_path",
        "absolute_path", "file_name", "extension",
        F.when(scanned, X.language(F.col("file_name"), F.col("extension"))).otherwise("Unknown").alias("language"),
        F.when(scanned, X.mime_type(F.col("extension"))).otherwise(X.DEFAULT_MIME).alias("mime_type"),
        F.when(ignored | failed, F.lit(0)).otherwise(F.col("size_bytes")).cast("bigint").alias("size_bytes"),
        F.when(scanned, X.sha256_of(F.col("content"), F.col("is_binary"))).alias("sha256"),
        "is_binary", X.is_hidden(F.col("relative_path")).alias("is_hidden"),
        F.when(~ignored, F.col("last_modified")).alias("last_modified"), "scan_status",
    )


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def scan_summary(files: DataFrame) -> DataFrame:
    """Per repository: files by status, binaries, hidden files, bytes, languages, in one pass."""
    s = F.col("scan_status")
    scanned = s == "SCANNED"
    return files.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("total_files"), _n(scanned).alias("scanned_files"), _n(s == "IGNORED").alias("ignored_files"),
        _n(s == "FAILED").alias("failed_files"), _n(scanned & F.col("is_binary")).alias("binary_files"),
        _n(F.col("is_hidden")).alias("hidden_files"),
        F.coalesce(F.sum(F.when(scanned, F.col("size_bytes"))), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_distinct(F.when(scanned, F.col("language"))).alias("n_languages"),
    )


def language_stats(files: DataFrame) -> DataFrame:
    """Per repository and language: scanned files, bytes, share of the repository's scanned files in percent."""
    per = files.where("scan_status = 'SCANNED'").groupBy("repository_id", "language").agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes")
    )
    # the window runs over the languages of a repository, not over its files
    whole = F.sum("file_count").over(Window.partitionBy("repository_id"))
    return per.withColumn("percentage", F.round(F.col("file_count") * F.lit(100.0) / whole, 2))


def top_languages(stats: DataFrame, keep: int = 8) -> DataFrame:
    """The ``keep`` commonest languages of each repository, all others as ``Other``."""
    w = Window.partitionBy("repository_id").orderBy(F.desc("file_count"), "language")
    ranked = stats.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy("repository_id", F.when(F.col("_r") <= keep, F.col("language")).otherwise("Other").alias("language")).agg(
        F.sum("file_count").alias("file_count"), F.sum("total_bytes").alias("total_bytes")
    )


def ancestor_directories(files: DataFrame) -> DataFrame:
    """(repository_id, directory, name, depth): every directory above a file, once."""
    parts = F.split("relative_path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = files.where(F.size(parts) > 1).select("repository_id", F.explode(upto).alias("directory")).where("directory <> ''").distinct()
    return rows.select(
        "repository_id", "directory", F.element_at(F.split("directory", "/"), -1).alias("name"), F.size(F.split("directory", "/")).alias("depth")
    )


def directory_tree(files: DataFrame) -> DataFrame:
    """(repository_id, parent_path, path, name, is_file, language, size_bytes) of the scanned files and their directories."""
    scanned = files.where("scan_status = 'SCANNED'")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    dirs = ancestor_directories(scanned).select("repository_id", F.col("directory").alias("path"), "name").select(
        "repository_id", parent.alias("parent_path"), "path", "name", F.lit(False).alias("is_file"),
        F.lit(None).cast("string").alias("language"), F.lit(0).cast("bigint").alias("size_bytes"),
    )
    leaves = scanned.select("repository_id", F.col("relative_path").alias("path"), F.col("file_name").alias("name"), "language", "size_bytes")
    leaves = leaves.select(
        "repository_id", parent.alias("parent_path"), "path", "name", F.lit(True).alias("is_file"), "language", "size_bytes"
    )
    return dirs.unionByName(leaves)


def parseable(files: DataFrame) -> DataFrame:
    """Files that parsing and indexing take: scanned text of a supported language."""
    return files.where(
        (F.col("scan_status") == "SCANNED") & F.col("language").isin("Python", "JavaScript", "TypeScript", "Java", "Go") & ~F.col("is_binary")
    )
