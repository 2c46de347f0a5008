"""Record sets of parsed files as tables on shared storage, replaced by repository."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders per kind; a repository lies in one, so that replacing it rewrites one folder per kind.
BUCKETS = 64


def bucket_of(repository: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(repository, F.lit(""))), F.lit(buckets)).cast("int")


def save_records(records: Mapping[str, DataFrame], root: str, buckets: int = BUCKETS) -> None:
    """Write every kind of record (with repository_id) as ``{root}/{kind}``, partitioned by a bucket of the repository."""
    for kind, rows in records.items():
        rows.withColumn("bucket", bucket_of(F.col("repository_id"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{kind}")


def read_records(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{kind}").drop("bucket")


def replace_repositories(spark: SparkSession, root: str, kind: str, fresh: DataFrame, repositories: DataFrame, buckets: int = BUCKETS) -> None:
    """Rows of the repositories in ``repositories`` (repository_id) become those of ``fresh``; none deletes them.

    Only the buckets of these repositories are read and overwritten (dynamic partitions); the new rows are written apart
    first, since a folder is not read while it is overwritten.
    """
    ids = repositories.select("repository_id").distinct()
    # at most ``buckets`` numbers
    touched = [r[0] for r in ids.select(bucket_of(F.col("repository_id"), buckets).alias("b")).distinct().collect()]
    if not touched:
        return
    path = f"{root}/{kind}"
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    kept = old.join(ids, "repository_id", "left_anti").select(old.columns)
    new = fresh.join(ids, "repository_id", "left_semi").withColumn("bucket", bucket_of(F.col("repository_id"), buckets)).select(old.columns)
    staged = f"{root}/_staged_{kind}"
    kept.unionByName(new).write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(old.schema).parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    # buckets that lost their last row have no new folder and keep the old one
    filled = {r[0] for r in rows.select("bucket").distinct().collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for b in set(touched) - filled:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}"), True)
