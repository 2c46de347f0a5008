"""Tables written between the steps of iterative jobs.

A step that is read more than once, or a loop whose lineage would grow, is
written as parquet below the shared folder of ``spark.checkpoint.dir`` and read
again.  The files live on shared storage, so a lost executor costs a re-read and
no recomputation of earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh temporary folder where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[app]


class Scratch:
    """Numbered parquet tables of one job; superseded ones can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/codestrata/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return the written table; its lineage is the scan alone.

        ``partition_by`` names a column with few values, whose rows can then be read apart.
        """
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
        if self.count == 1:  # the folder goes when the application ends
            self._filesystem(self.root)[0].deleteOnExit(self._filesystem(self.root)[1])
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table written by :meth:`save` that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, where = self._filesystem(path)
            fs.delete(where, True)

    def _filesystem(self, path: str):
        """(Hadoop file system, Hadoop path) of a path."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where
