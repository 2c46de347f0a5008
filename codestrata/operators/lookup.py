"""Point lookups of many keys at once, pages, and deletes of whole repositories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(wanted: DataFrame, rows: DataFrame, keys: Mapping[str, str], value: str, name: str) -> DataFrame:
    """``wanted`` with ``name``: the least ``value`` among the rows whose keys are equal, null where there is none.

    ``keys`` maps columns of ``wanted`` to columns of ``rows``.  A null key finds nothing.  Rows are reduced to one per
    key first, so that repeated rows do not repeat the wanted ones.
    """
    one = rows.groupBy(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(keys.values())]).agg(F.min(value).alias(name))
    found = [F.col(a) == F.col(f"_k{i}") for i, a in enumerate(keys)]
    return wanted.drop(name).join(one, found, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def page_per(rows: DataFrame, scope: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each scope in a total order."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= limit).drop("_place")


def delete_repositories(tables: Mapping[str, DataFrame], gone: DataFrame, key: str = "repository_id") -> dict[str, DataFrame]:
    """Every table without the rows of the repositories in ``gone`` (repository_id); rows without a repository stay.

    The list is small beside the tables and adaptive execution broadcasts it when its size allows.
    """
    ids = gone.select(F.col("repository_id").alias("_gone")).distinct()
    return {name: t.join(ids, F.col(key) == F.col("_gone"), "left_anti") for name, t in tables.items()}


def upsert_keeping(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` replace those of ``existing`` with the same key but take over the ``kept`` columns.

    Keys are unique on both sides; a null in a key is a value like any other.  New keys keep what they bring.
    """
    before = existing.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_there"), *[F.col(c).alias(f"_old_{c}") for c in kept])
    same = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = c if same is None else same & c
    fresh = incoming.join(before, same, "left").select(
        *[F.when(F.col("_there"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in existing.columns]
    )
    after = incoming.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return existing.join(after, same, "left_anti").unionByName(fresh)
