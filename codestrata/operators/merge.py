"""Latest-wins, keep-first and batch-aware merges on a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.sources.scratch import Scratch

#: Keys of one scope that one task puts in order.
HOT_KEYS = 500_000


def latest(df: DataFrame, keys: Sequence[str], version: str = "updated_at") -> DataFrame:
    """One row per key: the one with the greatest ``version``.

    Ties on ``version`` are settled by the whole row, so the result never depends on
    partitioning; a null version loses against any other.  Written as an aggregation
    (map-side combine), so a hot key costs one row per map task and no sort of the group.
    Map columns cannot be compared and are not allowed.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [version, *[c for c in rest if c != version]]
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in order])).alias("_best")
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
    return out.select(*[F.col(f"`{k}`") if k in keys else F.col(f"_best.`{k}`").alias(k) for k in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` (nulls first); ties by the remaining columns."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order and c not in keys]]
    best = F.min(F.struct(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(ranked)])).alias("_best")
    place = {c: i for i, c in reversed(list(enumerate(ranked)))}
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
    return out.select(*[F.col(f"`{k}`") if k in keys else F.col(f"_best._o{place[k]}").alias(k) for k in df.columns])


def duplicate_stats(df: DataFrame, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct keys and surplus rows, per ``scope``."""
    per_key = df.groupBy(*scope, *[k for k in keys if k not in scope]).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*scope).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total"),
        F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
        F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).cast("bigint").alias("colliding_keys"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``existing`` with the same key; keys of ``incoming`` must be unique."""
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti").select(*existing.columns)
    return kept.unionByName(incoming.select(*existing.columns))


def batched_upsert_winners(
    df: DataFrame, scope: str, batch_key: str, keys: Sequence[str], sequence: Sequence[str], batch_size: int = 20
) -> DataFrame:
    """Collision policy of batch loads: first wins inside a batch, the last batch wins overall.

    ``batch_key`` (e.g. a path) is numbered per ``scope`` in ascending order and cut into
    batches of ``batch_size``.  Numbering runs over the distinct batch keys only, in ranges of keys, so that
    no task orders the keys of a hot scope alone.
    """
    places = numbered(df.select(scope, batch_key).distinct(), scope, batch_key, "_place")
    batches = places.withColumn("_batch", F.floor(F.col("_place") / F.lit(batch_size))).drop("_place")
    tagged = df.join(batches, [scope, batch_key])
    return keep_first(tagged.withColumn("_rank", -F.col("_batch")), list(keys), ["_rank", batch_key, *sequence]).drop(
        "_rank", "_batch"
    )


def numbered(keys: DataFrame, scope: str, order: str, name: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``keys`` with ``name``: the place, from 0, of each key in its scope.

    Scopes of more than ``hot_keys`` keys are range-partitioned by (scope, order) and written with their range, so that
    recomputed tasks find the same ranges; a place is that in the range plus the sizes of the ranges before it.
    """
    ordered = lambda *by: Window.partitionBy(*by).orderBy(order)
    sizes = keys.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > hot_keys)
    n_hot = hot.agg(F.sum("_n")).first()[0] or 0
    if not n_hot:
        return keys.withColumn(name, F.row_number().over(ordered(scope)) - 1)
    ids = hot.select(F.col(scope).alias("_hot"))
    usual = keys.join(ids, F.col(scope).eqNullSafe(F.col("_hot")), "left_anti").withColumn(name, F.row_number().over(ordered(scope)) - 1)
    crowded = keys.join(ids, F.col(scope).eqNullSafe(F.col("_hot")), "left_semi").repartitionByRange(1 + n_hot // hot_keys, scope, order)
    crowded = Scratch(keys.sparkSession, "ranges").save(crowded.withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = crowded.groupBy(scope, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col(scope).alias("_scope"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = crowded.withColumn("_in", F.row_number().over(ordered(scope, "_range")) - 1)
    placed = placed.join(starts, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_range") == F.col("_r")))
    return usual.unionByName(placed.select(*keys.columns, (F.col("_in") + F.col("_start")).cast("int").alias(name)))


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | (F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) == 0)
