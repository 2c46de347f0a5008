"""Per-key results where a few keys hold most rows.

The rows are first compressed to (key, value, weight).  That grouping spreads a hot
key over all tasks by its values, and a hot (key, value) is combined on the map side,
so no task sees more than its share.  Everything per key is then derived from the
weighted values: counts, exact distinct counts, modes, sums and percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): how often each value occurs under each key; nulls are values."""
    return df.groupBy(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def weighted_summary(weighted: DataFrame) -> DataFrame:
    """Per key: rows, exact distinct non-null values, the mode (smallest value on ties) and its rows.

    Works on partial aggregates only.  A key with nothing but null values has 0 distinct
    values and a null mode.
    """
    best = F.max(
        F.when(F.col("value").isNotNull(), F.struct(F.col("weight").alias("weight"), F.col("value").alias("value")))
    )
    # the smallest value among those of the greatest weight: second pass over the compressed rows
    top = weighted.groupBy("key").agg(
        F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct"), best.getField("weight").alias("_w")
    )
    modes = (
        weighted.where(F.col("value").isNotNull())
        .groupBy("key", "weight")
        .agg(F.min("value").alias("value"))
        .groupBy("key")
        .agg(F.max(F.struct("weight", "value")).alias("m"))
        .select(F.col("key").alias("_key"), F.col("m.value").alias("mode"), F.col("m.weight").alias("mode_rows"))
    )
    return top.join(modes, F.col("key").eqNullSafe(F.col("_key")), "left").select(
        "key", "n_rows", "n_distinct", "mode", F.coalesce("mode_rows", F.lit(0)).alias("mode_rows")
    )


def _bucket(v: Column) -> Column:
    """Order-preserving bucket of a number: sign, binary exponent and five further bits, at most ~4,100 buckets."""
    a = F.abs(v.cast("double"))
    e = F.when(a < 1, F.lit(0)).otherwise(F.floor(F.log2(a)).cast("int") + 1)
    low = F.when(e == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (e - 1).cast("double")))
    width = F.when(e == 0, F.lit(1.0)).otherwise(low)
    step = F.least(F.lit(31), F.greatest(F.lit(0), F.floor((a - low) / width * 32).cast("int")))
    size = e * 32 + step
    return F.when(v < 0, -size - 1).otherwise(size).cast("int")


def weighted_percentiles(weighted: DataFrame, percentages: Sequence[float]) -> DataFrame:
    """(key, percentage, value): exact discrete percentiles of numeric values, nulls set aside.

    The value at rank ``ceil(p * n)`` (at least 1).  First a histogram per key over
    order-preserving buckets locates the bucket that holds the rank; then only the
    compressed values of that bucket are ordered.  No task sorts all values of a key.
    """
    w = weighted.where(F.col("value").isNotNull()).withColumn("b", _bucket(F.col("value")))
    hist = w.groupBy("key", "b").agg(F.sum("weight").alias("n"))
    upto = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    allof = Window.partitionBy("key")
    hist = hist.select("key", "b", "n", F.sum("n").over(upto).alias("cum"), F.sum("n").over(allof).alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percentages])).alias("percentage")
    located = (
        hist.select("key", "b", "n", "cum", "total", wanted)
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("percentage") * F.col("total"))))
        .where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("n") < F.col("rank")))
        .select(
            F.col("key").alias("_key"), F.col("b").alias("_b"), "percentage",
            (F.col("rank") - F.col("cum") + F.col("n")).alias("inner_rank"),
        )
    )
    near = w.join(located, F.col("key").eqNullSafe(F.col("_key")) & (F.col("b") == F.col("_b")))
    run = Window.partitionBy("key", "percentage").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("cum", F.sum("weight").over(run))
    return (
        near.where((F.col("cum") >= F.col("inner_rank")) & (F.col("cum") - F.col("weight") < F.col("inner_rank")))
        .select("key", "percentage", "value")
    )


def heavy_keys(tables: dict[str, DataFrame], share: float) -> DataFrame:
    """(table_name, key, n_rows) of keys with more than ``share`` of all rows of their table.

    ``tables`` maps a name to (key, value, weight) rows.  Rows without a key count for the
    total but are no key.
    """
    parts = [df.select(F.lit(name).alias("table_name"), "key", "weight") for name, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    per_key = rows.groupBy("table_name", "key").agg(F.sum("weight").alias("n_rows"))
    # one row per table name: bounded by the number of tables
    totals = per_key.groupBy("table_name").agg(F.sum("n_rows").alias("_total"))
    return (
        per_key.join(F.broadcast(totals), "table_name")
        .where(F.col("key").isNotNull() & (F.col("n_rows") > F.lit(share) * F.col("_total")))
        .select("table_name", "key", "n_rows")
    )
