"""References to keys that do not exist, or not at the time of the reference.

1. Parent keys are reduced to (key, born, died) intervals.
2. A Bloom filter over the parent keys is built as a table of bitmaps (distributed,
   partial aggregation).  It is sized from the number of keys and cut into slices by a hash
   of the key, so that each broadcast has at most ``filter_bits`` bits whatever the number of
   parents.  References are cut into the same slices, and each meets its own slice alone.
   A reference whose key the filter does not hold is a definite orphan and is never shuffled.
3. Only the filter-positive references go to the exact join, which also checks the time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.sources.scratch import Scratch

#: Most bits of one slice: 2**26 bits = 8 MiB a broadcast; a documented bound.
FILTER_BITS = 1 << 26
#: About 1 % false positives with four hashes; a third of the bits are set.
BITS_PER_KEY = 10
HASHES = 4
_WORD = 32768  # bits of one bitmap_construct_agg bucket


def _position(hashed: Column, i: int, bits: int) -> Column:
    """Bit ``i`` of a key with the 64-bit hash ``hashed``: the low half plus i times the odd high half."""
    low, high = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1))
    return F.pmod(low + high * F.lit(i), F.lit(bits))


def bloom_filter(parents: DataFrame, key: str, filter_bits: int = FILTER_BITS) -> np.ndarray | None:
    """Bitmap of the keys as bytes, or None when over half of it would be set and the keys need more slices.

    The driver receives at most ``filter_bits / 8`` bytes.
    """
    hashed = parents.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_h"))
    spots = F.explode(F.array(*[_position(F.col("_h"), i, filter_bits) for i in range(HASHES)])).alias("p")
    words = (
        hashed.select(spots)
        .select((F.floor(F.col("p") / _WORD)).alias("w"), F.pmod(F.col("p"), F.lit(_WORD)).alias("o"))
        .groupBy("w")
        .agg(F.expr("bitmap_construct_agg(o)").alias("m"))
        .toPandas()
    )
    out = np.zeros(filter_bits // 8, dtype=np.uint8)
    for w, m in zip(words["w"], words["m"]):
        out[int(w) * (_WORD // 8) : int(w) * (_WORD // 8) + len(m)] = np.frombuffer(bytes(m), dtype=np.uint8)
    filled = int(np.bitwise_count(out).sum())
    return None if filled * 2 > filter_bits else out


def _slice(key: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit("")), F.lit(1)), F.lit(slices)).cast("int")


@dataclass
class KeyFilter:
    """The Bloom filter of a set of keys, one broadcast bitmap per slice."""

    slices: list[Broadcast]
    bits: int
    scratch: Scratch

    def tag(self, refs: DataFrame, key: str) -> DataFrame:
        """``refs``, written once, with a boolean ``_maybe``: False proves that no parent has the key (a null key has none)."""
        if len(self.slices) == 1:
            return self.scratch.save(_held(refs, key, self.slices[0], self.bits))
        # one pass over the references, written apart by slice without a shuffle; each part is read with its own bitmap
        spread = self.scratch.save(refs.withColumn("_slice", _slice(key, len(self.slices))), "_slice")
        parts = [
            _held(spread.where(F.col("_slice") == i).drop("_slice"), key, bitmap, self.bits) for i, bitmap in enumerate(self.slices)
        ]
        return self.scratch.save(reduce(DataFrame.unionByName, parts))


def key_filter(parents: DataFrame, key: str, scratch: Scratch, filter_bits: int = FILTER_BITS) -> KeyFilter:
    """The filter of ``parents[key]`` with as many slices as its keys need; repeated keys only make it roomier."""
    keys = parents.where(F.col(key).isNotNull()).select(key)
    n = keys.count()
    bits = max(_WORD, min(filter_bits, 1 << max(0, n * BITS_PER_KEY - 1).bit_length()))
    slices = max(1, math.ceil(n * BITS_PER_KEY / bits))
    sc = parents.sparkSession.sparkContext
    if slices > 1:
        keys = scratch.save(keys.withColumn("_slice", _slice(key, slices)), "_slice")
    out: list[Broadcast] = []
    for i in range(slices):
        part = keys.where(F.col("_slice") == i) if slices > 1 else keys
        bitmap = bloom_filter(part, key, bits)
        if bitmap is None:  # cannot happen with an even hash; a full slice would only let references through to the join
            bitmap = np.full(bits // 8, 255, dtype=np.uint8)
        out.append(sc.broadcast(bitmap))
    return KeyFilter(out, bits, scratch)


def _held(refs: DataFrame, key: str, bitmap: Broadcast, bits: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = bitmap.value
        for hashes in parts:
            h = hashes.to_numpy(dtype=np.int64).view(np.uint64)
            low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
            ok = np.ones(len(h), dtype=bool)
            for i in range(HASHES):
                p = (low + high * np.uint64(i)) % np.uint64(bits)
                ok &= (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
            yield pd.Series(ok)

    flag = held(F.xxhash64(F.coalesce(F.col(key), F.lit(""))))
    return refs.withColumn("_maybe", F.col(key).isNotNull() & flag)


def orphans(
    refs: DataFrame, parents: DataFrame, ref_key: str, ref_time: str, filter_bits: int = FILTER_BITS, held: KeyFilter | None = None
) -> DataFrame:
    """The rows of ``refs`` that have no parent alive at their time.

    ``parents`` has ``key``, ``born`` and ``died`` (null: never).  A parent lives in
    [born, died).  A null key or null time has no living parent; a null ``born`` never
    lives.  Repeated references stay repeated; an empty parent table makes every reference
    an orphan.  Hot keys on the reference side are split by adaptive skew handling, as the
    join is a left anti join.  ``held`` is the filter of ``parents`` where it is there already.
    """
    if held is None:
        held = key_filter(parents, "key", Scratch(refs.sparkSession, "orphans"), filter_bits)
    alive = parents.select(
        F.col("key").alias("_pkey"), F.col("born").alias("_born"), F.col("died").alias("_died")
    )
    cond = (
        (F.col(ref_key) == F.col("_pkey"))
        & (F.col("_born") <= F.col(ref_time))
        & (F.col("_died").isNull() | (F.col(ref_time) < F.col("_died")))
    )
    tagged = held.tag(refs, ref_key)
    sure = tagged.where(~F.col("_maybe")).drop("_maybe")
    verified = tagged.where("_maybe").drop("_maybe").join(alive, cond, "left_anti")
    return sure.unionByName(verified)
