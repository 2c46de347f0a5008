"""Packing texts into windows of fixed capacity.

Hierarchical residual packing: every task packs its own items best-fit and lets go of the
bins that are nearly full; the underfull bins become single items (their contents stay
together) and go on to fewer tasks, each of which gets those of several former ones, until one
task holds the rest or a round, grouped anew, saves no bin.  What crosses the network after the first round
is one row per underfull bin, not the items.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.sources.scratch import Scratch

#: A bin filled to this share of its capacity is emitted without further rounds.
NEARLY_FULL = 0.98
#: Underfull bins that one task packs in a merge round, at most about this many.
MERGE_ITEMS = 20_000
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoding(path: str, pattern: str):
    """A byte-level BPE encoding from a file of ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) by the byte-level BPE in ``path``; a null text has 0 tokens."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(path, pattern)
        for texts in parts:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.select(F.col(doc_id).alias("doc_id"), count(F.col(text)).alias("n_tokens"))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the item numbers of each bin.  No size may exceed ``capacity``."""
    room: list[int] = []  # free room of the open bins, ascending
    bins_at: list[int] = []  # their numbers, in the same order
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(room, sizes[i])
        if at == len(room):
            number, left = len(bins), capacity - sizes[i]
            bins.append([i])
        else:
            number, left = bins_at.pop(at), room.pop(at) - sizes[i]
            bins[number].append(i)
        at = bisect.bisect_left(room, left)
        room.insert(at, left)
        bins_at.insert(at, number)
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One round on the items of one group and one window: each item gets a bin, each bin its fill."""
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable").reset_index(drop=True)
    bins = best_fit(pdf["size"].tolist(), capacity)
    names, fills = [""] * len(pdf), [0] * len(pdf)
    sizes, items = pdf["size"].tolist(), pdf["item"].tolist()
    for members in bins:
        name, fill = min(items[i] for i in members), sum(sizes[i] for i in members)
        for i in members:
            names[i], fills[i] = name, fill
    return pdf.assign(bin=names, fill=fills)[["window_name", "capacity", "item", "size", "bin", "fill"]]


_PACKED = "window_name string, capacity int, item string, size bigint, bin string, fill bigint"


def pack(
    items: DataFrame, windows: DataFrame, scratch: Scratch, nearly_full: float = NEARLY_FULL, merge_items: int = MERGE_ITEMS
) -> DataFrame:
    """(window_name, bin, doc_id, part, n_tokens) for every text and window.

    ``items`` has doc_id and n_tokens; ``windows`` has window_name and capacity_tokens (a list,
    broadcast).  A text longer than the capacity is cut into full parts and a rest, each an
    item of its own; a text without tokens takes no room and gets no row.  A bin is named by
    its smallest item.  Items of one size are interchangeable, so ties cost nothing.
    """
    # the windows are parameters: a handful of rows
    wanted = windows.where("capacity_tokens > 0").select("window_name", "capacity_tokens").distinct().collect()
    if not wanted:
        return items.sparkSession.createDataFrame([], "window_name string, bin string, doc_id bigint, part int, n_tokens bigint")
    each = F.explode(
        F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("int").alias("capacity")) for n, c in wanted])
    )
    cut = (
        items.where("n_tokens > 0")
        .select("doc_id", "n_tokens", each.alias("w"))
        .select("doc_id", "n_tokens", "w.window_name", "w.capacity")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)))
        .select(
            "window_name", "capacity", F.concat_ws(":", "doc_id", "part").alias("item"), "doc_id", "part",
            F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - F.col("part") * F.col("capacity")).alias("size"),
        )
    )
    cut = scratch.save(cut)
    full = cut.where("size = capacity").select("window_name", "doc_id", "part", "size", F.col("item").alias("bin"))
    loose = cut.where("size < capacity")
    open_items = loose.select("window_name", "capacity", "item", "size")
    n = open_items.count()
    groups = max(1, math.ceil(n / merge_items))
    belongs: list[DataFrame] = []
    while n:
        key = F.pmod(F.xxhash64("item", F.lit(len(belongs))), F.lit(groups))
        packed = scratch.save(
            open_items.withColumn("g", key).groupBy("window_name", "g").applyInPandas(_pack, _PACKED)
        )
        belongs.append(packed.select("window_name", "item", "bin"))
        if groups == 1:
            break
        # nearly full bins are done; the others are the items of the next round, dealt anew to as few groups as hold them
        left = packed.where(F.col("fill") < F.lit(nearly_full) * F.col("capacity"))
        open_items = left.groupBy("window_name", "capacity", F.col("bin").alias("item")).agg(F.sum("size").alias("size"))
        bins = packed.select("window_name", "bin").distinct().count()
        if bins == n:  # a whole round without a saving: the items that are left do not combine
            break
        n = open_items.count()
        groups = max(1, math.ceil(n / merge_items))
    placed = loose.select("window_name", "doc_id", "part", "size", "item")
    for step in belongs:
        nxt = step.select("window_name", F.col("item").alias("_item"), "bin")
        placed = (
            placed.join(nxt, (placed["window_name"] == nxt["window_name"]) & (F.col("item") == F.col("_item")), "left")
            .select(placed["window_name"], "doc_id", "part", "size", F.coalesce("bin", "item").alias("item"))
        )
    placed = placed.withColumnRenamed("item", "bin")
    return full.unionByName(placed).select("window_name", "bin", "doc_id", "part", F.col("size").alias("n_tokens"))
