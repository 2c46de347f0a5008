"""Packing: nothing lost, nothing split that fits, close to the lower bound."""

import math
import random

from codestrata.llm.packing import best_fit, pack, token_counts, tokenizer_path
from codestrata.sources.scratch import Scratch


def test_best_fit_is_valid_and_tight():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    bins = best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.05 * math.ceil(sum(sizes) / 100) + 1


def test_pack_keeps_every_token(spark):
    rng = random.Random(4)
    items = [(i, rng.choice([0, 1, 7, 64, 65, 200, rng.randrange(1, 60)])) for i in range(400)]
    df = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint")
    w = spark.createDataFrame([("s", 64), ("l", 256)], "window_name string, capacity_tokens int")
    out = pack(df, w, Scratch(spark, "t"), merge_items=60).collect()
    for name, capacity in (("s", 64), ("l", 256)):
        rows = [r for r in out if r["window_name"] == name]
        parts, fill = {}, {}
        for r in rows:
            parts.setdefault(r["doc_id"], []).append(r["n_tokens"])
            fill[r["bin"]] = fill.get(r["bin"], 0) + r["n_tokens"]
        assert {d: sum(p) for d, p in parts.items()} == {d: n for d, n in items if n}
        assert all(len(p) == math.ceil(sum(p) / capacity) for p in parts.values())  # split only where it must be
        assert max(fill.values()) <= capacity
        assert len(fill) <= 1.15 * math.ceil(sum(n for _, n in items) / capacity) + 1  # a bound that whole items need not reach


def test_pack_of_items_that_never_combine(spark):
    df = spark.range(300).selectExpr("id as doc_id", "cast(40 as bigint) as n_tokens")
    w = spark.createDataFrame([("s", 64)], "window_name string, capacity_tokens int")
    assert pack(df, w, Scratch(spark, "t"), merge_items=20).select("bin").distinct().count() == 300
    assert pack(df.limit(0), w, Scratch(spark, "t")).count() == 0
    assert pack(df, w.limit(0), Scratch(spark, "t")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>")], "doc_id bigint, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, tokenizer_path()).collect()}
    assert n[1] == n[2] == 0 and n[3] == 2 and n[4] > 1
