"""Shared spans against brute force, and the index against plain search."""

import random

import numpy as np
import pytest

from codestrata.llm import spans
from codestrata.llm.fmindex import FMIndex
from codestrata.sources.scratch import Scratch


def test_index_counts_like_plain_search():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé漢") for _ in range(rng.randrange(1, 60))) for _ in range(20)] + ["", "aaaaaaaa"]
    index = FMIndex(texts, 64)
    for length in (1, 2, 3, 5):
        patterns = ["".join(rng.choice("abcé漢z") for _ in range(length)) for _ in range(50)] + ["a" * length]
        symbols, starts = index.encode(patterns)
        lo, hi = index.search(symbols, starts, length)
        for p, a, b in zip(patterns, lo, hi):
            want = sum(t.startswith(p, i) for t in texts for i in range(len(t)))
            assert max(0, b - a) == want
            assert sorted(set(index.owner(index.suffixes[a:b]))) == [k for k, t in enumerate(texts) if p in t] if want else True


def _brute(docs, n):
    owners = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            owners.setdefault(t[i : i + n], set()).add(d)
    pairs = {(a, b) for v in owners.values() for a in v for b in v if a < b}
    covered = {}
    for d, t in docs:
        marks = np.zeros(len(t or ""), dtype=bool)
        for i in range(len(t or "") - n + 1):
            if len(owners[t[i : i + n]]) > 1:
                marks[i : i + n] = True
        covered[d] = int(marks.sum())
    return pairs, covered


@pytest.mark.parametrize("shard", [1000, 3])
def test_spans_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spans, "SHARD_PIECES", shard)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh \n漢") for _ in range(n))
    header = text(58)
    pool = [text(rng.randrange(30, 200)) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, "x" * 70), (3, "x" * 90), (4, "ab" * 60)]
    for d in range(5, 60):
        parts = [rng.choice(["", header]), text(rng.randrange(60)), rng.choice(pool)[rng.randrange(20) :], text(rng.randrange(60)), rng.choice(pool)]
        docs.append((d, "".join(parts)))
    docs += [(60, docs[10][1]), (61, docs[10][1])]
    pairs, covered = _brute(docs, 60)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    windows, classes = spans.shared_windows(df, Scratch(spark, "t"), min_chars=60, gram=16)
    assert {(r[0], r[1]) for r in spans.shared_pairs(windows, classes).collect()} == pairs and pairs
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_coverage(windows, classes).collect()}
    assert got == {d: covered[d] for d, t in docs if t and len(t) >= 60}


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "short")], "doc_id bigint, text string")
    windows, classes = spans.shared_windows(df, Scratch(spark, "t"))
    assert spans.shared_pairs(windows, classes).count() == 0 and spans.shared_coverage(windows, classes).count() == 0
