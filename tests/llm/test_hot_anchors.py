"""Anchors that more texts have than a shard holds."""

import random

import pandas as pd

from codestrata.llm import spans
from codestrata.sources.scratch import Scratch
from tests.llm.test_spans import _brute


def test_groups_of_a_hot_anchor_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spans, "SHARD_PIECES", 16)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    header = text(150)
    # the whole header before nothing else, or cut and followed by a few texts, some of them twice
    tails = [text(40) for _ in range(25)]
    docs = [(d, text(rng.randrange(30)) + header[rng.randrange(40) :] + rng.choice(tails)) for d in range(90)]
    docs += [(d, header + header + tails[d % 5] + str(d)) for d in range(90, 100)]
    search, seen = spans._search_shard, tmp_path / "sizes"

    def counted(pdf: pd.DataFrame, *args) -> pd.DataFrame:
        with seen.open("a") as f:
            print(pdf["piece"].nunique(), len(pdf), file=f)
        return search(pdf, *args)

    monkeypatch.setattr(spans, "_search_shard", counted)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    windows, classes = spans.shared_windows(df, Scratch(spark, "t"), min_chars=60, gram=16)
    pairs, covered = _brute(docs, 60)
    assert {(r[0], r[1]) for r in spans.shared_pairs(windows, classes).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_coverage(windows, classes).collect()} == covered
    sizes = [tuple(map(int, x.split())) for x in seen.read_text().splitlines()]
    assert max(n for n, _ in sizes) <= 48 and max(n for _, n in sizes) <= 64
