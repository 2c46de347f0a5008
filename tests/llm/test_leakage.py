"""Leaked passages against brute force."""

import random
import re

from codestrata.llm import leakage
from codestrata.llm.leakage import leaked_passages, without_passages

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda_mu nu Straße ÉCOLE 42 x".split()


def _words(text):
    return [w.casefold() for w in re.findall(r"[^\W_]+", text)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.choice([5, 12, 30])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, items[0][1])]
    docs = [(0, None), (1, ""), (2, "short")]
    for d in range(3, 80):
        parts = [" ".join(rng.choice(WORDS) for _ in range(20))]
        for _ in range(rng.randrange(3)):
            w = re.findall(r"[^\W_]+", rng.choice(items[:30])[1])
            a = rng.randrange(len(w))
            parts.append(rng.choice([" ", "\n--", "_", ", "]).join(x.upper() if rng.random() < 0.3 else x for x in w[a : a + rng.randrange(5, 20)]))
        rng.shuffle(parts)
        docs.append((d, "\n".join(parts)))
    want = set()
    for d, t in docs:
        dw = _words(t or "")
        grams = {tuple(dw[i : i + 12]) for i in range(len(dw) - 11)}
        for i, x in items:
            iw = _words(x or "")
            if any(tuple(iw[k : k + 12]) in grams for k in range(len(iw) - 11)):
                want.add((d, i))
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string")
    idf = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaked_passages(ddf, idf).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    # nothing is left to find after the passages were cut
    assert leaked_passages(without_passages(ddf, idf), idf).count() == 0


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaked_passages(docs, none).count() == 0
    assert without_passages(docs, none).first()["n_removed"] == 0


def test_items_in_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(30))) for i in range(12)]
    docs = [(d, "Some words first. " + items[d % 12][1] + "\nand " + items[(d * 5) % 12][1][:150] + " end", 7) for d in range(30)] + [(99, None, 7), (100, "", 7), (3, "clean", 7)]
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string, n_removed int"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = {(r["doc_id"], r["text"], r["n_removed"]) for r in without_passages(ddf, idf).collect()}
    hits = sorted(map(str, leaked_passages(ddf, idf).collect()))
    monkeypatch.setattr(leakage, "MAX_BROADCAST_NGRAMS", 40)
    cut = without_passages(ddf, idf)
    assert cut.columns == ["doc_id", "text", "n_removed"]
    assert {(r["doc_id"], r["text"], r["n_removed"]) for r in cut.collect()} == whole
    assert sorted(map(str, leaked_passages(ddf, idf).collect())) == hits
