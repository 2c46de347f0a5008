"""Evaluation texts that leak into a corpus.

The n-grams of the normalised evaluation items form a hash set that is broadcast; the
corpus is scanned once, in place, without a shuffle.  A window of n consecutive words is
looked up in the set, a hit is verified against the words of the item, and the matched
character spans come out per document and item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs of letters and digits; everything else, underscore included, separates.
WORD = re.compile(r"[^\W_]+")
NGRAM_WORDS = 12
#: Documented bound of the broadcast set; beyond it the items are matched in blocks of this many n-grams.
MAX_BROADCAST_NGRAMS = 2_000_000


def words(text: str) -> list[str]:
    """The normalised words of a text."""
    if text.isascii():
        return WORD.findall(text.lower())
    return [w.casefold() for w in WORD.findall(text)]


def _gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` word numbers."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + x[k : k + len(out)]
        return out ^ (out >> np.uint64(29))


class NgramSet:
    """Vocabulary and n-grams of one block of evaluation items, as a sorted array of 64-bit hashes with the place of each.

    A gram takes 12 bytes beside the words of the items; a hash that is found is compared with the words at its places.
    """

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        ids, hashes, places, ends = [], [], [], []
        at = 0
        for _, text in items:
            own = np.array([number.setdefault(w, len(number)) for w in words(text)], dtype=np.int32)
            if len(own) >= n:
                hashes.append(_gram_hashes(own, n))
                places.append(np.arange(at, at + len(own) - n + 1, dtype=np.int32))
            ids.append(own)
            at += len(own)
            ends.append(at)
        self.items = [i for i, _ in items]
        self.ends = np.array(ends, dtype=np.int64)
        self.words = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.places = np.concatenate(places) if places else np.empty(0, np.int32)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places = self.hashes[order], self.places[order]

    def hits(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Word intervals [first, last) of ``text`` per item, merged where they touch."""
        found: dict[int, list[tuple[int, int]]] = {}
        spoken, n = words(text), self.n
        if len(spoken) < n or not len(self.hashes):
            return found
        known = np.fromiter(map(self.vocabulary.get, spoken, repeat(-1)), dtype=np.int64, count=len(spoken))
        # windows without an unknown word
        unknown = np.concatenate([[0], np.cumsum(known < 0)])
        whole = np.flatnonzero(unknown[n:] == unknown[:-n])
        if not len(whole):
            return found
        wanted = _gram_hashes(known, n)[whole]
        first = np.searchsorted(self.hashes, wanted, side="left")
        in_set = (first < len(self.hashes)) & (self.hashes[np.minimum(first, len(self.hashes) - 1)] == wanted)
        for at, low, h in zip(whole[in_set].tolist(), first[in_set].tolist(), wanted[in_set]):
            high = int(np.searchsorted(self.hashes, h, side="right"))
            window = known[at : at + n]
            owners = {
                self.items[int(np.searchsorted(self.ends, p, side="right"))]
                for p in self.places[low:high].tolist() if np.array_equal(self.words[p : p + n], window)
            }
            for item in owners:
                spans = found.setdefault(item, [])
                if spans and spans[-1][1] >= at:
                    spans[-1] = (spans[-1][0], at + n)
                else:
                    spans.append((at, at + n))
        return found


def _blocks(items: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[NgramSet]:
    """The items in blocks of bounded size, read in order of their id."""
    block: list[tuple[int, str]] = []
    grams = 0
    rows = items.where(F.col(text_col).isNotNull()).select(id_col, text_col).orderBy(id_col)
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, text))
        grams += max(0, len(words(text)) - n + 1)
        if grams >= MAX_BROADCAST_NGRAMS:
            yield NgramSet(block, n)
            block, grams = [], 0
    if block:
        yield NgramSet(block, n)


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = NGRAM_WORDS,
) -> DataFrame:
    """(doc_id, item_id, n_words, n_spans, first_word): how much of an item each document holds.

    A row per document and item with at least ``n`` consecutive words in common.  ``n_words``
    counts the document's words inside of matched windows.  Null, blank or shorter texts match
    nothing; repeated documents each give their rows; items shorter than ``n`` words cannot leak.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    ikind = items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {ikind}, n_words int, n_spans int, first_word int"
    corpus = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text, n):
        shared = spark.sparkContext.broadcast(block)

        def scan(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            table = shared.value
            for pdf in parts:
                rows = []
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    for item, spans in table.hits(t).items():
                        rows.append((d, item, sum(b - a for a, b in spans), len(spans), spans[0][0]))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_spans", "first_word"])

        found = corpus.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the word intervals in ``spans``."""
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in sorted(spans):
        left, right = places[a][0], places[b - 1][1]
        if left > at:
            kept.append(text[at:left])
        at = max(at, right)
    return "".join(kept) + text[at:]


def without_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = NGRAM_WORDS,
) -> DataFrame:
    """``documents`` with the leaked passages cut out of ``text`` and ``n_removed`` characters added.

    A passage runs from its first to its last word.  A null text stays null with 0 removed.  Items of one block are
    cut in the scan that finds them.  With more blocks each scan holds one of them and gives the intervals of
    the texts that have any; these few rows are joined back by the digest of the text and cut together.
    """
    spark = documents.sparkSession
    sets = [spark.sparkContext.broadcast(b) for b in _blocks(items, item_id, item_text, n)]
    if len(sets) <= 1:

        @F.pandas_udf("text string, n_removed int")
        def cut(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in parts:
                rows = []
                for t in texts:
                    spans = [s for b in sets for v in b.value.hits(t).values() for s in v] if t else []
                    new = _cut(t, spans) if spans else t
                    rows.append((new, len(t) - len(new) if t else 0))
                yield pd.DataFrame(rows, columns=["text", "n_removed"])

        cleaned = documents.withColumn("_cut", cut(F.col(text)))
        return cleaned.withColumn(text, F.col("_cut.text")).withColumn("n_removed", F.col("_cut.n_removed")).drop("_cut")

    def spans_of(block) -> DataFrame:
        @F.pandas_udf("array<struct<a int, b int>>")
        def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield pd.Series([[{"a": a, "b": b} for v in block.value.hits(t).values() for a, b in v] for t in texts])

        found = documents.where(F.col(text).isNotNull()).select(F.md5(text).alias("_digest"), find(F.col(text)).alias("_spans"))
        return found.where(F.size("_spans") > 0)

    every = reduce(DataFrame.unionByName, map(spans_of, sets))
    every = every.groupBy("_digest").agg(F.array_distinct(F.flatten(F.collect_list("_spans"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut_found(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _cut(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(texts, spans)])

    joined = documents.withColumn("_digest", F.md5(text)).join(every, "_digest", "left").withColumn("_new", cut_found(F.col(text), F.col("_spans")))
    removed = F.coalesce(F.char_length(text) - F.char_length("_new"), F.lit(0)).cast("int")
    return joined.select(*[F.col(c) for c in documents.columns if c != "n_removed"], removed.alias("n_removed"), "_new").withColumn(text, F.col("_new")).drop("_new").select(
        *[c for c in documents.columns if c != "n_removed"], "n_removed"
    )


