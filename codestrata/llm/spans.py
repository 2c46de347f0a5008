"""Long exact spans that records share.

1. Winnowing: every window of ``min_chars`` characters has one anchor, the smallest hashed
   k-gram in it.  Two texts that share a run of ``min_chars`` characters have the same anchor
   at the same place of that run.  Only anchors of two different texts go on.
2. Around these anchors the text that a shared window can cover is cut out and sent to a
   shard chosen by the anchor, so that a shard holds everything that can match.
3. Each shard builds an FM-index of its pieces (wavelet matrix over the BWT) and streams the
   pieces through it.  Backward search extends the anchor to the left; whenever the interval
   loses members, the window that starts there is searched as a whole.  That finds every
   piece that shares any window of ``min_chars`` characters with the streamed one: a piece that
   agrees with it on l characters left of the anchor leaves the interval right after l, and
   its shared window, if there is one, starts at l.
4. Windows come out as groups (group, text); the pairs are made from the groups.

Copies of a whole text are one text until the very end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.fmindex import FMIndex, code_points
from codestrata.sources.scratch import Scratch

MIN_CHARS = 400
GRAM = 64
#: Pieces per index shard; the distinct pieces of an anchor with more are cut into blocks, any two of which make a shard.
SHARD_PIECES = 2500
#: Characters that the winnowing step holds at once.
_CHUNK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` symbols (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        base, size = np.uint64(0xD6E8FEB86659FD93), 1
        while size < gram:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def anchors(x: np.ndarray, spans: list[tuple[int, int]], min_chars: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of the texts ``x[a:b]``; windows never cross a text's end."""
    h = _gram_hashes(x, gram)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = min_chars - gram + 1
    low, size = key, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        rest = width - size
        low = np.minimum(low[:-rest], low[rest:])
    starts = [np.arange(a, b - min_chars + 1) for a, b in spans if b - a >= min_chars]
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.unique((low[np.concatenate(starts)] & _PLACE).astype(np.int64))
    return at, h[at]


def _anchor_rows(parts: Iterator[pd.DataFrame], min_chars: int, gram: int) -> Iterator[pd.DataFrame]:
    def flush(pieces):
        spans, at = [], 0
        for _, _, _, t in pieces:
            spans.append((at, at + len(t)))
            at += len(t)
        x = np.concatenate([t for _, _, _, t in pieces])
        if len(x) < min_chars:
            return None
        pos, h = anchors(x, spans, min_chars, gram)
        which = np.searchsorted([a for a, _ in spans], pos, side="right") - 1
        shift = np.array([off - a for (_, _, off, _), (a, _) in zip(pieces, spans)], dtype=np.int64)
        return pd.DataFrame(
            {
                "anchor": h.view(np.int64), "digest": [pieces[i][1] for i in which],
                "pos": (pos + shift[which]).astype(np.int64), "doc_id": [pieces[i][0] for i in which],
            }
        )

    for pdf in parts:
        pieces, size = [], 0
        for d, g, t in zip(pdf["doc_id"], pdf["digest"], pdf["text"]):
            x = code_points(t)
            # a long text goes through in overlapping stretches, so that each window lies in one
            for off in range(0, max(1, len(x) - min_chars + 1), _CHUNK):
                piece = x[off : off + _CHUNK + min_chars - 1]
                if size and size + len(piece) > 2 * _CHUNK:
                    yield flush(pieces)
                    pieces, size = [], 0
                pieces.append((d, g, off, piece))
                size += len(piece)
        if pieces:
            out = flush(pieces)
            if out is not None:
                yield out


def _search_shard(pdf: pd.DataFrame, min_chars: int, gram: int) -> pd.DataFrame:
    """Groups and covered intervals of one shard; see :func:`shared_windows` for the columns."""
    rep, offset = pdf["rep"].to_numpy(), pdf["offset"].to_numpy()
    origin = pdf["pos"].to_numpy() - offset
    pieces = list(dict.fromkeys(pdf["piece"]))
    number = {t: i for i, t in enumerate(pieces)}
    piece_of = np.array([number[t] for t in pdf["piece"]], dtype=np.int64)
    # the indexed pieces come first, so that a text of the index has the number of its piece
    indexed = np.zeros(len(pieces), dtype=bool)
    indexed[piece_of[pdf["indexed"].to_numpy(dtype=bool)]] = True
    order = np.argsort(~indexed, kind="stable")
    pieces = [pieces[i] for i in order]
    renumber = np.empty(len(order), dtype=np.int64)
    renumber[order] = np.arange(len(order))
    piece_of, n_indexed = renumber[piece_of], int(indexed.sum())
    columns = ["group", "rep", "span_from", "span_to"]
    if not n_indexed:
        return pd.DataFrame(columns=columns)
    index = FMIndex(pieces[:n_indexed], 2 * min_chars)
    owner = index.owner(index.suffixes)
    symbols, starts = index.encode(pieces)
    holders: dict[int, set[int]] = {}
    for n, r in zip(piece_of.tolist(), rep.tolist()):
        holders.setdefault(n, set()).add(r)

    # streamed: every distinct piece at every place its anchor has in it
    asks, ask_of = np.unique(np.stack([piece_of, offset.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    ask_of = ask_of.reshape(-1)
    number, off = asks[:, 0], asks[:, 1]
    size = np.array([len(t) for t in pieces], dtype=np.int64)[number]
    # an indexed piece of one text always finds itself, which is no match yet
    alone = np.array([len(holders[n]) == 1 for n in range(len(pieces))])
    least = np.where((number < n_indexed) & alone[number], 1, 0)
    lo, hi = index.search(symbols, starts[number] + off, gram)
    live = np.flatnonzero(hi - lo > least)
    lo, hi = lo[live], hi[live]
    windows: set[tuple[int, int]] = set()

    def keep_windows(which: np.ndarray, left: int) -> None:
        fits = off[which] - left + min_chars <= size[which]
        windows.update((int(i), int(off[i]) - left) for i in which[fits])

    left = 0
    while len(live):
        ended = (off[live] == left) | (left == min_chars - gram)
        keep_windows(live[ended], left)
        live, lo, hi = live[~ended], lo[~ended], hi[~ended]
        if not len(live):
            break
        nlo, nhi = index.extend(lo, hi, symbols[starts[number[live]] + off[live] - left - 1])
        keep_windows(live[(nhi - nlo) < (hi - lo)], left)
        more = (nhi - nlo) > least[live]
        live, lo, hi = live[more], nlo[more], nhi[more]
        left += 1

    # equal windows are searched once
    askers: dict[str, list[tuple[int, int]]] = {}
    for i, start in sorted(windows):
        askers.setdefault(pieces[int(number[i])][start : start + min_chars], []).append((i, start))
    if not askers:
        return pd.DataFrame(columns=columns)
    refs = list(askers.values())
    lo, hi = index.search(symbols, np.array([starts[number[r[0][0]]] + r[0][1] for r in refs], dtype=np.int64), min_chars)
    by_ask: dict[int, list[int]] = {}
    for row, ask in enumerate(ask_of.tolist()):
        by_ask.setdefault(ask, []).append(row)
    rows: list[tuple[bytes, int, int, int]] = []
    seen: set[bytes] = set()
    for ref, a, b in zip(refs, lo.tolist(), hi.tolist()):
        names = {m for t in np.unique(owner[a:b]).tolist() for m in holders[t]}
        for i, _ in ref:
            names |= holders[int(number[i])]
        if len(names) < 2:
            continue
        members = sorted(names)
        group = _set_identity(members)
        if group not in seen:
            seen.add(group)
            rows.extend((group, m, -1, -1) for m in members)
        for i, start in ref:
            own = int(number[i])
            at = int(starts[own]) + start
            end = start + min_chars
            tail = symbols[at + min_chars : int(starts[own]) + int(size[i])]
            # a piece of several texts is shared as a whole
            end += len(tail) if len(holders[own]) > 1 else _continuation(index, owner, tail, holders, own, a, b, min_chars)
            rows.extend((group, int(rep[o]), int(origin[o]) + start, int(origin[o]) + end) for o in by_ask[i])
    return pd.DataFrame(rows, columns=columns)


def _search_blocks(pdf: pd.DataFrame, min_chars: int, gram: int) -> pd.DataFrame:
    """:func:`_search_shard` over collapsed pieces (shard, key, rep_a, rep_b, offset, piece): (group, key, span_from, span_to) with spans within the piece.

    Two names stand for the texts of a piece that several texts have; one text has one name in all of its pieces.
    """
    names: dict[object, int] = {}
    keys = pdf["key"].tolist()
    rows, key_of = [], {}
    for i, (key, a, b, offset, piece) in enumerate(zip(keys, pdf["rep_a"], pdf["rep_b"], pdf["offset"], pdf["piece"])):
        for holder in [a] if a == b else [(key, 0), (key, 1)]:
            name = names.setdefault(holder, len(names))
            key_of.setdefault(name, key)
            rows.append((name, (i << 32) + int(offset), int(offset), piece, True))  # the row number comes back in the span
    found = _search_shard(pd.DataFrame(rows, columns=["rep", "pos", "offset", "piece", "indexed"]), min_chars, gram)
    shard = str(pdf["shard"].iloc[0]).encode()
    out = {
        (hashlib.blake2b(bytes(g) + shard, digest_size=16).digest(), key_of[r] if f < 0 else keys[f >> 32], f if f < 0 else f & 0xFFFFFFFF, t if f < 0 else t & 0xFFFFFFFF)
        for g, r, f, t in zip(found["group"], found["rep"].tolist(), found["span_from"].tolist(), found["span_to"].tolist())
    }
    return pd.DataFrame(sorted(out), columns=["group", "key", "span_from", "span_to"])


def _set_identity(names: list[int]) -> bytes:
    return hashlib.blake2b(np.array(names, dtype=np.int64).tobytes(), digest_size=16).digest()


def _continuation(
    index: FMIndex, owner: np.ndarray, tail: np.ndarray, holders: dict[int, set[int]], own: int, lo: int, hi: int, skip: int
) -> int:
    """How much of ``tail`` follows the window in some piece that another text holds.

    The suffixes of the interval are in order, so the longest common beginning is with a
    neighbour of the place where ``tail`` belongs; pieces of the own text alone are passed over.
    """
    mine = holders[own]
    a, b = lo, hi
    while a < b:
        m = (a + b) // 2
        _, less = _compare(index.symbols, int(index.suffixes[m]) + skip, tail)
        if less:
            a = m + 1
        else:
            b = m
    best = 0
    for step, at in ((-1, a - 1), (1, a)):
        while lo <= at < hi and holders[int(owner[at])] == mine:
            at += step
        if lo <= at < hi:
            best = max(best, _compare(index.symbols, int(index.suffixes[at]) + skip, tail)[0])
    return best


def _compare(x: np.ndarray, at: int, tail: np.ndarray) -> tuple[int, bool]:
    """(length of the common beginning of ``x[at:]`` and ``tail``, whether ``x[at:]`` comes first)."""
    u = x[at : at + len(tail)]
    bad = np.flatnonzero(u != tail[: len(u)])
    if len(bad):
        k = int(bad[0])
        return k, bool(u[k] < tail[k])
    return len(u), len(u) < len(tail)


def shared_windows(
    documents: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """(windows, classes).

    classes: (doc_id, rep, n_chars), the smallest id with exactly the same text.  windows: (group, rep,
    span_from, span_to); rows with span_from -1 name the members of a group, others an interval
    of the rep's text that is found in another text.  ``doc_id`` is a unique number.  Texts that are
    null or shorter than ``min_chars`` take no part.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(
        F.char_length("text") >= min_chars
    )
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))
    same = docs.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = docs.select("doc_id", "digest", F.char_length("text").alias("n_chars")).join(same, "digest").select(
        "doc_id", "rep", "n_chars"
    )
    found = docs.mapInPandas(
        lambda parts: _anchor_rows(parts, min_chars, gram), "anchor bigint, digest binary, pos bigint, doc_id bigint"
    )
    # one row per anchor of a distinct text, named by the smallest doc_id that has the text
    places = scratch.save(found.groupBy("anchor", "digest", "pos").agg(F.min("doc_id").alias("rep")))
    several = (
        places.groupBy("anchor")
        .agg(F.min("digest").alias("_a"), F.max("digest").alias("_b"), F.count(F.lit(1)).alias("n_pieces"))
        .where("_a <> _b")
        .select("anchor", "n_pieces")
    )
    shared = scratch.save(places.select("anchor", "rep", "pos").join(several, "anchor"))
    reach = min_chars - gram
    start = F.greatest(F.lit(0), F.col("pos") - reach)
    # written once: the usual and the hot anchors both read it, and the texts are shuffled once
    pieces = scratch.save(shared.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep").select(
        "anchor", "rep", "pos", "n_pieces", (F.col("pos") - start).cast("int").alias("offset"),
        F.substring("text", (start + 1).cast("int"), (F.col("pos") - start + min_chars).cast("int")).alias("piece"),
    ))
    hot = F.col("n_pieces") > SHARD_PIECES
    total = shared.where(~hot).count()
    shards = max(1, math.ceil(total / SHARD_PIECES))
    usual = pieces.where(~hot).select("rep", "pos", "offset", "piece", F.lit(True).alias("indexed"), F.pmod("anchor", F.lit(shards)).alias("shard"))
    # as many tasks as shards: merged by their bytes, a few tasks would search most of them
    tasks = max(1, min(shards, spread_over(documents) * 4))
    windows = usual.repartition(tasks, "shard").groupBy("shard").applyInPandas(
        lambda pdf: _search_shard(pdf, min_chars, gram), "group binary, rep bigint, span_from bigint, span_to bigint"
    )
    if not shared.where(hot).isEmpty():
        windows = windows.unionByName(_hot_windows(pieces.where(hot), scratch, min_chars, gram))
    return scratch.save(windows), classes


def _hot_windows(pieces: DataFrame, scratch: Scratch, min_chars: int, gram: int) -> DataFrame:
    """(group, rep, span_from, span_to) of the pieces of anchors that more texts have than a shard holds.

    Equal pieces become one.  What is left of an anchor is cut into blocks of half a shard, and every two blocks
    make a group of their own, so that any two pieces meet in a group of bounded size.
    """
    keyed = pieces.withColumn("key", F.unhex(F.md5(F.concat_ws(":", "anchor", "offset", "piece"))))
    places = scratch.save(keyed.select("key", "rep", (F.col("pos") - F.col("offset")).alias("origin")))
    one = scratch.save(
        keyed.groupBy("anchor", "key", "offset").agg(F.min("rep").alias("rep_a"), F.max("rep").alias("rep_b"), F.first("piece").alias("piece"))
    )
    sizes = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.lit(2), F.ceil(F.col("n") * 2 / SHARD_PIECES).cast("int"))
    spread = one.join(sizes, "anchor").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))))
    spread = spread.select(
        "key", "rep_a", "rep_b", "offset", "piece",
        F.concat_ws(":", "anchor", F.least("own", "other"), F.greatest("own", "other")).alias("shard"),
    )
    found = spread.repartition(spread_over(pieces) * 4, "shard").groupBy("shard").applyInPandas(
        lambda pdf: _search_blocks(pdf, min_chars, gram), "group binary, key binary, span_from bigint, span_to bigint"
    )
    here = F.when(F.col("span_from") < 0, F.lit(0)).otherwise(F.col("origin"))
    return found.join(places, "key").select(
        "group", "rep", (F.col("span_from") + here).alias("span_from"), (F.col("span_to") + here).alias("span_to")
    ).distinct()


def spread_over(df: DataFrame) -> int:
    """Tasks of a shuffle, as the session sets them."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def class_pairs(windows: DataFrame) -> DataFrame:
    """(class_a, class_b), a < b: pairs of different texts that share a window, each text named by its smallest doc_id.

    A group is cut into salts by its size before it meets itself, so that no task makes the pairs of a hot group alone.
    """
    return _pairs_in_groups(windows.where("span_from < 0").select("group", F.col("rep").alias("doc_id")).distinct()).withColumnsRenamed(
        {"doc_id_a": "class_a", "doc_id_b": "class_b"}
    )


def class_members(windows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) per document: its text's smallest doc_id, the documents with that text and the other texts that share a window with it."""
    pairs = class_pairs(windows)
    ends = pairs.select(F.col("class_a").alias("rep")).unionByName(pairs.select(F.col("class_b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies")).join(links, "rep", "left")
    return classes.join(sizes, "rep").select("doc_id", F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def shared_pairs(windows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of documents that share a window or their whole text.

    A pair per two documents is the result asked for, copies included; :func:`class_pairs` with
    :func:`class_members` say the same without expanding copies.
    """
    groups = windows.where("span_from < 0").select("group", "rep").distinct()
    members = groups.join(classes.select("rep", "doc_id"), "rep").select("group", "doc_id")
    copies = classes.select(F.unhex(F.md5(F.col("rep").cast("string"))).alias("group"), "doc_id")
    return _pairs_in_groups(members.unionByName(copies))


def _pairs_in_groups(rows: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, distinct, of the members (group, doc_id) of each group."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "group").withColumn("salts", F.ceil(F.col("n") / 500).cast("int"))
    a = rows.select("group", F.col("doc_id").alias("doc_id_a"), F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"))
    b = rows.select(
        "group", F.col("doc_id").alias("doc_id_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    return a.join(b, ["group", "salt"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def shared_coverage(windows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars): how much of each document is found in others.

    Documents that share nothing have 0; a document with copies is shared as a whole.
    """
    spans = windows.where("span_from >= 0").select("rep", "span_from", "span_to").distinct()
    ahead = Window.partitionBy("rep").orderBy("span_from", "span_to").rowsBetween(Window.unboundedPreceding, -1)
    merged = spans.withColumn("seen", F.coalesce(F.max("span_to").over(ahead), F.lit(-1)))
    per_rep = merged.groupBy("rep").agg(
        F.sum(F.greatest(F.lit(0), F.col("span_to") - F.greatest("span_from", "seen"))).alias("covered"),
    )
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    return classes.join(sizes, "rep").join(per_rep, "rep", "left").select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"),
        F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars"),
    )
