"""Traversals as loops of frontier joins, for many starts at once.

Each round joins the frontier with the edges, removes what was seen, and writes the new
frontier; the lineage is the scan of the written tables.  A round costs one shuffle of the frontier
by node, the edges being read again from their table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.sources.scratch import Scratch

#: Rounds that clear a graph of most dead ends before its cycles are searched.
PEEL_ROUNDS = 3


def reach(pairs: DataFrame, starts: DataFrame, max_depth: int, scratch: Scratch) -> DataFrame:
    """(start, node, depth) of the nodes within ``max_depth`` hops of each start, the start itself left out.

    ``pairs`` are (src, dst), ``starts`` (start).  Depth is the least number of hops.
    """
    pairs = scratch.save(pairs.select("src", "dst").distinct())
    frontier = scratch.save(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    seen = [frontier]
    for depth in range(1, max_depth + 1):
        step = frontier.join(pairs, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = step.join(reduce(DataFrame.unionByName, seen).select("start", "node"), ["start", "node"], "left_anti")
        frontier = scratch.save(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return reduce(DataFrame.unionByName, seen).where("depth > 0")


def shortest_paths(pairs: DataFrame, wanted: DataFrame, max_depth: int, scratch: Scratch, separator: str = " > ") -> DataFrame:
    """(source, target, hops, path) of the shortest path of each wanted pair, the least path text among equals.

    Equal ends give 0 hops; a pair without a path within ``max_depth`` gives no row.
    """
    pairs = scratch.save(pairs.select("src", "dst").distinct())
    wanted = wanted.select("source", "target").distinct()
    frontier = scratch.save(wanted.select("source", "target", F.col("source").alias("node"), F.col("source").alias("path")))
    found = [frontier.where("node = target").select("source", "target", F.lit(0).alias("hops"), "path")]
    seen = [frontier.select("source", "target", "node")]
    for hops in range(1, max_depth + 1):
        going = frontier.where("node <> target")
        step = going.join(pairs, F.col("node") == F.col("src")).groupBy("source", "target", F.col("dst").alias("node")).agg(
            F.min(F.concat("path", F.lit(separator), "dst")).alias("path")
        )
        done = reduce(DataFrame.unionByName, found).select("source", "target")
        step = step.join(reduce(DataFrame.unionByName, seen), ["source", "target", "node"], "left_anti").join(done, ["source", "target"], "left_anti")
        frontier = scratch.save(step)
        if frontier.isEmpty():
            break
        found.append(frontier.where("node = target").select("source", "target", F.lit(hops).alias("hops"), "path"))
        seen.append(frontier.select("source", "target", "node"))
    return reduce(DataFrame.unionByName, found)


def cycles(pairs: DataFrame, max_length: int, scratch: Scratch, separator: str = " > ") -> DataFrame:
    """(length, path) of the simple cycles of 2 to ``max_length`` edges, each once, from its least node on.

    Some rounds peel off edges that cannot lie on a cycle first, so that few walks pass through a hub that leads nowhere.
    A path only grows over nodes greater than its first, so that no rotation is made twice.
    """
    pairs = pairs.where("src <> dst").select("src", "dst").distinct()
    inner = scratch.save(cyclic_nodes(pairs, scratch, PEEL_ROUNDS))
    pairs = scratch.save(
        pairs.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    )
    walks = scratch.save(pairs.where("src < dst").select(F.array("src", "dst").alias("walk")))
    found = []
    for length in range(2, max_length + 1):
        step = walks.join(pairs, F.element_at("walk", -1) == F.col("src"))
        closed = step.where(F.element_at("walk", 1) == F.col("dst")).select(F.lit(length).alias("length"), F.array_join("walk", separator).alias("path"))
        found.append(scratch.save(closed))
        if length == max_length:
            break
        grown = step.where((F.col("dst") > F.element_at("walk", 1)) & ~F.array_contains("walk", F.col("dst")))
        walks = scratch.save(grown.select(F.array_append("walk", F.col("dst")).alias("walk")))
        if walks.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def cyclic_nodes(pairs: DataFrame, scratch: Scratch, rounds: int | None = None) -> DataFrame:
    """(node) of what remains when nodes without incoming or without outgoing edges are peeled off again and again.

    Empty exactly if the graph has no cycle; otherwise the nodes on cycles and on paths between cycles.  After
    ``rounds`` rounds, where given, some others may be left.
    """
    left = scratch.save(pairs.select("src", "dst").distinct())
    before = left.count()
    done = 0
    while before and done != rounds:
        done += 1
        heads = left.select(F.col("dst").alias("src")).distinct()
        tails = left.select(F.col("src").alias("dst")).distinct()
        new = scratch.save(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        after = new.count()
        scratch.drop(left)
        left = new
        if after == before:
            break
        before = after
    return left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def longest_chain(pairs: DataFrame, max_hops: int, scratch: Scratch, separator: str = " > ") -> DataFrame:
    """(hops, path): the longest walk of at most ``max_hops`` from a node without incoming edges, the least text among equals.

    Level k holds the nodes that end a walk of exactly k hops, each with its least path; in a graph without
    cycles the last level that is not empty holds the longest chains.
    """
    pairs = scratch.save(pairs.where("src <> dst").select("src", "dst").distinct())
    roots = pairs.select(F.col("src").alias("node")).distinct().join(pairs.select(F.col("dst").alias("node")), "node", "left_anti")
    level = scratch.save(roots.select("node", F.col("node").alias("path")))
    hops = 0
    while hops < max_hops:
        nxt = scratch.save(
            level.join(pairs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(
                F.min(F.concat("path", F.lit(separator), "dst")).alias("path")
            )
        )
        if nxt.isEmpty():
            break
        level, hops = nxt, hops + 1
    return level.agg(F.min("path").alias("path")).select(F.lit(hops).alias("hops"), "path")


def trails(edges: DataFrame, hops: int, scratch: Scratch) -> DataFrame:
    """(start, node, hops): what undirected trails of up to ``hops`` edges reach; edges are not repeated, nodes may be.

    So the start is among its own nodes where a closed trail leads back to it.  ``edges`` are (source_id, target_id,
    edge_type); hops is the least number.
    """
    named = edges.select("source_id", "target_id", "edge_type").distinct().withColumn("edge", F.xxhash64("source_id", "target_id", "edge_type"))
    out = named.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "edge")
    back = named.where("source_id <> target_id").select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), "edge")
    steps = scratch.save(out.unionByName(back))
    walks = scratch.save(steps.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("edge").alias("used")))
    found = [walks.select("start", "node", F.lit(1).alias("hops"))]
    for n in range(2, hops + 1):
        grown = walks.join(steps, F.col("node") == F.col("src")).where(~F.array_contains("used", F.col("edge")))
        grown = grown.select("start", F.col("dst").alias("node"), F.array_sort(F.array_append("used", F.col("edge"))).alias("used")).distinct()
        walks = scratch.save(grown)
        found.append(walks.select("start", "node", F.lit(n).alias("hops")))
    return reduce(DataFrame.unionByName, found).groupBy("start", "node").agg(F.min("hops").alias("hops"))
