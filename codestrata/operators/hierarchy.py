"""Parent-child rows to full hierarchies.

Every node gets its depth, root, path and a nested-set range [left, right]: the
descendants of a node are exactly the nodes of the same root whose ``left`` lies in
its range.  Steps:

1. ``number_nodes`` maps ids to compact longs once; the loops below move longs only.
2. Upward: pointers jump 1, 2, 4, ... ancestors.  ``below`` counts the descendants closer
   than the jump, so the subtree sizes are complete after log2(height) rounds.  A node
   whose pointer runs out is processed; the loop ends in the first round in which none is.
3. Nodes never processed lie on a loop of parents or hang below one.
4. Downward: siblings get consecutive preorder ranges by prefix sums of subtree sizes, and
   the same jumps add the offsets (and names, for the path) along the way to the root.

The number of rounds grows with the logarithm of the depth, not with the depth.  All joins
are equi-joins on node numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.sources.scratch import Scratch

#: Children of one parent that are put in order by one task.
HOT_CHILDREN = 200_000
#: Positions of a nested-set range that one row is spread into at a time.
RANGE_CHUNK = 10_000


@dataclass
class Tree:
    """Numbered nodes and what became of them."""

    nodes: DataFrame  # n, id, name, parent_id, p: the parent's number, null for roots
    processed: DataFrame  # n, depth, root
    sizes: DataFrame  # n, size: descendants including the node; complete for processed nodes
    looped: DataFrame  # n, p of the nodes on or below a loop


def number_nodes(df: DataFrame, id_col: str, parent_col: str, name_col: str, scratch: Scratch) -> DataFrame:
    """(n, id, name, parent_id, p).  Ids must be unique and not null; a parent that is null or unknown gives p null."""
    ids = scratch.save(
        df.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent_id"), F.col(name_col).alias("name"))
        .withColumn("n", F.monotonically_increasing_id())
    )
    up = ids.select(F.col("id").alias("parent_id"), F.col("n").alias("p"))
    # a null parent_id never meets a node; keeping those rows out of the join spares one task from getting all roots
    inner = ids.where(F.col("parent_id").isNotNull()).join(up, "parent_id", "left")
    roots = ids.where(F.col("parent_id").isNull()).withColumn("p", F.lit(None).cast("bigint"))
    cols = ["n", "id", "name", "parent_id", "p"]
    return scratch.save(inner.select(cols).unionByName(roots.select(cols)))


def climb(nodes: DataFrame, scratch: Scratch) -> Tree:
    """Depth, root and subtree size of every node in log2(depth) rounds; the rest is on or below a loop."""
    state = scratch.save(
        nodes.select(
            "n", F.col("p").alias("jump"), F.coalesce("p", "n").alias("top"),
            F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.lit(1).cast("bigint").alias("below"),
        )
    )
    open_nodes = state.where(F.col("jump").isNotNull()).count()
    while open_nodes:
        target = state.select(
            F.col("n").alias("jump"), F.col("jump").alias("_jump"), F.col("top").alias("_top"),
            F.col("dist").alias("_dist"),
        )
        gained = state.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("n")).agg(
            F.sum("below").alias("_gain")
        )
        moving = state.where(F.col("jump").isNotNull()).join(target, "jump").select(
            "n", F.col("_jump").alias("jump"), F.col("_top").alias("top"), (F.col("dist") + F.col("_dist")).alias("dist"),
            "below",
        )
        ended = state.where(F.col("jump").isNull()).select("n", "jump", "top", "dist", "below")
        after = moving.unionByName(ended).join(gained, "n", "left").select(
            "n", "jump", "top", "dist", (F.col("below") + F.coalesce("_gain", F.lit(0))).alias("below")
        )
        new = scratch.save(after)
        left = new.where(F.col("jump").isNotNull()).count()
        scratch.drop(state)
        state = new
        if left == open_nodes:
            break
        open_nodes = left
    done = F.col("jump").isNull()
    looped = nodes.join(state.where(~done).select("n"), "n", "left_semi").select("n", "p")
    return Tree(
        nodes,
        state.where(done).select("n", F.col("dist").alias("depth"), F.col("top").alias("root")),
        state.where(done).select("n", F.col("below").alias("size")),
        looped,
    )


def loop_members(tree: Tree, scratch: Scratch) -> DataFrame:
    """(n, cycle_id, on_loop): each unprocessed node with the smallest id on its loop.

    Every unprocessed node has a parent, and following it long enough ends on the loop.  The
    set reached after 2^k steps shrinks until it is the loops themselves; one round without
    change proves that.  The smallest id spreads by the same jumps until no node changes.
    """
    ids = tree.nodes.select("n", "id")
    state = scratch.save(
        tree.looped.join(ids, "n").select("n", F.col("p").alias("jump"), F.col("id").alias("least"))
    )
    reached = state.select("jump").distinct().count()
    stable = False
    while reached:
        far = state.select(F.col("n").alias("jump"), F.col("jump").alias("_jump"), F.col("least").alias("_least"))
        new = scratch.save(
            state.join(far, "jump").select(
                "n", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least"),
                (F.col("_least") < F.col("least")).alias("changed"),
            )
        )
        now = new.select("jump").distinct().count()
        if stable or now == reached:
            stable = True
            loop = new.select("jump").distinct()
            moved = new.where("changed").join(loop.select(F.col("jump").alias("n")), "n", "left_semi").limit(1).count()
            if not moved:
                state = new.drop("changed")
                break
        reached = now
        scratch.drop(state)
        state = new.drop("changed")
        state._scratch_path = new._scratch_path  # type: ignore[attr-defined]
    loop = state.select("jump").distinct().select(F.col("jump").alias("_n"), F.lit(True).alias("on_loop"))
    least = state.select(F.col("n").alias("jump"), F.col("least").alias("cycle_id"))
    return (
        state.select("n", "jump").join(least, "jump")
        .join(loop, F.col("n") == F.col("_n"), "left")
        .select("n", "cycle_id", F.coalesce("on_loop", F.lit(False)).alias("on_loop"))
    )


def _sibling_offsets(rows: DataFrame, scratch: Scratch, hot_children: int = HOT_CHILDREN) -> DataFrame:
    """(n, p, ..., before): sum of the sizes of the earlier siblings, in order of ``id``.

    The children of parents with more than ``hot_children`` of them are range-partitioned by (p, id) with
    sampled bounds and written, so that the blocks are even whatever the ids look like; blocks are
    summed and ordered, and siblings are ordered inside of a block only.  A parent of a third of
    all nodes is so spread over as many tasks as its children need.
    """
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    hot = rows.groupBy("p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_children)
    hot = scratch.save(hot)
    n_hot = hot.agg(F.sum("_n")).first()[0] or 0
    usual = rows.join(hot, "p", "left_anti") if n_hot else rows
    usual = usual.withColumn("before", summed("size", earlier("p").orderBy("id")))
    if not n_hot:
        return usual
    crowded = rows.join(hot.select("p"), "p", "left_semi").repartitionByRange(1 + math.ceil(n_hot / hot_children), "p", "id")
    crowded = scratch.save(crowded.withColumn("_block", F.spark_partition_id()))
    blocks = crowded.groupBy("p", "_block").agg(F.sum("size").alias("_sum"))
    blocks = blocks.select("p", "_block", summed("_sum", earlier("p").orderBy("_block")).alias("_start"))
    crowded = (
        crowded.withColumn("_in", summed("size", earlier("p", "_block").orderBy("id")))
        .join(blocks, ["p", "_block"])
        .withColumn("before", F.col("_in") + F.col("_start"))
        .drop("_block", "_in", "_start")
    )
    return usual.unionByName(crowded)


def nested_sets(tree: Tree, scratch: Scratch, separator: str = "/", hot_children: int = HOT_CHILDREN) -> DataFrame:
    """(n, depth, root, left, right, path) of the processed nodes.

    ``left`` is the preorder number inside of the root's tree, from 0; ``right`` the last
    number of the subtree.  ``path`` joins the names from the root down; a null name is ''.
    """
    base = tree.processed.join(tree.sizes, "n").join(tree.nodes, "n")
    name = F.coalesce("name", F.lit(""))
    roots = base.where(F.col("p").isNull()).select(
        "n", "depth", "root", "size", F.lit(None).cast("bigint").alias("jump"), F.lit(0).cast("bigint").alias("off"),
        name.alias("path"),
    )
    inner = _sibling_offsets(base.where(F.col("p").isNotNull()), scratch, hot_children).select(
        "n", "depth", "root", "size", F.col("p").alias("jump"), (F.col("before") + 1).cast("bigint").alias("off"),
        name.alias("path"),
    )
    whole = scratch.save(roots.unionByName(inner))
    fixed = whole.select("n", "depth", "root", "size")
    state = whole.select("n", "jump", "off", "path")
    first = True
    while state.where(F.col("jump").isNotNull()).limit(1).count():
        up = state.select(
            F.col("n").alias("jump"), F.col("jump").alias("_jump"), F.col("off").alias("_off"), F.col("path").alias("_path")
        )
        moving = state.where(F.col("jump").isNotNull()).join(up, "jump").select(
            "n", F.col("_jump").alias("jump"), (F.col("off") + F.col("_off")).alias("off"),
            F.concat("_path", F.lit(separator), "path").alias("path"),
        )
        new = scratch.save(moving.unionByName(state.where(F.col("jump").isNull())))
        if not first:
            scratch.drop(state)
        state, first = new, False
    return fixed.join(state, "n").select(
        "n", "depth", "root", F.col("off").alias("left"), (F.col("off") + F.col("size") - 1).alias("right"), "path"
    )


def loops(spark: SparkSession, df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(entry_id, cycle_id, on_loop) of every row on or below a loop of parents.

    ``df`` holds one row per id.  A null id is no node; a node that is its own parent is a loop
    of one; an empty table gives no rows.
    """
    scratch = Scratch(spark, "loops")
    nodes = number_nodes(df.withColumn("_name", F.lit("")), id_col, parent_col, "_name", scratch)
    tree = climb(nodes, scratch)
    return loop_members(tree, scratch).join(nodes, "n").select(F.col("id").alias("entry_id"), "cycle_id", "on_loop")


def hierarchy(
    spark: SparkSession, df: DataFrame, id_col: str, parent_col: str, name_col: str, hot_children: int = HOT_CHILDREN
) -> DataFrame:
    """One row per id: entry_id, parent_id, root_id, depth, left, right, n_descendants, path, cycle_id.

    Rows on or below a loop have a cycle_id, -1 for the numbers and null for root and path.  parent_id is null where the
    parent is not in the table.
    """
    scratch = Scratch(spark, "hierarchy")
    nodes = number_nodes(df, id_col, parent_col, name_col, scratch)
    tree = climb(nodes, scratch)
    sets = nested_sets(tree, scratch, hot_children=hot_children)
    root_ids = nodes.where(F.col("p").isNull()).select(F.col("n").alias("root"), F.col("id").alias("root_id"))
    placed = nodes.join(sets, "n").join(root_ids, "root").select(
        F.col("id").alias("entry_id"), F.when(F.col("p").isNotNull(), F.col("parent_id")).alias("parent_id"), "root_id",
        "depth", "left", "right", (F.col("right") - F.col("left")).alias("n_descendants"), "path",
        F.lit(None).cast("string").alias("cycle_id"),
    )
    stuck = loop_members(tree, scratch).join(nodes, "n").select(
        F.col("id").alias("entry_id"), "parent_id", F.lit(None).cast("string").alias("root_id"),
        *[F.lit(-1).cast("bigint").alias(c) for c in ("depth", "left", "right", "n_descendants")],
        F.lit(None).cast("string").alias("path"), "cycle_id",
    )
    return placed.unionByName(stuck)


def descendants(placed: DataFrame, of: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for the entries named in ``of`` (entry_id), by nested-set ranges.

    Preorder numbers have no gaps, so a range is the list of its positions, each of which is exactly one node of the
    root: the join is on (root, position), makes no candidate that is no result, and no root is a hot key.  A
    long range is spread in chunks that go to different tasks.  Entries on or below loops have no ranges.
    """
    wanted = placed.join(of.select("entry_id").distinct(), "entry_id", "left_semi").where(F.col("n_descendants") > 0)
    start = F.explode(F.sequence(F.col("left") + 1, F.col("right"), F.lit(RANGE_CHUNK).cast("bigint")))
    chunks = wanted.select(
        F.col("entry_id").alias("ancestor_id"), "root_id", F.col("depth").alias("_depth"), start.alias("_from"), "right"
    )
    # only ranges of more than a chunk have to leave their task
    several = chunks.where(F.col("right") - F.col("_from") >= RANGE_CHUNK - 1).repartition("ancestor_id", "_from")
    chunks = chunks.where(F.col("right") - F.col("_from") < RANGE_CHUNK - 1).unionByName(several)
    last = F.least("right", F.col("_from") + RANGE_CHUNK - 1)
    a = chunks.select("ancestor_id", "root_id", "_depth", F.explode(F.sequence("_from", last)).alias("left"))
    d = placed.where(F.col("depth") > 0).select(F.col("entry_id").alias("descendant_id"), "root_id", "left", "depth")
    return a.join(d, ["root_id", "left"]).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("_depth")).alias("distance"))
