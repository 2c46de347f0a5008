"""Questions about a stored graph: neighbours, subgraphs, unused and orphaned symbols, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges if not types else edges.where(F.col("edge_type").isin(types))


def directed(edges: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(src, dst) pairs, once: outgoing, incoming or both."""
    out = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"outgoing": out, "incoming": back}.get(direction, out.unionByName(back)).distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(node_id, neighbour_id, edge_type, direction) with neighbours that are nodes of the same repository."""
    rows = of_types(edges, types).select("source_id", "target_id", "edge_type").distinct()
    parts = []
    if direction in ("outgoing", "both"):
        parts.append(rows.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id"), "edge_type", F.lit("outgoing").alias("direction")))
    if direction in ("incoming", "both"):
        parts.append(rows.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour_id"), "edge_type", F.lit("incoming").alias("direction")))
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    a = nodes.select("node_id", F.col("repository_id").alias("_a"))
    b = nodes.select(F.col("node_id").alias("neighbour_id"), F.col("repository_id").alias("_b"))
    return pairs.join(a, "node_id").join(b, "neighbour_id").where("_a = _b").select("node_id", "neighbour_id", "edge_type", "direction")


def subgraph(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Edges of some types whose ends are both nodes, each once."""
    rows = of_types(edges, types).select("source_id", "target_id", "edge_type").distinct()
    return induced(rows, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi"
    )


def unused_functions(nodes: DataFrame, edges: DataFrame, literal: bool = False) -> DataFrame:
    """Functions and methods that nothing calls.  ``literal`` tests methods only and returns every function."""
    called = edges.where("edge_type = 'CALLS'").select(F.col("target_id").alias("node_id")).distinct()
    f = nodes.where("node_type = 'Function'")
    m = nodes.where("node_type = 'Method'").join(called, "node_id", "left_anti")
    return (f if literal else f.join(called, "node_id", "left_anti")).unionByName(m)


def orphan_classes(nodes: DataFrame, edges: DataFrame, ignore_structure: bool = False) -> DataFrame:
    """Classes without any edge; ``ignore_structure`` sets CONTAINS and BELONGS_TO aside."""
    rows = edges.where("edge_type not in ('CONTAINS', 'BELONGS_TO')") if ignore_structure else edges
    touched = rows.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return nodes.where("node_type = 'Class'").join(touched, "node_id", "left_anti")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: nodes, and edges that leave its nodes."""
    n = nodes.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.join(nodes.select(F.col("node_id").alias("source_id"), F.col("repository_id").alias("_r")), "source_id").groupBy(
        F.col("_r").alias("repository_id")
    ).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "repository_id", "left").select("repository_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
