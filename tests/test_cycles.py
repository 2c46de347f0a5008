"""Long cycles, and cycles over edges of several types."""

from codestrata.plans import registry


def _edges(spark, tmp_path, edges):
    rows = [(a, b, kind, "r") for a, b, kind in edges]
    spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, repository_id string").write.parquet(str(tmp_path / "graph_edges.parquet"))
    return str(tmp_path)


def test_cycles_of_five_and_six_calls(spark, tmp_path):
    rings = ["abcde", "fghijk", "lmnopqr"]
    d = _edges(spark, tmp_path, [(x, y, "CALLS") for r in rings for x, y in zip(r, r[1:] + r[0])])
    got = {(r["length"], r["path"]) for r in registry.queries()["cycles_calls_6"](spark, d).collect()}
    assert got == {(5, "a > b > c > d > e"), (6, "f > g > h > i > j > k")}


def test_a_cycle_of_mixed_edges_is_seen(spark, tmp_path):
    d = _edges(spark, tmp_path, [("a", "b", "CALLS"), ("b", "c", "INHERITS"), ("c", "a", "IMPORTS"), ("c", "d", "CALLS"), ("d", "a", "DEFINES")])
    got = {r["edge_type"]: r["n_left"] for r in registry.queries()["has_cycle"](spark, d).collect()}
    assert got == {"CALLS": 0, "DEFINES": 0, "INHERITS": 0, "DEPENDENCIES": 3}
