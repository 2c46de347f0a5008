"""Graph building, questions and traversals on small graphs."""

import random

import pytest

from codestrata.operators import graph_build as B
from codestrata.operators import graph_query as G
from codestrata.operators import traverse as T
from codestrata.sources.scratch import Scratch

DIAMOND = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")]


def _pairs(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def _starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


def test_reach_on_the_diamond(spark):
    got = {r["node"]: r["depth"] for r in T.reach(_pairs(spark, DIAMOND), _starts(spark, "A"), 10, Scratch(spark, "t")).collect()}
    assert got == {"B": 1, "C": 1, "D": 2, "E": 3}
    near = T.reach(_pairs(spark, DIAMOND), _starts(spark, "A", "E", "gone"), 1, Scratch(spark, "t")).collect()
    assert sorted((r["start"], r["node"]) for r in near) == [("A", "B"), ("A", "C")]


def test_shortest_paths(spark):
    wanted = spark.createDataFrame([("A", "E"), ("A", "A"), ("E", "A"), ("A", "gone")], "source string, target string")
    got = {(r["source"], r["target"]): (r["hops"], r["path"]) for r in T.shortest_paths(_pairs(spark, DIAMOND), wanted, 10, Scratch(spark, "t")).collect()}
    assert got == {("A", "E"): (3, "A > B > D > E"), ("A", "A"): (0, "A")}
    both = DIAMOND + [(b, a) for a, b in DIAMOND]
    got = T.shortest_paths(_pairs(spark, both), wanted.where("source = 'E'"), 10, Scratch(spark, "t")).first()
    assert (got["hops"], got["path"]) == (3, "E > D > B > A")


@pytest.mark.parametrize("seed", range(2))
def test_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(22)})
    want = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0] and len(path) > 1:
                    want.add((len(path), " > ".join(path)))
                elif len(path) < 5 and b > path[0] and b not in path:
                    walk([*path, b])

    for n in {a for a, _ in edges}:
        walk([n])
    got = {(r["length"], r["path"]) for r in T.cycles(_pairs(spark, edges), 5, Scratch(spark, "t")).collect()}
    assert got == want


def test_peeling_and_chains(spark):
    assert T.cyclic_nodes(_pairs(spark, DIAMOND), Scratch(spark, "t")).count() == 0
    left = T.cyclic_nodes(_pairs(spark, [*DIAMOND, ("E", "D"), ("x", "x")]), Scratch(spark, "t"))
    assert {r["node"] for r in left.collect()} == {"D", "E", "x"}
    row = T.longest_chain(_pairs(spark, [*DIAMOND, ("q", "D")]), 20, Scratch(spark, "t")).first()
    assert (row["hops"], row["path"]) == (3, "A > B > D > E")


def test_empty_graphs(spark):
    none = _pairs(spark, [])
    assert T.reach(none, _starts(spark, "A"), 3, Scratch(spark, "t")).count() == 0
    assert T.cycles(none, 4, Scratch(spark, "t")).count() == 0
    assert T.cyclic_nodes(none, Scratch(spark, "t")).count() == 0


ENTRY = "id string, repository_id string, qualified_name string"


def test_call_resolution(spark):
    entries = spark.createDataFrame([("1", "r", "a"), ("2", "r", "b"), ("3", "r", "o.c"), ("9", "s", "b"), ("4", "r", "b")], ENTRY)
    calls = [("r", "a", "b", None), ("r", "a", "c", "o"), ("r", "a", "c", ""), ("r", "zz", "b", None), ("r", None, "b", None), ("r", "a", "", None), ("r", "a", "b", None)]
    df = spark.createDataFrame(calls, "repository_id string, caller_name string, callee_name string, callee_object string")
    assert sorted((r["source_id"], r["target_id"]) for r in B.call_edges(df, entries).collect()) == [("1", "2"), ("1", "3")]


def test_import_resolution(spark):
    entries = spark.createDataFrame([("1", "r", "util.text")], ENTRY)
    rows = [("r", "x.py", "util.text", False), ("r", "x.py", "..util.text", True), ("r", "x.py", "numpy.linalg", False), ("r", "x.py", "example.org/team/tool", False), ("r", "x.py", "util", False), ("r", "x.py", "./local", False)]
    imports = spark.createDataFrame(rows, "repository_id string, relative_path string, module_path string, is_relative boolean")
    libs = B.library_nodes(B.external_imports(imports, entries))
    assert {r["name"] for r in libs.collect()} == {"numpy", "tool"}
    got = sorted((r["edge_type"], r["target_id"]) for r in B.import_edges(imports, entries, libs).collect())
    assert got == [("IMPORTS", "1"), ("IMPORTS", "1"), ("USES_LIBRARY", "lib:r:numpy"), ("USES_LIBRARY", "lib:r:tool")]


def test_classes_and_routes(spark):
    entries = spark.createDataFrame([("1", "r", "K"), ("2", "r", "L"), ("3", "r", "K.M"), ("4", "r", "show")], ENTRY)
    classes = spark.createDataFrame([("r", "K", ["L", "M", "gone", ""], ["L"]), ("r", "Z", ["L"], [])], "repository_id string, qualified_name string, base_classes array<string>, interfaces array<string>")
    assert sorted((r[0], r[1]) for r in B.inheritance_edges(classes, entries).collect()) == [("1", "2"), ("1", "3")]
    assert [(r[0], r[1]) for r in B.implements_edges(classes, entries).collect()] == [("1", "2")]
    routes = spark.createDataFrame([("r", "a.py", "get", "/x/y", "show"), ("r", "a.py", "POST", "/", None)], "repository_id string, relative_path string, http_method string, path string, handler_name string")
    got = sorted((r["edge_type"], r["source_id"], r["target_id"]) for r in B.route_edges(routes, entries).collect())
    assert got == [("CALLS", "route:r:GET.|x|y", "4"), ("EXPOSES_ROUTE", "file:r:a.py", "route:r:GET.|x|y"), ("EXPOSES_ROUTE", "file:r:a.py", "route:r:POST.|")]


def test_validation_and_questions(spark):
    nodes = spark.createDataFrame(
        [("f", "Function", "r", "f", "f", "", ""), ("g", "Method", "r", "g", "g", "", ""), ("c", "Class", "r", "c", "c", "", ""), ("d", "Class", "r", "d", "d", "", ""), (" ", "File", "r", "x", "x", "", ""), ("n", "File", "r", "", "x", "", "")],
        "node_id string, node_type string, repository_id string, name string, qualified_name string, language string, file_path string",
    )
    assert {r["node_id"] for r in B.valid_nodes(nodes).collect()} == {"f", "g", "c", "d"}
    edges = spark.createDataFrame(
        [("f", "g", "CALLS", "r"), ("f", "f", "CALLS", "r"), ("c", "c", "CONTAINS", "r"), ("f", "gone", "CALLS", "r"), ("c", "g", "CONTAINS", "r")],
        "source_id string, target_id string, edge_type string, repository_id string",
    )
    kept = B.valid_edges(edges, nodes)
    assert sorted((r["source_id"], r["target_id"]) for r in kept.collect()) == [("c", "g"), ("f", "f"), ("f", "g")]
    assert [r["node_id"] for r in G.unused_functions(nodes, edges.where("source_id <> target_id")).collect()] == ["f"]
    assert {r["node_id"] for r in G.unused_functions(nodes, edges, literal=True).collect()} == {"f"}
    assert {r["node_id"] for r in G.orphan_classes(nodes, edges).collect()} == {"d"}
    assert {r["node_id"] for r in G.orphan_classes(nodes, edges, ignore_structure=True).collect()} == {"c", "d"}
    assert sorted((r["node_id"], r["neighbour_id"], r["direction"]) for r in G.neighbours(kept, nodes, "both", ["CONTAINS"]).collect()) == [("c", "g", "outgoing"), ("g", "c", "incoming")]
