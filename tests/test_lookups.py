"""Lookups, deletes, upserts, properties, trails and record tables on small rows."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from codestrata.functions.files import decoded
from codestrata.operators import graph_build as B
from codestrata.operators import lookup as L
from codestrata.operators import traverse as T
from codestrata.sources import records as R
from codestrata.sources.scratch import Scratch, shared_folder
from codestrata.streaming.incremental import stream_reindex_repositories


def test_lookup(spark):
    wanted = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("zz", 4)], "k string, found int")
    rows = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", None), (None, "9")], "key string, id string")
    got = {r["k"]: r["id"] for r in L.lookup(wanted, rows, {"k": "key"}, "id", "id").collect()}
    assert got == {"a": "1", "b": None, None: None, "zz": None}
    assert L.lookup(wanted, rows.limit(0), {"k": "key"}, "id", "id").count() == 4


def test_delete_and_upsert(spark):
    t = spark.createDataFrame([("r1", 1), ("r2", 2), (None, 3)], "repository_id string, x int")
    left = L.delete_repositories({"t": t, "empty": t.limit(0)}, spark.createDataFrame([("r1",), ("r1",), (None,)], "repository_id string"))
    assert sorted(r["x"] for r in left["t"].collect()) == [2, 3] and left["empty"].count() == 0
    at = lambda n: datetime(2024, 1, n)
    old = spark.createDataFrame([("r", "a", "id1", at(1), 5), ("r", None, "id2", at(1), 6)], "repository_id string, path string, id string, created_at timestamp, size int")
    new = spark.createDataFrame([("r", "a", "new1", at(9), 7), ("r", None, "new2", at(9), None), ("r", "b", "new3", at(9), 9)], old.schema)
    got = {(r["path"]): (r["id"], r["created_at"].day, r["size"]) for r in L.upsert_keeping(old, new, ["repository_id", "path"], ["id", "created_at"]).collect()}
    assert got == {"a": ("id1", 1, 7), None: ("id2", 1, None), "b": ("new3", 9, 9)}


def test_routes_become_one_node_each(spark):
    rows = [("r", "GET", "/a", "b.py", 9, "Python", "g"), ("r", "GET", "/a", "a.py", 5, "Python", "f"), ("r", "POST", "/a", "a.py", 7, "Python", None), ("r", None, "/x", "a.py", 1, "Python", None)]
    routes = spark.createDataFrame(rows, "repository_id string, http_method string, path string, relative_path string, start_line int, language string, handler_name string")
    got = {r["node_id"]: (r["name"], r["file_path"], r["node_type"]) for r in B.route_nodes(routes).collect()}
    assert got == {"route:r:GET.|a": ("GET /a", "a.py", "ApiRoute"), "route:r:POST.|a": ("POST /a", "a.py", "ApiRoute")}


def test_properties_merge(spark):
    rows = spark.createDataFrame([("n", "x" * 600, True, 3), ("m", "", False, None)], "id string, documentation string, is_async boolean, start_line int")
    old = B.symbol_properties(rows)
    got = {r["node_id"]: r["properties"] for r in old.collect()}
    assert got == {"n": {"documentation": "x" * 500, "is_async": "true", "start_line": "3"}, "m": {}}
    new = spark.createDataFrame([("n", {"start_line": "8", "visibility": "public"}), ("k", {"a": "b"})], "node_id string, properties map<string,string>")
    got = {r["node_id"]: r["properties"] for r in B.merge_properties(old, new).collect()}
    assert got == {"n": {"documentation": "x" * 500, "is_async": "true", "start_line": "8", "visibility": "public"}, "m": {}, "k": {"a": "b"}}


def test_trails_equal_brute_force(spark):
    rng = random.Random(2)
    edges = list({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", rng.choice("AB")) for _ in range(14)})
    want = {}

    def walk(start, at, used):
        for e in edges:
            if e in used or at not in e[:2]:
                continue
            for a, b in {(e[0], e[1]), (e[1], e[0])}:
                if a == at:
                    want[(start, b)] = min(want.get((start, b), 9), len(used) + 1)
                    if len(used) < 2:
                        walk(start, b, used | {e})

    for n in {x for e in edges for x in e[:2]}:
        walk(n, n, frozenset())
    df = spark.createDataFrame(edges, "source_id string, target_id string, edge_type string")
    assert {(r["start"], r["node"]): r["hops"] for r in T.trails(df, 3, Scratch(spark, "t")).collect()} == want


def test_record_tables(spark):
    root = shared_folder(spark) + "/records"
    f = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3), (None, 4)], "repository_id string, x int")
    R.save_records({"functions": f, "empty": f.limit(0)}, root, 4)
    assert sorted(r["x"] for r in R.read_records(spark, root, "functions").collect()) == [1, 2, 3, 4]
    fresh = spark.createDataFrame([("r2", 20), ("r2", 21), ("r9", 9)], "repository_id string, x int")
    gone = spark.createDataFrame([("r1",), ("r2",), ("r1",)], "repository_id string")
    R.replace_repositories(spark, root, "functions", fresh, gone, 4)
    assert sorted(r["x"] for r in R.read_records(spark, root, "functions").collect()) == [3, 4, 20, 21]
    R.replace_repositories(spark, root, "functions", fresh.limit(0), gone.limit(0), 4)
    assert R.read_records(spark, root, "functions").count() == 4


def test_stream_replaces_the_files_of_touched_repositories(spark, tmp_path):
    schema = "id string, repository_id string, file_id string, qualified_name string, parent_symbol_id string"
    rows = [("1", "r", "f1", "K", None), ("2", "r", "f2", "K.m", "1"), ("3", "s", "f3", "X", None)]
    root = str(tmp_path / "index")
    R.save_records({"entries": spark.createDataFrame(rows, schema)}, root, R.BUCKETS)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"repository_id": "r", "file_id": "f1", "name": "L"}\n')
    stream = spark.readStream.schema("repository_id string, file_id string, name string").json(str(tmp_path / "in"))

    def parse(df):
        return df.selectExpr("'9' as id", "repository_id", "file_id", "name as qualified_name", "cast(null as string) as parent_symbol_id")

    for checkpoint in ("cp1", "cp2"):  # the same batch twice gives the same table
        q = stream_reindex_repositories(stream, root, "entries", str(tmp_path / checkpoint), parse, spark)
        q.awaitTermination(120)
        got = {(r["id"], r["qualified_name"], r["parent_symbol_id"]) for r in R.read_records(spark, root, "entries").collect()}
        assert got == {("9", "L", None), ("2", "K.m", None), ("3", "X", None)}


def test_decoding(spark):
    texts = [b"plain", "é漢".encode(), "caf\xe9".encode("latin-1"), b"", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, b binary")
    got = [r["t"] for r in df.select("i", decoded(F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == ["plain", "é漢", "café", "", None]
