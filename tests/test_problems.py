"""Skewed keys, orphan references and hierarchies against brute force, with nulls, ties and empty tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from codestrata.operators import hierarchy as H
from codestrata.operators.merge import batched_upsert_winners, duplicate_stats, keep_first, latest, numbered, upsert
from codestrata.operators.orphans import bloom_filter, key_filter, orphans
from codestrata.operators.skew import compress, heavy_keys, weighted_percentiles, weighted_summary
from codestrata.sources.scratch import Scratch


def test_weighted_summary_and_percentiles(spark):
    rng = random.Random(7)
    rows = [(("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])), rng.choice([None, -5, 0, 1, 3, 1000, 2**40, rng.randrange(10**6)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {r["key"]: r for r in weighted_summary(compress(df, "k", "v")).collect()}
    pct = {(r["key"], r["percentage"]): r["value"] for r in weighted_percentiles(compress(df, "k", "v"), [0.0, 0.5, 0.99, 1.0]).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key]
        known = sorted(v for v in values if v is not None)
        top = max(set(known), key=lambda v: (known.count(v), -v))
        assert (got[key]["n_rows"], got[key]["n_distinct"]) == (len(values), len(set(known)))
        assert (got[key]["mode"], got[key]["mode_rows"]) == (top, known.count(top))
        for p in (0.0, 0.5, 0.99, 1.0):
            rank = max(1, int(np.ceil(round(p * len(known), 9))))
            assert pct[(key, p)] == known[rank - 1]


def test_weighted_summary_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert weighted_summary(compress(df, "k", "v")).count() == 0
    only_null = spark.createDataFrame([("a", None)], "k string, v bigint")
    row = weighted_summary(compress(only_null, "k", "v")).first()
    assert (row["n_rows"], row["n_distinct"], row["mode"], row["mode_rows"]) == (1, 0, None, 0)
    assert weighted_percentiles(compress(only_null, "k", "v"), [0.5]).count() == 0


def test_heavy_keys_count_rows_without_key(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [(None, 1)] * 95, "k string, v int")
    assert heavy_keys({"t": compress(df, "k", "v")}, 0.05).count() == 0  # exactly the share is not more
    assert [r["key"] for r in heavy_keys({"t": compress(df, "k", "v")}, 0.049).collect()] == ["a"]


def _time(n):
    return None if n is None else datetime(2024, 1, 1) + timedelta(days=n)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 15])
def test_orphans_equal_brute_force(spark, bits):
    rng = random.Random(3)
    parents = [(f"k{rng.randrange(200)}", rng.randrange(100), rng.choice([None, rng.randrange(100)])) for _ in range(300)]
    refs = [(i, rng.choice([None, f"k{rng.randrange(260)}"]), rng.choice([None, rng.randrange(100)])) for i in range(800)]
    p = spark.createDataFrame([(k, _time(b), _time(d)) for k, b, d in parents], "key string, born timestamp, died timestamp")
    r = spark.createDataFrame([(i, k, _time(t)) for i, k, t in refs], "id int, name string, at timestamp")
    want = {
        i for i, k, t in refs
        if k is None or t is None or not any(pk == k and b <= t and (d is None or t < d) for pk, b, d in parents)
    }
    assert {x["id"] for x in orphans(r, p, "name", "at", bits).collect()} == want


def test_orphans_without_parents_and_full_filter(spark):
    p = spark.createDataFrame([], "key string, born timestamp, died timestamp")
    r = spark.createDataFrame([(1, "a", _time(1))], "id int, name string, at timestamp")
    assert orphans(r, p, "name", "at", 1 << 15).count() == 1
    assert orphans(r.limit(0), p, "name", "at", 1 << 15).count() == 0
    many = spark.range(30000).selectExpr("cast(id as string) as key")
    assert bloom_filter(many, "key", 1 << 15) is None  # too full to be of use


def test_filter_with_more_keys_than_a_slice_holds(spark):
    parents = spark.range(30000).selectExpr("concat('k', id) as key", "timestamp '2024-01-01' as born", "cast(null as timestamp) as died")
    held = key_filter(parents, "key", Scratch(spark, "slices"), 1 << 15)
    assert len(held.slices) >= 9
    refs = spark.range(40000).selectExpr("id", "if(id % 40 = 7, null, concat('k', id)) as key", "timestamp '2024-02-01' as at")
    tagged = held.tag(refs, "key")
    assert tagged.where("key is null").count() == tagged.where("key is null and not _maybe").count() == 1000
    assert tagged.where("id < 30000 and key is not null and not _maybe").count() == 0  # no parent is ever denied
    through = tagged.where("id >= 30000 and _maybe").count()
    assert through < 300  # the others meet no join
    found = orphans(refs, parents, "key", "at", 1 << 15)
    assert found.count() == refs.where("id >= 30000 or key is null").count()


def _tree_brute(rows):
    up = {i: p for i, p, _ in rows}
    name = {i: n for i, _, n in rows}
    out = {}
    for i in up:
        path, seen = [i], {i}
        while up[path[-1]] in up and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        last = up[path[-1]]
        if last in seen:
            loop = path[path.index(last):]
            out[i] = ("loop", min(loop), i in loop)
        else:
            out[i] = ("tree", path[-1], len(path) - 1, "/".join(name[x] or "" for x in reversed(path)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(120)]
    rows = []
    for k, i in enumerate(ids):
        parent = rng.choice([None, "gone", ids[rng.randrange(max(1, k))], ids[max(0, k - 1)], ids[max(0, k - 1)]]) if k else None
        rows.append((i, parent, rng.choice([None, f"x{k}"])))
    for a, b in ((5, 9), (40, 40), (70, 75)):  # close some loops
        rows[a] = (ids[a], ids[b], "loop")
    df = spark.createDataFrame(rows, "id string, parent string, name string")
    want = _tree_brute(rows)
    got = {r["entry_id"]: r for r in H.hierarchy(spark, df, "id", "parent", "name").collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        if w[0] == "loop":
            assert (r["cycle_id"], r["depth"], r["root_id"]) == (w[1], -1, None)
        else:
            assert (r["root_id"], r["depth"], r["path"], r["cycle_id"]) == (w[1], w[2], w[3], None)
    # nested sets: descendants of a node are exactly the rows of its root inside of its range
    placed = [r for r in got.values() if r["cycle_id"] is None]
    up = {i: p for i, p, _ in rows}
    for r in placed:
        inside = {x["entry_id"] for x in placed if x["root_id"] == r["root_id"] and r["left"] < x["left"] <= r["right"]}
        below = set()
        for x in placed:
            j = up[x["entry_id"]]
            while j in up:
                if j == r["entry_id"]:
                    below.add(x["entry_id"])
                    break
                j = up[j]
        assert inside == below and r["n_descendants"] == len(below)
    flags = {r["entry_id"]: (r["cycle_id"], r["on_loop"]) for r in H.loops(spark, df, "id", "parent").collect()}
    assert flags == {i: w[1:] for i, w in want.items() if w[0] == "loop"}


def test_hot_parent_with_prefixed_ids(spark):
    rng = random.Random(11)
    rows = [("file:0", None, "top")] + [(f"file:{i}", "file:0" if i % 3 else f"file:{max(0, i - 1)}", "x") for i in range(1, 400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, parent string, name string")
    want = H.hierarchy(spark, df, "id", "parent", "name")
    got = H.hierarchy(spark, df, "id", "parent", "name", hot_children=20)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    tree = Scratch(spark, "tree").save(got)
    pairs = {(r[0], r[1]): r[2] for r in H.descendants(tree, tree.select("entry_id")).collect()}
    up, brute = {i: p for i, p, _ in rows}, {}
    for i in up:
        j, n = up[i], 1
        while j:
            brute[(j, i)] = n
            j, n = up[j], n + 1
    assert pairs == brute


def test_hierarchy_edges(spark):
    empty = spark.createDataFrame([], "id string, parent string, name string")
    assert H.hierarchy(spark, empty, "id", "parent", "name").count() == 0
    one = spark.createDataFrame([("a", "a", "x"), (None, "a", "y"), ("b", None, None)], "id string, parent string, name string")
    got = {r["entry_id"]: r["cycle_id"] for r in H.hierarchy(spark, one, "id", "parent", "name").collect()}
    assert got == {"a": "a", "b": None}
    tree = H.hierarchy(spark, spark.createDataFrame([("a", None, "x"), ("b", "a", "y"), ("c", "b", "z")], "id string, parent string, name string"), "id", "parent", "name")
    pairs = H.descendants(tree, spark.createDataFrame([("a",)], "entry_id string"))
    assert sorted((r[0], r[1]) for r in pairs.collect()) == [("a", "b"), ("a", "c")]


def test_merges(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), ("b", None, "p")], "id string, updated_at int, v string"
    )
    assert sorted(map(tuple, latest(df, ["id"]).collect())) == [("a", 2, "z"), ("b", None, "q")]
    assert sorted(map(tuple, keep_first(df, ["id"], ["updated_at"]).collect())) == [("a", 1, "x"), ("b", None, "p")]
    assert tuple(duplicate_stats(df, ["id"]).first()) == (5, 2, 3, 2)
    new = spark.createDataFrame([("b", 9, "n"), ("c", 1, "m")], df.schema)
    assert sorted(r["id"] + r["v"] for r in upsert(latest(df, ["id"]), new, ["id"]).collect()) == ["az", "bn", "cm"]


def test_batched_upsert_first_in_batch_last_batch_wins(spark):
    rows = [("r", f"f{i:02d}", "q", i) for i in range(5)]
    df = spark.createDataFrame(rows, "repo string, path string, name string, seq int")
    won = batched_upsert_winners(df, "repo", "path", ["repo", "name"], ["seq"], batch_size=2).collect()
    assert [r["path"] for r in won] == ["f04"]
    won = batched_upsert_winners(df.where("seq < 4"), "repo", "path", ["repo", "name"], ["seq"], batch_size=2).collect()
    assert [r["path"] for r in won] == ["f02"]


def test_numbering_of_hot_scopes(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", None]), f"p{i:04d}") for i in rng.sample(range(9999), 300)]
    df = spark.createDataFrame(rows, "repo string, path string")
    want = {(s, p): i for s in {r[0] for r in rows} for i, p in enumerate(sorted(p for t, p in rows if t == s))}
    for hot in (20, 1000):
        assert {(r["repo"], r["path"]): r["n"] for r in numbered(df, "repo", "path", "n", hot).collect()} == want


def test_scratch_rounds(spark):
    s = Scratch(spark, "test")
    a = s.save(spark.range(5).toDF("x"))
    b = s.save(a.where("x > 2"))
    s.drop(a)
    assert b.count() == 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, "x", 1, 2, 3, 4), ("b", "a", "y", 1, 2, 3, 4)], "id string, parent string, name string, n int, p int, left int, depth int")
    assert {r["entry_id"]: r["depth"] for r in H.hierarchy(spark, df, "id", "parent", "name").collect()} == {"a": 0, "b": 1}
    assert H.loops(spark, df, "id", "parent").count() == 0
    rows = spark.createDataFrame([("a", 1, 9, 9), ("a", 2, 9, 9)], "key string, value int, weight int, n_rows int")
    assert weighted_summary(compress(rows, "key", "value")).first()["n_rows"] == 2
    refs = spark.createDataFrame([("a", _time(1), 1, 2), ("b", _time(1), 1, 2)], "key string, born timestamp, died int, at int")
    parents = spark.createDataFrame([("a", _time(0), None)], "key string, born timestamp, died timestamp")
    assert [r["key"] for r in orphans(refs, parents, "key", "born", 1 << 15).collect()] == ["b"]
    tagged = spark.createDataFrame([("a", 1, "s", 5)], "id string, updated_at int, _v string, n int")
    assert latest(tagged, ["id"]).columns == tagged.columns
