"""Calls on the results of other calls, and in the bodies of declarations of one line."""

from codestrata.parsing import definitions as D
from codestrata.parsing import records as P

CHAINS = [
    ("1", "r", "A.java", "Java", 'public class A {\n  public void run(@Named("x") int a) {\n    var n = x.stream().skip(3).toList();\n    b.of(f(a), "q)")\n        .map(g(1)[0].h())\n        .get();\n    new Box<>(a).open();\n  }\n  public int one() { return two(3).three(); }\n}\nclass K { void m() { g.go(); } }\n'),
    ("2", "r", "b.py", "Python", 'def f(a, b=g()): return h(a).i()\nclass A: x = j()\n", ".join(a)\nif (a or b).k(): pass\n'),
    ("3", "r", "c.ts", "TypeScript", "export const f = async (a) => g(a)?.h();\nload(...rest(a)).then((x) => x.y()).catch(bad);\n"),
    ("4", "r", "d.go", "Go", "package d\nfunc (t *T) Run() error { return t.a().b(c[0].d()) }\n"),
]


def test_chained_calls_and_bodies_of_one_line(spark):
    df = spark.createDataFrame(CHAINS, "file_id string, repository_id string, relative_path string, language string, source string")
    got = {}
    for r in P.calls(P.declared(P.source_lines(df))).collect():
        obj = None if r["callee_object"] is None else "".join(r["callee_object"].split())
        got.setdefault(r["file_id"], set()).add((r["start_line"], r["caller_name"], obj, r["callee_name"]))
    chain = 'b.of(f(a),"")'
    assert got["1"] == {
        (3, "A.run", "x", "stream"), (3, "A.run", "x.stream()", "skip"), (3, "A.run", "x.stream().skip(3)", "toList"),
        (4, "A.run", "b", "of"), (4, "A.run", None, "f"), (4, "A.run", chain, "map"), (5, "A.run", None, "g"), (5, "A.run", "g(1)[0]", "h"),
        (4, "A.run", chain + ".map(g(1)[0].h())", "get"), (7, "A.run", "newBox<>(a)", "open"),
        (9, "A.one", None, "two"), (9, "A.one", "two(3)", "three"), (11, "A.one", "g", "go"),
    }
    assert got["2"] == {
        (1, "f", None, "g"), (1, "f", None, "h"), (1, "f", "h(a)", "i"), (2, "f", None, "j"), (3, "f", "_s_", "join"), (4, "f", "(aorb)", "k"),
    }
    assert got["3"] == {
        (1, "f", None, "g"), (1, "f", "g(a)", "h"), (2, "f", None, "load"), (2, "f", None, "rest"), (2, "f", "load(...rest(a))", "then"),
        (2, "f", "x", "y"), (2, "f", "load(...rest(a)).then((x)=>x.y())", "catch"),
    }
    assert got["4"] == {(2, "(T).Run", "t", "a"), (2, "(T).Run", "t.a()", "b"), (2, "(T).Run", "c[0]", "d")}


def test_calls_by_outline_are_the_same(spark):
    df = spark.createDataFrame(CHAINS, "file_id string, repository_id string, relative_path string, language string, source string")
    flat = lambda rows: {(r["file_id"], r["start_line"], "".join((r["callee_object"] or "").replace("_s_", '""').split()), r["callee_name"]) for r in rows}
    new = D.calls(df).collect()
    assert flat(new) == flat(P.calls(P.declared(P.source_lines(df))).collect())
    callers = {(r["file_id"], r["start_line"]): r["caller_name"] for r in new}
    assert callers[("1", 4)] == "A.run" and callers[("2", 3)] == "<module>" and callers[("3", 2)] == "<module>" and callers[("4", 2)] == "(T).Run"
