"""File trees, extraction of records, and incremental jobs on small inputs."""

import hashlib

import pytest

from codestrata.functions import files as X
from codestrata.functions import names as N
from codestrata.operators import index as I
from codestrata.operators import scan as S
from codestrata.parsing import records as P
from codestrata.streaming.incremental import delete_files, delete_nodes, stream_reindex


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    content = {
        "src/a.py": b"x = 1\n", "src/types/index.d.ts": b"export {}\n", "Dockerfile": b"FROM x\n", "docker/dockerfile.dev": b"FROM y\n",
        ".hidden/b.go": b"package b\n", "img/logo.png": b"\x89PNG", "bin.dat": b"ab\x00cd", "lib.jar": b"zip", "empty.js": b"", ".git/HEAD": b"ref",
        "node_modules/x/y.js": b"z", "big.txt": b"x" * 3000, "Makefile": b"all:\n", "noext": b"t",
    }
    for path, data in content.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    return root


def test_scan_tree(spark, tree):
    rows = {r["relative_path"]: r for r in S.scan_tree(spark, str(tree), "r", max_bytes=2000).collect()}
    assert ".git/HEAD" not in rows and "node_modules/x/y.js" not in rows
    assert (rows["src/a.py"]["language"], rows["src/a.py"]["mime_type"], rows["src/a.py"]["sha256"]) == ("Python", "text/x-python", hashlib.sha256(b"x = 1\n").hexdigest())
    d = rows["src/types/index.d.ts"]
    assert (d["extension"], d["language"], d["mime_type"]) == ("d.ts", "TypeScript", "application/octet-stream")
    assert rows["Dockerfile"]["language"] == rows["docker/dockerfile.dev"]["language"] == "Dockerfile"
    assert rows["Makefile"]["language"] == rows["noext"]["language"] == "Unknown"
    assert rows[".hidden/b.go"]["is_hidden"] and not rows["src/a.py"]["is_hidden"]
    assert (rows["img/logo.png"]["scan_status"], rows["img/logo.png"]["size_bytes"]) == ("IGNORED", 0)
    assert (rows["big.txt"]["scan_status"], rows["big.txt"]["size_bytes"]) == ("IGNORED", 3000)
    assert rows["bin.dat"]["is_binary"] and rows["bin.dat"]["sha256"] is None and rows["lib.jar"]["is_binary"]
    assert rows["empty.js"]["sha256"] is None and not rows["empty.js"]["is_binary"]
    files = S.scan_tree(spark, str(tree), "r", max_bytes=2000)
    assert {r["directory"] for r in S.ancestor_directories(files).collect()} == {"src", "src/types", "docker", ".hidden", "img"}
    summary = S.scan_summary(files).first()
    assert (summary["total_files"], summary["ignored_files"], summary["binary_files"]) == (12, 2, 2)
    assert sum(r["percentage"] for r in S.language_stats(files).collect()) == pytest.approx(100, abs=0.1)


def test_functions_on_names(spark):
    df = spark.createDataFrame(
        [("a.b.c", "c", "app/x/y.py", "Python"), ("c", "c", "internal/a/h.go", "Go"), ("..a..b. ", "b", "src/a.test.ts", "TypeScript"), (None, None, None, None)],
        "q string, n string, p string, l string",
    )
    c = df.select(
        N.normalise(df.q).alias("norm"), N.display_name(df.q).alias("disp"), N.module_prefix(df.q, df.n).alias("mod"), N.parent_name(df.q).alias("par"),
        N.module_of(df.p, df.l).alias("path"), N.is_valid(df.q).alias("ok"), N.qualified(df.p, df.l, df.n).alias("full"),
    ).collect()
    assert tuple(c[0]) == ("a.b.c", "b.c", "a.b", "a.b", "app.x.y", True, "app.x.y.c")
    assert tuple(c[1]) == ("c", "c", None, None, "internal/a/h", True, "internal/a/h.c")
    assert c[2]["norm"] == "a.b" and c[2]["path"] == "src.a.test" and c[3]["norm"] is None and c[3]["ok"] is False
    lib = spark.createDataFrame([("numpy.linalg",), ("example.org/team/tool",), ("lodash/fp",), ("",)], "m string")
    assert [r[0] for r in lib.select(N.library_name(lib.m)).collect()] == ["numpy", "tool", "lodash", ""]
    size = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024**3,)], "n bigint")
    assert [r[0] for r in size.select(X.human_bytes(size.n)).collect()] == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 GB"]


SOURCES = [
    ("1", "r", "a.py", "Python", 'import os\nfrom .x import y\n\n@app.get("/items")\nasync def load(a):\n    """def fake():"""\n    os.path.join(a)  # call(1)\n    return fetch(a)\n\nclass K(Base, metaclass=M):\n    def _run(self):\n        load("open(")\n'),
    ("2", "r", "b.ts", "TypeScript", "import { a } from './a';\nexport class B extends C {\n  private async go(x: number): Promise<void> {\n    if (x) {\n      this.svc.call(x);\n    }\n  }\n}\n/*\nfunction no() {}\n*/\nexport const f = (a) => {\n};\napp.post('/u', f);\n"),
    ("3", "r", "C.java", "Java", 'import java.util.List;\npublic class C extends D {\n  @GetMapping("/c")\n  public static int run(int a) {\n    return helper.make(a);\n  }\n}\n'),
    ("4", "r", "d.go", "Go", 'package d\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n}\n\nfunc (t *T) Run() error {\n\tfmt.Println("x")\n\treturn nil\n}\n'),
    ("5", "r", "e.py", "Python", None),
]


@pytest.fixture(scope="module")
def declared(spark):
    df = spark.createDataFrame(SOURCES, "file_id string, repository_id string, relative_path string, language string, source string")
    return P.declared(P.source_lines(df))


def test_records(declared):
    fn = {(r["file_id"], r["qualified_name"], r["start_line"], r["visibility"], r["is_async"]) for r in P.functions(declared).collect()}
    assert fn == {
        ("1", "load", 5, "public", True), ("1", "K._run", 11, "protected", False), ("2", "B.go", 3, "private", True), ("2", "f", 12, "public", False),
        ("3", "C.run", 4, "public", False), ("4", "(T).Run", 10, "public", False),
    }
    assert {(r["class_name"], tuple(r["base_classes"])) for r in P.classes(declared).collect()} == {("K", ("Base",)), ("B", ("C",)), ("C", ("D",)), ("T", ())}
    assert {r["module_path"] for r in P.imports(declared).collect()} == {"os", ".x", "./a", "java.util.List", "fmt"}
    calls = {(r["caller_name"], r["callee_object"], r["callee_name"]) for r in P.calls(declared).collect()}
    assert {("load", "os.path", "join"), ("load", None, "fetch"), ("K._run", None, "load"), ("B.go", "this.svc", "call"), ("C.run", "helper", "make"), ("(T).Run", "fmt", "Println")} <= calls
    assert not any(c[2] in ("fake", "open", "no") for c in calls)
    routes = {(r["http_method"], r["path"], r["handler_name"]) for r in P.routes(declared).collect()}
    assert routes == {("GET", "/items", "load"), ("GET", "/c", "C.run"), ("POST", "/u", None)}
    assert {(r["file_id"], r["start_line"], r["end_line"]) for r in P.comment_blocks(declared).collect()} >= {("2", 9, 11)}


def test_extraction_agrees_with_recorded_functions(spark):
    """Held-out accuracy against what another parser recorded for the same files."""
    d = "/root/testdata/sf0.01"
    sources = spark.read.parquet(f"{d}/source_files.parquet")
    got = {(r["file_id"], r["start_line"]) for r in P.functions(P.declared(P.source_lines(sources))).select("file_id", "start_line").collect()}
    want = {(r["file_id"], r["start_line"]) for r in spark.read.parquet(f"{d}/function_definitions.parquet").select("file_id", "start_line").distinct().collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_incremental(spark, tmp_path):
    cols = "id string, repository_id string, file_id string, qualified_name string"
    entries = I.link_parents(spark.createDataFrame([("1", "r", "f1", "K"), ("2", "r", "f2", "K.m"), ("3", "r", "f3", "x")], cols))
    entries.write.parquet(str(tmp_path / "index/v0"))
    assert delete_files(entries, spark.createDataFrame([("f1",)], "file_id string")).count() == 2
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("f1", "L"), ("f3", None)], "file_id string, name string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id string, name string").parquet(str(tmp_path / "in"))

    def parse(df):
        return df.where("name is not null").selectExpr("'9' as id", "'r' as repository_id", "file_id", "name as qualified_name", "cast(null as string) as parent_symbol_id")

    q = stream_reindex(stream, str(tmp_path / "index"), str(tmp_path / "cp"), parse, spark)
    q.awaitTermination(120)
    got = {(r["id"], r["qualified_name"], r["parent_symbol_id"]) for r in spark.read.parquet(str(tmp_path / "index/v1")).collect()}
    assert got == {("9", "L", None), ("2", "K.m", None)}  # the parent of K.m went away with its file
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source_id string, target_id string")
    n, e = delete_nodes(nodes, edges, spark.createDataFrame([("b",)], "node_id string"))
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [("c", "a")]


def test_search_and_pages(spark):
    df = spark.createDataFrame([("1", "Load", "a.Load", "Go", "function"), ("2", "loader", "b.loader", "Go", "class"), ("3", "x", "load.x", "Java", "class")], "id string, name string, qualified_name string, language string, symbol_type string")
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(I.search(df, "LOAD")) == ["1", "2"] and ids(I.search(df, "load", "exact")) == ["1"] and ids(I.search(df, "load", "nonsense")) == ["1", "2"]
    assert ids(I.search(df, "load", "qualified", language="Java")) == ["3"] and ids(I.search(df, "load", limit=1)) == ["1"]
    assert ids(I.page(df, ["id"], limit=1, offset=1, language="Go", symbol_type=None)) == ["2"]
