"""Declarations of small sources, and those of the recorded functions."""

import pytest

from codestrata.parsing import definitions as D
from codestrata.parsing.outline import outline

PY = '''import os
LIMIT = 3
name: str = "x"

class Base(ABC, metaclass=M):
    """Base class."""
    size = 1

    @property
    @deco.two(1)
    async def run(self, a, *args, b: Dict[str, int] = {"k": (1, 2)}, **kw) -> Dict[str, int]:
        """Runs
    it."""
        def inner(x):
            return x  # def not_one():

        return inner

    @staticmethod
    def _help(): pass

def last():
    # note
    "One line."
    return "def f(): pass"
'''
JAVA = """package a;
/** A thing. */
@Entity(name = "x")
public abstract class Thing<T> extends Base<T> implements One<T>, Two {
    private static final int LIMIT = 3;
    List<String> names;
    /**
     * Makes one.
     *
     * @param a x
     */
    public Thing(int a, Map<String, List<T>> m) {
        int local = 1;
        call(local);
    }
    @Override
    @Named("b")
    protected static <R> List<R> find(final String[] keys, int... rest) throws E { return null; }
    abstract void later();
    interface Inner {
        int size();
    }
    enum Kind { A, B }
}
"""
TS = """import x from 'y';
export interface Shape extends A, B { area(): number }
/** Circle. */
@Component({ selector: 'c' })
export default class Circle extends Base implements Shape {
  constructor(private readonly r: number, public name?: string) { super() }
  @Input()
  static async make<T>(a: Map<string, T>, ...rest: any[]): Promise<T> { if (a) { return go(a) } }
}
export const twice = async (n: number): Promise<number> => { return n * 2 }
const inc = n => n + 1;
let count = 0;
function* gen() { yield `function no() {}` }
"""
GO = """package a

const Max = 3
var total int

// Box holds
// things.
type Box[T any] struct {
\tBase
}

// Add adds.
func (b *Box[T]) Add(x, y int, f func(int) error) (n int, err error) {
\treturn
}

func main() {
}
"""


def _functions(text, language):
    return {r[2]: r for r in outline(text, language) if r[0] == "function"}


def test_outline_scopes_and_ends():
    py = {r[2]: r for r in outline(PY, "Python")}
    assert set(py) == {"LIMIT", "name", "Base", "run", "inner", "_help", "last"}
    assert py["Base"][5:7] == (5, 20) and py["run"][3:7] == ("Base", "Base", 11, 17) and py["inner"][3:7] == ("Base.run", "Base", 14, 15)
    assert py["run"][10] == ["@property", "@deco.two(1)"] and py["last"][5:7] == (22, 25) and py["_help"][5:7] == (20, 20)
    java = {r[2]: r for r in outline(JAVA, "Java")}
    assert {k for k, r in java.items() if r[0] == "function"} == {"find", "later", "size"} | {"Thing"}
    assert {k for k, r in java.items() if r[0] == "variable"} == {"LIMIT", "names"}
    assert java["find"][5:7] == (18, 18) and java["size"][3:5] == ("Thing.Inner", "Inner") and java["Kind"][1] == "enum"
    assert {k: r[1] for k, r in ((r[2], r) for r in outline(TS, "TypeScript")) if r[0] != "function"} == {"Shape": "interface", "Circle": "class", "count": "let"}
    assert list(_functions(TS, "TypeScript")) == ["constructor", "make", "twice", "inc", "gen"]
    assert list(_functions(GO, "Go")) == ["Add", "main"]
    for bad in (None, "", "def", "class {", "func (", "public class A { void f("):
        for language in (*D.LANGUAGES, "Rust", None):
            outline(bad, language)


def test_records(spark):
    rows = [("p", "r", "a.py", "Python", PY), ("j", "r", "T.java", "Java", JAVA), ("t", "r", "c.ts", "TypeScript", TS), ("g", "r", "b.go", "Go", GO), ("n", "r", None, "Python", None), ("o", "r", "x", None, "def f(): pass")]
    d = D.definitions(spark.createDataFrame(rows, "file_id string, repository_id string, relative_path string, language string, source string")).cache()
    f = {(r["file_id"], r["function_name"]): r for r in D.functions(d).collect()}
    run = f[("p", "run")]
    assert (run["parameters"], run["return_type"], run["is_async"], run["is_method"], run["decorators"]) == (["a", "args", "b", "kw"], "Dict[str, int]", True, True, ["property", "deco.two"])
    assert run["documentation"].split() == ["Runs", "it."] and f[("p", "last")]["documentation"] == "One line."
    assert f[("p", "inner")]["nested_name"] == "Base.run.inner" and f[("p", "_help")]["is_static"] and f[("p", "_help")]["visibility"] == "protected"
    find, made = f[("j", "find")], f[("j", "Thing")]
    assert (find["parameters"], find["return_type"], find["decorators"], find["visibility"], find["is_static"]) == (["keys", "rest"], "List<R>", ["Override", "Named"], "protected", True)
    assert made["is_constructor"] and made["parameters"] == ["a", "m"] and made["documentation"].startswith("Makes one.")
    make = f[("t", "make")]
    assert (make["parameters"], make["return_type"], make["is_async"], make["is_static"], make["decorators"]) == (["a", "rest"], "Promise<T>", True, True, ["Input"])
    assert f[("t", "constructor")]["parameters"] == ["r", "name"] and f[("t", "twice")]["is_async"] and f[("t", "inc")]["parameters"] == ["n"]
    add = f[("g", "Add")]
    assert (add["qualified_name"], add["return_type"], add["documentation"], add["parameters"]) == ("(Box).Add", "(n int, err error)", "Add adds.", ["x", "y", "f"])
    t = {r["class_name"]: r for r in D.types(d).collect()}
    assert (t["Base"]["base_classes"], t["Base"]["is_abstract"], t["Base"]["documentation"]) == (["ABC"], True, "Base class.")
    assert (t["Thing"]["base_classes"], t["Thing"]["interfaces"], t["Thing"]["is_abstract"], t["Thing"]["decorators"], t["Thing"]["documentation"]) == (["Base"], ["One", "Two"], True, ["Entity"], "A thing.")
    assert (t["Circle"]["base_classes"], t["Circle"]["interfaces"], t["Shape"]["base_classes"], t["Box"]["class_kind"]) == (["Base"], ["Shape"], ["A", "B"], "struct")
    v = {(r["file_id"], r["variable_name"]): r["symbol_type"] for r in D.variables(d).collect()}
    assert v == {("p", "LIMIT"): "constant", ("p", "name"): "variable", ("j", "LIMIT"): "constant", ("j", "names"): "variable", ("t", "count"): "variable", ("g", "Max"): "constant", ("g", "total"): "variable"}


def test_imports_comments_and_routes(spark):
    py = "import os, a.b as c\nfrom . import (x as y,\n  z)\nfrom ..p import *\n# one\n# two\nx = 1  # three\n@app.get('/items/{id}')\nasync def item(id):\n    '''Doc.'''\n@bp.route('/f', methods=['POST', 'PUT'])\ndef f(): pass\ns = 'import no'\n"
    ts = "import d, { a, b as c } from './m';\nimport * as n from \"pkg\";\nimport 'side';\nconst { r } = require('q');\n/** Doc of g. */\nfunction g() {}\napp.get('/x', auth, handler)\n// app.get('/no', f)\nclass C {\n  @Post('make')\n  make() { return 1 }\n}\n"
    java = "package p;\nimport java.util.*;\nimport static a.B.c;\n/* block */\nclass A {\n  @RequestMapping(value = \"/r\", method = RequestMethod.PUT)\n  public void put() {}\n  @GetMapping\n  public void all() {}\n}\n"
    go = "package p\nimport \"fmt\"\nimport (\n\tx \"a/b\"\n\t. \"c\"\n)\nfunc main() {\n\tr.GET(\"/g\", list)\n\te.POST(\"/e\", make)\n\thttp.HandleFunc(\"/h\", serve)\n}\n"
    rows = [("p", "r", "a.py", "Python", py), ("t", "r", "a.ts", "TypeScript", ts), ("j", "r", "A.java", "Java", java), ("g", "r", "a.go", "Go", go), ("n", "r", None, "Go", None)]
    src = spark.createDataFrame(rows, "file_id string, repository_id string, relative_path string, language string, source string")
    got = {(r["file_id"], r["module_path"], tuple(r["names"]), tuple(r["aliases"]), r["is_relative"], r["start_line"]) for r in D.imports(src).collect()}
    assert got == {
        ("p", "os", (), (), False, 1), ("p", "a.b", (), ("c",), False, 1), ("p", ".", ("x", "z"), ("y", ""), True, 2), ("p", "..p", ("*",), ("",), True, 4),
        ("t", "./m", ("d", "a", "b"), ("", "", "c"), True, 1), ("t", "pkg", ("*",), ("",), False, 2), ("t", "side", (), (), False, 3), ("t", "q", ("r",), ("",), False, 4),
        ("j", "java.util", ("*",), ("",), False, 2), ("j", "a.B.c", ("c",), ("",), False, 3),
        ("g", "fmt", (), (), False, 2), ("g", "a/b", (), ("x",), False, 4), ("g", "c", (), (".",), False, 5),
    }
    notes = {(r["file_id"], r["kind"], r["start_line"], r["end_line"], r["symbol"]) for r in D.comments(src).collect()}
    assert notes == {("p", "line", 5, 6, None), ("p", "line", 7, 7, None), ("p", "docstring", 10, 10, "item"), ("t", "doc", 5, 5, "g"), ("t", "line", 8, 8, None), ("j", "block", 4, 4, None)}
    routes = {(r["file_id"], r["framework"], r["http_method"], r["path"], r["handler_name"]) for r in D.routes(src).collect()}
    assert routes == {
        ("p", "fastapi", "GET", "/items/{id}", "item"), ("p", "flask", "POST", "/f", "f"), ("t", "express", "GET", "/x", "handler"), ("t", "nestjs", "POST", "make", "C.make"),
        ("j", "spring", "PUT", "/r", "A.put"), ("j", "spring", "GET", "/", "A.all"), ("g", "gin", "GET", "/g", "list"), ("g", "echo", "POST", "/e", "make"), ("g", "net/http", "ANY", "/h", "serve"),
    }
