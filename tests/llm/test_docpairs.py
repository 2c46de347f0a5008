"""Documented functions in small sources of every language."""

import pytest

from codestrata.llm.docpairs import description, function_documentation, informative_words, parse_pairs

GOOD = "Turns the raw rows into one table per region"


@pytest.mark.parametrize(
    "ext, source, line, name",
    [
        ("py", f'def a(x):\n    pass\n\n@cached\nasync def load(x: int = f(1, ")")) -> dict:\n    """{GOOD}."""\n    return x\n', 5, "load"),
        ("py", f"class K:\r\n    def load(self):\r\n        # note\r\n        '''{GOOD}\r\n        '''\r\n", 2, "load"),
        ("java", f"class K {{\n  /**\n   * {GOOD}.\n   * @param x it\n   */\n  @Override\n  @Named(\"a)\")\n  public static Map<String, List<T>> load(int x) {{\n  }}\n}}\n", 8, "load"),
        ("js", f"/** {GOOD} */\nexport const load = async (a, b) => {{\n}};\n", 2, "load"),
        ("ts", f"class K {{\n  /**\n   * {GOOD}\n   */\n  private async load<T>(x: T): Promise<T> {{\n  }}\n}}\n", 5, "load"),
        ("go", f"package x\n\n// load rows.\n// {GOOD}.\nfunc (k *K) load(a int) error {{\n}}\n", 5, "load"),
        ("go", f"package x\n\n/*\n{GOOD}\n*/\nfunc load() {{\n}}\n", 6, "load"),
    ],
)
def test_pairs(ext, source, line, name):
    found = parse_pairs(ext, source)
    assert [(a, b) for a, b, _, _ in found] == [(line, name)]
    text = description(found[0][2], found[0][3])
    assert GOOD in text and "@param" not in text
    assert informative_words(text, name) >= 5


@pytest.mark.parametrize(
    "ext, source",
    [
        ("py", 'def load():\n    x = 1\n    """Not a docstring as it comes too late"""\n'),
        ("py", 's = """\ndef fake():\n    \'a string and no function at all\'\n"""\n'),
        ("js", "// A line comment is no documentation in a script\nfunction load() {}\n"),
        ("java", "/** Belongs to the class and to nothing else */\npublic class Load {\n  void a() {}\n}\n"),
        ("go", "// Some words that stand far above the function\n\nfunc load() {}\n"),
        ("rb", "def load; end"),
        ("py", ""),
        ("py", None),
    ],
)
def test_no_pairs(ext, source):
    assert parse_pairs(ext, source) == []


@pytest.mark.parametrize(
    "doc",
    ["", "Load the rows.", "TODO: describe what this thing does in some detail", "Args:\n    x: the number of rows that come back\n", ":param x: the number of rows that come back",
     "eslint-disable-next-line max-len, no-unused-vars, no-param-reassign", "rows = load(a, b, c, d, e, f)\nload(a, b, c, d, e)", "Auto-generated method stub, replace the body with your own"],
)
def test_trivial(doc):
    assert informative_words(description(doc, 0), "loadRows") < 5


def test_operator_keeps_nulls_and_broken_files_out_of_trouble(spark):
    rows = [("a", "x.py", f'def f(:\n    """{GOOD}"""\n\ndef g():\n    """{GOOD}"""\n'), ("b", None, "x"), ("c", "y.go", None), ("d", "z.java", "/** unfinished")]
    df = spark.createDataFrame(rows, "file_id string, relative_path string, source string")
    got = function_documentation(df).collect()
    assert [(r["file_id"], r["function_name"], r["start_line"], r["trivial"]) for r in got] == [("a", "g", 4, False)]
    assert function_documentation(df.limit(0)).count() == 0


def test_deep_nesting_ends_early():
    deep = f'def a():\n    """{GOOD}"""\n\ndef b(x={"(" * 5000}1{")" * 5000}):\n    pass\n'
    assert [(n, name) for n, name, _, _ in parse_pairs("py", deep)] == [(1, "a")]


def test_notices_of_templates_say_nothing():
    for text in ("Stub produced by the project template; fill in the description of this member", "Method stub created by the wizard, please fill in the details here"):
        assert informative_words(text, "run") == 0
    assert informative_words("Fills in the stub that the remote side left behind for us", "run") >= 5


def test_signatures_by_rules():
    java = "/** Doc. */\n@A(x = \"(\")\npublic static <T extends Map<String, List<T>>> Map<String, T[]> [] join (T a) {}\n/** Doc. */\nclass A {}\n/** Doc. */\nA() {}\n"
    assert [(line, name) for line, name, _, _ in parse_pairs("java", java)] == [(3, "join"), (7, "A")]
    ts = "/** Doc. */\nexport const f: Handler = async (x) => x\n/** Doc. */\nexport default function* g<T extends Array<T>>(a: T) {}\n/** Doc. */\nif (x) {}\n"
    assert [name for _, name, _, _ in parse_pairs("ts", ts)] == ["f", "g"]
    go = "// Doc.\nfunc (s *Set[K]) Add[T Map[K, []V]](x T) {}\n// Doc.\nfunctional(x)\n"
    assert [name for _, name, _, _ in parse_pairs("go", go)] == ["Add"]
