"""Constructors in the parsed index."""

from codestrata.plans import registry

SOURCES = [
    ("1", "r", "a.py", "Python", "class K:\n    def __init__(self):\n        pass\n    def constructor(self):\n        pass\ndef __init__():\n    pass\n"),
    ("2", "r", "b.ts", "TypeScript", "export class B {\n  constructor(x: number) {\n  }\n  go(x) {\n  }\n}\n"),
    ("3", "r", "C.java", "Java", "public class C {\n  public C(int a) {\n  }\n  public void run() {\n  }\n}\n"),
]


def test_constructors_come_before_methods(spark, tmp_path):
    spark.createDataFrame(SOURCES, "file_id string, repository_id string, relative_path string, language string, source string").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {(r["qualified_name"], r["symbol_type"]) for r in registry.queries()["parsed_index"](spark, str(tmp_path)).collect() if r["symbol_type"] != "class"}
    assert got == {
        ("K.__init__", "constructor"), ("K.constructor", "method"), ("__init__", "function"), ("B.constructor", "constructor"), ("B.go", "method"),
        ("C.C", "constructor"), ("C.run", "method"),
    }
