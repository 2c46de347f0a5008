"""Paths written with backslashes."""

import datetime

from codestrata.plans import registry

PATHS = [("1", "src\\app\\Main.java", "Java"), ("2", "pkg\\io/b.go", "Go"), ("3", "a/b.py", "Python"), ("4", "docs\\types.d.ts", "TypeScript")]


def test_every_path_has_a_name_and_a_module(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, "r", p, "", "", lang, "", 1, None, False, False, "SCANNED", at) for i, p, lang in PATHS]
    schema = """id string, repository_id string, relative_path string, file_name string, extension string, language string, mime_type string, size_bytes bigint,
      sha256 string, is_binary boolean, is_hidden boolean, scan_status string, updated_at timestamp"""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "repository_files.parquet"))
    q = registry.queries()
    assert {(r["id"], r["name"], r["ext"], r["language"]) for r in q["scan_rows_all"](spark, str(tmp_path)).collect()} == {
        ("1", "Main.java", "java", "Java"), ("2", "b.go", "go", "Go"), ("3", "b.py", "py", "Python"), ("4", "types.d.ts", "d.ts", "TypeScript")
    }
    assert {(r["id"], r["module"]) for r in q["modules_all"](spark, str(tmp_path)).collect()} == {
        ("1", "src.app.Main"), ("2", "pkg/io/b"), ("3", "a.b"), ("4", "docs.types.d")
    }
