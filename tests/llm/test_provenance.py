"""Generated, minified, vendored and data files."""

import re

import pytest

from codestrata.llm.provenance import attribute_lines, declared_marks, glob_regex, not_hand_written, text_evidence
from codestrata.sources.scratch import Scratch


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("*.js", ["a.js", "x/y/a.js"], ["a.jsx"]),
        ("lib/*.js", ["lib/a.js"], ["x/lib/a.js", "lib/b/a.js"]),
        ("**/gen/**", ["gen/a", "x/gen/y/a"], ["gen", "generated/a"]),
        ("/top.py", ["top.py"], ["x/top.py"]),
        ("a/**/b.go", ["a/b.go", "a/x/y/b.go"], ["b.go"]),
        ("x[0-9].py", ["x1.py"], ["xa.py"]),
        ("x[!0-9].py", ["xa.py"], ["x1.py"]),
        ("f?.c", ["d/f1.c"], ["f.c"]),
    ],
)
def test_globs(glob, yes, no):
    rx = re.compile(glob_regex(glob) + r"\Z")
    assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no)


def test_attribute_lines():
    text = "# c\n*.js generated\nlib/* linguist-vendored=false -generated\nx !vendored text\n\nbad"
    assert [(n, m, on) for n, _, m, on in attribute_lines(text)] == [(1, "generated", True), (2, "vendored", False), (2, "generated", False), (3, "vendored", False)]
    assert attribute_lines(None) == []


def test_precedence_by_directory_and_line(spark):
    files = [("1", "r", "a/x.js"), ("2", "r", "a/b/x.js"), ("3", "r", "x.js"), ("4", "s", "x.js")]
    rules = [("r", ".gitattributes", "*.js generated\nx.js -generated"), ("r", "a/.gitattributes", "*.js generated"), ("r", "a/b/.gitattributes", "x.js generated=false")]
    got = declared_marks(
        spark.createDataFrame(files, "file_id string, repository_id string, path string"),
        spark.createDataFrame(rules, "repository_id string, path string, text string"),
    )
    assert {(r["file_id"], r["on"]) for r in got.collect()} == {("1", True), ("2", False), ("3", False)}


@pytest.mark.parametrize(
    "text, want",
    [
        (None, None), ("", None), ("x = 1\n", None),
        ("// Code generated by foo. DO NOT EDIT.\npackage x\n", "generated"),
        ("#!/usr/bin/env python\n# A tool\n\n# AUTO-GENERATED on build 7. Any edit is overwritten by the next run.\nx = 1\n", "generated"),
        ("# @license thing 1.2 (vendored, see upstream repository for the sources)\nx = 1\n", "vendored"),
        ("x = 1\n# Code generated by foo. DO NOT EDIT.\n", None),  # not at the top
        ("# Auto-generated method stub, replace the body\nx = 1\n", None),
        ("# This file may be copied and changed by anybody as long as this notice stays\nx = 1\n", None),
        ("T = '" + "aB3+" * 400 + "'\n", "data"),
        ("T = [" + "12, " * 300 + "1]\n", "data"),
        ("!function(e,t){" + "var a=t[1]||e.b(c,2);" * 80 + "}(this);", "minified"),
        ("a()\n//# sourceMappingURL=a.map\n", "minified"),
    ],
)
def test_text_evidence(text, want):
    assert text_evidence(text) == want


def test_long_texts_are_read_once():
    import time

    began = time.time()
    assert text_evidence("X = '" + "deadbeef" * 250_000 + "'\n") == "data"
    assert text_evidence("X = [" + "0xdeadbeef, -1.5e-3, " * 100_000 + "]\n") == "data"
    assert text_evidence("e1" * 500_000) == "minified"
    assert time.time() - began < 10


def test_operator(spark):
    big = 600 * 1024
    rows = [
        ("hand", "r1", "src/a.py", "py", 100, "h1", "SCANNED"), ("min", "r1", "web/a.min.js", "js", 100, "h2", "SCANNED"),
        ("big", "r1", "src/b.go", "go", big, None, "SCANNED"), ("vendor", "r1", ".\\lib\\third_party\\x.ts", "ts", 10, "h3", "SCANNED"),
        ("copy", "r2", "src/x.ts", "ts", 10, "h3", "SCANNED"), ("failed", "r1", "vendor/a.js", "js", big, None, "FAILED"),
        ("doc", "r1", "vendor/a.md", "md", 10, None, "SCANNED"), ("nulls", "r1", None, "py", None, None, "SCANNED"),
        ("decoy", "r1", "src/vendors/min_x.js", "js", 10, "h4", "SCANNED"), ("text", "r2", "src/t.py", "py", 10, "h5", "SCANNED"),
        ("undone", "r3", "vendor/own.go", "go", 10, "h6", "SCANNED"), ("said", "r3", "made/x.go", "go", 10, "h7", "SCANNED"),
    ]
    files = spark.createDataFrame(
        rows, "id string, repository_id string, relative_path string, extension string, size_bytes bigint, sha256 string, scan_status string"
    )
    mined = [(f"m{i}", f"q{i % 4}", f"src/weave/m{i}.py", "py", 10, f"m{i}", "SCANNED") for i in range(12)]
    files = files.unionByName(spark.createDataFrame(mined, files.schema))
    texts = [("text", "r2", "src/t.py", "# @generated by x from y\n"), ("hand", "r1", "src/a.py", "x = 1"), ("att", "r3", ".gitattributes", "vendor/** -vendored\nmade/* generated")]
    texts += [(f"m{i}", f"q{i % 4}", f"src/weave/m{i}.py", "# Code generated by w. DO NOT EDIT.\n") for i in range(8)] + [("null", "r1", "src/n.py", None)]
    hand = [(f"h{i}", "r1", f"src/h{i}.py", "py", 10, f"x{i}", "SCANNED") for i in range(20)]
    files = files.unionByName(spark.createDataFrame(hand, files.schema))
    texts += [(f"h{i}", "r1", f"src/h{i}.py", "x = 1\n") for i in range(20)]
    sources = spark.createDataFrame(texts, "file_id string, repository_id string, relative_path string, source string")
    got = {r["file_id"]: r["reason"] for r in not_hand_written(files, sources, Scratch(spark, "t")).collect()}
    assert {k: v for k, v in got.items() if not k.startswith("m") or k == "min"} == {
        "min": "generated", "big": "oversized", "vendor": "vendored", "copy": "copy", "text": "generated", "said": "declared generated",
    }
    # the directory was mined from the files with notices and reaches those without a text
    assert {f"m{i}" for i in range(12)} <= set(got) and got["m11"].startswith("pattern dir:weave")
    assert not_hand_written(files.limit(0), sources, Scratch(spark, "t")).count() == 0


def test_taken_back_mark_lets_others_apply(spark):
    files = spark.createDataFrame([("1", "r", "vendor/a.js"), ("2", "r", "vendor/b.js")], "file_id string, repository_id string, path string")
    rules = spark.createDataFrame([("r", ".gitattributes", "vendor/* -vendored\nvendor/b.js !vendored")], "repository_id string, path string, text string")
    assert [(r["file_id"], r["on"]) for r in declared_marks(files, rules).collect()] == [("1", False)]


def test_patterns_of_declaring_repositories_reach_the_others(spark):
    names = "id string, repository_id string, relative_path string, extension string, size_bytes bigint, sha256 string, scan_status string"
    rows, texts = [], []
    for r in range(4):
        texts.append((f"att{r}", f"d{r}", ".gitattributes", "**/thirdlib/** linguist-vendored\n*.weave.go linguist-generated"))
        rows += [(f"d{r}v{i}", f"d{r}", f"src/thirdlib/x{i}.py", "py", 9, None, "SCANNED") for i in range(5)]
        rows += [(f"d{r}g{i}", f"d{r}", f"cmd/x{i}.weave.go", "go", 9, None, "SCANNED") for i in range(5)]
        rows += [(f"d{r}h{i}", f"d{r}", f"src/own/x{i}.py", "py", 9, None, "SCANNED") for i in range(20)]
    rows += [("u1", "u", "lib/thirdlib/y.py", "py", 9, None, "SCANNED"), ("u2", "u", "pkg/z.weave.go", "go", 9, None, "SCANNED")]
    rows += [("u3", "u", "src/own/y.py", "py", 9, None, "SCANNED"), ("u4", "u", "pkg/weave.go", "go", 9, None, "SCANNED")]
    # a declaring repository that takes the mark back for a directory of its own
    texts.append(("att9", "d9", ".gitattributes", "lib/thirdlib/** -linguist-vendored"))
    rows.append(("d9v", "d9", "lib/thirdlib/own.py", "py", 9, None, "SCANNED"))
    files = spark.createDataFrame(rows, names)
    sources = spark.createDataFrame(texts, "file_id string, repository_id string, relative_path string, source string")
    got = {r["file_id"]: r["reason"] for r in not_hand_written(files, sources, Scratch(spark, "t"), defaults="").collect()}
    assert got.pop("u1") == "pattern dir:thirdlib" and got.pop("u2") == "pattern end:.weave|go"
    assert set(got) == {f"d{r}{k}{i}" for r in range(4) for k in "vg" for i in range(5)}
