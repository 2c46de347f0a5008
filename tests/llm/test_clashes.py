"""Extra columns whose names the operators use themselves change nothing."""

from pyspark.sql import functions as F

from codestrata.llm.docpairs import function_documentation
from codestrata.llm.leakage import leaked_passages, without_passages
from codestrata.llm.packing import pack, token_counts, tokenizer_path
from codestrata.llm.provenance import not_hand_written
from codestrata.llm.spans import shared_pairs, shared_windows
from codestrata.llm.syntax import syntax_repairs
from codestrata.sources.scratch import Scratch


def _with(df, *names):
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


def test_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = _with(
        spark.createDataFrame([(1, words), (2, words + " more"), (3, None)], "doc_id bigint, text string"),
        "digest", "anchor", "rep", "pos", "piece", "item_id", "n_words", "_cut", "n_removed", "n_tokens", "size", "window_name", "group", "shard", "n_chars",
    )
    items = _with(spark.createDataFrame([(7, words)], "item_id bigint, text string"), "doc_id", "suite", "n_words")
    assert sorted((r[0], r[1]) for r in leaked_passages(docs, items).select("doc_id", "item_id").collect()) == [(1, 7), (2, 7)]
    assert without_passages(docs, items).where("n_removed > 0").count() == 2
    windows, classes = shared_windows(docs, Scratch(spark, "t"), min_chars=60, gram=16)
    assert [tuple(r) for r in shared_pairs(windows, classes).collect()] == [(1, 2)]
    sizes = token_counts(docs, tokenizer_path())
    bins = _with(spark.createDataFrame([("s", 64)], "window_name string, capacity_tokens int"), "capacity", "item", "bin")
    assert pack(_with(sizes, "item", "bin", "g", "fill", "w", "capacity"), bins, Scratch(spark, "t")).select("doc_id").distinct().count() == 2
    src = _with(
        spark.createDataFrame([("f", "r", "a.py", 'def f():\n    """Turns the raw rows into one table per region"""\n')], "file_id string, repository_id string, relative_path string, source string"),
        "lang", "what", "start", "tokens", "edits", "kind", "extension", "documentation", "n_words", "known", "shown", "path", "text", "mark", "reason",
    )
    assert [r["edits"] for r in syntax_repairs(src, Scratch(spark, "t")).collect()] == [0]
    assert function_documentation(src).count() == 1
    files = _with(
        spark.createDataFrame([("f", "r", "vendor/a.py", "py", 5, "h", "SCANNED")], "id string, repository_id string, relative_path string, extension string, size_bytes bigint, sha256 string, scan_status string"),
        "file_id", "path", "hard", "default", "mined", "feature", "declared", "spoken", "reason", "known", "shown", "source",
    )
    assert [r["reason"] for r in not_hand_written(files, src, Scratch(spark, "t")).collect()] == ["vendored"]
