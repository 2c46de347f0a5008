"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.docpairs import function_documentation
from codestrata.llm.leakage import leaked_passages, without_passages
from codestrata.llm.packing import pack, token_counts, tokenizer_path
from codestrata.llm.provenance import not_hand_written
from codestrata.llm.spans import class_members, class_pairs, shared_coverage, shared_pairs, shared_windows
from codestrata.llm.syntax import extension_of, language_of, reports_bad_content, syntax_repairs
from codestrata.operators.merge import latest
from codestrata.sources.scratch import Scratch
from codestrata.sources.tables import read_table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return leaked_passages(docs, read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item: the documents it leaked into and the words found there."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    hits = leaked_passages(docs, read_table(spark, sf_dir, "eval_items"))
    return hits.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest_words")
    )


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the leaked passages."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return without_passages(docs, read_table(spark, sf_dir, "eval_items")).select(
        "doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256")
    )


def _not_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "repository_id", "relative_path", "extension", "size_bytes", "sha256", "scan_status", "updated_at"]
    files = latest(read_table(spark, sf_dir, "repository_files", *cols), ["id"])
    sources = read_table(spark, sf_dir, "source_files", "file_id", "repository_id", "relative_path", "source")
    return not_hand_written(files, sources, Scratch(spark, "provenance"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files that were generated, minified, vendored, or are data."""
    return _not_hand_written(spark, sf_dir).select("file_id").distinct()


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and reason: the files that nobody wrote by hand."""
    found = _not_hand_written(spark, sf_dir)
    return found.groupBy("repository_id", "reason").agg(F.count(F.lit(1)).alias("n_files"))


def _broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, broken, kind, edits) of the files with a text at hand or else a job, which has no edits."""
    sources = read_table(spark, sf_dir, "source_files", "file_id", "relative_path", "source")
    parsed = syntax_repairs(sources, Scratch(spark, "syntax")).select("file_id", (F.col("edits") > 0).alias("broken"), "kind", "edits")
    jobs = latest(read_table(spark, sf_dir, "file_parse_jobs", "file_id", "error_message", "updated_at"), ["file_id"])
    reported = jobs.join(sources.select("file_id"), "file_id", "left_anti").select(
        "file_id", reports_bad_content(F.col("error_message")).alias("broken"), F.lit("reported").alias("kind"), F.lit(None).cast("bigint").alias("edits")
    )
    return parsed.unionByName(reported)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are invalid in the language of their extension."""
    return _broken_files(spark, sf_dir).where("broken").select("file_id").distinct()


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least repair cost and kind of damage of every file with a text."""
    sources = read_table(spark, sf_dir, "source_files", "file_id", "relative_path", "source")
    return syntax_repairs(sources, Scratch(spark, "syntax"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and language of the extension: files checked, broken files and their share."""
    files = latest(read_table(spark, sf_dir, "repository_files", "id", "repository_id", "relative_path", "updated_at"), ["id"])
    known = files.select(
        F.col("id").alias("file_id"), "repository_id", language_of(extension_of(F.col("relative_path"))).alias("language")
    ).where("language is not null")
    rows = _broken_files(spark, sf_dir).join(known, "file_id")
    return rows.groupBy("repository_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("broken"), 1)).alias("n_broken"),
        F.round(F.avg(F.col("broken").cast("double")), 6).alias("broken_share"),
    )


def _documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "source_files", "file_id", "relative_path", "source")
    pairs = function_documentation(files).where("not trivial")
    functions = read_table(
        spark, sf_dir, "function_definitions", "file_id", "qualified_name", "start_line", "function_name", "signature"
    ).distinct()
    return functions.join(pairs, ["file_id", "start_line", "function_name"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded functions with a documentation comment that says something."""
    return _documented(spark, sf_dir).select("file_id", "qualified_name", "start_line").distinct()


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature and description of each documented function."""
    return _documented(spark, sf_dir).select(
        "file_id", "qualified_name", "start_line", "signature", "documentation", "n_words"
    )


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    sizes = scratch.save(token_counts(docs, tokenizer_path()))
    return pack(sizes, read_table(spark, sf_dir, "context_windows"), scratch)


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its bin, for each context window."""
    return _packing(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per context window: bins, tokens, and the share of room left unused."""
    windows = read_table(spark, sf_dir, "context_windows")
    bins = _packing(spark, sf_dir).groupBy("window_name", "bin").agg(F.sum("n_tokens").alias("fill"))
    per = bins.groupBy("window_name").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("fill").alias("n_tokens"))
    return per.join(F.broadcast(windows), "window_name").select(
        "window_name", "n_bins", "n_tokens",
        F.round(1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return shared_windows(read_table(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark, "spans"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a run of at least 400 characters."""
    return shared_pairs(*_windows(spark, sf_dir))


def p9_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts that share a run of at least 400 characters, each named by its smallest document."""
    return class_pairs(_windows(spark, sf_dir)[0])


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of at least 400 characters: the class of its text, copies, and other texts it shares a run with."""
    return class_members(*_windows(spark, sf_dir))


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its length and how many of its characters lie in runs found in other documents."""
    return shared_coverage(*_windows(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p5_found, p5_kinds, p5_rates, p6_found, p6_pairs, p7_packing, p7_fill, p8_found, p8_leaked_items, p8_cleaned, p9_found, p9_class_pairs, p9_classes, p9_coverage)}

_GRAMS = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
hit AS (SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig ON dg.g = ig.g)
"""

_PLACES = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT id, p, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
hit AS (SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id, dg.p FROM dg JOIN ig ON dg.g = ig.g)
"""

_SHARED = r"""
WITH docs AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 400),
same AS (SELECT text, min(doc_id) AS rep, count(*) AS n_copies FROM docs GROUP BY text),
win AS (SELECT rep, p, md5(substr(text, p, 400)) AS h FROM (SELECT rep, text, unnest(range(1, length(text) - 398)) AS p FROM same)),
shared AS (SELECT h FROM win GROUP BY h HAVING count(DISTINCT rep) > 1),
member AS (SELECT DISTINCT h, rep FROM win WHERE h IN (SELECT h FROM shared)),
linked AS (SELECT DISTINCT a.rep AS class_a, b.rep AS class_b FROM member a JOIN member b ON a.h = b.h AND a.rep < b.rep),
cls AS (SELECT d.doc_id, d.n, s.rep, s.n_copies FROM docs d JOIN same s ON d.text = s.text)
"""

SQL: dict[str, str] = {
    "p8_found": _GRAMS + "SELECT doc_id, item_id FROM hit",
    "p8_leaked_items": _PLACES
    + """, cov AS (SELECT doc_id, item_id, CAST(count(DISTINCT w) AS INTEGER) AS n_words
  FROM (SELECT doc_id, item_id, unnest(range(p, p + 12)) AS w FROM hit) GROUP BY doc_id, item_id)
SELECT item_id, count(*) AS n_documents, max(n_words) AS longest_words FROM cov GROUP BY item_id""",
    "p8_cleaned": _PLACES
    + r""", tok AS (SELECT id, t, i, w, t SIMILAR TO '[\p{L}\p{N}].*' AS is_word FROM (
  SELECT doc_id AS id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')) AS t, unnest(range(1, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')) + 1)) AS i, 0 AS w
  FROM documents WHERE doc_id IN (SELECT doc_id FROM hit))),
num AS (SELECT id, t, i, is_word, sum(CASE WHEN is_word THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS w FROM tok),
gone AS (SELECT DISTINCT num.id, num.i FROM num JOIN (SELECT DISTINCT doc_id, p FROM hit) h
  ON num.id = h.doc_id AND num.w >= h.p AND (CASE WHEN is_word THEN num.w <= h.p + 11 ELSE num.w <= h.p + 10 END)),
kept AS (SELECT id, coalesce(string_agg(t, '' ORDER BY i), '') AS text FROM num WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = num.id AND gone.i = num.i) GROUP BY id)
SELECT d.doc_id, CASE WHEN h.doc_id IS NULL THEN 0 ELSE CAST(length(d.text) - length(coalesce(k.text, '')) AS INTEGER) END AS n_removed,
  sha256(CASE WHEN h.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END) AS text_sha256
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM hit) h ON d.doc_id = h.doc_id LEFT JOIN kept k ON d.doc_id = k.id""",
    "p9_class_pairs": _SHARED + "SELECT class_a, class_b FROM linked",
    "p9_found": _SHARED
    + """SELECT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b
FROM linked JOIN cls a ON a.rep = class_a JOIN cls b ON b.rep = class_b
UNION SELECT a.doc_id, b.doc_id FROM cls a JOIN cls b ON a.rep = b.rep AND a.doc_id < b.doc_id""",
    "p9_classes": _SHARED
    + """, links AS (SELECT rep, count(*) AS n_links FROM (SELECT class_a AS rep FROM linked UNION ALL SELECT class_b FROM linked) GROUP BY rep)
SELECT doc_id, cls.rep AS class_id, n_copies, coalesce(n_links, 0) AS n_links FROM cls LEFT JOIN links ON cls.rep = links.rep""",
    "p9_coverage": _SHARED
    + """, cov AS (SELECT rep, CAST(sum(len) AS BIGINT) AS covered FROM (
  SELECT rep, least(400, coalesce(lead(p) OVER (PARTITION BY rep ORDER BY p) - p, 400)) AS len FROM win WHERE h IN (SELECT h FROM shared)) GROUP BY rep)
SELECT doc_id, n AS n_chars, CASE WHEN n_copies > 1 THEN n ELSE coalesce(covered, 0) END AS shared_chars FROM cls LEFT JOIN cov ON cls.rep = cov.rep""",
}
