"""Queries on files, jobs, index entries and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import files as X
from codestrata.functions import names as N
from codestrata.operators import index as I
from codestrata.operators import scan as S
from codestrata.operators.merge import batched_upsert_winners, duplicate_stats, keep_first, latest, upsert
from codestrata.sources.tables import read_table

FILE_COLUMNS = [
    "id", "repository_id", "relative_path", "file_name", "extension", "language", "mime_type", "size_bytes", "sha256", "is_binary",
    "is_hidden", "scan_status", "updated_at",
]
ENTRY_COLUMNS = [
    "id", "repository_id", "file_id", "language", "symbol_type", "name", "qualified_name", "parent_symbol_id", "documentation",
    "visibility", "start_line", "end_line", "created_at", "updated_at",
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read_table(spark, sf_dir, "repository_files", *FILE_COLUMNS), ["id"])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read_table(spark, sf_dir, "symbol_index_entries", *ENTRY_COLUMNS), ["id"])


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read_table(spark, sf_dir, "repositories"), ["id"])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "file_id", "repository_id", "parse_status", "language", "symbol_count", "call_count", "function_count", "class_count", "updated_at"]
    return latest(read_table(spark, sf_dir, "file_parse_jobs", *cols), ["file_id"])


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function records, exact repeats once, with the path of their file."""
    f = read_table(spark, sf_dir, "function_definitions").drop("parameters", "decorators", "created_at").distinct()
    return f.join(files(spark, sf_dir).select(F.col("id").alias("file_id"), "relative_path"), "file_id")


def lang_stats(spark, sf_dir):
    return S.language_stats(files(spark, sf_dir))


def lang_top8(spark, sf_dir):
    return S.top_languages(S.language_stats(files(spark, sf_dir)))


def scan_summary(spark, sf_dir):
    return S.scan_summary(files(spark, sf_dir))


def _scan_rows(f: DataFrame) -> DataFrame:
    name = X.file_name(F.col("relative_path"))
    return f.select("id", name.alias("name")).withColumn("ext", X.extension(F.col("name"))).select(
        "id", "name", "ext", X.language(F.col("name"), F.col("ext")).alias("language"), X.mime_type(F.col("ext")).alias("mime_type"),
        F.col("ext").isin(X.IGNORED_EXTENSIONS).alias("is_ignored"),
    )


def scan_rows(spark, sf_dir):
    """Metadata derived from the path of every file row whose path is written with slashes; ``scan_rows_all`` has the others too."""
    return _scan_rows(files(spark, sf_dir).where(~F.col("relative_path").contains("\\")))


def scan_rows_all(spark, sf_dir):
    """Metadata derived from the path of every file row."""
    return _scan_rows(files(spark, sf_dir))


def scan_texts(spark, sf_dir):
    """Size, hash and binary flag of the texts at hand, from their bytes."""
    s = read_table(spark, sf_dir, "source_files", "file_id", "source").where("source is not null")
    body = F.encode("source", "UTF-8")
    s = s.withColumn("is_binary", X.is_binary(F.lit("txt"), body))
    return s.select("file_id", F.octet_length("source").cast("bigint").alias("size_bytes"), X.sha256_of(body, F.col("is_binary")).alias("sha256"), "is_binary")


def decoded_texts(spark, sf_dir):
    """Texts read back from bytes, Latin-1 where all characters are of that set and UTF-8 elsewhere, without being told which."""
    s = read_table(spark, sf_dir, "source_files", "file_id", "source").where("source is not null")
    narrow = F.col("source").rlike(r"^[\x00-\xff]*$")
    body = F.when(narrow, F.encode("source", "ISO-8859-1")).otherwise(F.encode("source", "UTF-8"))
    text = X.decoded(body)
    return s.select("file_id", F.char_length(text).cast("bigint").alias("n_chars"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"))


def dir_nodes(spark, sf_dir):
    return S.ancestor_directories(files(spark, sf_dir)).select("repository_id", "directory", "name", F.col("depth").cast("bigint").alias("depth"))


def dir_tree(spark, sf_dir):
    return S.directory_tree(files(spark, sf_dir))


def files_parseable(spark, sf_dir):
    return S.parseable(files(spark, sf_dir)).select("id", "repository_id", "relative_path", "language")


def files_page(spark, sf_dir):
    """The second page of the files in order of repository and path."""
    return I.page(files(spark, sf_dir), ["repository_id", "relative_path", "id"], limit=100, offset=100).select("id", "repository_id", "relative_path")


def file_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("repository_id", "scan_status").agg(F.count(F.lit(1)).alias("n_files"))


def human_sizes(spark, sf_dir):
    return files(spark, sf_dir).select("id", X.human_bytes(F.coalesce("size_bytes", F.lit(0))).alias("size"), X.short_sha(F.col("sha256")).alias("sha"))


def job_progress(spark, sf_dir):
    """Per repository: latest jobs by status, absent statuses as 0, and the overall state."""
    s = F.col("parse_status")
    counts = [F.count(F.when(s == v, 1)).alias(v.lower()) for v in ("QUEUED", "PARSING", "COMPLETED", "FAILED")]
    per = jobs(spark, sf_dir).groupBy("repository_id").agg(*counts)
    total = F.col("queued") + F.col("parsing") + F.col("completed") + F.col("failed")
    overall = (
        F.when(total == 0, "NOT_STARTED").when(F.col("queued") + F.col("parsing") > 0, "PARSING")
        .when(F.col("failed") == total, "FAILED").otherwise("COMPLETED")
    )
    return per.withColumn("overall", overall)


def job_sums(spark, sf_dir):
    j = jobs(spark, sf_dir).where("parse_status = 'COMPLETED'")
    return j.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("symbol_count", "call_count", "function_count", "class_count")],
    )


def repositories_newest(spark, sf_dir):
    """Registered repositories, newest first, with owner and name taken from their address."""
    r = repositories(spark, sf_dir)
    url = F.regexp_replace(F.trim("github_url"), r"\.git$", "")
    rx = r"^https://github\.com/([^/]+)/([^/]+)$"
    return r.orderBy(F.desc("created_at"), "id").select(
        "id", "full_name", F.regexp_extract(url, rx, 1).alias("owner_part"), F.regexp_extract(url, rx, 2).alias("name_part"),
        url.rlike(rx).alias("is_valid"), F.coalesce(F.nullif("default_branch", F.lit("")), F.lit("main")).alias("branch"),
    )


def repositories_duplicates(spark, sf_dir):
    return duplicate_stats(read_table(spark, sf_dir, "repositories", "id", "language"), ["id"], ["language"])


def entries_filtered(spark, sf_dir):
    """First page of the Python classes in order of qualified name."""
    return I.page(entries(spark, sf_dir), ["qualified_name", "id"], limit=500, language="Python", symbol_type="class").select("id", "qualified_name")


def entries_by_filename(spark, sf_dir):
    """Entries of the files whose name holds a word."""
    f = files(spark, sf_dir).where(F.lower("file_name").contains("ledger")).select(F.col("id").alias("file_id"), "file_name")
    return entries(spark, sf_dir).join(f, "file_id").select("id", "qualified_name", "file_name")


def search_prefix(spark, sf_dir):
    return I.search(entries(spark, sf_dir), "Fetch", "prefix").select("id", "name", "qualified_name")


def search_exact(spark, sf_dir):
    return I.search(entries(spark, sf_dir), "merge", "exact").select("id", "name", "qualified_name")


def search_qualified(spark, sf_dir):
    return I.search(entries(spark, sf_dir), "ledger", "qualified", symbol_type="method").select("id", "name", "qualified_name")


def children(spark, sf_dir):
    e = entries(spark, sf_dir)
    up = e.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("parent"))
    return e.join(up, "parent_symbol_id").select("parent", "name", "id")


def entry_counts(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("repository_id", "language", "symbol_type").agg(F.count(F.lit(1)).alias("n_entries"))


def entry_flags(spark, sf_dir):
    """Names and flags derived from each entry."""
    q, n = F.col("qualified_name"), F.col("name")
    return entries(spark, sf_dir).select(
        "id", N.last_segment(q).alias("short"), N.display_name(q).alias("display"), N.module_prefix(q, n).alias("module"),
        N.parent_name(q).alias("parent"), (F.col("visibility") == "public").alias("is_exported"), N.is_deprecated(F.col("documentation")).alias("is_deprecated"),
        F.coalesce(F.length(F.substring("documentation", 1, 500)), F.lit(0)).cast("bigint").alias("doc_chars"), N.node_label(F.col("symbol_type")).alias("label"),
    )


def names_normalised(spark, sf_dir):
    """Normal form and validity of the callers' names."""
    c = read_table(spark, sf_dir, "calls", "caller_name").where("caller_name is not null").distinct()
    return c.select("caller_name", N.normalise(F.col("caller_name")).alias("normal"), N.is_valid(F.col("caller_name")).alias("is_valid"))


def modules(spark, sf_dir):
    """Module names of the files whose path is written with slashes; ``modules_all`` has the others too."""
    f = files(spark, sf_dir).where(~F.col("relative_path").contains("\\") & F.col("language").isNotNull())
    return f.select("id", N.module_of(F.col("relative_path"), F.col("language")).alias("module"))


def modules_all(spark, sf_dir):
    """Module names of all files with a language."""
    f = files(spark, sf_dir).where(F.col("language").isNotNull())
    return f.select("id", N.module_of(F.col("relative_path"), F.col("language")).alias("module"))


def dedup_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return keep_first(d, ["digest"], ["doc_id"]).select("doc_id")


def dedup_stats(spark, sf_dir):
    return duplicate_stats(read_table(spark, sf_dir, "calls", "id", "language"), ["id"], ["language"])


def upsert_batches(spark, sf_dir):
    """Winner per (repository, qualified name) of the function records, loaded in batches of 20 files."""
    f = functions(spark, sf_dir).select("repository_id", "relative_path", "qualified_name", "start_line", "id")
    return batched_upsert_winners(f, "repository_id", "relative_path", ["repository_id", "qualified_name"], ["start_line", "id"]).select("id", "qualified_name")


def index_functions(spark, sf_dir):
    """Function records as linked index entries."""
    e = I.map_functions(functions(spark, sf_dir)).withColumn("source_rank", F.lit(0))
    linked = I.link_parents(I.index_entries(e))
    return linked.select("id", "qualified_name", "symbol_type", "display_name", "is_exported", "parent_symbol_id")


def parent_link(spark, sf_dir):
    """Index entries with the parent that their qualified name asks for, the least id per name."""
    e = entries(spark, sf_dir).where("qualified_name is not null")
    one = keep_first(e.select("repository_id", "qualified_name", "id"), ["repository_id", "qualified_name"], ["id"])
    return I.link_parents(one).select("id", "parent_symbol_id")


def upsert_files(spark, sf_dir):
    """The first file rows after an upsert of the later ones, by key."""
    f = read_table(spark, sf_dir, "repository_files", "id", "size_bytes", "scan_status", "updated_at", "created_at")
    old = latest(f.where("updated_at < timestamp '2024-06-01'"), ["id"])
    new = latest(f.where("updated_at >= timestamp '2024-06-01'"), ["id"])
    return upsert(old, new, ["id"]).select("id", "size_bytes", "scan_status")


_NAMES = """lang_stats lang_top8 scan_summary scan_rows scan_rows_all scan_texts decoded_texts dir_nodes dir_tree files_parseable files_page file_counts human_sizes job_progress job_sums
repositories_newest repositories_duplicates entries_filtered entries_by_filename search_prefix search_exact search_qualified children entry_counts
entry_flags names_normalised modules modules_all dedup_documents dedup_stats upsert_batches index_functions parent_link upsert_files"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}


def current(table: str, alias: str, key: str = "id") -> str:
    """CTE of the current rows of a table."""
    return f"{alias} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY updated_at DESC) AS rn FROM {table}) WHERE rn = 1)"


F_ = "WITH " + current("repository_files", "f")
E_ = "WITH " + current("symbol_index_entries", "e")
R_ = "WITH " + current("repositories", "r")
J_ = "WITH " + current("file_parse_jobs", "j", "file_id")
_LANG = ",\nl AS (SELECT repository_id, language, count(*) AS file_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM f WHERE scan_status = 'SCANNED' GROUP BY 1, 2)"
_DIRS = ",\np AS (SELECT repository_id, string_split(relative_path, '/') AS a{more} FROM f{where}),\nd AS (SELECT DISTINCT repository_id, array_to_string(a[1:k], '/') AS directory FROM (SELECT repository_id, a, unnest(range(1, len(a))) AS k FROM p))"


def _case(table: dict[str, list[str]], key: str, default: str) -> str:
    rows = [f"WHEN {key} IN ({', '.join(repr(k) for k in keys)}) THEN '{value}'" for value, keys in table.items()]
    return "CASE " + " ".join(rows) + f" ELSE '{default}' END"


_EXT = "CASE WHEN name NOT LIKE '%.%' OR regexp_matches(name, '^\\.[^.]*$') THEN '' WHEN regexp_matches(lower(name), '^.+\\.d\\.ts$') THEN 'd.ts' ELSE lower(string_split(name, '.')[-1]) END"
_SEARCH = "SELECT id, name, qualified_name FROM e WHERE {} ORDER BY qualified_name, id LIMIT 50"
_PARENT = "nullif(regexp_extract(qualified_name, '^(.*)\\.[^.]*$', 1), '')"
_DISPLAY = "regexp_extract(qualified_name, '([^.]*\\.)?[^.]*$', 0)"
_FD = "fd AS (SELECT DISTINCT * EXCLUDE (parameters, decorators, created_at) FROM function_definitions),\ng AS (SELECT fd.*, f.relative_path FROM fd JOIN f ON fd.file_id = f.id)"
_WIN = """,
b AS (SELECT repository_id, relative_path, floor((row_number() OVER (PARTITION BY repository_id ORDER BY relative_path) - 1) / 20) AS batch FROM (SELECT DISTINCT repository_id, relative_path FROM g)),
w AS (SELECT g.*, row_number() OVER (PARTITION BY g.repository_id, qualified_name ORDER BY batch DESC, g.relative_path, {order}) AS wn
  FROM g JOIN b ON g.repository_id = b.repository_id AND g.relative_path = b.relative_path)"""

SQL = {
    "lang_stats": F_ + _LANG + " SELECT *, round(file_count * 100.0 / CAST(sum(file_count) OVER (PARTITION BY repository_id) AS DOUBLE), 2) AS percentage FROM l",
    "lang_top8": F_ + _LANG + " SELECT repository_id, CASE WHEN r <= 8 THEN language ELSE 'Other' END AS language, CAST(sum(file_count) AS BIGINT) AS file_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY file_count DESC, language) AS r FROM l) GROUP BY 1, 2",
    "scan_summary": F_ + " SELECT repository_id, count(*) AS total_files, count(*) FILTER (scan_status = 'SCANNED') AS scanned_files, count(*) FILTER (scan_status = 'IGNORED') AS ignored_files, count(*) FILTER (scan_status = 'FAILED') AS failed_files, count(*) FILTER (scan_status = 'SCANNED' AND is_binary) AS binary_files, count(*) FILTER (is_hidden) AS hidden_files, CAST(coalesce(sum(size_bytes) FILTER (scan_status = 'SCANNED'), 0) AS BIGINT) AS total_bytes, count(DISTINCT language) FILTER (scan_status = 'SCANNED') AS n_languages FROM f GROUP BY 1",
    "scan_rows": F_ + f", n AS (SELECT id, string_split(relative_path, '/')[-1] AS name FROM f WHERE relative_path NOT LIKE '%\\%'), x AS (SELECT *, {_EXT} AS ext FROM n) SELECT id, name, ext, CASE WHEN lower(name) = 'dockerfile' OR lower(name) LIKE 'dockerfile.%' THEN 'Dockerfile' ELSE {_case(X.LANGUAGE_EXTENSIONS, 'ext', 'Unknown')} END AS language, {_case(X.MIME_EXTENSIONS, 'ext', X.DEFAULT_MIME)} AS mime_type, ext IN ({', '.join(repr(x) for x in X.IGNORED_EXTENSIONS)}) AS is_ignored FROM x",
    "scan_texts": "SELECT file_id, CAST(strlen(source) AS BIGINT) AS size_bytes, CASE WHEN strlen(source) > 0 THEN sha256(source) END AS sha256, false AS is_binary FROM source_files WHERE source IS NOT NULL",
    "decoded_texts": "SELECT file_id, CAST(length(source) AS BIGINT) AS n_chars, md5(source) AS text_md5 FROM source_files WHERE source IS NOT NULL",
    "dir_nodes": F_ + _DIRS.format(more="", where="") + " SELECT repository_id, directory, string_split(directory, '/')[-1] AS name, len(string_split(directory, '/')) AS depth FROM d WHERE directory <> ''",
    "dir_tree": F_ + _DIRS.format(more="", where=" WHERE scan_status = 'SCANNED'") + " SELECT repository_id, regexp_extract(directory, '^(.*)/[^/]*$', 1) AS parent_path, directory AS path, string_split(directory, '/')[-1] AS name, false AS is_file, CAST(NULL AS VARCHAR) AS language, CAST(0 AS BIGINT) AS size_bytes FROM d WHERE directory <> '' UNION ALL SELECT repository_id, regexp_extract(relative_path, '^(.*)/[^/]*$', 1), relative_path, file_name, true, language, size_bytes FROM f WHERE scan_status = 'SCANNED'",
    "files_parseable": F_ + " SELECT id, repository_id, relative_path, language FROM f WHERE scan_status = 'SCANNED' AND language IN ('Python', 'JavaScript', 'TypeScript', 'Java', 'Go') AND NOT is_binary",
    "files_page": F_ + " SELECT id, repository_id, relative_path FROM f ORDER BY repository_id, relative_path, id LIMIT 100 OFFSET 100",
    "file_counts": F_ + " SELECT repository_id, scan_status, count(*) AS n_files FROM f GROUP BY 1, 2",
    "human_sizes": F_ + ", s AS (SELECT id, sha256, coalesce(size_bytes, 0) AS b FROM f) SELECT id, CASE WHEN b < 1024 THEN printf('%.1f B', CAST(b AS DOUBLE)) WHEN b < 1048576 THEN printf('%.1f KB', round(b / CAST(1024.0 AS DOUBLE), 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round(b / CAST(1048576.0 AS DOUBLE), 1)) ELSE printf('%.1f GB', round(b / CAST(1073741824.0 AS DOUBLE), 1)) END AS size, substring(sha256, 1, 8) AS sha FROM s",
    "job_progress": J_ + ", c AS (SELECT repository_id, count(*) FILTER (parse_status = 'QUEUED') AS queued, count(*) FILTER (parse_status = 'PARSING') AS parsing, count(*) FILTER (parse_status = 'COMPLETED') AS completed, count(*) FILTER (parse_status = 'FAILED') AS failed FROM j GROUP BY 1) SELECT *, CASE WHEN queued + parsing + completed + failed = 0 THEN 'NOT_STARTED' WHEN queued + parsing > 0 THEN 'PARSING' WHEN failed = queued + parsing + completed + failed THEN 'FAILED' ELSE 'COMPLETED' END AS overall FROM c",
    "job_sums": J_ + " SELECT repository_id, count(*) AS n_files, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("symbol_count", "call_count", "function_count", "class_count")) + " FROM j WHERE parse_status = 'COMPLETED' GROUP BY 1",
    "repositories_newest": R_ + ", u AS (SELECT *, regexp_replace(trim(github_url), '\\.git$', '') AS url FROM r) SELECT id, full_name, regexp_extract(url, '^https://github\\.com/([^/]+)/([^/]+)$', 1) AS owner_part, regexp_extract(url, '^https://github\\.com/([^/]+)/([^/]+)$', 2) AS name_part, regexp_matches(url, '^https://github\\.com/([^/]+)/([^/]+)$') AS is_valid, coalesce(nullif(default_branch, ''), 'main') AS branch FROM u",
    "repositories_duplicates": "SELECT language, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_keys, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS colliding_keys FROM (SELECT language, id, count(*) AS n FROM repositories GROUP BY 1, 2) GROUP BY 1",
    "entries_filtered": E_ + " SELECT id, qualified_name FROM e WHERE language = 'Python' AND symbol_type = 'class' ORDER BY qualified_name, id LIMIT 500",
    "entries_by_filename": F_ + ", " + current("symbol_index_entries", "e") + " SELECT e.id, qualified_name, file_name FROM e JOIN f ON e.file_id = f.id WHERE lower(file_name) LIKE '%ledger%'",
    "search_prefix": E_ + _SEARCH.format("lower(name) LIKE 'fetch%'"),
    "search_exact": E_ + _SEARCH.format("lower(name) = 'merge'"),
    "search_qualified": E_ + _SEARCH.format("lower(qualified_name) LIKE '%ledger%' AND symbol_type = 'method'"),
    "children": E_ + " SELECT p.name AS parent, c.name, c.id FROM e c JOIN e p ON c.parent_symbol_id = p.id",
    "entry_counts": E_ + " SELECT repository_id, language, symbol_type, count(*) AS n_entries FROM e GROUP BY 1, 2, 3",
    "entry_flags": E_ + f" SELECT id, string_split(qualified_name, '.')[-1] AS short, {_DISPLAY} AS display, CASE WHEN qualified_name <> name AND ends_with(qualified_name, '.' || name) THEN substring(qualified_name, 1, length(qualified_name) - length(name) - 1) END AS module, {_PARENT} AS parent, visibility = 'public' AS is_exported, coalesce(documentation LIKE '%deprecated%' OR documentation LIKE '%DEPRECATED%' OR documentation LIKE '%@Deprecated%', false) AS is_deprecated, CAST(coalesce(length(substring(documentation, 1, 500)), 0) AS BIGINT) AS doc_chars, " + _case({b: [a for a, c in N.NODE_LABELS.items() if c == b] for b in N.NODE_LABELS.values()}, "symbol_type", "Variable") + " AS label FROM e",
    "names_normalised": r"SELECT DISTINCT caller_name, regexp_replace(regexp_replace(regexp_replace(caller_name, '^\s+|\s+$', '', 'g'), '^\.+|\.+$', '', 'g'), '\.{2,}', '.', 'g') AS normal, regexp_matches(regexp_replace(caller_name, '^\s+|\s+$', '', 'g'), '^[\p{L}\p{N}_.\-/()*]+$') AS is_valid FROM calls WHERE caller_name IS NOT NULL",
    "modules": F_ + r", s AS (SELECT id, language, regexp_replace(relative_path, '([^/])\.[^./]*$', '\1') AS stem FROM f WHERE relative_path NOT LIKE '%\%' AND language IS NOT NULL) SELECT id, CASE WHEN lower(language) = 'go' THEN stem ELSE array_to_string(list_filter(string_split(stem, '/'), lambda p: p <> '' AND p <> '.'), '.') END AS module FROM s",
    "dedup_documents": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
    "dedup_stats": "SELECT language, CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_keys, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS colliding_keys FROM (SELECT language, id, count(*) AS n FROM calls GROUP BY 1, 2) GROUP BY 1",
    "upsert_batches": F_ + ",\n" + _FD + _WIN.format(order="start_line, id") + " SELECT id, qualified_name FROM w WHERE wn = 1",
    "index_functions": F_ + ",\n" + _FD + _WIN.format(order="start_line, id") + f", x AS (SELECT repository_id, qualified_name, CASE WHEN is_constructor THEN 'constructor' WHEN is_method THEN 'method' ELSE 'function' END AS symbol_type, visibility, sha256(repository_id || '::' || qualified_name) AS id, {_PARENT} AS pn FROM w WHERE wn = 1) SELECT x.id, x.qualified_name, x.symbol_type, regexp_extract(x.qualified_name, '([^.]*\\.)?[^.]*$', 0) AS display_name, x.visibility = 'public' AS is_exported, p.id AS parent_symbol_id FROM x LEFT JOIN x p ON x.repository_id = p.repository_id AND x.pn = p.qualified_name",
    "parent_link": E_ + f", o AS (SELECT repository_id, qualified_name, min(id) AS id, {_PARENT} AS pn FROM e WHERE qualified_name IS NOT NULL GROUP BY 1, 2) SELECT o.id, p.id AS parent_symbol_id FROM o LEFT JOIN o p ON o.repository_id = p.repository_id AND o.pn = p.qualified_name",
    "upsert_files": F_ + " SELECT id, size_bytes, scan_status FROM f",
}
for _name, _filter in (("scan_rows", " WHERE relative_path NOT LIKE '%\\%'"), ("modules", "relative_path NOT LIKE '%\\%' AND ")):
    SQL[f"{_name}_all"] = SQL[_name].replace(_filter, "").replace("relative_path", "replace(relative_path, '\\', '/')")
