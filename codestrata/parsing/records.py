"""Functions, classes, imports, calls, routes and comments from source files.

The sources become a table of lines.  Declarations are found by one expression per language, and
what a line belongs to (the enclosing class or function, an open block comment) by windows over the
lines of its file, so Spark partitions the work by file.  Only calls are read in Python, a file at a
time, as the object of a call has to be followed back over brackets and lines.  Declarations must
stand at the beginning of a line, as formatted code has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.parsing import chains

#: Per language: (function, class, import) expressions; groups are read by the functions below.
_FUNCTION = {
    "Python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    "JavaScript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(",
    "Java": r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+(?:<[^>]*>\s*)?(?:[\w.<>,?\[\] ]+\s+)?(\w+)\s*\(",
    "Go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]",
}
_ARROW = r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[^=]+)?=>"
_METHOD = r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{\s*$"
_NOT_METHODS = ["if", "for", "while", "switch", "catch", "function", "return", "else", "do", "try", "with"]
_CLASS = {
    "Python": r"^\s*class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:",
    "JavaScript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+([\w., ]+?))?(?:\s+implements\s+[\w., ]+)?\s*\{",
    "Java": r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)[^{]*?(?:\s+extends\s+([\w., ]+?))?(?:\s+implements\s+[\w., ]+)?\s*\{",
    "Go": r"^type\s+(\w+)()\s+(?:struct|interface)\b",
}
_IMPORT = {
    "Python": r"^\s*(?:from\s+(\S+)\s+import\b|import\s+([\w.]+))",
    "JavaScript": r"^\s*(?:import\b.*?\bfrom\s*['\"]([^'\"]+)['\"]|import\s*['\"]([^'\"]+)['\"])",
    "Java": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*()?;",
    "Go": r"^(?:import\s+(?:\w+\s+)?\"([^\"]+)\"|\s+(?:[\w.]+\s+)?\"([^\"]+)\"\s*$)",
}
_ROUTE = (
    r"^\s*@(?:\w+)\.(get|post|put|delete|patch|head|options|route)\(\s*['\"]([^'\"]+)['\"]"
    r"|^\s*@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(\s*(?:value\s*=\s*)?['\"]([^'\"]*)['\"])?"
    r"|^\s*(?:app|router|r|e|group|server)\.(get|post|put|delete|patch|use|all|GET|POST|PUT|DELETE|PATCH)\(\s*['\"]([^'\"]+)['\"]"
)
_METHOD_HEAD = r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*\w+\s*\("
_ARROW_HEAD = r"^\s*(?:export\s+)?(?:const|let|var)\s+\w+\s*(?::[^=]+)?=\s*(?:async\b)?"
_KEYWORDS = (
    "if for while switch catch return function def class func elif with assert super await yield print raise throw new and or not in is lambda del except"
).split()


def _by_language(table: dict[str, str], text: Column, group: int) -> Column:
    out = F.lit("")
    for lang, rx in table.items():
        here = F.col("language").isin("JavaScript", "TypeScript") if lang == "JavaScript" else F.col("language") == lang
        out = F.when(here, F.regexp_extract(text, rx, group)).otherwise(out)
    return F.nullif(out, F.lit(""))


def source_lines(sources: DataFrame) -> DataFrame:
    """(file_id, repository_id, relative_path, language, line, text, code, comment).

    ``code`` is the line with its strings emptied and its comments cut; lines inside of block comments
    and docstrings have none.  Null sources give no lines.
    """
    rows = sources.where("source is not null").select(
        "file_id", "repository_id", "relative_path", "language", F.posexplode(F.split(F.regexp_replace("source", "﻿", ""), r"\r?\n")).alias("line", "text")
    )
    rows = rows.withColumn("line", F.col("line") + 1)
    python = F.col("language") == "Python"
    # possessive, so that a long string costs no stack
    bare = F.regexp_replace(F.col("text"), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|' + r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", '""')
    # Python: single quotes only, as triple ones are counted below
    plain = "|".join(rf"(?<!{q}){q}(?!{q})[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}(?!{q})" for q in "\"'")
    python_bare = F.regexp_replace(F.regexp_replace(F.col("text"), plain, "_s_"), r"#.*$", "")
    bare = F.when(python, python_bare).otherwise(F.regexp_replace(bare, r"//.*$", ""))
    count = lambda c, rx: F.size(F.split(c, rx)) - 1
    rows = rows.withColumn("_bare", bare)
    quotes = count(F.col("_bare"), r"\"\"\"|'''")
    turn = F.when(python, quotes).otherwise(count(F.col("_bare"), r"/\*") - count(F.col("_bare"), r"\*/"))
    earlier = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_open", F.coalesce(F.sum(turn).over(earlier), F.lit(0)))
    inside = F.when(python, F.col("_open") % 2 == 1).otherwise(F.col("_open") > 0)
    mark = F.trim("text").rlike(r"^(?:#|//|/\*|\*|\"\"\"|''')")
    code = F.when(python, F.regexp_replace("_bare", r"(?:\"\"\"|''')[\s\S]*$", "")).otherwise(F.regexp_replace("_bare", r"/\*.*?(?:\*/|$)", ""))
    return rows.select(
        "file_id", "repository_id", "relative_path", "language", "line", "text", F.when(inside, F.lit("")).otherwise(code).alias("code"),
        (inside | mark).alias("comment"),
    )


def declared(lines: DataFrame) -> DataFrame:
    """``lines`` with function_name, class_name, bases, indent, and the enclosing class and function of each line."""
    code = F.col("code")
    script = F.col("language").isin("JavaScript", "TypeScript")
    direct = _by_language(_FUNCTION, code, 1)
    arrow = F.when(script, F.nullif(F.regexp_extract(code, _ARROW, 1), F.lit("")))
    method = F.when(script, F.nullif(F.regexp_extract(code, _METHOD, 1), F.lit("")))
    method = F.when(~method.isin(_NOT_METHODS), method)
    rows = lines.withColumn("class_name", _by_language(_CLASS, code, 1)).withColumn("bases", _by_language(_CLASS, code, 2))
    rows = rows.withColumn("function_name", F.when(F.col("class_name").isNull(), F.coalesce(direct, arrow, method)))
    rows = rows.withColumn("indent", F.length(F.regexp_extract("text", r"^[ \t]*", 0)))
    upto = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_class", F.last("class_name", True).over(upto))
    receiver = F.nullif(F.regexp_extract("code", r"^func\s+\(\s*\w*\s*\*?(\w+)", 1), F.lit(""))
    owner = F.when(F.col("language") == "Go", F.when(receiver.isNotNull(), F.concat(F.lit("("), receiver, F.lit(")")))).otherwise(
        F.when(F.col("indent") > 0, F.col("last_class"))
    )
    rows = rows.withColumn("owner", F.when(F.col("function_name").isNotNull(), owner))
    qualified = F.when(F.col("function_name").isNotNull(), F.concat_ws(".", "owner", "function_name"))
    rows = rows.withColumn("qualified_name", qualified)
    return rows.withColumn("caller", F.last("qualified_name", True).over(upto))


def functions(rows: DataFrame) -> DataFrame:
    """(file_id, repository_id, language, function_name, qualified_name, is_method, is_async, visibility, start_line, signature)."""
    name = F.col("function_name")
    visibility = (
        F.when(F.col("language") == "Go", F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private"))
        .when(F.col("language") == "Python", F.when(name.startswith("__") & ~name.endswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public"))
        .when(F.col("language") == "Java", F.coalesce(F.nullif(F.regexp_extract("code", r"\b(public|protected|private)\b", 1), F.lit("")), F.lit("internal")))
        .otherwise(F.coalesce(F.nullif(F.regexp_extract("code", r"\b(public|protected|private)\b", 1), F.lit("")), F.when(name.startswith("_"), "private").otherwise("public")))
    )
    return rows.where(name.isNotNull()).select(
        "file_id", "repository_id", "language", "function_name", "qualified_name", F.col("owner").isNotNull().alias("is_method"),
        F.col("code").rlike(r"\basync\b").alias("is_async"), visibility.alias("visibility"), F.col("line").alias("start_line"),
        F.regexp_replace(F.trim("text"), r"\s*[{:]\s*$", "").alias("signature"),
    )


def is_constructor() -> Column:
    """Whether a row of ``functions`` is a constructor, by the name that its language gives to them."""
    name, language = F.col("function_name"), F.col("language")
    named = F.when(language == "Python", name == "__init__").when(language.isin("JavaScript", "TypeScript"), name == "constructor")
    # a Java constructor has the name of its class
    java = F.col("qualified_name") == F.concat_ws(".", name, name)
    return F.col("is_method") & F.coalesce(named.when(language == "Java", java), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """(file_id, repository_id, language, class_name, qualified_name, base_classes, start_line)."""
    split = F.filter(F.transform(F.split(F.coalesce("bases", F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("="))
    return rows.where("class_name is not null").select(
        "file_id", "repository_id", "language", "class_name", F.col("class_name").alias("qualified_name"), split.alias("base_classes"),
        F.col("line").alias("start_line"),
    )


def imports(rows: DataFrame) -> DataFrame:
    """(file_id, repository_id, relative_path, language, module_path, is_relative, start_line)."""
    text = F.when(F.col("code") == "", F.lit("")).otherwise(F.regexp_replace("text", r"//.*$|#.*$", ""))
    module = F.coalesce(_by_language(_IMPORT, text, 1), _by_language(_IMPORT, text, 2))
    return rows.withColumn("module_path", module).where("module_path is not null").select(
        "file_id", "repository_id", "relative_path", "language", "module_path", F.col("module_path").startswith(".").alias("is_relative"),
        F.col("line").alias("start_line"),
    )


def calls(rows: DataFrame) -> DataFrame:
    """(file_id, repository_id, language, caller_name, callee_name, callee_object, start_line), repeats in a line once.

    A call outside of any function has the placeholder of its language as caller.  The object is the text before
    the dot, its strings emptied; it may hold calls itself.
    """
    code = F.col("code")
    top = F.when(F.col("language") == "Java", "<class>").when(F.col("language") == "Go", "<package>").otherwise("<module>")
    arrow = F.regexp_extract(code, _ARROW, 1) == F.col("function_name")
    rest = F.when(arrow, F.regexp_extract(code, _ARROW_HEAD, 0)).otherwise(F.regexp_extract(code, _METHOD_HEAD, 0))
    head = F.when(F.col("class_name").isNotNull(), _by_language(_CLASS, code, 0)).when(
        F.col("function_name").isNotNull(), F.coalesce(_by_language(_FUNCTION, code, 0), rest)
    )
    line = F.struct(
        "line", "code", F.coalesce(F.length(head), F.lit(0)).alias("head"), F.col("class_name").isNotNull().alias("is_class"),
        F.coalesce("caller", top).alias("caller"),
    )
    found = F.udf(chains.calls, "array<struct<start_line int, caller_name string, callee_name string, callee_object string>>", useArrow=True)
    files = rows.where("code <> ''").groupBy("file_id", "repository_id", "language").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    out = files.select("file_id", "repository_id", "language", F.inline(found("lines", "language")))
    # after a dot, a keyword is a name like any other
    return out.where(~F.col("callee_name").isin(_KEYWORDS) | F.col("callee_object").isNotNull()).select(
        "file_id", "repository_id", "language", "caller_name", "callee_name", "callee_object", "start_line"
    ).distinct()


def routes(rows: DataFrame) -> DataFrame:
    """(file_id, repository_id, relative_path, language, http_method, path, handler_name, start_line).

    Decorated routes are handled by the next function of the file, others by none.
    """
    g = lambda i: F.nullif(F.regexp_extract("text", _ROUTE, i), F.lit(""))
    after = Window.partitionBy("file_id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    tagged = rows.withColumn("handler_name", F.first("qualified_name", True).over(after))
    method = F.upper(F.coalesce(g(1), g(3), g(5)))
    path = F.coalesce(g(2), g(4), g(6), F.lit("/"))
    return tagged.withColumn("http_method", method).withColumn("path", path).where("http_method is not null and not comment").select(
        "file_id", "repository_id", "relative_path", "language", "http_method", "path",
        F.when(F.trim("text").startswith("@"), F.col("handler_name")).alias("handler_name"), F.col("line").alias("start_line"),
    )


def comment_blocks(rows: DataFrame) -> DataFrame:
    """(file_id, repository_id, language, start_line, end_line, n_lines): runs of comment lines."""
    order = Window.partitionBy("file_id").orderBy("line")
    starts = rows.where("comment").withColumn("_new", (F.col("line") - F.lag("line", 1, -1).over(order) > 1).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file_id", "repository_id", "language", "_run").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count(F.lit(1)).alias("n_lines")
    ).drop("_run")
