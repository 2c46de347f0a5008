"""Declarations of source texts as records: functions, types, variables, each with its scope, end, lists and comment.

Each file is read once, in place: the outline of a text comes back as an array of its row, so nothing is shuffled.
What the parts of a declaration mean is decided by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.parsing import statements
from codestrata.parsing.outline import outline
from codestrata.parsing.records import _KEYWORDS as KEYWORDS

_OUTLINE = (
    "array<struct<kind string, keyword string, name string, chain string, owner string, start_line int, end_line int, header string,"
    " parameters array<string>, result string, above array<string>, doc string, depth int>>"
)
LANGUAGES = ["Python", "JavaScript", "TypeScript", "Java", "Go"]


def _texts(sources: DataFrame) -> DataFrame:
    """The texts to read; those of a table with fewer splits than cores are dealt out, as reading them is work for a core."""
    rows = sources.where(F.col("language").isin(LANGUAGES) & F.col("source").isNotNull()).select("file_id", "repository_id", "relative_path", "language", "source")
    cores = sources.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def definitions(sources: DataFrame) -> DataFrame:
    """(file_id, repository_id, relative_path, language, and the fields of an outline) of every declaration; null texts give none."""
    read = F.udf(outline, _OUTLINE, useArrow=True)
    return _texts(sources).select("file_id", "repository_id", "relative_path", "language", F.inline(read("source", "language")))


def _read(sources: DataFrame, helper, fields: str) -> DataFrame:
    read = F.udf(helper, f"array<struct<{fields}>>", useArrow=True)
    return _texts(sources).select("file_id", "repository_id", "relative_path", "language", F.inline(read("source", "language")))


def imports(sources: DataFrame) -> DataFrame:
    """Import records: module_path, names, aliases (in the order of the names, empty without one), is_relative, start_line."""
    return _read(sources, statements.imports, "module_path string, names array<string>, aliases array<string>, is_relative boolean, start_line int")


def comments(sources: DataFrame) -> DataFrame:
    """Comment records: kind (docstring, doc, block, line), lines, raw text, and the declaration it documents."""
    return _read(sources, statements.comments, "kind string, start_line int, end_line int, text string, symbol string")


def calls(sources: DataFrame) -> DataFrame:
    """Call records: caller_name, callee_name, callee_object, start_line, repeats in a line once.

    A call outside of any function has the placeholder of its language as caller.  The object is the text before
    the dot, its strings emptied; it may hold calls itself.
    """
    found = _read(sources, statements.calls, "start_line int, caller_name string, callee_name string, callee_object string")
    # after a dot, a keyword is a name like any other
    return found.where(~F.col("callee_name").isin(KEYWORDS) | F.col("callee_object").isNotNull()).select(
        "file_id", "repository_id", "language", "caller_name", "callee_name", "callee_object", "start_line"
    ).distinct()


_VERBS = "get|post|put|delete|patch|head|options"


def routes(sources: DataFrame) -> DataFrame:
    """Route records: http_method, path, handler_name, framework, start_line.

    Decorated or annotated functions (FastAPI, Flask, NestJS, Spring) are their own handlers; routes registered by a call
    (Express, Gin, Echo, net/http) have the last argument of the call, where it is a name.
    """
    lang = F.col("language")
    mark = definitions(sources).where("kind = 'function'").select(
        "file_id", "repository_id", "relative_path", "language", F.concat_ws(".", "owner", "name").alias("handler_name"), "start_line", F.explode("above").alias("mark")
    )
    verb = F.upper(F.coalesce(
        F.nullif(F.regexp_extract("mark", rf"^@\w+\.({_VERBS})\(", 1), F.lit("")), F.nullif(F.regexp_extract("mark", rf"(?i)^@({_VERBS})(?:Mapping)?\b", 1), F.lit("")),
        F.nullif(F.regexp_extract("mark", r"methods\s*=\s*[\[(]\s*['\"](\w+)", 1), F.lit("")), F.nullif(F.regexp_extract("mark", r"RequestMethod\.(\w+)", 1), F.lit("")),
    ))
    named = F.regexp_extract("mark", r"^@[\w.]+\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*['\"]([^'\"]*)['\"]", 1)
    framework = (
        F.when((lang == "Python") & F.col("mark").rlike(r"^@\w+\.route\("), "flask").when((lang == "Python") & F.col("mark").rlike(rf"^@\w+\.(?:{_VERBS})\("), "fastapi")
        .when((lang == "TypeScript") & F.col("mark").rlike(r"^@(?:Get|Post|Put|Delete|Patch|Head|Options|All)\("), "nestjs")
        .when((lang == "Java") & F.col("mark").rlike(r"^@(?:Get|Post|Put|Delete|Patch|Request)Mapping\b"), "spring")
    )
    marked = mark.withColumn("framework", framework).where("framework is not null").select(
        "file_id", "repository_id", "relative_path", "language", F.coalesce(verb, F.lit("GET")).alias("http_method"),
        F.coalesce(F.nullif(named, F.lit("")), F.lit("/")).alias("path"), "handler_name", "framework", "start_line",
    )
    calls = _read(sources, statements.called_routes, "receiver string, verb string, path string, handler_name string, start_line int")
    by_call = (
        F.when(lang != "Go", "express").when(F.col("verb").isin("HandleFunc", "Handle"), "net/http").when(F.col("receiver").isin("r", "router", "group"), "gin").otherwise("echo")
    )
    kept = (lang != "Go") | F.col("verb").rlike(r"^[A-Z]")
    method = F.when(F.col("verb").isin("HandleFunc", "Handle"), "ANY").otherwise(F.upper("verb"))
    called = calls.where(kept).select(
        "file_id", "repository_id", "relative_path", "language", method.alias("http_method"), "path", "handler_name", by_call.alias("framework"), "start_line"
    )
    return marked.unionByName(called)


def _is(*languages: str) -> Column:
    return F.col("language").isin(*languages)


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def documentation(raw: Column, language: Column) -> Column:
    """A comment without its marks: quotes of a docstring, the stars of a block, the slashes of lines; blank lines of blocks are dropped."""
    quoted = F.trim(F.regexp_replace(raw, r"""^(?:\"\"\"|'''|"|')|(?:\"\"\"|'''|"|')$""", ""))
    lines = F.split(raw, "\n")
    block = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*/?\*+/?|\*+/\s*$", ""))), lambda x: x != ""), "\n")
    slashes = F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*//+", ""))), "\n")
    return _blank_to_null(F.when(language == "Python", quoted).when(F.ltrim(raw).startswith("//"), slashes).otherwise(block))


def decorators(above: Column) -> Column:
    """Names of decorators or annotations, in order."""
    return F.transform(above, lambda x: F.trim(F.regexp_extract(x, r"^@\s*([\w.$]+)", 1)))


def parameter_names(parameters: Column, language: Column) -> Column:
    """Names of the parameters; the receiver of a Python method is none."""
    python = F.filter(F.transform(parameters, lambda p: F.regexp_extract(p, r"^\*{0,2}(\w+)", 1)), lambda n: ~n.isin("self", "cls", ""))
    java = F.transform(parameters, lambda p: F.regexp_extract(p, r"([\w$]+)\s*(?:\[\s*\]\s*)*$", 1))
    script = F.transform(parameters, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(?:@[\w.]+(?:\([^)]*\))?\s*)?(?:(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?([\w$]+)", 1), F.lit("")), p))
    go = F.transform(parameters, lambda p: F.regexp_extract(p, r"^(\w+)", 1))
    return F.when(language == "Python", python).when(language == "Java", java).when(language == "Go", go).otherwise(script)


def return_type(header: Column, name: Column, result: Column, language: Column) -> Column:
    """Declared type of the result; null without one."""
    before = F.regexp_extract(header, r"^(.*?)\s*[\w$]+\s*\(", 1)
    java = F.regexp_replace(before, r"^(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<.*?>\s+)?", "")
    arrow = F.regexp_replace(result, r"^->\s*|^:\s*", "")
    return _blank_to_null(F.when(language == "Java", java).when(language == "JavaScript", F.lit(None).cast("string")).otherwise(arrow))


def receiver(header: Column) -> Column:
    """Type of the receiver of a Go method, without the star; null for a function."""
    return F.nullif(F.regexp_extract(header, r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)", 1), F.lit(""))


def visibility(name: Column, header: Column, language: Column) -> Column:
    stated = F.nullif(F.regexp_extract(header, r"^[^(=]*?\b(public|protected|private)\b", 1), F.lit(""))
    marked = F.when(name.startswith("_") | name.startswith("#"), "private").otherwise("public")
    python = F.when(name.startswith("__") & ~name.endswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")
    return (
        F.when(language == "Go", F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")).when(language == "Python", python)
        .when(language == "Java", F.coalesce(stated, F.lit("internal"))).when(language == "JavaScript", marked).otherwise(F.coalesce(stated, marked))
    )


def functions(rows: DataFrame) -> DataFrame:
    """Function records of ``definitions``."""
    lang, name, header, owner = F.col("language"), F.col("name"), F.col("header"), F.col("owner")
    recv = F.when(lang == "Go", receiver(header))
    marks = decorators(F.col("above"))
    named = F.when(lang == "Python", name == "__init__").when(lang.isin("JavaScript", "TypeScript"), name == "constructor").when(lang == "Java", name == owner)
    return rows.where("kind = 'function'").select(
        "file_id", "repository_id", "relative_path", "language", name.alias("function_name"),
        F.when(recv.isNotNull(), F.concat(F.lit("("), recv, F.lit(")."), name)).otherwise(F.concat_ws(".", owner, name)).alias("qualified_name"),
        F.concat_ws(".", "chain", name).alias("nested_name"),
        (owner.isNotNull() | recv.isNotNull()).alias("is_method"), (owner.isNotNull() & F.coalesce(named, F.lit(False))).alias("is_constructor"),
        header.rlike(r"^[^(]*\basync\b").alias("is_async"),
        (F.array_contains(marks, "staticmethod") | (_is("Java", "JavaScript", "TypeScript") & header.rlike(r"^[^(=]*\bstatic\b"))).alias("is_static"),
        F.array_contains(marks, "classmethod").alias("is_class_method"), visibility(name, header, lang).alias("visibility"),
        parameter_names(F.col("parameters"), lang).alias("parameters"), return_type(header, name, F.col("result"), lang).alias("return_type"),
        "start_line", "end_line", documentation(F.col("doc"), lang).alias("documentation"), marks.alias("decorators"), F.regexp_replace(header, r"^export\s+(?:default\s+)?(?:declare\s+)?", "").alias("signature"),
    )


def _names_in(text: Column) -> Column:
    """Names of a list of types, type arguments cut; keyword arguments of Python are none."""
    bare = F.regexp_replace(text, r"<[^<>]*(?:<[^<>]*>[^<>]*)*>|\[[^\]]*\]", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("="))


def types(rows: DataFrame) -> DataFrame:
    """Class records of ``definitions``: classes, interfaces, enums, structs, records and annotations."""
    lang, header = F.col("language"), F.col("header")
    base = (
        F.when(lang == "Python", F.regexp_extract(header, r"^class\s+\w+\s*(?:\[[^\]]*\])?\s*\((.*)\)", 1))
        .otherwise(F.regexp_extract(header, r"\bextends\s+(.+?)(?:\s+implements\b|\s+permits\b|$)", 1))
    )
    marks = decorators(F.col("above"))
    bases = _names_in(base)
    kind = F.when(F.col("keyword") == "record", "struct").when(F.col("keyword") == "@interface", "annotation").otherwise(F.col("keyword"))
    abstract = header.rlike(r"^[^{(]*\babstract\b") | ((lang == "Python") & F.exists(bases, lambda b: b.isin("ABC", "abc.ABC")))
    return rows.where("kind = 'class'").select(
        "file_id", "repository_id", "relative_path", "language", F.col("name").alias("class_name"), F.concat_ws(".", "chain", "name").alias("qualified_name"),
        kind.alias("class_kind"), F.when(lang == "Go", F.array().cast("array<string>")).otherwise(bases).alias("base_classes"),
        _names_in(F.regexp_extract(header, r"\bimplements\s+(.+?)(?:\s+permits\b|$)", 1)).alias("interfaces"), abstract.alias("is_abstract"),
        visibility(F.col("name"), header, lang).alias("visibility"), "start_line", "end_line", documentation(F.col("doc"), lang).alias("documentation"),
        marks.alias("decorators"),
    )


def variables(rows: DataFrame) -> DataFrame:
    """Constants and variables: of modules (Python, Go), of any scope (scripts), fields of classes (Java)."""
    lang, name, header = F.col("language"), F.col("name"), F.col("header")
    upper = name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}")
    constant = (
        F.when(lang == "Java", header.rlike(r"\bstatic\b") & header.rlike(r"\bfinal\b")).when(lang == "Go", F.col("keyword") == "const")
        .when(lang == "Python", upper).otherwise(F.col("keyword") == "const")
    )
    return rows.where("kind = 'variable'").select(
        "file_id", "repository_id", "relative_path", "language", name.alias("variable_name"), F.concat_ws(".", "chain", "name").alias("qualified_name"),
        F.when(constant, "constant").otherwise("variable").alias("symbol_type"), visibility(name, header, lang).alias("visibility"), "start_line",
    )
