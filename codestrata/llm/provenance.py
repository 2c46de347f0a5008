"""Source files that nobody wrote by hand.

Evidence, in this order of authority:

1. Attribute files.  Their lines mark paths as generated or vendored (or take a mark back); globs
   are resolved per directory, a deeper file wins over a higher one and a later line over an
   earlier one.
2. Hard evidence of a file itself: notices in its text, machine-made layout, a size beyond what is
   written by hand, a place below a directory named like a package with its version.
3. Patterns mined from the corpus for repositories that declare nothing: directory names and file-name
   endings whose files are marked by attribute files elsewhere, or carry hard evidence, far more often than others.
4. A short default attribute file of conventions that small corpora are not enough to mine.

A file with the same hash as a kept copy is a copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.sources.scratch import Scratch

#: Nothing written by hand is larger (given with the data).
MAX_HAND_WRITTEN_BYTES = 512 * 1024
CODE_EXTENSIONS = ["py", "js", "mjs", "ts", "d.ts", "java", "go"]
#: Mined patterns need evidence in this many repositories (declared marks: in this many), and a lower confidence
#: bound of the share of files with evidence above one of these, tried from the surest down.
MIN_REPOSITORIES, MIN_DECLARING = 3, 2
SHARES = (0.5, 0.35, 0.25, 0.18)
#: No pattern rests on sizes or places alone with a lower share than these.
MIN_LARGE, MIN_PLACED, MIN_DECLARED = 0.2, 0.3, 0.3
_Z = 1.64

#: Conventions of public tools, as an attribute file (fixed values), for corpora too small to mine them from.
DEFAULT_ATTRIBUTES = """
**/node_modules/** vendored
**/vendor/** vendored
**/third_party/** vendored
**/dist/** vendored
*.min.* generated
*.bundle.* generated
*.packed.* generated
*.umd.* generated
*.prod.js generated
*-min.* generated
zz_generated.* generated
*.gen.* generated
*_gen.go generated
*.pb.go generated
*.generated.* generated
*_generated.go generated
*_generated.py generated
*_pb.* generated
*.g.ts generated
bindata.go generated
*.designer.* generated
"""
#: A directory, or the beginning of a file name, like a package with its version: a copy of that package.
_VERSIONED = r"(?:^|/)[A-Za-z][\w.]*-\d+\.\d+(?:\.\d+)?[/.]"

_NOTICE = re.compile(
    r"code generated by\b|\bdo not (?:edit|modify|change)\b|@generated\b|<auto-?generated|\bauto-?generated (?:by|from|on|file|code|using|with)\b|\bautomatically (?:generated|created|produced)\b"
    r"|\bgenerated (?:automatically|by|from) (?:the )?\S+|\bthis (?:file|class|code|module) (?:was|is|has been) (?:\w+ )?(?:generated|produced|created|emitted|written) by\b|\bmanual changes will be lost\b"
    r"|\b(?:edits?|changes?) (?:\w+ ){0,3}(?:will be|is|are) (?:lost|overwritten|discarded)\b|\bautogenerated\b|\bchange the template instead\b",
    re.I,
)
_COPY = re.compile(
    r"@license\b|@preserve\b|\bvendored\b|\bthird[- ]party (?:component|code|library|module|source)\b|\bbundled copy\b|\bfix upstream\b|\bupstream (?:license|licence|repository|project|source)\b"
    r"|\bv?\d+\.\d+(?:\.\d+)?\b.{0,40}\breleased under\b|\bcopied (?:verbatim )?from\b|\bdo not patch here\b|\blocal copy of\b",
    re.I,
)
_NOT_A_NOTICE = re.compile(r"\b(?:method|function|constructor|catch block|class) stub\b", re.I)
_HEAD = re.compile(r"(?:\s|﻿|#[^\n]*|//[^\n]*|/\*(?s:.*?)\*/|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|[\"']use strict[\"'];?)*")
_LITERAL = re.compile(r"[\"'`]([^\"'`\s]{200,})[\"'`]")
# possessive and from a boundary on, so that a long run of digits is read once
_NUMBERS = re.compile(r"(?<![\w.])(?:-?+[\dxXa-fA-F.]++(?:(?<=[eE])[-+]\d++)?+\s*+,\s*+){40,}+")
_SOURCE_MAP = re.compile(r"(?m)^\s*(?://|/\*)[#@]\s*sourceMappingURL=")


def text_evidence(text: str | None) -> str | None:
    """``generated``, ``vendored``, ``minified`` or ``data`` where the text itself shows it, else None.

    Notices count in the comments before the first code.  Minified text has lines of hundreds of
    characters throughout; data is a literal or a list of numbers that makes up most of the file.
    """
    if not text:
        return None
    head = text[: _HEAD.match(text).end()]
    for line in head.splitlines():
        if _NOT_A_NOTICE.search(line):
            continue
        if _COPY.search(line):
            return "vendored"
        if _NOTICE.search(line):
            return "generated"
    if _SOURCE_MAP.search(text):
        return "minified"
    size = len(text)
    held = sum(len(m.group(1)) for m in _LITERAL.finditer(text)) + sum(m.end() - m.start() for m in _NUMBERS.finditer(text))
    if held * 2 > size:
        return "data"
    lines = text.splitlines()
    longest = max(map(len, lines), default=0)
    if longest > 500 and sum(len(x) for x in lines if len(x) > 500) * 2 > size:
        return "minified"
    return None


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ``./`` or ``/``, no doubled slashes."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./|/)+", "")


def glob_regex(pattern: str) -> str:
    """Regular expression of an attribute glob, for paths relative to the attribute file's directory.

    Without a slash it matches the file name at any depth; with one it is anchored; ``**`` crosses
    directories.  A pattern for a directory alone does not match its files, as in attribute files.
    """
    anchored = "/" in pattern.rstrip("/")
    p, out, i = pattern.lstrip("/"), [], 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif p.startswith("**", i) and i + 2 == len(p) and i and p[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            body = p[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return ("" if anchored else "(?:.*/)?") + "".join(out)


_MARK = re.compile(r"^([-!]?)(?:linguist-)?(generated|vendored|vendor)(?:=(\w+))?$")


def attribute_rules(text: str | None) -> list[tuple[int, str, str, bool | None]]:
    """(line number, regular expression, mark, set) of the lines about a mark; set is None where the line takes back what others say."""
    out = []
    for n, line in enumerate((text or "").splitlines()):
        parts = line.strip().split()
        if len(parts) < 2 or parts[0].startswith(("#", "!")):
            continue
        for attribute in parts[1:]:
            m = _MARK.match(attribute)
            if m:
                on = not m.group(1) and (m.group(3) or "true").lower() not in ("false", "0", "no", "unset")
                mark = "generated" if m.group(2) == "generated" else "vendored"
                out.append((n, glob_regex(parts[0]), mark, None if m.group(1) == "!" else on))
    return out


def attribute_lines(text: str | None) -> list[tuple[int, str, str, bool]]:
    """:func:`attribute_rules` with False where the line sets nothing."""
    return [(n, rx, mark, bool(on)) for n, rx, mark, on in attribute_rules(text)]


def declared_marks(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(file_id, mark, on): what attribute files say about each file; a mark that is unspecified again has no row.

    ``files`` has file_id, repository_id, path; ``attributes`` has repository_id, path, text of the attribute
    files themselves.  Only files of declaring repositories are spread over the directories above them; each meets the
    rules of those through an equi-join on (repository, directory), and the deepest directory and then the last
    line wins.
    """

    def rules(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [
                (r, p.rpartition("/")[0], n, rx, mark, on)
                for r, p, t in zip(pdf["repository_id"], pdf["path"], pdf["text"])
                for n, rx, mark, on in attribute_rules(t)
            ]
            yield pd.DataFrame(rows, columns=["repository_id", "directory", "line", "regex", "mark", "on"]).astype({"on": "boolean"})

    @F.pandas_udf("boolean")
    def matches(paths: pd.Series, patterns: pd.Series) -> pd.Series:
        compiled = {rx: re.compile(rx) for rx in patterns.unique()}
        return pd.Series([compiled[rx].fullmatch(p) is not None for p, rx in zip(paths, patterns)], dtype=bool)

    rule = attributes.select("repository_id", "path", "text").mapInPandas(
        rules, "repository_id string, directory string, line int, regex string, mark string, on boolean"
    )
    declaring = attributes.select("repository_id").distinct()
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )
    inside = files.join(declaring, "repository_id", "left_semi")
    spread = inside.select("file_id", "repository_id", "path", F.explode(above).alias("directory"))
    under = F.when(F.col("directory") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("directory") + 2, F.length("path")))
    met = spread.join(rule, ["repository_id", "directory"]).withColumn("rest", under)
    met = met.where(matches("rest", "regex"))
    return met.groupBy("file_id", "mark").agg(
        F.max_by("on", F.struct(F.length("directory"), "line")).alias("on")
    ).where("on is not null")


def default_mark(path: Column, attributes: str = DEFAULT_ATTRIBUTES) -> Column:
    """Mark of a default attribute file, compared without case in directories; null without one."""
    out = F.lit(None).cast("string")
    for mark in ("generated", "vendored"):
        rules = [rx for _, rx, m, _ in attribute_lines(attributes) if m == mark]
        named = [r for r in rules if not r.startswith("(?:[^/]+/)*")]
        placed = [r for r in rules if r.startswith("(?:[^/]+/)*")]
        hit = F.lit(False)
        if named:
            hit = hit | path.rlike("^(?:" + "|".join(named) + ")$")
        if placed:
            hit = hit | path.rlike("(?i)^(?:" + "|".join(placed) + ")$")
        out = F.when(hit, F.lit(mark)).otherwise(out)
    return out


def path_features(path: Column, extension: Column) -> Column:
    """Names of the directories above a file, and how its name begins and ends, apart for the languages.

    Endings are the last part of the name behind a separator, or its last one and last two capitalised words.
    """
    parts = F.split(path, "/")
    directories = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: F.concat(F.lit("dir:"), F.lower(d)))
    name = F.element_at(parts, -1)
    stem = F.when(F.endswith(name, F.concat(F.lit("."), extension)), F.substring(name, F.lit(1), F.length(name) - F.length(extension) - 1)).otherwise(name)
    family = F.when(extension.isin("js", "mjs", "ts", "d.ts"), F.lit("js")).otherwise(extension)
    ends = [
        ("end", r"([._-][A-Za-z0-9]*)$"), ("word", r"[a-z0-9]([A-Z][a-z0-9]*)$"), ("words", r"[a-z0-9]([A-Z][a-z0-9]*[A-Z][a-z0-9]*)$"),
        ("first", r"^([A-Za-z]+(?:_[A-Za-z]+)?)[._-]"),
    ]
    named = [F.when(stem.rlike(rx), F.concat(F.lit(kind + ":"), F.regexp_extract(stem, rx, 1), F.lit("|"), family)) for kind, rx in ends]
    return F.array_distinct(F.concat(directories, F.filter(F.array(*named), lambda x: x.isNotNull())))


def _lower_bound(hits: Column, n: Column) -> Column:
    """Lower confidence bound of a share (Wilson), 0 of nothing."""
    share, z = hits / n, F.lit(_Z)
    spread = z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)
    return F.when(n > 0, (share + z * z / (2 * n) - spread) / (1 + z * z / n)).otherwise(F.lit(0.0))


def mined_patterns(evidence: DataFrame, scratch: Scratch) -> DataFrame:
    """(feature, mark): features whose files carry evidence far more often than others.

    ``evidence`` has file_id, repository_id, features, and what is known about each file: ``declaring`` (its
    repository has attribute files), ``declared`` (their mark), ``known`` (the text is at hand), ``shown`` (what the text
    shows), ``large`` and ``placed``.  Counts are exact over all files and combine on the map side, so frequent
    directories cost nothing.  Shares are taken of the files on which that evidence could be seen.  Sure patterns
    explain their files, which then no longer speak for the other features they have (a directory above, say);
    only files with evidence are looked at again for that.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    totals = scratch.save(
        evidence.select(F.explode("features").alias("feature"), "declaring", "known")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), one(F.col("declaring")).alias("n_declaring"), one(F.col("known")).alias("n_known"))
    )
    speaking = scratch.save(
        evidence.where("declared is not null or shown is not null or large or placed")
        .select("file_id", "repository_id", "declared", "shown", "large", "placed", F.explode("features").alias("feature"))
    )
    left, found = speaking, None
    kinds = {"declared": F.col("declared").isNotNull(), "shown": F.col("shown").isNotNull(), "large": F.col("large"), "placed": F.col("placed")}
    copied = F.coalesce(F.col("declared") == "vendored", F.col("shown") == "vendored", F.lit(False)) | F.col("placed")
    for share in SHARES:
        per_repo = left.groupBy("feature", "repository_id").agg(*[one(c).alias(k) for k, c in kinds.items()], F.count(F.lit(1)).alias("hits"), one(copied).alias("copied"))
        per = per_repo.groupBy("feature").agg(
            *[F.sum(k).alias(k) for k in kinds], *[one(F.col(k) > 0).alias("in_" + k) for k in kinds], F.sum("hits").alias("hits"), F.sum("copied").alias("copied"),
        ).join(totals, "feature")
        sure = lambda k, n, least, repos: (F.col("in_" + k) >= repos) & (_lower_bound(F.col(k), F.col(n)) >= max(share, least))
        ok = (
            sure("declared", "n_declaring", MIN_DECLARED, MIN_DECLARING) | sure("shown", "n_known", 0, MIN_REPOSITORIES)
            | sure("large", "n", MIN_LARGE, MIN_REPOSITORIES) | sure("placed", "n", MIN_PLACED, MIN_REPOSITORIES)
        )
        mark = F.when(F.col("copied") * 2 > F.col("hits"), "vendored").otherwise("generated")
        new = scratch.save(per.where(ok).select("feature", mark.alias("mark")))
        found = new if found is None else found.unionByName(new)
        explained = speaking.join(found, "feature", "left_semi").select("file_id").distinct()
        left = speaking.join(explained, "file_id", "left_anti")
    return found.groupBy("feature").agg(F.max("mark").alias("mark"))


def not_hand_written(
    files: DataFrame, sources: DataFrame, scratch: Scratch, max_bytes: int = MAX_HAND_WRITTEN_BYTES, defaults: str = DEFAULT_ATTRIBUTES
) -> DataFrame:
    """(file_id, repository_id, path, reason) of the code files that nobody wrote by hand.

    ``files`` holds one current row per id (id, repository_id, relative_path, extension, size_bytes, sha256,
    scan_status); ``sources`` (file_id, relative_path, source) the texts at hand, attribute files among them.
    Only SCANNED files with a code extension come out.  Null paths, sizes and hashes give no evidence; a
    declaration that unsets a mark overrules defaults and mined patterns, not hard evidence.
    """
    code = files.where((F.col("scan_status") == "SCANNED") & F.col("extension").isin(CODE_EXTENSIONS)).select(
        F.col("id").alias("file_id"), "repository_id", F.coalesce(normal_path(F.col("relative_path")), F.lit("")).alias("path"),
        "extension", "size_bytes", "sha256",
    )

    @F.pandas_udf("string")
    def seen(texts: pd.Series) -> pd.Series:
        return texts.map(text_evidence)

    shown = sources.where("source is not null").select("file_id", seen("source").alias("shown"), F.lit(True).alias("known"))
    attributes = sources.where(F.col("relative_path").rlike(r"(^|[/\\])\.gitattributes$") & F.col("source").isNotNull()).select(
        F.col("repository_id"), normal_path(F.col("relative_path")).alias("path"), F.col("source").alias("text")
    )
    declared = declared_marks(code.select("file_id", "repository_id", "path"), attributes)
    said = declared.groupBy("file_id").agg(F.max(F.when(F.col("on"), F.col("mark"))).alias("declared"), F.lit(True).alias("spoken"))
    declaring = attributes.select("repository_id").distinct().withColumn("declaring", F.lit(True))
    base = scratch.save(
        code.join(shown.groupBy("file_id").agg(F.max("shown").alias("shown"), F.max("known").alias("known")), "file_id", "left")
        .join(said, "file_id", "left").join(declaring, "repository_id", "left")
        .withColumn("large", F.coalesce(F.col("size_bytes") > max_bytes, F.lit(False)))
        .withColumn("placed", F.col("path").rlike(_VERSIONED))
        .withColumn("default", default_mark(F.col("path"), defaults))
        .withColumn("features", path_features(F.col("path"), F.col("extension")))
        .withColumn("declaring", F.coalesce("declaring", F.lit(False))).withColumn("known", F.coalesce("known", F.lit(False)))
    )
    mined = scratch.save(mined_patterns(base, scratch))
    by_pattern = (
        base.select("file_id", F.explode("features").alias("feature")).join(mined, "feature")
        .groupBy("file_id").agg(F.min("feature").alias("mined"), F.max("mark").alias("mined_mark"))
    )
    hard = F.when(F.col("large"), "oversized").otherwise(F.col("shown"))
    judged = base.join(by_pattern, "file_id", "left").withColumn(
        "reason",
        F.coalesce(
            F.when(F.col("declared").isNotNull(), F.concat(F.lit("declared "), "declared")), hard,
            F.when(F.col("spoken").isNull(), F.coalesce(
                F.when(F.col("placed"), "vendored"), F.when(F.col("mined").isNotNull(), F.concat(F.lit("pattern "), "mined")), "default",
            )),
        ),
    ).withColumn("kept", F.col("placed") | F.coalesce(F.col("shown") == "vendored", F.lit(False)) | F.coalesce(F.col("default") == "vendored", F.lit(False)) | F.coalesce(F.col("mined_mark") == "vendored", F.lit(False)))
    judged = scratch.save(judged.select("file_id", "repository_id", "path", "size_bytes", "sha256", "kept", "spoken", "reason"))
    # one row per hash of a kept copy, whatever the number of its copies
    kept = judged.where("sha256 is not null and size_bytes > 0 and reason is not null and kept").select("sha256").distinct()
    copies = judged.where("reason is null and spoken is null and size_bytes > 0").join(kept, "sha256", "left_semi").select(
        "file_id", "repository_id", "path", F.lit("copy").alias("reason")
    )
    return judged.where("reason is not null").select("file_id", "repository_id", "path", "reason").unionByName(copies)
