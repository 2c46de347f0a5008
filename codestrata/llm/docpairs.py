"""Functions paired with their documentation.

One parsing expression grammar per language walks a source file.  Its terminals are coarse
(whole strings, comments, runs of lines without anything of interest), its rules find a
documentation comment that belongs to a signature, and the semantic actions emit the pair
with its offsets.  A broken file gives the pairs that still parse.  An informativeness
filter then drops comments that say nothing.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.peg import Grammar, State, ahead, balanced, choice, many, opt, rx, seq

#: Fewer words than this, besides those of the function's name, make a comment trivial.
MIN_WORDS = 5


def _python() -> Grammar:
    g = Grammar()
    triple = r'[rRbBuUfF]{0,2}(?:"""(?s:(?:[^\\]|\\.)*?)"""|\'\'\'(?s:(?:[^\\]|\\.)*?)\'\'\')'
    plain = r'[rRbBuUfF]{0,2}(?:"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\')'
    string = rx(f"{triple}|{plain}")
    comment = rx(r"#[^\n]*")
    g.rule("parens", balanced("(", ")", choice(rx(r"[^()\"'#]+"), comment, string)))
    g.rule(
        "docstring",
        seq(rx(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*"), rx(f"(?P<quoted>{triple}|{plain})"), ahead(rx(r"[ \t]*(?:;|#|\r?\n|$)"))),
    )

    def emit(state: State, at: int, end: int, value: list) -> None:
        head, doc = value[0], value[-1]
        if doc is not None:
            quoted = doc[1]
            body = re.sub(r"^[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')(.*)\1$", r"\2", quoted.group("quoted"), flags=re.S)
            line_start = state.text.rfind("\n", 0, quoted.start()) + 1
            state.out.append((head.start("name"), head.group("name"), body, quoted.start() - line_start))

    g.rule(
        "function",
        seq(
            rx(r"[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\][ \t]*)?"), g.ref("parens"),
            rx(r"[ \t]*(?:->[^:\n#]*)?:[ \t]*"), opt(g.ref("docstring")),
        ),
        emit,
    )
    idle = rx(r"(?:(?![ \t]*(?:async[ \t]+)?def\b)[^\n\"'#]*\n)+")
    g.rule("file", many(choice(g.ref("function"), idle, string, comment, rx(r"[^\n\"'#]+"), rx(r"(?s:.)"))))
    return g



def _at_line_start(state: State, at: int):
    """Nothing but white space stands before this offset on its line."""
    text, i = state.text, at
    while i and text[i - 1] in " \t\ufeff":
        i -= 1
    return (at, None) if i == 0 or text[i - 1] == "\n" else None


def _name(value: object) -> tuple[int, str]:
    """(offset, text) of the one group that the terminals of a signature caught."""
    if isinstance(value, re.Match):
        k = value.lastindex
        return (value.start(k), value.group(k)) if k else (-1, "")
    return max(map(_name, value), default=(-1, "")) if isinstance(value, list) else (-1, "")


def _braces(doc: str, signature: Callable[[Grammar], None], string: str, before: str) -> Grammar:
    """A language with C-like comments: ``doc`` directly above the rule ``signature``, with ``before`` allowed in between."""
    g = Grammar()
    quoted = rx(string)
    comment = rx(r"/\*(?s:.*?)\*/|//[^\n]*")
    gap = rx(r"[ \t]*(?:\r?\n[ \t]*)?")
    g.rule("parens", balanced("(", ")", choice(rx(r"[^()\"'`/]+"), comment, quoted, rx(r"/"))))
    g.rule("between", many(seq(rx(before), opt(g.ref("parens")), gap)))
    g.rule("angles", seq(balanced("<", ">", rx(r"=>|[^<>(){};=]+|[(){};=]")), _SPACE))
    g.rule("brackets", seq(balanced("[", "]", rx(r"[^\[\]]+")), _SPACE))
    signature(g)

    def emit(state: State, at: int, end: int, value: list) -> None:
        start, name = _name(value[4])
        state.out.append((start, name, value[1].group(0), -1))

    g.rule("documented", seq(_at_line_start, rx(doc), gap, g.ref("between"), g.ref("signature")), emit)
    g.rule("file", many(choice(g.ref("documented"), comment, quoted, rx(r"[^\"'`/]+"), rx(r"(?s:.)"))))
    return g


_SPACE = rx(r"\s*")
_OPEN = rx(r"\(")


def _java_signature(g: Grammar) -> None:
    g.rule("modifiers", many(rx(r"(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+")))
    g.rule("type", seq(rx(r"[\w.$]+\s*"), opt(g.ref("angles")), many(rx(r"\[\s*\]\s*"))))
    g.rule("name", rx(r"([\w$]+)\s*\("))
    g.rule(
        "signature",
        seq(
            g.ref("modifiers"), opt(g.ref("angles")), rx(r"(?!(?:class|record|interface|enum|new|return|throw|if|for|while|switch|catch)\b)"),
            choice(seq(g.ref("type"), g.ref("name")), g.ref("name")),
        ),
    )


def _script_signature(g: Grammar) -> None:
    g.rule("prefix", seq(many(rx(r"(?:export|default|declare)\s+")), rx(r"(?!(?:if|for|while|switch|catch|return|new|throw)\b)")))
    g.rule("modifiers", many(rx(r"(?:public|private|protected|static|async|get|set|readonly|abstract|override)\s+")))
    g.rule("typed", rx(r":[^=;]+"))
    g.rule("function", seq(opt(rx(r"async\s+")), rx(r"function\s*\*?\s*([\w$]+)\s*"), opt(g.ref("angles")), _OPEN))
    g.rule(
        "constant",
        seq(rx(r"(?:const|let|var)\s+([\w$]+)\s*"), opt(g.ref("typed")), rx(r"=\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>|<)")),
    )
    g.rule("method", seq(g.ref("modifiers"), rx(r"\*?\s*(#?[\w$]+)\??\s*"), opt(g.ref("angles")), _OPEN))
    g.rule("field", seq(g.ref("modifiers"), rx(r"(#?[\w$]+)\s*"), opt(g.ref("typed")), rx(r"=\s*(?:async\s*)?(?:function\b|\()")))
    g.rule("signature", seq(g.ref("prefix"), choice(*map(g.ref, ("function", "constant", "method", "field")))))


def _go_signature(g: Grammar) -> None:
    g.rule("receiver", seq(g.ref("parens"), _SPACE))
    g.rule("signature", seq(rx(r"func\b\s*"), opt(g.ref("receiver")), rx(r"(\w+)\s*"), opt(g.ref("brackets")), _OPEN))


_C_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_JS_STRING = _C_STRING + r"|`(?:[^`\\]|\\(?s:.))*`"
_BLOCK_DOC = r"/\*\*(?!/)(?s:.*?)\*/"
_GO_DOC = r"(?://[^\n]*\n[ \t]*)*//[^\n]*|/\*(?s:.*?)\*/"


def _grammars() -> dict[str, Grammar]:
    script = _braces(_BLOCK_DOC, _script_signature, _JS_STRING, r"@[\w.$]+")
    return {
        "py": _python(),
        "java": _braces(_BLOCK_DOC, _java_signature, _C_STRING, r"@(?!interface\b)[\w.$]+"),
        "js": script, "mjs": script, "ts": script,
        "go": _braces(_GO_DOC, _go_signature, _JS_STRING, r"(?!)"),
    }


_GRAMMARS: dict[str, Grammar] = {}


def parse_pairs(extension: str, source: str) -> list[tuple[int, str, str, int]]:
    """(line of the signature's name, name, raw comment, indentation) of every documented function.

    Lines end with LF or CRLF.  An unknown extension or a null source has none.  ``indentation`` is the
    column of a docstring, -1 for other comments.
    """
    if not _GRAMMARS:
        _GRAMMARS.update(_grammars())
    grammar = _GRAMMARS.get(extension)
    if grammar is None or not source:
        return []
    found = grammar.parse(source, "file").out
    if not found:
        return []
    breaks = [m.start() for m in re.finditer("\n", source)]
    return [(bisect.bisect_left(breaks, at) + 1, name, doc, column) for at, name, doc, column in found]


def strip_marks(doc: str, column: int) -> list[str]:
    """Lines of a comment without its marks; indentation inside of the comment is kept."""
    lines = doc.replace("\r\n", "\n").split("\n")
    if column >= 0:  # a docstring: cut the common indentation
        return [lines[0].lstrip(), *[x[column:] if not x[:column].strip() else x.lstrip() for x in lines[1:]]]
    block = doc.lstrip().startswith("/*")
    if block:
        lines[-1] = re.sub(r"\*+/\s*$", "", lines[-1])
    out = []
    for i, x in enumerate(lines):
        if block:
            x = re.sub(r"^\s*/\*+[ \t]?", "", x) if i == 0 else re.sub(r"^\s*\*+[ \t]?", "", x)
        else:
            x = re.sub(r"^\s*//+[ \t]?", "", x)
        out.append(x.rstrip())
    return out


_TAG = re.compile(r"^\s*(?:@\w|\{@\w+[^}]*\}\s*$|:\w[\w \t*.\[\]]*:)|^\s*\{@inherit", re.I)
_SECTION = re.compile(
    r"^\s*(?:args|arguments|parameters?|params?|keyword args|keyword arguments|other parameters|attributes|returns?|results?"
    r"|yields?|raises|throws|exceptions?|errors|rtype)\s*:\s*$",
    re.I,
)
_UNDERLINED = re.compile(r"^\s*(?:parameters|other parameters|returns|yields|raises|attributes)\s*$", re.I)
_PROMISE = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|tbc|hack|wip)\b|\b(?:document(?:ation)?|describe|description|docs?)\b.*\b(?:later|coming soon|to be written|to be done|to follow|missing)\b"
    r"|^\W*(?:write|add|fill in|insert|provide)\b.*\b(?:documentation|docs?|docstring|description|comment)s?\b",
    re.I,
)
_STUB = re.compile(
    r"\bauto-?\s?generated (?:method|function|constructor|catch|class)?\s*(?:stub|block|body)\b|\bplaceholder\b.*\b(?:comment|documentation|docs?|text|inserted|template)\b"
    r"|\b(?:comment|text|documentation)\b.*\binserted by\b|\breplace (?:the body|this (?:text|comment|line)|me) with\b|\byour (?:own )?(?:implementation|description|code|text) (?:goes )?here\b"
    r"|\bgenerated by (?:the )?(?:ide|editor|template|wizard)\b|\bdescription of the (?:method|function)\b|\binsert description\b|\btemplate\b.*\b(?:file|settings|notice)\b.*\b(?:change|edit|choose|open)\b"
    r"|\bstub (?:produced|created|generated|emitted|inserted|added|made|written)\b|\bfill in (?:the|this|a|your) (?:\w+ )?(?:description|documentation|details|comment|text|body)\b"
    r"|\bto change this (?:template|body|text)\b|^\W*lorem ipsum\b",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint(?:-\w+)*|tslint|jshint|jslint|prettier-ignore|stylelint|istanbul|c8 ignore|v8 ignore|noqa|nosec|nolint|noinspection|pylint|pyright|mypy|flake8|pragma|type:\s*ignore"
    r"|fmt:\s*(?:on|off|skip)|isort|yapf|black|checkstyle|nosonar|sonar\w*|spotless|suppresswarnings|formatter:\s*(?:on|off)|go:\w+|\+build|export \w+$|codecov|coverage|sourcery|ts-(?:ignore|nocheck|expect-error|check)"
    r"|@ts-|@formatter|@flow|language=|region|endregion|lint:|lint\b|cspell|spell-checker|biome-ignore|deno-lint|webpack\w+|jscpd|rubocop|golint|gosec|staticcheck|revive|exhaustive|bandit|skipcq|deepcode|semgrep|ruff)\b",
    re.I,
)
_CODE = re.compile(
    r"^\s*(?:(?:return|throw|raise|yield|await|var|let|const|final|import|from|package|del|assert|defer|go)\b[^.!?]*[;()={}\[\]]"
    r"|(?:if|for|while|switch|else|elif|try|catch|with|def|func|function|class)\b.*[:{]\s*$"
    r"|[\w.$\[\]\"']+(?:,\s*[\w.$]+)*\s*(?::=|[-+*/|&%]?=(?!=))\s*\S.*"
    r"|(?:[\w$]+\s+)?[\w.$]+\s*=\s*[^=].*|[\w.$]+\(.*\)\s*[;,{:]?\s*$|[{}()\[\];]+\s*$|.*;\s*$|.*\)\s*\{\s*$)"
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _name_words(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)
    return {p.lower() for p in parts}


def description(doc: str, column: int) -> str:
    """The comment without marks, tag lines and the sections for parameters, results and exceptions.

    A section ends at the first line that is not indented deeper than its heading.  An underlined
    heading takes everything up to the next blank line.
    """
    kept, inside, skipping_to_blank = [], None, False
    lines = strip_marks(doc, column)
    for i, line in enumerate(lines):
        text = line.strip()
        indent = len(line) - len(line.lstrip())
        if skipping_to_blank:
            skipping_to_blank = bool(text)
            continue
        if inside is not None:
            if text and indent > inside:
                continue
            inside = None
        if _SECTION.match(line):
            inside = 0 if i == 0 else indent
        elif _UNDERLINED.match(line) and i + 1 < len(lines) and re.match(r"^\s*[-=~]{3,}\s*$", lines[i + 1]):
            skipping_to_blank = True
        elif not _TAG.match(line):
            kept.append(line.rstrip())
    return "\n".join(kept).strip("\n")


def informative_words(text: str, name: str) -> int:
    """Words of a description besides those of the function's own name.

    Lines that are a promise to document later, a stub or template notice, a directive to a tool or
    code do not count.
    """
    own = _name_words(name)
    count = 0
    for line in text.split("\n"):
        if not line.strip() or any(p.search(line) for p in (_PROMISE, _STUB, _DIRECTIVE)) or _CODE.match(line):
            continue
        for m in _WORD.finditer(line):
            w = m.group(0)
            if w.lower() not in own and not (_name_words(w) <= own and _name_words(w)):
                count += 1
    return count


def function_documentation(sources: DataFrame, file_id: str = "file_id", path: str = "relative_path", source: str = "source") -> DataFrame:
    """(file_id, start_line, function_name, documentation, n_words, trivial) per documented function.

    ``n_words`` counts the informative words.  A null source or path gives no rows; files that
    do not parse give what parses; repeated files repeat their rows.
    """
    kind = sources.schema[file_id].dataType.simpleString()
    schema = f"file_id {kind}, start_line int, function_name string, documentation string, n_words int, trivial boolean"
    names = schema.replace(",", "").split()[::2]
    wanted = sources.where(F.col(source).isNotNull() & F.col(path).isNotNull()).select(
        F.col(file_id).alias("file_id"),
        F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z0-9]+)$", 1)).alias("extension"),
        F.col(source).alias("source"),
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for f, ext, text in zip(pdf["file_id"], pdf["extension"], pdf["source"]):
                for line, name, doc, column in parse_pairs(ext, text):
                    said = description(doc, column)
                    n = informative_words(said, name)
                    rows.append((f, line, name, said, n, n < MIN_WORDS))
            yield pd.DataFrame(rows, columns=names)

    return wanted.mapInPandas(run, schema)
