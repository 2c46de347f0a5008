"""Source files that do not parse.

A file is cut into short units: the statements of each block and the contents of each bracket
group, written as sequences of token kinds with inner groups as single tokens.  The same unit
occurs in many files, so Spark collects the distinct units of the whole corpus, parses each of
them once with the error-correcting chart of its language, and joins the edits back to the files.
Stray and unclosed brackets and unfinished strings stay in their units as tokens that no production has, so
that the chart repairs them together with what is around them.  A file's repair cost is the sum over its units,
its conflict markers, unfinished comments and, in Python, the lines whose indentation or clause does not fit.
Any edit flags the file; where the edits lie tells truncation, conflict, mismatch and local damage apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import grammars
from codestrata.llm.chart import ChartGrammar
from codestrata.sources.scratch import Scratch

LANGUAGES = {"py": "py", "pyi": "py", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "ts", "d.ts": "ts", "java": "java", "go": "go"}

_WORDS = {
    "js": "var let const function class extends import export default if else for while do switch case break continue return throw try catch finally"
    " new delete typeof instanceof in void yield await async static get set of from as debugger",
    "java": "package import class interface enum extends implements permits throws public protected private static final abstract synchronized native"
    " transient volatile strictfp default if else for while do switch case break continue return throw try catch finally new instanceof assert yield",
    "go": "package import func type var const struct interface map chan if else for range switch case default select go defer return break continue goto fallthrough",
    "py": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
}
_WORDS["ts"] = _WORDS["js"] + " interface type enum namespace module declare abstract readonly public private protected implements override satisfies keyof infer is asserts unique global accessor out"
#: Words that are names except where the grammar of their language wants them.
_SOFT = {
    "js": set("async static get set of from as yield await let".split()),
    "ts": set("async static get set of from as let interface type namespace module declare abstract readonly public private protected implements override satisfies keyof infer is asserts unique global accessor out".split()),
    "java": {"record", "sealed", "permits", "yield"}, "go": set(), "py": {"match", "case", "type"},
}
_STRING = r'"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\''
_NUMBER = r"\.?\d(?:[eEpP][+-]|[\w.])*"
_C_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
_CONFLICT = r"(?:<{7}|={7}|>{7}|\|{7})(?![<=>|])[^\n]*"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_OPS = {
    "js": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|\*\*|<<",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<",
    "go": r"<<=|>>=|&\^=|\.\.\.|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<<|&\^",
    "py": r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<>|<=|>=|[-+*/%&|^@]=|\*\*|//|<<",
}
_OPS["ts"] = _OPS["js"]
_KINDS = {"|": "bar", "%": "o", "^": "o"}
_BINARY = set("=== !== == != <= >= && || ?? << // &^ <>".split())


def _lexer(lang: str) -> re.Pattern:
    if lang == "py":
        prefix = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"
        s = rf'{prefix}(?:"""(?s:(?:[^\\]|\\.)*?)"""|\'\'\'(?s:(?:[^\\]|\\.)*?)\'\'\'|(?!"""|\'\'\')(?:{_STRING}))'
        comment, extra = r"#[^\n]*|\\\r?\n", ""
    elif lang == "go":
        s, comment, extra = rf"`[^`]*`|{_STRING}", _C_COMMENT, ""
    elif lang == "java":
        s, comment, extra = rf'"""(?s:(?:[^\\]|\\.)*?)"""|(?!""")(?:{_STRING})', _C_COMMENT, r"|(?P<hyphen>non-sealed\b)"
    else:
        s, comment, extra = rf"`|{_STRING}", _C_COMMENT + r"|(?<![\s\S])#![^\n]*", ""
    return re.compile(
        rf"(?P<space>[ \t\f\r﻿\xa0]+)|(?P<nl>\n)|(?P<conflict>(?<![^\n]){_CONFLICT})|(?P<comment>{comment})"
        rf"|(?P<string>{s})|(?P<number>{_NUMBER})|(?P<name>{_NAME}){extra}|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<op>{_OPS[lang]})|(?P<char>(?s:.))"
    )


_LEXERS: dict[str, re.Pattern] = {}
_KEYWORDS = {k: set(v.split()) for k, v in _WORDS.items()}
_PAIR = {"(": ")", "[": "]", "{": "}"}
_GROUP = {"(": "P", "[": "B", "{": "C"}
#: After these a slash starts a regular expression and a line goes on.
_OPERAND_NEXT = set("( [ { , ; = ~= : ? o + - * / < > bar & ! ~ => -> := <- return typeof case in of instanceof new delete void throw else do await yield && extends default".split())
#: Tokens that a line cannot begin with as a new statement of a language without semicolons.
_GOES_ON = set(". ?. , ; = ~= : ? o + - * / < > bar & => instanceof in of as satisfies extends implements from".split())
_JS_SEMI_FREE = _GOES_ON - {"+", "-", "*", "/", "<", "from", "of", "as"} | {"*", "/", "<", "+", "-"}
_GO_ENDS = {"n", "0", "s", "return", "break", "continue", "fallthrough", "++", "--", "P", "B", "C", "s!", "P!", "B!", "C!", "!"}
_JS_CANNOT_END = _OPERAND_NEXT - {"default", "return"} | {"const", "var", "function", "class", "import", "export", "if", "while", "for", "switch", "try", "finally", "catch", "@", "..."}


@dataclass
class Shape:
    """What a file is made of: units by kind and text, and the edits found outside of them."""

    units: dict[tuple[str, str], tuple[int, int]] = field(default_factory=dict)  # (start symbol, tokens) -> (count, first place)
    edits: list[tuple[str, int]] = field(default_factory=list)  # (what, offset)

    def add(self, start: str, tokens: list[str], at: int) -> None:
        key = (start, " ".join(tokens))
        n, first = self.units.get(key, (0, at))
        self.units[key] = (n + 1, min(first, at))


@dataclass
class _Frame:
    opener: str
    context: str  # how the content is read
    at: int
    tokens: list[str] = field(default_factory=list)
    statements: list[tuple[list[str], int]] = field(default_factory=list)
    start: int = 0
    fresh_line: bool = False


def _template_end(text: str, at: int) -> int:
    """Offset after the template literal that starts at ``at``; -1 if it never ends."""
    depth: list[int] = []  # open braces inside of each ${
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if not depth or depth[-1] == -1:  # in template text
            if c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif c == "$" and text.startswith("${", i):
                depth.append(0)
                i += 1
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            if depth[-1] == 0:
                depth.pop()
            else:
                depth[-1] -= 1
        elif c == "`":
            depth.append(-1)
        elif c in "\"'":
            m = re.compile(_STRING).match(text, i)
            if m:
                i = m.end()
                continue
        i += 1
    return -1


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def shape(lang: str, text: str) -> Shape:
    """Units and structural edits of a source text."""
    if lang not in _LEXERS:
        _LEXERS[lang] = _lexer(lang)
    if lang == "py":
        return _python_shape(text)
    out = Shape()
    match, words, soft = _LEXERS[lang].match, _KEYWORDS[lang], _SOFT[lang]
    script, go, java = lang in ("js", "ts"), lang == "go", lang == "java"
    stack = [_Frame("", "top", 0)]
    frame = stack[0]
    toks = frame.tokens
    prev, at, n = "", 0, len(text)
    newline = False

    def end_statement() -> None:
        if frame.tokens:
            frame.statements.append((list(frame.tokens), frame.start))
            frame.tokens.clear()

    while at < n:
        m = match(text, at)
        kind, here, at = m.lastgroup, at, m.end()
        if kind == "space":
            continue
        if kind == "nl":
            newline = True
            if go and frame.context != "list" and toks and toks[-1] in _GO_ENDS:
                end_statement()
                prev = ""
            continue
        if kind == "comment":
            if go and "\n" in m.group():
                newline = True
            elif "\n" in m.group():
                newline = True
            continue
        if kind == "conflict":
            out.edits.append(("conflict", here))
            continue
        if kind == "name":
            w = m.group()
            t = w if w in words and prev not in (".", "?.", "::") or (w == "class" and java) or (w == "super" and prev == "?") else "n"
            if script and t != "n" and t not in ("default", "case") and frame.opener == "{" and _next_char(text, at) == ":" and (not toks or toks[-1] in (",", "C", ";")) and t not in soft:
                t = "n"  # a keyword as a property name
            elif t in soft and not _soft_keyword(lang, t, toks, text, at):
                t = "n"
            elif java and w in ("record", "sealed") and re.match(r"\s+\w", text[at : at + 40]) and all(x in words for x in toks):
                t = w
        elif kind == "string":
            t = "s"
            if script and m.group() == "`":
                at = _template_end(text, here)
                if at < 0:
                    out.edits.append(("end", here))
                    at, t = n, "s!"
        elif kind == "number":
            t = "0"
        elif kind == "hyphen":
            t = "non-sealed"
        elif kind == "op":
            w = m.group()
            t = "o" if w in _BINARY or (w == "**" and script) else "~=" if w[-1] == "=" and w not in ("=>", ":=", "<=", ">=") else w
        elif kind == "char":
            c = m.group()
            if text.startswith("/*", here):
                out.edits.append(("open", here))
                break
            if c == "/" and script and (prev in _OPERAND_NEXT or prev == ""):
                r = _REGEX.match(text, here)
                if r:
                    at, t = r.end(), "r"
                else:
                    t = "/"
            elif c in "\"'`":
                out.edits.append(("end" if c == "`" or text.find("\n", here) < 0 else "string", here))
                stop = text.find("\n", here)
                at = n if c == "`" or stop < 0 else stop
                t = "s!"
            else:
                t = _KINDS.get(c, c)
                if c in "%^" and go and c == "^":
                    t = "^"
        elif kind == "open":
            c = m.group()
            if script and newline and _statement_break(toks, c, prev):
                end_statement()
            if not toks:
                frame.start = here
            stack.append(_Frame(c, _context(lang, c, frame, prev), here, start=at))
            frame = stack[-1]
            toks = frame.tokens
            prev, newline = c, False
            continue
        else:  # close
            c = m.group()
            if len(stack) == 1 or _PAIR[frame.opener] != c:
                held = [f.opener for f in stack[1:]]
                if any(_PAIR[o] == c for o in held):
                    while _PAIR[frame.opener] != c:
                        out.edits.append(("bracket", frame.at))
                        frame, toks = _close(out, lang, stack, "!")
                else:
                    out.edits.append(("bracket", here))
                    if not toks:
                        frame.start = here
                    toks.append("!")
                    continue
            done = frame.opener
            frame, toks = _close(out, lang, stack)
            prev = _GROUP[done]
            newline = False
            if done == "{" and _block_ends(lang, frame, text, at):
                end_statement()
                prev = ""
            continue
        # an ordinary token
        if script and newline and _statement_break(toks, t, prev):
            end_statement()
        newline = False
        if not toks:
            frame.start = here
        toks.append(t)
        prev = t
        if t == ";" and frame.context != "list":
            if not (go and toks[0] in ("if", "for", "switch")):
                if go:
                    toks.pop()
                end_statement()
                prev = ""
        elif t == ":" and script and toks[0] in ("case", "default") and "?" not in toks and frame.context != "list":
            pass
    while len(stack) > 1:
        out.edits.append(("end", n))
        frame, toks = _close(out, lang, stack, "!")
    end_statement()
    _emit(out, lang, frame)
    if go and not any(s[:1] == ["package"] for s, _ in frame.statements[:1]):
        out.edits.append(("package", 0))
    return out


def _next_char(text: str, at: int) -> str:
    m = re.compile(r"\s*(.)").match(text, at)
    return m.group(1) if m else ""


def _soft_keyword(lang: str, t: str, toks: list[str], text: str, at: int) -> bool:
    """Whether a word that may be a name stands where its language reads it as a keyword."""
    nxt = _next_char(text, at)
    last = toks[-1] if toks else ""
    if nxt in (",", ".", ")", ";", "=", "]", "?", ":") and t not in ("is",):
        return t in ("async", "static") and False
    if t in ("of", "from", "as", "satisfies", "is", "implements", "infer"):
        return last in ("n", "C", "B", "P", "s", "*", ">", "default", "o") if t != "infer" else True
    if t in ("keyof", "unique", "asserts"):
        return last in (":", "=", "<", "bar", "&", ",", "=>", "in", "extends", "?", "[", "")
    if nxt == "(" and t not in ("async", "await", "yield", "override", "public", "private", "protected"):
        return False
    if t == "await" or t == "yield":
        return True
    if nxt in ("<", "(") and t == "async":
        return True
    return bool(re.match(r"[\w$\[{*\"'#@]", nxt))


def _context(lang: str, c: str, frame: _Frame, prev: str) -> str:
    toks = frame.tokens
    if c != "{":
        if lang == "go" and c == "(" and toks and toks[-1] in ("import", "const", "var", "type") and len(toks) == 1:
            return "group"
        return "list"
    if lang == "java":
        if any(w in toks for w in ("class", "interface", "enum", "record")):
            return "member"
        if toks and toks[-1] == "P" and "new" in toks:
            return "member"
        if prev in ("=", "B", ",", "(", "{") and toks[-1:] != ["P"] and (toks or frame.context == "list"):
            return "list"
        return "block"
    if lang == "go":
        if prev in ("struct", "interface"):
            return "block"
        if prev == "n" or prev == "B":
            heads = ("if", "for", "switch", "select", "func")
            return "block" if any(h in toks for h in heads) and frame.context != "list" else "list"
        return "list" if frame.context == "list" and prev in ("(", "[", "{", ",", ":", "") else "block"
    return "script"


def _statement_break(toks: list[str], t: str, prev: str) -> bool:
    """A newline between ``prev`` and ``t`` ends a statement of a script."""
    return bool(toks) and prev not in _JS_CANNOT_END and t not in _JS_SEMI_FREE and not (t in ("else", "catch", "finally", "while") and prev == "C") and prev != "" and not (
        prev == "P" and toks[0] in ("if", "while", "for") and toks.count("P") == 1
    ) and not (prev in ("else", "do"))


def _block_ends(lang: str, frame: _Frame, text: str, at: int) -> bool:
    """Whether the ``}`` just read ends the statement it belongs to."""
    if frame.context == "list" or lang == "go":
        return False
    toks = frame.tokens
    m = re.compile(r"(?:\s+|//[^\n]*|/\*(?s:.*?)\*/)*(\w+|\S)").match(text, at)
    nxt = m.group(1) if m else ""
    first = toks[0] if toks else ""
    if nxt in ("else", "catch", "finally") or (nxt == "while" and first == "do"):
        return False
    if lang == "java":
        if "=" in toks or "->" in toks[:1] or first in ("return", "throw") or ("new" in toks):
            return nxt[:1] not in (";", ",", ".", ")", "]", "?", ":", "[", "+", "&", "|", "=") and first in ("case", "default")
        return nxt[:1] not in (",", ".", ")") or first in ("if", "for", "while", "try", "switch")
    head = [x for x in toks if x not in ("export", "default", "async", "declare", "abstract", "static", "public", "private", "protected", "readonly", "override", "get", "set", "*")]
    h = head[0] if head else ""
    if h in ("if", "for", "while", "try", "switch", "function", "class", "interface", "enum", "namespace", "module", "else", "@") and "=" not in toks:
        return True
    if h == "case" or first == "default":
        return toks[-2:-1] == [":"] and nxt[:1] not in (",", ".", ")", ";")
    if h in ("n", "s", "B", "#", "0") and "P" in toks and "=" not in toks and "." not in toks[:2] and "?" not in toks and "=>" not in toks and toks[-2:-1] != ["o"]:
        return nxt[:1] not in (",", ".", ")", "(", "?", "=", "+", "&", "|", "`")
    return toks == ["C"] and nxt[:1] not in (",", ".", ")", "=", ";", "(", "?")


def _close(out: Shape, lang: str, stack: list[_Frame], error: str = "") -> tuple[_Frame, list[str]]:
    """Take the innermost group off the stack, emit its units, and put its token, marked by ``error``, into the outer one."""
    inner = stack.pop()
    if inner.tokens and inner.context != "list":
        inner.statements.append((list(inner.tokens), inner.start))
        inner.tokens.clear()
    _emit(out, lang, inner)
    outer = stack[-1]
    if not outer.tokens:
        outer.start = inner.at
    outer.tokens.append(_GROUP[inner.opener] + error)
    return outer, outer.tokens


_START = {
    ("java", "top"): "Top", ("java", "member"): "Mem", ("go", "top"): "Top", ("go", "group"): "Gr",
}


def _emit(out: Shape, lang: str, frame: _Frame) -> None:
    if frame.context == "list":
        toks = frame.tokens
        if not toks:
            return
        if ";" in toks or (lang in ("js", "ts", "java") and _is_header(toks)):
            out.add("H", toks, frame.at)
        elif "<" in toks or "," not in toks or "lambda" in toks or toks[0] == ",":
            out.add("L", toks, frame.at)
        else:
            item: list[str] = []
            for t in toks:
                if t == ",":
                    if item:
                        out.add("It", item, frame.at)
                    elif frame.opener != "[" or lang not in ("js", "ts"):  # an array of a script may have holes
                        out.add("L", [",", ","], frame.at)
                    item = []
                else:
                    item.append(t)
            if item:
                out.add("It", item, frame.at)
        return
    start = _START.get((lang, frame.context), "S")
    if lang in ("js", "ts", "java"):  # an else after a branch without braces belongs to the statement before it
        joined: list[tuple[list[str], int]] = []
        for tokens, at in frame.statements:
            if tokens[0] == "else" and joined and "if" in joined[-1][0]:
                joined[-1] = (joined[-1][0] + tokens, joined[-1][1])
            else:
                joined.append((tokens, at))
        frame.statements = joined
    if frame.context == "script" and frame.statements:
        one = frame.statements[0][0]
        if len(frame.statements) == 1 and ";" not in one and ("," in one or ":" in one or "as" in one or one == ["n"] or one[:1] == ["..."]):
            # an object literal, a pattern, or a list of names
            if "<" in one or "," not in one or "case" in one:
                out.add("L|S", one, frame.at)
                return
            items, item = [], []
            for t in [*one, ","]:
                if t == ",":
                    items.append(item)
                    item = []
                else:
                    item.append(t)
            if one[0] in ("const", "let", "var", "return", "import", "export", "case", "default", "if", "for"):
                out.add("S", one, frame.at)
                return
            for i, item in enumerate(items):
                if item:
                    out.add("It|S", item, frame.at)
                elif i + 1 < len(items):
                    out.add("L", [",", ","], frame.at)
            return
    for tokens, at in frame.statements:
        out.add(start, tokens, at)


def _is_header(toks: list[str]) -> bool:
    return toks[0] in ("const", "let", "var") or "of" in toks or (":" in toks and "?" not in toks and toks[-1] != "C" and "->" not in toks and "=>" not in toks and "case" not in toks and toks[0] in ("n", "final", "@") and toks.index(":") >= 2)


_OPENS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async", "match", "case"}
_FOLLOWS = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "try", "except", "async"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}


def _python_shape(text: str) -> Shape:
    out = Shape()
    match, words = _LEXERS["py"].match, _KEYWORDS["py"]
    stack = [_Frame("", "top", 0)]
    frame = stack[0]
    indents = [0]
    heads: list[list[str]] = [[]]  # the statement heads of each open block, newest last
    header = False  # the last logical line opened a block
    at, n = 0, len(text)
    line_start, prev = True, ""
    column = 0

    def finish_line(here: int) -> None:
        nonlocal header
        toks = frame.tokens
        if not toks:
            return
        if toks[0] in ("match", "case") and ":" not in toks:
            toks[0] = "n"
        first = toks[0]
        opens = toks[-1] == ":" and first in _OPENS and not (first in ("match", "case") and len(toks) < 3)
        seen = heads[-1]
        if first in _FOLLOWS:
            if not seen or seen[-1] not in _FOLLOWS[first]:
                out.edits.append(("clause", frame.start))
        elif seen and seen[-1] == "try":
            out.edits.append(("clause", frame.start))
        seen[:] = [first if first not in ("n",) else "n"]
        parts: list[list[str]] = [[]]
        for t in toks:
            if t == ";":
                parts.append([])
            else:
                parts[-1].append(t)
        for i, part in enumerate(parts):
            if part:
                out.add("S", part, frame.start)
            elif i + 1 < len(parts):
                out.edits.append(("clause", frame.start))
        header = opens
        toks.clear()

    while at < n:
        if line_start and len(stack) == 1:
            m = re.compile(r"[ \t\f]*").match(text, at)
            lead = m.group().expandtabs(8)
            nxt = text[m.end() : m.end() + 1]
            if nxt not in ("", "\n", "\r", "#", "﻿"):
                column = len(lead.replace("\f", ""))
                if header:
                    if column > indents[-1]:
                        indents.append(column)
                        heads.append([])
                    else:
                        out.edits.append(("indent", m.end()))
                elif column > indents[-1]:
                    out.edits.append(("indent", m.end()))
                header = False
                while column < indents[-1]:
                    if heads.pop()[-1:] == ["try"]:
                        out.edits.append(("clause", m.end()))
                    indents.pop()
                    if column > indents[-1]:
                        out.edits.append(("indent", m.end()))
                        indents.append(column)
                        heads.append([])
                        break
            at = m.end()
            line_start = False
            if at >= n:
                break
        m = match(text, at)
        kind, here, at = m.lastgroup, at, m.end()
        if kind == "space" or kind == "comment":
            continue
        if kind == "nl":
            if len(stack) == 1:
                finish_line(here)
                line_start = True
                prev = ""
            continue
        if kind == "conflict":
            out.edits.append(("conflict", here))
            continue
        if kind == "name":
            w = m.group()
            t = w if w in words and (prev != "." or w == "import" and frame.tokens[:1] == ["from"]) else "n"
            if t in ("match", "case", "type") and (frame.tokens or len(stack) > 1 or not re.match(r"[ \t]*[\w\"'(\[{*-]", text[at : at + 30]) or re.match(r"[ \t]*(?:=|\.|in\b|is\b|and\b|or\b|not in\b|if\b)", text[at : at + 30])):
                t = "n"
        elif kind == "string":
            t = "s"
        elif kind == "number":
            t = "0" if re.fullmatch(_PY_NUMBER, m.group()) else "?"
        elif kind == "op":
            w = m.group()
            t = "o" if w in _BINARY else "~=" if w[-1] == "=" and w not in (":=", "<=", ">=") else ":=" if w == ":=" else w
            if w == "->":
                frame.tokens.append("-")
                t = ">"
        elif kind == "open":
            c = m.group()
            if not frame.tokens:
                frame.start = here
            stack.append(_Frame(c, "list", here))
            frame, prev = stack[-1], c
            continue
        elif kind == "close":
            c = m.group()
            if len(stack) == 1 or _PAIR[frame.opener] != c:
                if any(_PAIR[f.opener] == c for f in stack[1:]):
                    while _PAIR[frame.opener] != c:
                        out.edits.append(("bracket", frame.at))
                        frame, _ = _close(out, "py", stack, "!")
                else:
                    out.edits.append(("bracket", here))
                    if not frame.tokens:
                        frame.start = here
                    frame.tokens.append("!")
                    continue
            frame, _ = _close(out, "py", stack)
            prev = frame.tokens[-1]
            continue
        else:
            c = m.group()
            if c in "\"'":
                open_ended = text.startswith(c * 3, here)
                stop = n if open_ended else text.find("\n", here)
                out.edits.append(("end" if open_ended or stop < 0 else "string", here))
                at = n if stop < 0 else stop
                t = "s!"
            else:
                t = {"|": "bar", "%": "o", "^": "^"}.get(c, c)
        if not frame.tokens:
            frame.start = here
        frame.tokens.append(t)
        prev = t
    while len(stack) > 1:
        out.edits.append(("end", n))
        frame, _ = _close(out, "py", stack, "!")
    finish_line(n)
    if header:
        out.edits.append(("open", n))
    while heads:
        if heads.pop()[-1:] == ["try"]:
            out.edits.append(("open", n))
    return out


_PY_NUMBER = r"0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?[jJ]?"


_GRAMMARS: dict[str, ChartGrammar] = {}


def unit_edits(lang: str, start: str, tokens: str, most: int | None = None) -> int:
    """Least edits that make a unit parse; with ``most``, one more than that for anything worse.

    ``start`` may name alternatives, of which the cheapest counts.
    """
    if lang not in _GRAMMARS:
        _GRAMMARS[lang] = ChartGrammar(
            {"js": grammars.GRAMMAR_JS, "ts": grammars.GRAMMAR_TS, "java": grammars.GRAMMAR_JAVA, "go": grammars.GRAMMAR_GO, "py": grammars.GRAMMAR_PY}[lang]
        )
    g = _GRAMMARS[lang]
    toks = tokens.split()
    starts = [s for s in start.split("|") if s in g.start] or ["L"]
    if any(g.error_at(toks, s) is None for s in starts):
        return 0
    return max(1, g.repair(toks, "|".join(starts), most))


_UNIT_COLUMNS = "file_id string, lang string, what string, start string, tokens string, n int, at int"


def extension_of(path: Column) -> Column:
    """Extension of a path, lower case; ``d.ts`` counts as one; '' without any."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.when(name.endswith(".d.ts"), F.lit("d.ts")).otherwise(F.regexp_extract(name, r".\.([^.]+)$", 1))


def language_of(extension: Column) -> Column:
    """Language that an extension stands for; null for others."""
    out = F.lit(None).cast("string")
    for ext, lang in LANGUAGES.items():
        out = F.when(extension == ext, F.lit(lang)).otherwise(out)
    return out


def source_units(sources: DataFrame, file_id: str = "file_id", path: str = "relative_path", source: str = "source") -> DataFrame:
    """(file_id, lang, what, start, tokens, n, at): the units of each file and its structural edits.

    ``what`` is ``unit``, or the kind of a structural edit; every file also has one row ``file``.  Files
    with a null source or an extension of no supported language are left out.
    """
    wanted = sources.select(
        F.col(file_id).cast("string").alias("file_id"), language_of(extension_of(F.col(path))).alias("lang"), F.col(source).alias("source")
    ).where("lang is not null and source is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _UNIT_COLUMNS.split(", ")]
        for pdf in parts:
            rows = []
            for f, lang, text in zip(pdf["file_id"], pdf["lang"], pdf["source"]):
                made = shape(lang, text)
                rows.append((f, lang, "file", "", "", 1, len(text)))
                rows.extend((f, lang, "unit", s, t, n, at) for (s, t), (n, at) in made.units.items())
                rows.extend((f, lang, what, "", "", 1, at) for what, at in made.edits)
            yield pd.DataFrame(rows, columns=names)

    return wanted.mapInPandas(run, _UNIT_COLUMNS)


def parse_units(units: DataFrame) -> DataFrame:
    """(lang, start, tokens, edits) of the distinct units that do not parse; each is parsed and repaired once."""
    distinct = units.where("what = 'unit'").select("lang", "start", "tokens").distinct()
    # few bytes but much work a row: an explicit number keeps the units spread over all cores
    distinct = distinct.repartition(4 * units.sparkSession.sparkContext.defaultParallelism)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            edits = [unit_edits(*u) for u in zip(pdf["lang"], pdf["start"], pdf["tokens"])]
            yield pdf.assign(edits=edits)

    return distinct.mapInPandas(run, "lang string, start string, tokens string, edits int").where("edits > 0")


#: Edits that are shown inside of the units that the chart repairs; their rows name places.
_IN_UNITS = ("string", "bracket", "end")


def syntax_repairs(
    sources: DataFrame, scratch: Scratch, file_id: str = "file_id", path: str = "relative_path", source: str = "source"
) -> DataFrame:
    """(file_id, lang, edits, kind) per file of a supported language.

    ``edits`` is the least repair cost, 0 for a file that parses.  ``kind`` is null without edits, else ``conflict`` (stray conflict markers),
    ``mismatch`` (the file's units mostly do not parse), ``truncation`` (something is open at the end and
    nothing but the last units is damaged) or ``local``.  An empty text parses except in Go.
    """
    units = scratch.save(source_units(sources, file_id, path, source))
    bad = scratch.save(parse_units(units))
    structural = units.where("what not in ('unit', 'file')").select("file_id", F.col("what"), "at", (~F.col("what").isin(*_IN_UNITS)).cast("int").alias("edits"))
    broken = units.where("what = 'unit'").join(bad, ["lang", "start", "tokens"]).select(
        "file_id", F.lit("unit").alias("what"), "at", (F.col("edits") * F.col("n")).alias("edits")
    )
    files = units.where("what in ('unit', 'file')").groupBy("file_id", "lang").agg(
        F.sum(F.when(F.col("what") == "unit", 1).otherwise(0)).alias("n_units"), F.max(F.when(F.col("what") == "file", F.col("at"))).alias("size")
    )
    found = structural.unionByName(broken).groupBy("file_id").agg(
        F.sum("edits").cast("bigint").alias("edits"), F.count(F.when(F.col("what") == "unit", 1)).alias("bad_units"),
        F.count(F.when(F.col("what") == "conflict", 1)).alias("conflicts"), F.count(F.when(F.col("what").isin("open", "end"), 1)).alias("open"),
        F.min(F.when(F.col("what").isin("unit", "bracket", "clause", "indent", "string"), F.col("at"))).alias("first"),
    )
    kind = (
        F.when(F.coalesce("edits", F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(F.col("conflicts") > 0, F.lit("conflict"))
        .when((F.col("bad_units") >= 3) & (F.col("bad_units") * 4 >= F.col("n_units")) | (F.col("bad_units") == F.col("n_units")), F.lit("mismatch"))
        .when((F.col("open") > 0) & ((F.col("first").isNull()) | (F.col("first") * 10 >= F.col("size") * 5)), F.lit("truncation"))
        .otherwise(F.lit("local"))
    )
    return files.join(found, "file_id", "left").select("file_id", "lang", F.coalesce("edits", F.lit(0)).alias("edits"), kind.alias("kind"))


#: What a message must say to report content that does not parse.
_SYNTAX_MESSAGE = (
    r"(?i)syntax|unexpected (token|character|symbol|indent|end of (file|input)|eof|identifier|keyword)|invalid (character|token|syntax)"
    r"|untermina|unclosed|never closed|unbalanced|unmatched|missing (closing|opening|delimiter|semicolon|brace|bracket|parenthes)|missing nodes|error node|malformed"
    r"|end of file|\beof\b|mismatch|conflict marker|indentationerror|taberror|parse ?error|parsing error|cannot parse|could not parse|failed to parse"
    r"|\bexpected\b|unerwartet|fehlerhaft"
)
#: Failures of operation and mere warnings, whatever else they say.
_OTHER_MESSAGE = (
    r"(?i)^\s*(warning|warn|info|note|skipped)\b|timed? ?out|timeout|memory|quota|permission|no such file|not found|connection|database|cancell?ed|exceeds|limit\b|no parser"
    r"|unsupported|worker|signal|killed|retried|disk|network|access denied|cannot read|unavailable"
)


def reports_bad_content(message: Column) -> Column:
    """Whether an error text says that the content could not be parsed; false for null, blank or without a reason."""
    return F.coalesce(message.rlike(_SYNTAX_MESSAGE) & ~message.rlike(_OTHER_MESSAGE), F.lit(False))
