"""Declarations of one source text, with the scopes they lie in.

A small helper for one file: strings and comments are blanked (offsets stay), brackets are paired,
declarations are found by one expression per language, and a stack of open scopes gives each its owner and its end.
What the declarations mean (names of parameters, visibility, kinds) is left to column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from codestrata.parsing.chains import _partners

_QUOTED = r'"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\''
_MASKED = {
    "Python": re.compile(rf'"""(?s:(?:[^\\]|\\.)*?)"""|\'\'\'(?s:(?:[^\\]|\\.)*?)\'\'\'|{_QUOTED}|#[^\n]*'),
    "Java": re.compile(rf'"""(?s:(?:[^\\]|\\.)*?)"""|{_QUOTED}|//[^\n]*|/\*(?s:.*?)\*/'),
    "Go": re.compile(rf"`[^`]*`|{_QUOTED}|//[^\n]*|/\*(?s:.*?)\*/"),
    "JavaScript": re.compile(rf"`(?:[^`\\]|\\(?s:.))*`|{_QUOTED}|//[^\n]*|/\*(?s:.*?)\*/"),
}
_JAVA_WORDS = r"public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed|transient|volatile"
_NOT = r"(?!(?:if|for|while|switch|catch|return|new|throw|else|do|try|with|function|await|yield|case|super|this|assert|package|import|class|interface|enum|record|goto|break|continue)\b)"
#: Groups: f function, c class (k its keyword), v variable (q its keyword).
_DECLARED = {
    "Python": r"^[ \t]*(?:(?:async[ \t]+)?def[ \t]+(?P<f>\w+)|(?P<k>class)[ \t]+(?P<c>\w+))|^(?P<v>[A-Za-z_]\w*)[ \t]*(?::[^=\n]+)?=(?!=)",
    "Java": rf"^[ \t]*(?:(?:{_JAVA_WORDS})[ \t]+)*(?:(?P<k>class|interface|enum|record|@interface)[ \t]+(?P<c>\w+)"
    rf"|(?:<[^;{{}}()=]*>[ \t]*)?{_NOT}(?:[\w.$]+(?:[ \t]*<[^;{{}}()=]*>)?(?:[ \t]*\[\])*[ \t]+)?{_NOT}(?P<f>\w+)[ \t]*\((?=[^;{{}}]*[;{{])"
    rf"|{_NOT}[\w.$]+(?:[ \t]*<[^;{{}}()=]*>)?(?:[ \t]*\[\])*[ \t]+{_NOT}(?P<v>\w+)[ \t]*(?:=(?!=)|;))",
    "Go": r"^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<f>\w+)[ \t]*[\[(]|^type[ \t]+(?P<c>\w+)(?:\[[^\]\n]*\])?[ \t]+(?P<k>struct|interface)\b"
    r"|^(?P<q>var|const)[ \t]+(?P<v>\w+)",
    "JavaScript": r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<f>[\w$]+)[ \t]*[<(]"
    r"|^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?P<k>class|interface|enum)[ \t]+(?P<c>[\w$]+)"
    r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<a>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async\b[ \t]*)?(?:function\b[^(\n]*)?(?=\([^;{}]*\)[^;{}\n]*(?:=>|\{)|[\w$]+[ \t]*=>)"
    r"|^[ \t]*(?:export[ \t]+)?(?P<q>const|let|var)[ \t]+(?P<v>[\w$]+)[ \t]*(?::[^=\n]+)?(?:=(?!=)|;)"
    rf"|^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)[ \t]+)*\*?[ \t]*{_NOT}(?P<m>#?[\w$]+)\??[ \t]*(?:<[^(){{}};]*>)?\((?=[^;{{}}]*\)[^;{{}}()]*\{{)",
}
_DECLARED = {k: re.compile(v, re.M) for k, v in _DECLARED.items()}


def _split(text: str) -> list[str]:
    """Parts of a list at its outermost commas; an arrow is no closing bracket."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] not in ("=", "-")):
            depth -= 1
        elif c == "," and depth <= 0:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [" ".join(p.split()) for p in parts if p.strip()]


def masked(text: str, family: str) -> tuple[str, dict[int, tuple[int, int]], dict[int, int]]:
    """(text with comments blank and strings underlined, span of each comment by its end, end of each string by its start)."""
    notes: dict[int, tuple[int, int]] = {}
    strings: dict[int, int] = {}

    def mask(m: re.Match) -> str:
        t = m.group()
        if t[0] in "#/":
            notes[m.end()] = m.span()
            return "".join("\n" if c == "\n" else " " for c in t)
        strings[m.start()] = m.end()
        return "".join("\n" if c == "\n" else "_" for c in t)

    return _MASKED[family].sub(mask, text), notes, strings


def outline(source: str | None, language: str | None) -> list[tuple]:
    """(kind, keyword, name, chain, owner, start_line, end_line, header, parameters, result, above, doc, n_inner) in order of place.

    ``chain`` names all enclosing declarations, ``owner`` the nearest enclosing class.  ``header`` runs to the body;
    ``result`` is the text between the parameters and the body, ``above`` the lines of decorators or annotations.
    A null source or another language has none; brackets without a partner end at the end of the text.
    """
    family = "JavaScript" if language == "TypeScript" else language
    if not source or family not in _MASKED:
        return []
    text = source.replace("\r\n", "\n").replace("﻿", "")
    code, notes, strings = masked(text, family)
    closing = {b: a for a, b in _partners(code).items()}
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    lines = code.split("\n")
    indents = [len(x) - len(x.lstrip(" \t")) if x.strip() else -1 for x in lines]
    for a, b in strings.items():  # a line that begins inside of a string belongs to the line before
        for n in range(line(a), line(b - 1)):
            indents[n] = 1 << 20
    out: list[tuple] = []
    scopes: list[tuple[int, str, bool]] = []  # (end offset, name, is class)
    for m in _DECLARED[family].finditer(code):
        g = m.groupdict()
        kind = "class" if g["c"] else "variable" if g["v"] else "function"
        name = g["c"] or g["v"] or g["f"] or g.get("a") or g.get("m")
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        while scopes and scopes[-1][0] <= start:
            scopes.pop()
        inner = scopes[-1] if scopes else None
        if (g.get("m") or (family == "Java" and kind != "class")) and not (inner and inner[2]):
            continue  # a call or a local variable, not a member
        # the end of the header, and the list of parameters in it
        at, inside, result = m.end(), "", ""
        if kind == "function":
            at = code.find("(", m.start("f") + len(name) if g["f"] else m.start("m") + len(name) if g.get("m") else m.end())
            if at < 0:
                continue
            if g.get("a") and code[m.end()] != "(":
                inside, at = re.compile(r"[\w$]+").match(code, m.end()).group(), m.end()
            else:
                end = closing.get(at, len(text) - 1)
                inside, at = text[at + 1 : end], end + 1
        stop = {"Python": ":", "Go": "{"}.get(family, "{;")
        body = at
        while body < len(code) and code[body] not in stop:
            if g.get("a") and code.startswith("=>", body):
                break
            if family == "Go" and code[body] == "\n":
                break
            # a type in braces or brackets belongs to the header
            body = closing[body] + 1 if code[body] in "([" and body in closing else body + 1
            if family == "Go" and code.startswith(("interface{", "struct{"), body):
                body = closing.get(code.find("{", body), body) + 1
        result = text[at:body].strip() if kind == "function" else ""
        if kind == "variable":
            header, last = lines[line(start) - 1].strip(), start
        elif family == "Python":
            header = text[start:body]
            first, n = line(start), line(body)
            while n < len(lines) and (indents[n] < 0 or indents[n] > indents[first - 1]):
                n += 1
            while n > line(body) and indents[n - 1] < 0:
                n -= 1
            last = breaks[n - 1] if n - 1 < len(breaks) else len(text)
            last = max(last, body + 1)
        else:
            header = text[start : body + 2 * code.startswith("=>", body)]
            opened = code.find("{", body) if g.get("a") and re.match(r"=>\s*\{", code[body : body + 40]) else body
            last = closing.get(opened, body if code[body : body + 1] != "{" else len(text)) if opened >= 0 else body
        above, top = [], line(start) - 1
        while top > 0 and (text[breaks[top - 1] - len(lines[top - 1]) : breaks[top - 1]].strip().startswith("@")) and family != "Go":
            above.insert(0, text[breaks[top - 1] - len(lines[top - 1]) : breaks[top - 1]].strip())
            top -= 1
        doc = None
        if family == "Python":
            q = re.compile(r"\s*[rRuU]?").match(text, body + 1).end() if kind != "variable" else -1
            while q >= 0 and q < len(text) and text[q] == "#":
                q = re.compile(r"[^\n]*\s*[rRuU]?").match(text, q).end()
            doc = text[q : strings[q]] if q in strings else None
        else:
            end = breaks[top - 1] if top > 0 else -1
            parts = []
            while end in notes or (end > 0 and end - 1 in notes):
                a, b = notes.get(end) or notes[end - 1]
                if text[text.rfind("\n", 0, a) + 1 : a].strip():
                    break
                parts.insert(0, text[a:b])
                end = text.rfind("\n", 0, a)
                if family != "Go" or text.startswith("/*", a):
                    break
            doc = "\n".join(parts) or None
            if doc and family != "Go" and not doc.startswith("/**"):
                doc = None
        owner = next((x[1] for x in reversed(scopes) if x[2]), None)
        out.append(
            (kind, g["k"] or g.get("q"), name, ".".join(x[1] for x in scopes) or None, owner, line(start), line(max(start, last - (family == "Python"))),
             " ".join(header.split()), _split(inside), " ".join(result.split()), above, doc, len(scopes))
        )
        if kind != "variable":
            scopes.append((last, name, kind == "class"))
    return out
