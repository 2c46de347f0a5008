"""Imports, comments and registered routes of one source text; small helpers beside the outline."""

from __future__ import annotations

import re
from bisect import bisect_right

from codestrata.parsing import chains
from codestrata.parsing.outline import masked, outline

_IMPORTS = {
    "Python": r"^[ \t]*from[ \t]+(?P<m>[\w.]+)[ \t]+import[ \t]*(?P<n>\([^)]*\)|[^\n;]+)|^[ \t]*import[ \t]+(?P<p>[^\n;]+)",
    "JavaScript": r"^[ \t]*(?:import|export)\b(?:[ \t]+type\b)?[ \t]*(?P<n>[^;'\"_()=]*?)\bfrom[ \t]*(?P<m>_+)|^[ \t]*import[ \t]*(?P<s>_+)|(?:(?:const|let|var)[ \t]+(?P<r>[\w$]+|\{[^}]*\})[ \t]*=[ \t]*)?\brequire\([ \t]*(?P<q>_+)[ \t]*\)",
    "Java": r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<m>[\w.]+?)(?P<n>\.\*)?[ \t]*;",
    "Go": r"^import[ \t]+(?:(?P<a>[\w.]+)[ \t]+)?(?P<m>_+)|^import[ \t]*\((?P<g>[^)]*)\)",
}
_IMPORTS = {k: re.compile(v, re.M) for k, v in _IMPORTS.items()}
_CALLED = re.compile(r"(?<![\w.$])([\w$]+)\.(get|post|put|delete|patch|head|options|all|use|GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|HandleFunc|Handle)\([ \t]*(?=_)")


def _family(source: str | None, language: str | None) -> tuple[str, str]:
    family = "JavaScript" if language == "TypeScript" else language or ""
    return (source or "").replace("\r\n", "\n").replace("\ufeff", ""), family if family in _IMPORTS else ""


def _named(text: str) -> tuple[list[str], list[str]]:
    """(names, aliases) of a list like ``a, b as c``; the alias of a name without one is empty."""
    pairs = [x.split() for x in re.sub(r"[(){}\n]", " ", text).replace(":", " as ").split(",") if x.strip()]
    return [p[0] for p in pairs], [p[2] if len(p) > 2 and p[1] == "as" else "" for p in pairs]


def imports(source: str | None, language: str | None) -> list[tuple]:
    """(module, names, aliases, is_relative, start_line) of the import statements, in order of place."""
    text, family = _family(source, language)
    if not family:
        return []
    code, _, _ = masked(text, family)
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = []
    for m in _IMPORTS[family].finditer(code):
        g = m.groupdict()
        at = bisect_right(breaks, m.start() + len(m.group()) - len(m.group().lstrip())) + 1
        part = lambda k: text[m.start(k) : m.end(k)] if g.get(k) else ""
        if family == "Python" and g["p"]:
            for module, alias in zip(*_named(code[m.start("p") : m.end("p")])):
                out.append((module, [], [alias] if alias else [], False, at))
        elif family == "Python":
            names, aliases = _named(code[m.start("n") : m.end("n")])
            out.append((g["m"], names, aliases, g["m"].startswith("."), at))
        elif family == "Java":
            out.append((g["m"], ["*"] if g["n"] else [g["m"].rsplit(".", 1)[-1]], [""], False, at))
        elif family == "Go" and g["g"] is not None:
            for k, row in enumerate(part("g").split("\n")):
                q = re.match(r"\s*([\w.]+)?\s*[\"`]([^\"`]+)", row)
                if q:
                    out.append((q.group(2), [], [q.group(1)] if q.group(1) else [], q.group(2).startswith("."), at + k))
        elif family == "Go":
            out.append((part("m").strip("\"`"), [], [g["a"]] if g["a"] else [], part("m")[1:2] == ".", at))
        else:
            module = (part("m") or part("s") or part("q")).strip("'\"`")
            names, aliases = _named((g["n"] or g["r"] or "").replace("* as", "*as"))
            names, aliases = [n if not n.startswith("*as") else "*" for n in names], [a or "" for a in aliases]
            out.append((module, names, aliases, module.startswith("."), at))
    return out


def comments(source: str | None, language: str | None) -> list[tuple]:
    """(kind, start_line, end_line, text, symbol) of the comments: doc, block or line; runs of line comments are one.

    ``symbol`` is the declaration that a comment documents, docstrings included; null for others.
    """
    text, family = _family(source, language)
    if not family:
        return []
    _, notes, strings = masked(text, family)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    owners: dict[str, list[str]] = {}
    for row in outline(source, language):
        if row[11]:
            owners.setdefault(row[11], []).append(row[2])
    out: list[list] = []
    for a, b in sorted(notes.values()):
        raw = text[a:b]
        kind = "doc" if raw.startswith("/**") else "block" if raw.startswith("/*") else "line"
        alone = not text[text.rfind("\n", 0, a) + 1 : a].strip()
        if kind == "line" and alone and out and out[-1][0] == "line" and out[-1][5] and out[-1][2] == line(a) - 1:
            out[-1][2], out[-1][3] = line(b), out[-1][3] + "\n" + raw
        else:
            out.append([kind, line(a), line(b), raw, None, alone])
    docs = [d for d in owners if family == "Python"]
    for a, b in strings.items():
        if text[a:b] in docs:
            out.append(["docstring", line(a), line(b), text[a:b], None, True])
    for row in out:
        row[4] = owners[row[3]].pop(0) if owners.get(row[3]) else None
    return [tuple(r[:5]) for r in sorted(out, key=lambda r: (r[1], r[2]))]


def called_routes(source: str | None, language: str | None) -> list[tuple]:
    """(receiver, method, path, handler, start_line) of routes that are registered by a call with a path."""
    text, family = _family(source, language)
    if family not in ("JavaScript", "Go"):
        return []
    code, _, strings = masked(text, family)
    breaks = [m.start() for m in re.finditer("\n", text)]
    out = []
    for m in _CALLED.finditer(code):
        end = strings.get(m.end(), m.end())
        path = text[m.end() + 1 : end - 1]
        if not path.startswith("/"):
            continue
        rest = re.compile(r"[^()\n]*?,?[ \t]*([\w$.]+)[ \t]*\)").match(code, end)
        out.append((m.group(1), m.group(2), path, rest.group(1) if rest else None, bisect_right(breaks, m.start()) + 1))
    return out


_TOP = {"Java": "<class>", "Go": "<package>"}


def calls(source: str | None, language: str | None) -> list[tuple]:
    """(start_line, caller, name, object) of the calls; see :func:`codestrata.parsing.chains.calls`.

    The caller is the innermost function around the call with its classes, or the placeholder of the language.
    """
    text, family = _family(source, language)
    if not family:
        return []
    code, _, strings = masked(text, family)
    # a string is two quotes and blanks, so that places stay
    parts, at = [], 0
    for a, b in strings.items():
        body = "".join("\n" if c == "\n" else " " for c in code[a + 1 : b - 1])
        parts += [code[at:a], '"', body, '"' if b - a > 1 else ""]
        at = b
    lines = ("".join(parts) + code[at:]).split("\n")
    callers: list[str | None] = [None] * (len(lines) + 2)
    heads, types = {}, set()
    for kind, _, name, chain, owner, first, last, header, *_ in outline(source, language):
        if kind == "class":
            types.add(first)
            body = re.search(r"class\s+\w+\s*(?:\([^)]*\))?\s*:" if family == "Python" else r"\{", lines[first - 1])
            heads[first] = max(heads.get(first, 0), body.end() if body else len(lines[first - 1]))
        elif kind == "function":
            got = re.match(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)", header) if family == "Go" else None
            full = f"({got.group(1)}).{name}" if got else f"{chain}.{name}" if family == "Python" and chain else f"{owner}.{name}" if owner else name
            for n in range(first, min(last, len(lines)) + 1):
                callers[n] = full
            place = re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])[^\n(=]*(?:=\s*(?:async\b)?|\()?", lines[first - 1])
            heads[first] = max(heads.get(first, 0), place.end() if place else 0)
    top = _TOP.get(family, "<module>")
    rows = [(n, x, heads.get(n, 0), n in types, callers[n] or top) for n, x in enumerate(lines, 1) if x.strip()]
    blank = re.compile(r'"[ \n]*"')
    return [(n, caller, name, blank.sub('""', owner) if owner else owner) for n, caller, name, owner in chains.calls(rows, language)]
