"""Calls in the code lines of one file, also those on the result of another expression."""

from __future__ import annotations

import re
from bisect import bisect_right

_NAME = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)[^\S\n]*\(", re.ASCII)
_WORD = re.compile(r"[\w$]")
_OPEN = {")": "(", "]": "[", "}": "{"}
#: Words before a bracket that do not belong to the expression in it.
_BEFORE = set("if for while switch catch return function elif with assert await yield throw raise new and or not in is lambda del except else case typeof".split())


def _partners(code: str) -> dict[int, int]:
    """Offset of each closing bracket to that of its opening one; a bracket without a partner is passed over."""
    out, stacks = {}, {b: [] for b in "([{"}
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m.group()
        if c in stacks:
            stacks[c].append(m.start())
        elif stacks[_OPEN[c]]:
            out[m.start()] = stacks[_OPEN[c]].pop()
    return out


def _blank(code: str, at: int) -> int:
    """The offset behind the last character before ``at`` that is not white space."""
    while at and code[at - 1].isspace():
        at -= 1
    return at


def _word(code: str, at: int) -> int:
    while at and _WORD.match(code[at - 1]):
        at -= 1
    return at


def _angle(code: str, at: int) -> int:
    """Start of the type arguments that end at ``at``, or ``at`` where there are none."""
    depth = 0
    for i in range(at - 1, -1, -1):
        c = code[i]
        depth += (c == ">") - (c == "<")
        if not depth:
            return i if i and _WORD.match(code[i - 1]) else at
        if not (c.isalnum() or c in "_$<>,.?[] &|"):
            break
    return at


def _start(code: str, end: int, partners: dict[int, int]) -> int:
    """Start of the expression that ends at ``end``, in front of a dot."""
    at = end
    while True:
        here = at
        while at and code[at - 1] in ")]}":
            if at - 1 not in partners:
                return here
            at = partners[at - 1]
            if code[at] == "(":
                at = _angle(code, at) if at and code[at - 1] == ">" else at
            back = _blank(code, at) if "\n" not in code[_blank(code, at) : at] else at
            word = _word(code, back)
            if code[word:back] in _BEFORE or (back < at and code[at] != "("):
                break
            if back and (_WORD.match(code[back - 1]) or code[back - 1] in ")]}\"'`"):
                at = back
        quote = code[at - 1] if at else ""
        if quote in ("'", '"', "`") and quote and at == here:
            first = code.rfind(quote, 0, at - 1)
            if first < 0:
                return here
            at = _word(code, first)
        else:
            word = _word(code, at)
            if code[word:at] not in _BEFORE or here == at:
                at = word
        if at == here:
            return at
        dot = _blank(code, at)
        if not dot or code[dot - 1] != "." or code[max(0, dot - 3) : dot] == "...":
            back = _blank(code, at)
            return back - 3 if code[_word(code, back) : back] == "new" else at
        at = _blank(code, dot - 1)
        while at and code[at - 1] in "?!":
            at -= 1


def calls(lines: list[tuple[int, str, int, bool, str | None]], language: str) -> list[tuple[int, str | None, str, str | None]]:
    """(start_line, caller, name, object) of the calls in ``lines`` (line, code, head, is_class, caller).

    ``head`` is the length of the declaration's header at the beginning of a line, its name and the bracket
    behind it included.  A call begins where its object does, so the calls of a chain share a line.
    """
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x[1]) + 1
    code = "\n".join(x[1] for x in lines)
    partners = _partners(code)
    closing = {b: a for a, b in partners.items()}
    out = []
    for m in _NAME.finditer(code):
        i = bisect_right(starts, m.start()) - 1
        head, is_class = lines[i][2], lines[i][3]
        if m.start() - starts[i] < head:
            continue
        begin, owner = m.start(), None
        back = _blank(code, begin)
        dotted = back > 0 and code[back - 1] == "." and code[max(0, back - 3) : back] != "..."
        if dotted:
            end = _blank(code, back - 1)
            while end and code[end - 1] in "?!":
                end -= 1
            first = _start(code, end, partners)
            if not (code[first:end].isdigit() and back < begin):
                begin, owner = first, code[first:end] or None
        elif head and language == "Java" and back and code[back - 1] == "@":
            continue  # an annotation of a parameter
        elif is_class and language != "Python":
            # a member in the body of a one-line class
            after = code[closing.get(m.end() - 1, m.end() - 1) + 1 :].split("\n", 1)[0]
            if re.match(r"\s*(?:throws[\w\s,.]+|:[^{;=]+)?\{", after) and code[_word(code, back) : back] != "new":
                continue
        i = bisect_right(starts, begin) - 1
        out.append((lines[i][0], lines[i][4], m.group(1), owner))
    return out
