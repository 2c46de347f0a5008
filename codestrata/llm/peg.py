"""Packrat parsing expression grammars.

Expressions are small closures ``f(state, at) -> (end, value) | None``.  Named rules keep
their result per position, so every rule runs at most once at each offset and parsing is
linear in the text.  Values keep source offsets; semantic actions append to ``state.out``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Result = tuple[int, Any] | None
Expr = Callable[["State", int], Result]


class State:
    __slots__ = ("text", "memo", "out")

    def __init__(self, text: str):
        self.text = text
        self.memo: dict[tuple[int, int], Result] = {}
        self.out: list[Any] = []


def rx(pattern: str, flags: int = 0) -> Expr:
    """A terminal; its value is the match."""
    match = re.compile(pattern, flags).match

    def run(state: State, at: int) -> Result:
        m = match(state.text, at)
        return (m.end(), m) if m else None

    return run


def seq(*parts: Expr) -> Expr:
    def run(state: State, at: int) -> Result:
        values = []
        for p in parts:
            r = p(state, at)
            if r is None:
                return None
            at = r[0]
            values.append(r[1])
        return at, values

    return run


def choice(*parts: Expr) -> Expr:
    def run(state: State, at: int) -> Result:
        for p in parts:
            r = p(state, at)
            if r is not None:
                return r
        return None

    return run


def many(part: Expr) -> Expr:
    """Zero or more; an empty match ends the repetition."""

    def run(state: State, at: int) -> Result:
        values = []
        while True:
            r = part(state, at)
            if r is None or r[0] == at:
                return at, values
            at = r[0]
            values.append(r[1])

    return run


def opt(part: Expr) -> Expr:
    def run(state: State, at: int) -> Result:
        return part(state, at) or (at, None)

    return run


def ahead(part: Expr) -> Expr:
    def run(state: State, at: int) -> Result:
        return (at, None) if part(state, at) is not None else None

    return run


def balanced(opening: str, closing: str, inner: Expr) -> Expr:
    """Nested pairs of two characters with ``inner`` between them, counted, so that no depth is too great.

    Places that are still open where it fails are remembered, so they are not tried again.
    """
    number = -1 - id(inner)

    def run(state: State, at: int) -> Result:
        text, memo, start, opened = state.text, state.memo, at, []
        while text.startswith(opening, at) or opened:
            if text.startswith(opening, at):
                if (number, at) in memo:
                    break
                opened.append(at)
                at += 1
            elif text.startswith(closing, at):
                opened.pop()
                at += 1
                if not opened:
                    return at, text[start:at]
            else:
                r = inner(state, at)
                if r is None or r[0] == at:
                    break
                at = r[0]
        memo.update({(number, x): None for x in opened})
        return None

    return run


class Grammar:
    """Named rules with memoised results; ``ref`` may name a rule that is defined later."""

    def __init__(self) -> None:
        self._rules: dict[str, tuple[int, Expr, Callable | None]] = {}

    def rule(self, name: str, body: Expr, action: Callable[[State, int, int, Any], Any] | None = None) -> None:
        self._rules[name] = (len(self._rules), body, action)

    def ref(self, name: str) -> Expr:
        rules = self._rules

        def run(state: State, at: int) -> Result:
            number, body, action = rules[name]
            key = (number, at)
            memo = state.memo
            if key in memo:
                return memo[key]
            r = body(state, at)
            if r is not None and action is not None:
                r = (r[0], action(state, at, r[0], r[1]))
            memo[key] = r
            return r

        return run

    def parse(self, text: str, start: str) -> State:
        """The state after ``start`` was tried at 0.  Nesting is counted by :func:`balanced`, so that no depth of the text is one of the stack."""
        state = State(text)
        self.ref(start)(state, 0)
        return state
