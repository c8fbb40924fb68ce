"""Tokens of Cypher text, with their places in it."""

from __future__ import annotations

import re
from typing import NamedTuple


class CypherError(ValueError):
    """The text is outside the supported, read-only subset."""


class Token(NamedTuple):
    kind: str  # name, number, string, param, symbol, end
    text: str
    start: int
    end: int

    def word(self, *words: str) -> bool:
        return self.kind == "name" and self.text.upper() in words


PATTERN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<number>(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+|\d+))(?!\w)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`(?:[^`]|``)*`)
    |(?P<param>\$\w+)
    |(?P<name>[^\W\d]\w*)
    |(?P<symbol><>|<=|>=|=~|\.\.|[()\[\]{}:,.|*+\-/%^=<>;])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unquote(text: str) -> str:
    if "\\" not in text:
        return text[1:-1]
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = PATTERN.match(text, at)
        if not m:
            raise CypherError(f"unexpected {text[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind == "string":
            found.append(Token("string", unquote(value), at, m.end()))
        elif kind == "quoted":
            found.append(Token("quoted", value[1:-1].replace("``", "`"), at, m.end()))
        elif kind != "space":
            found.append(Token(kind, value[1:] if kind == "param" else value, at, m.end()))
        at = m.end()
    return [*found, Token("end", "", len(text), len(text))]
