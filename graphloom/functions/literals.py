"""Do the values of a question and of its query agree?

The question is read once into typed values: its words are given a kind each (month, year, day or other number, dash,
word), and dates and months are shapes in the string of kinds. Each literal that the query compares with data has
a few acceptable readings, typed alike. A literal is stated if one of its readings is among the question's values.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date

from ..plans.lexer import Token
from .query_text import TEMPORAL, clauses, scan

# Fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER_WORDS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "twenty-five": 25, "thirty": 30, "fifty": 50, "hundred": 100, "thousand": 1000, "double": 2, "twice": 2, "triple": 3, "pair": 2,
    "dozen": 12, "half": 2, "quarter": 4, "percent": 100, "percentage": 100, "week": 7, "weeks": 7, "fortnight": 14, "month": 30, "months": 30, "year": 365, "years": 365,
    "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
#: Values below or from these on are not looked at (identifiers and epochs above).
LEAST, MOST = 2, 1e9

MONTH_NUMBER = {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])} | {"sept": 9}
#: Problem code -> message.
MESSAGES = {
    "placeholder": "unfilled placeholder {} in the question",
    "bound": "bound value {!r} is missing from the query",
    "quoted": "quoted value {!r} is missing from the query",
    "text": "literal {!r} is missing from the question",
    "number": "number {:g} is missing from the question",
    "limit": "LIMIT {:g} is missing from the question",
    "hops": "hop bound {:g} is missing from the question",
}
PIECE = re.compile(r"(?P<number>\d+(?:\.\d+)?)(?P<nth>st|nd|rd|th)?(?![a-z_])|(?P<word>[a-z_][a-z0-9_]*(?:-five)?)|(?P<dash>[-/])")
#: Shapes over the kinds M (month name), Y (four digits), D (one or two digits), - (dash or slash) and their parts' order.
DATES = (("MDY", "mdy"), ("Do?MY", "dmy"), ("Y-D-D", "ymd"))
MONTHS_OF_YEARS = (("MY", "my"), ("Y-D", "ym"))


@dataclass(frozen=True)
class Stated:
    """What a question states."""

    text: str
    numbers: frozenset[float]
    dates: frozenset[tuple[int, int, int]]
    months: frozenset[tuple[int, int]]

    def has(self, reading: tuple) -> bool:
        kind, value = reading
        if kind == "text":
            return plain(value) in plain(self.text)
        if kind == "amounts":
            return all(v == 1 or v in self.numbers for v in value)
        return value in {"number": self.numbers, "date": self.dates, "month": self.months}[kind] if kind != "year" else str(value) in self.text


def plain(text: str) -> str:
    return " ".join(text.lower().replace("_", " ").replace("-", " ").split())


def read_question(question: str) -> Stated:
    low = question.lower()
    pieces, kinds = [], []
    for m in PIECE.finditer(low):
        word = m["word"]
        kind = "-" if m["dash"] else "M" if word in MONTH_NUMBER else "o" if word == "of" else "w" if word else "Y" if len(m["number"]) == 4 else "D" if m["number"].isdigit() and len(m["number"]) < 3 else "n"
        pieces.append(MONTH_NUMBER.get(word, 0) if word else m["number"] or 0)
        kinds.append(kind)
    shape = "".join(kinds)

    def shaped(forms) -> Iterator[dict[str, int]]:
        for form, order in forms:
            for m in re.finditer(f"(?={form})", shape):
                at = [i for i in range(m.start(), len(shape)) if shape[i] in "MYD"][: len(order)]
                yield {part: int(pieces[i]) for part, i in zip(order, at, strict=True)}

    dates = frozenset((v["y"], v["m"], v["d"]) for v in shaped(DATES) if real(v["y"], v["m"], v["d"]))
    months = frozenset((v["y"], v["m"]) for v in shaped(MONTHS_OF_YEARS))
    joined = low.replace(",", "")
    numbers = {float(n) for n in re.findall(r"(?<![a-z0-9_])-?\d+(?:\.\d+)?", joined)} | {float(x) for d in dates for x in d}
    words = set(re.findall(r"[a-z0-9_]+", joined)) | set(re.findall(r"twenty-five", joined))
    numbers |= {float(NUMBER_WORDS[w]) for w in words & NUMBER_WORDS.keys()}
    return Stated(question, frozenset(numbers), dates, months)


def real(y: int, m: int, d: int) -> bool:
    try:
        return date(y, m, d) is not None
    except ValueError:
        return False


def readings(literal: str) -> Iterator[tuple]:
    """What a text literal may stand for: itself, a duration's amounts, or a day, which may bound a month or a year."""
    yield "text", literal
    amounts = re.findall(r"(\d+)([YMWDHMS])", literal)
    if literal.startswith("P") and amounts and "P" + "".join(n + u for n, u in amounts) == literal.replace("T", ""):
        yield "amounts", tuple(float(n) for n, _ in amounts)
    day = re.match(r"(\d{4})-(\d{2})-(\d{2})", literal)
    if not day or not real(*map(int, day.groups())):
        return
    y, m, d = map(int, day.groups())
    yield "date", (y, m, d)
    if d == 1:
        last = (y, m - 1) if m > 1 else (y - 1, 12)
        yield from (("month", (y, m)), ("month", last), ("month", (y, last[1])), ("year", y))
        if m == 1:
            yield "year", y - 1
    if (m, d) == (12, 31):
        yield "year", y


def compared(tokens: list[Token], i: int) -> bool:
    """Whether the literal at ``i`` is compared with data: an operand, a list member of IN, a map value in a pattern, or inside a temporal call there."""
    before, after = tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
    signs = ("=", "<>", "<", ">", "<=", ">=", "=~")
    if before is None:
        return False
    if before.text in signs or before.word("CONTAINS", "WITH") or after is not None and after.text in signs:
        return True
    if before.text == "(" and i > 1 and tokens[i - 2].text.lower() in TEMPORAL:
        j = i - 3
        return j >= 0 and (tokens[j].text in signs or tokens[j].text in "+-")
    if before.text in ("[", ","):
        j = i - 1
        while j >= 0 and tokens[j].text != "[" and tokens[j].text not in "({})":
            j -= 1
        return j > 0 and tokens[j].text == "[" and tokens[j - 1].word("IN")
    if before.text == ":":
        j, depth = i - 1, 0
        while j >= 0:
            depth += (tokens[j].text == "}") - (tokens[j].text == "{")
            if depth < 0:
                break
            j -= 1
        return j > 0 and (tokens[j - 1].kind in ("name", "quoted") or tokens[j - 1].text in "([") and not (j > 1 and tokens[j - 1].text == "(" and tokens[j - 2].kind == "name" and not tokens[j - 2].word("MATCH"))
    return False


def as_number(value: str) -> float | None:
    return float(value) if re.fullmatch(r"-?\d+(?:\.\d+)?", value) else None


def claims(text: str, tokens: list[Token]) -> Iterator[tuple[str, str | float, list[tuple]]]:
    """(code, value, readings) of the literals that a question has to state."""
    ordered = any(c.name == "ORDER BY" for c in clauses(text))
    for i, t in enumerate(tokens):
        before, after = tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
        if t.kind == "string" and compared(tokens, i):
            yield "text", t.text, list(readings(t.text))
        if t.kind != "number" or before is None:
            continue
        value = float(t.text)
        exact = [("number", value)]
        if before.text in ("*", "..") and any(x.text == "[" for x in tokens[max(0, i - 6) : i]):
            yield "hops", value, exact
        elif before.word("LIMIT"):
            if ordered:
                yield "limit", value, exact
        elif compared(tokens, i) and before.text not in tuple("*/+-%") and (after is None or after.text not in tuple("*/+%")):
            yield "number", value, [*exact, ("number", value - 1), ("number", value + 1)]  # "more than 3" may be >= 4


def literal_mismatches(question: str, text: str, bound: Iterable = (), ignore_limits: Iterable[int] = ()) -> list[tuple[str, str | float]]:
    """(code, value) of each disagreement; codes are the keys of MESSAGES. ``bound``: values that slots were filled with; limits to ignore were appended."""
    tokens, stated = scan(text), read_question(question)
    strings, numbers = {t.text for t in tokens if t.kind == "string"}, {float(t.text) for t in tokens if t.kind == "number"}
    used = lambda v: v in strings or as_number(v) in numbers
    given = {str(v): as_number(str(v)) for v in bound if v is not None}
    asked = [next(filter(None, q)) for q in re.findall(r"(?<!\w)'([^']+)'(?!\w)|(?<!\w)\"([^\"]+)\"(?!\w)|“([^”]+)”|‘([^’]+)’", question)]
    out: list[tuple[str, str | float]] = [("placeholder", p) for p in re.findall(r"\{[A-Za-z_]\w*\}", question)]
    out += [("bound", v) for v in given if not used(v)] + [("quoted", v) for v in asked if not used(v)]
    free = {"text": set(given) | {""}, "limit": {float(v) for v in ignore_limits}}
    for code, value, ways in claims(text, tokens):
        exempt = value in free.get(code, ()) or not value.strip() if code == "text" else value in free.get(code, ()) or value in given.values() or not LEAST <= abs(value) < MOST
        if not exempt and not any(map(stated.has, ways)):
            out.append((code, value))
    return out


def literal_problems(question: str, text: str, bound: Iterable = (), ignore_limits: Iterable[int] = ()) -> list[str]:
    """``literal_mismatches`` as messages."""
    return [MESSAGES[code].format(value) for code, value in literal_mismatches(question, text, bound, ignore_limits)]
