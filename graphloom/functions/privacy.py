"""Redaction of values in queries and questions, and the audit of what is left."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import QUOTED

LITERAL = re.compile(QUOTED)
NUMBER = re.compile(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])")


def placeholder(value: Column, salt: str) -> Column:
    """``<v_`` and 10 hex digits of the salted hash ``>``: equal values stay equal."""
    return F.concat(F.lit("<v_"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 10), F.lit(">"))


def redact_values(text: Column, values: Column, salt: str) -> Column:
    """Replace each value of the array by its placeholder, longest first, so that no value hides inside another."""
    longest = F.array_sort(F.filter(F.array_distinct(values), lambda v: v.isNotNull() & (v != "")), lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(longest, text, lambda t, v: F.replace(t, v, placeholder(v, salt)))


def redact_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![\w.<])\d+(?:\.\d+)?(?![\w.])", "<num>")


#: What stands for a log line that quotes a query, for a quoted query and for a literal.
QUERY_LINE = 'Received notification from DBMS server: [REDACTED_NOTIFICATION] for query: "[REDACTED_CYPHER]"'
QUERY_MARK, LITERAL_MARK = "[REDACTED_CYPHER]", "'[REDACTED_LITERAL]'"


def redact_log(line: Column) -> Column:
    """A line of a runtime log without the queries and values that it quotes."""
    quoted = r"""(?i)(query|cypher)=('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""
    plain = F.regexp_replace(F.regexp_replace(line, quoted, "$1=" + QUERY_MARK), r"'[^']{1,200}'", LITERAL_MARK)
    return F.when(F.contains(line, F.lit("for query:")), F.lit(QUERY_LINE)).otherwise(plain)


def residual_values(text: Column, values: Column) -> Column:
    """The values that still occur in the text."""
    return F.filter(F.array_distinct(values), lambda v: v.isNotNull() & (v != "") & F.contains(text, v))


def redact_literals(text: str) -> tuple[str, dict[str, str]]:
    """Number the quoted literals of a query: <value_1>, <value_2>, …; equal ones share a number."""
    names: dict[str, str] = {}

    def name(m: re.Match) -> str:
        body = m[0][1:-1]
        names.setdefault(body, f"<value_{len(names) + 1}>")
        return f"'{names[body]}'"

    return LITERAL.sub(name, text), names


def domain_sample(values: list[str], most: int, hashed: bool = False, omit: tuple[str, ...] = ()) -> list[str]:
    """A property's values to show: none if there are too many or one matches an ``omit`` pattern; hashes on request."""
    import hashlib

    if len(values) > most or any(re.search(p, v) for p in omit for v in values):
        return []
    return [hashlib.sha256(v.encode()).hexdigest()[:10] if hashed else v for v in sorted(values)]
