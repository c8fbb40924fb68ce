"""The syntax tree of the read-only Cypher subset."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Property:
    of: Any
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class NullTest:
    of: Any
    null: bool


@dataclass(frozen=True)
class HasLabel:
    of: Any
    labels: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple  # (key, expression)


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Case:
    whens: tuple  # (condition, value)
    otherwise: Any


@dataclass(frozen=True)
class Quantified:
    """all/any/none/single (x IN list WHERE p), or a list comprehension as ``map``."""

    kind: str
    name: str
    of: Any
    where: Any
    value: Any = None


@dataclass(frozen=True)
class Exists:
    paths: tuple
    where: Any = None


@dataclass(frozen=True)
class Node:
    name: str | None
    labels: tuple = ()
    props: tuple = ()


@dataclass(frozen=True)
class Relationship:
    name: str | None
    types: tuple = ()
    direction: str = "out"  # out, in, both
    low: int | None = None  # None: one hop; else the bounds of a variable length
    high: int | None = None
    props: tuple = ()

    @property
    def many(self) -> bool:
        return self.low is not None


@dataclass(frozen=True)
class Path:
    nodes: tuple
    rels: tuple
    name: str | None = None
    shortest: bool = False


@dataclass(frozen=True)
class Match:
    paths: tuple
    where: Any = None
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    of: Any
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    name: str


@dataclass(frozen=True)
class Projection:
    """WITH or RETURN. ``items`` is None for ``*``."""

    items: tuple | None
    distinct: bool = False
    order: tuple = ()  # (expression, descending)
    skip: Any = None
    limit: Any = None
    where: Any = None
    final: bool = False


@dataclass(frozen=True)
class Subquery:
    imports: tuple
    query: Any


@dataclass(frozen=True)
class Single:
    clauses: tuple


@dataclass(frozen=True)
class Query:
    parts: tuple
    all: tuple = field(default=())  # for each UNION whether it keeps duplicates


def walk(tree):
    """Every node of the tree, itself first."""
    yield tree
    if isinstance(tree, (tuple, list)):
        for x in tree:
            yield from walk(x)
    elif hasattr(tree, "__dataclass_fields__"):
        for name in tree.__dataclass_fields__:
            value = getattr(tree, name)
            if isinstance(value, tuple) or hasattr(value, "__dataclass_fields__"):
                yield from walk(value)
