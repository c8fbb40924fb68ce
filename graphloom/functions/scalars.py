"""Cypher's scalar and aggregate semantics on Spark columns.

A ``Typed`` column carries a coarse kind (int, float, str, bool, ts, date, dur, list:x, map, node, any), by which ``+``
joins text or adds, and ``/`` of two integers truncates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lexer import CypherError


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str


def literal(value: Any) -> Typed:
    if isinstance(value, (list, tuple)):
        return list_of([literal(x) for x in value])
    kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "str" if isinstance(value, str) else "any"
    return Typed(F.lit(value).cast("long") if kind == "int" else F.lit(value), kind)


def common(values: Sequence[Typed]) -> str:
    kinds = {v.kind for v in values} - {"any"}
    return kinds.pop() if len(kinds) == 1 else "float" if kinds == {"int", "float"} else "any"


def list_of(values: Sequence[Typed]) -> Typed:
    return Typed(F.array(*[v.column for v in values]), f"list:{common(values)}")


def index(of: Typed, at: Typed) -> Typed:
    """From 0, negative from the end; outside the list null."""
    if at.kind == "str":
        return Typed(of.column[at.column], "any")
    place = F.when(at.column >= 0, at.column + 1).otherwise(at.column).cast("int")
    return Typed(F.try_element_at(of.column, place), of.kind.removeprefix("list:") if of.kind.startswith("list:") else "any")


PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "quarter": F.quarter, "dayOfWeek": lambda c: F.weekday(c) + 1, "ordinalDay": F.dayofyear, "week": F.weekofyear}


def field(of: Typed, name: str) -> Typed:
    if of.kind in ("ts", "date"):
        if name == "epochMillis":
            return Typed(F.unix_millis(of.column.cast("timestamp")), "int")
        if name == "epochSeconds":
            return Typed(F.unix_seconds(of.column.cast("timestamp")), "int")
        if name == "second":
            return Typed(F.second(of.column).cast("long"), "int")
        if name in PARTS:
            return Typed(PARTS[name](of.column).cast("long"), "int")
    if of.kind == "dur":
        unit = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}.get(name)
        if unit:
            return Typed(F.floor(of.column.cast("interval second").cast("decimal(38,6)") / unit).cast("long"), "int")
    return Typed(of.column.getField(name), "any")


FAMILY = {"int": "number", "float": "number", "str": "text", "bool": "truth", "ts": "time", "date": "time"}


def binary(op: str, a: Typed, b: Typed) -> Typed:
    x, y = a.column, b.column
    if op in ("AND", "OR", "XOR"):
        return Typed(x & y if op == "AND" else x | y if op == "OR" else x != y, "bool")
    if op in ("=", "<>", "<", "<=", ">", ">="):
        if {"ts", "date"} & {a.kind, b.kind} and "str" in (a.kind, b.kind):
            x, y = (x.cast("timestamp"), y) if a.kind == "str" else (x, y.cast("timestamp"))
        elif a.kind in FAMILY and b.kind in FAMILY and FAMILY[a.kind] != FAMILY[b.kind]:  # values of different types differ and have no order
            return Typed(F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "<>")) if op in ("=", "<>") else F.lit(None).cast("boolean"), "bool")
        test = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Typed(test, "bool")
    if op == "IN":
        return Typed(F.array_contains(y, x), "bool")
    if op == "CONTAINS":
        return Typed(F.contains(x, y), "bool")
    if op == "STARTS":
        return Typed(F.startswith(x, y), "bool")
    if op == "ENDS":
        return Typed(F.endswith(x, y), "bool")
    if op == "=~":
        return Typed(F.regexp_like(x, F.concat(F.lit("^(?:"), y, F.lit(")$"))), "bool")
    if op == "^":
        return Typed(F.pow(x, y), "float")
    if op == "+":
        if a.kind.startswith("list") or b.kind.startswith("list"):
            x, y = (x if a.kind.startswith("list") else F.array(x)), (y if b.kind.startswith("list") else F.array(y))
            return Typed(F.concat(x, y), a.kind if a.kind.startswith("list") else b.kind)
        if "str" in (a.kind, b.kind):
            return Typed(F.concat(x.cast("string"), y.cast("string")), "str")
        if "dur" in (a.kind, b.kind) and {"ts", "date"} & {a.kind, b.kind}:
            return Typed(x + y, "ts")
        return Typed(x + y, common([a, b]))
    if op == "-" and {"ts", "date"} & {a.kind} and b.kind == "dur":
        return Typed(x - y, "ts")
    if op == "-":
        return Typed(x - y, common([a, b]))
    if op == "*":
        return Typed(x * y, common([a, b]))
    if op == "/":
        return Typed(F.call_function("div", x, y), "int") if (a.kind, b.kind) == ("int", "int") else Typed(x / y, "float")
    if op == "%":
        return Typed(x % y, common([a, b]))
    raise CypherError(f"unknown operator {op}")


def duration(text: str) -> Column:
    """An ISO 8601 duration of weeks, days, hours, minutes and seconds, or a map of them, as a day-time interval."""
    import re

    m = re.fullmatch(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m:
        raise CypherError(f"duration {text!r} has parts that are no fixed time")
    weeks, days, hours, minutes, seconds = (float(x) if x else 0 for x in m.groups())
    return F.make_dt_interval(F.lit(int(weeks * 7 + days)), F.lit(int(hours)), F.lit(int(minutes)), F.lit(seconds))


def duration_of(parts: dict[str, float]) -> Column:
    """A duration from a map of weeks, days, hours, minutes, seconds."""
    unknown = set(parts) - {"weeks", "days", "hours", "minutes", "seconds"}
    if unknown:
        raise CypherError(f"duration parts {sorted(unknown)} are no fixed time")
    days = int(parts.get("weeks", 0) * 7 + parts.get("days", 0))
    return F.make_dt_interval(F.lit(days), F.lit(int(parts.get("hours", 0))), F.lit(int(parts.get("minutes", 0))), F.lit(float(parts.get("seconds", 0))))


def truncated(c: Column) -> Column:
    return c.cast("double").cast("long")


def call(name: str, args: list[Typed]) -> Typed:
    c = [a.column for a in args]
    one = args[0] if args else None
    text = {"toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim}
    if name in text:
        return Typed(text[name](c[0]), "str")
    floats = {"sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos}
    if name in floats:
        return Typed(floats[name](c[0].cast("double")), "float")
    if name in ("ceil", "floor", "round"):
        digits = [F.lit(0)] if len(c) == 1 else []
        value = {"ceil": F.ceil, "floor": F.floor}[name](c[0].cast("double")).cast("double") if name != "round" else F.round(c[0].cast("double"), digits[0] if digits else c[1])
        return Typed(value, "float")
    simple = {
        "tostring": lambda: Typed(c[0].cast("string"), "str"),
        "tointeger": lambda: Typed(F.coalesce(c[0].try_cast("long"), F.floor(c[0].try_cast("double")).cast("long")) if one.kind == "str" else truncated(c[0]), "int"),
        "tofloat": lambda: Typed(c[0].try_cast("double"), "float"),
        "toboolean": lambda: Typed(F.when(F.lower(F.trim(c[0].cast("string"))) == "true", True).when(F.lower(F.trim(c[0].cast("string"))) == "false", False), "bool"),
        "split": lambda: Typed(F.split(c[0], F.concat(F.lit("\\Q"), c[1], F.lit("\\E")), -1), "list:str"),
        "replace": lambda: Typed(F.replace(c[0], c[1], c[2]), "str"),
        "substring": lambda: Typed(F.substr(c[0], c[1].cast("int") + 1, c[2].cast("int")) if len(c) > 2 else F.substr(c[0], c[1].cast("int") + 1), "str"),
        "left": lambda: Typed(F.left(c[0], c[1].cast("int")), "str"),
        "right": lambda: Typed(F.right(c[0], c[1].cast("int")), "str"),
        "reverse": lambda: Typed(F.reverse(c[0]), one.kind),
        "size": lambda: Typed((F.char_length(c[0]) if one.kind == "str" else F.size(c[0])).cast("long"), "int"),
        "length": lambda: Typed(F.char_length(c[0]).cast("long"), "int"),
        "head": lambda: Typed(F.try_element_at(c[0], F.lit(1)), one.kind.removeprefix("list:")),
        "last": lambda: Typed(F.try_element_at(c[0], F.lit(-1)), one.kind.removeprefix("list:")),
        "tail": lambda: Typed(F.slice(c[0], F.lit(2), F.greatest(F.size(c[0]) - 1, F.lit(0))), one.kind),
        "coalesce": lambda: Typed(F.coalesce(*c), common(args)),
        "abs": lambda: Typed(F.abs(c[0]), one.kind),
        "sign": lambda: Typed(F.signum(c[0].cast("double")).cast("long"), "int"),
        "range": lambda: Typed(F.sequence(*c), "list:int"),
        "isempty": lambda: Typed((F.char_length(c[0]) if one.kind == "str" else F.size(c[0])) == 0, "bool"),
        "exists": lambda: Typed(c[0].isNotNull(), "bool"),
        "date": lambda: Typed(c[0].cast("date") if c else F.current_date(), "date"),
        "datetime": lambda: Typed(c[0].cast("timestamp") if c else F.current_timestamp(), "ts"),
        "localdatetime": lambda: Typed(c[0].cast("timestamp") if c else F.current_timestamp(), "ts"),
        "timestamp": lambda: Typed(F.unix_millis(F.current_timestamp()), "int"),
        "duration.between": lambda: Typed(c[1].cast("timestamp") - c[0].cast("timestamp"), "dur"),
        "duration.inseconds": lambda: Typed(c[1].cast("timestamp") - c[0].cast("timestamp"), "dur"),
    }
    if name not in simple:
        raise CypherError(f"unknown function {name}")
    return simple[name]()


def aggregate(name: str, args: list[Typed], distinct: bool) -> Typed:
    c, kind = args[0].column, args[0].kind
    if name == "count":
        return Typed(F.count_distinct(c) if distinct else F.count(c), "int")
    if name == "collect":
        return Typed(F.collect_set(c) if distinct else F.collect_list(c), f"list:{kind}")
    if name == "sum":  # of nothing: 0
        return Typed(F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0)), kind)
    if name == "avg":
        return Typed(F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c), "float")
    if name in ("min", "max"):
        return Typed(F.min(c) if name == "min" else F.max(c), kind)
    if name in ("stdev", "stdevp"):  # of one value: 0
        spread = F.stddev_samp(c) if name == "stdev" else F.stddev_pop(c)
        return Typed(F.coalesce(spread, F.lit(0.0)), "float")
    if name == "percentilecont":
        return Typed(F.percentile(c, args[1].column.cast("double")), "float")
    raise CypherError(f"unknown aggregate {name}")
