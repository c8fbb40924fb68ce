"""Schema differences, graph migrations, and what they do to a benchmark."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query_text import Schema
from ..plans.catalog import GraphCatalog, Triple
from .selection import unit_interval

PROPOSE, REWRITE = 0.6, 0.75


# -- schema as atoms


def schema_atoms(s: Schema) -> set[str]:
    """label, rel, prop, relprop, pattern and cat atoms of a schema; relationship properties of types without a pattern are ghosts and left out."""
    live = {t for _, t, _ in s.patterns} or set(s.rels)
    out = {f"label:{x}" for x in s.nodes} | {f"rel:{x}" for x in live}
    out |= {f"prop:{label}.{p}" for label, ps in s.nodes.items() for p in ps} | {f"relprop:{t}.{p}" for t, ps in s.rels.items() if t in live for p in ps}
    return out | {f"pattern:(:{a})-[:{t}]->(:{b})" for a, t, b in s.patterns} | {f"cat:{k}={v}" for k, vs in s.domains.items() for v in vs}


def atom_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(atom, change): removed or added; both frames have one column, atom."""
    a, b = old.select("atom").distinct().withColumn("_o", F.lit(1)), new.select("atom").distinct().withColumn("_n", F.lit(1))
    joined = a.join(b, "atom", "full_outer").filter(F.col("_o").isNull() | F.col("_n").isNull())
    return joined.select("atom", F.when(F.col("_n").isNull(), "removed").otherwise("added").alias("change"))


def jaccard(a: Iterable, b: Iterable) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def closeness(a: float, b: float) -> float:
    return min(a, b) / max(a, b) if max(a, b) else 1.0


def greedy(pairs: Iterable[tuple[float, str, str]], least: float) -> list[tuple[str, str, float]]:
    """One-to-one pairs by falling score, ties by names."""
    used_a, used_b, out = set(), set(), []
    for score, a, b in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if score >= least and a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, round(score, 6)))
    return out


def propose_renames(old: Schema, new: Schema, uniqueness: Mapping[str, tuple[float, float]] | None = None, least: float = PROPOSE) -> dict[str, tuple[str, float]]:
    """Old atom -> (new atom, score) for labels, types and properties that seem renamed.

    Labels: half the Jaccard of properties, half that of patterns (with the label itself blanked). Types: 0.6 of endpoints, 0.3 of properties,
    0.1 of closeness of counts. Properties of labels that stayed: 0.5 same type, 0.3 close uniqueness, 0.1 shared name parts, 0.1 same domain.
    """
    gone, came = sorted(set(old.nodes) - set(new.nodes)), sorted(set(new.nodes) - set(old.nodes))
    blank = lambda s, x: {("@" if a == x else a, t, "@" if b == x else b) for a, t, b in s.patterns if x in (a, b)}
    labels = greedy([(0.5 * jaccard(old.nodes[a], new.nodes[b]) + 0.5 * jaccard(blank(old, a), blank(new, b)), a, b) for a in gone for b in came], least)
    renamed = {a: b for a, b, _ in labels}
    out = {f"label:{a}": (f"label:{b}", s) for a, b, s in labels}
    types = lambda s: {t for _, t, _ in s.patterns} | (set(s.rels) if not s.patterns else set())
    ends = lambda s, t, names: {(names.get(a, a), names.get(b, b)) for a, x, b in s.patterns if x == t}
    total = lambda s, t: sum(n or 0 for (_, x, _), n in s.patterns.items() if x == t)
    score = lambda a, b: 0.6 * jaccard(ends(old, a, renamed), ends(new, b, {})) + 0.3 * jaccard(old.rels.get(a, {}), new.rels.get(b, {})) + 0.1 * closeness(total(old, a), total(new, b))
    out |= {f"rel:{a}": (f"rel:{b}", s) for a, b, s in greedy([(score(a, b), a, b) for a in types(old) - types(new) for b in types(new) - types(old)], least)}
    for kind, was, now, names in (("prop", old.nodes, new.nodes, renamed), ("relprop", old.rels, new.rels, {})):
        for owner, props in was.items():
            to = names.get(owner, owner)
            if to not in now:
                continue
            lost, found = set(props) - set(now[to]), set(now[to]) - set(props)
            unique = lambda p: (uniqueness or {}).get(p, (1.0, 1.0))
            parts = lambda p: {x.lower() for x in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", p)}
            pairs = []
            for a in lost:
                for b in found:
                    same_type = float(props[a] == now[to][b])
                    u = closeness(unique(f"{owner}.{a}")[0], unique(f"{to}.{b}")[1])
                    values = float(old.domains.get(f"{owner}.{a}") == new.domains.get(f"{to}.{b}"))
                    pairs.append((0.5 * same_type + 0.3 * u + 0.1 * jaccard(parts(a), parts(b)) + 0.1 * values, a, b))
            out |= {f"{kind}:{owner}.{a}": (f"{kind}:{to}.{b}", s) for a, b, s in greedy(pairs, least)}
    return out


def propose_splits(old: Schema, new: Schema, least: float = PROPOSE) -> dict[str, tuple[tuple[str, str], float]]:
    """Old label -> (two new labels, score) where together they have its properties (0.6) and patterns (0.4)."""
    gone, came = sorted(set(old.nodes) - set(new.nodes)), sorted(set(new.nodes) - set(old.nodes))
    ends = lambda s, xs: {("@" if a in xs else a, t, "@" if b in xs else b) for a, t, b in s.patterns if a in xs or b in xs}
    out = {}
    for a in gone:
        pairs = [(0.6 * jaccard(old.nodes[a], {*new.nodes[x], *new.nodes[y]}) + 0.4 * jaccard(ends(old, {a}), ends(new, {x, y})), x, y) for i, x in enumerate(came) for y in came[i + 1 :]]
        if pairs and (best := max(pairs, key=lambda p: (p[0], p[1], p[2])))[0] >= least:
            out[a] = ((best[1], best[2]), round(best[0], 6))
    return out


# -- what happens to an item


def refresh_class(original_ok: Column, schema_errors: Column, migrated_ok: Column, original_rows: Column, migrated_rows: Column, equal: Column) -> Column:
    """One of six classes, in this precedence."""
    return (
        F.when(~original_ok, "original_execution_error").when(schema_errors > 0, "broken_schema").when(~migrated_ok, "execution_error").when((original_rows > 0) & (migrated_rows == 0), "now_empty")
        .when(~equal, "silently_changed_answer").otherwise("unchanged_answer")
    )


def refresh_action(cls: Column, rewrite_ok: Column) -> Column:
    return (
        F.when(cls == "unchanged_answer", "reuse").when(cls == "silently_changed_answer", "refresh_answer").when(cls.isin("now_empty", "execution_error"), "regenerate")
        .when(cls == "broken_schema", F.when(rewrite_ok, "rename_rewrite").otherwise("regenerate")).otherwise("exclude")
    )


def refresh_plan(df: DataFrame, cls: str, action: str, by: Iterable[str] = ()) -> DataFrame:
    """(dimension, value, class, action, n) overall and by each column."""
    sides = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(b).alias("dimension"), F.col(b).cast("string").alias("value")) for b in by]]
    return df.select(F.explode(F.array(*sides)).alias("d"), F.col(cls).alias("class"), F.col(action).alias("action")).groupBy("d.dimension", "d.value", "class", "action").agg(F.count(F.lit(1)).alias("n"))


# -- migrations: catalog -> catalog


def retype(catalog: GraphCatalog, old: str, new: str) -> GraphCatalog:
    moved = [t for t in catalog.edges if t[1] == old]
    return catalog.changed(edges={**dict.fromkeys(moved), **{(a, new, b): catalog.edges[a, t, b] for a, t, b in moved}})


def rename_property(catalog: GraphCatalog, owner: str, old: str, new: str) -> GraphCatalog:
    """Of a label's nodes, or of a type's edges."""
    return catalog.changed({owner: catalog.nodes[owner].withColumnRenamed(old, new)} if owner in catalog.nodes else None, {t: catalog.edges[t].withColumnRenamed(old, new) for t in catalog.edges if t[1] == owner})


def relabel(catalog: GraphCatalog, old: str, new: str) -> GraphCatalog:
    swap = lambda x: new if x == old else x
    touched = [t for t in catalog.edges if old in (t[0], t[2])]
    return catalog.changed({old: None, new: catalog.nodes[old]}, {**dict.fromkeys(touched), **{(swap(a), t, swap(b)): catalog.edges[a, t, b] for a, t, b in touched}})


def drop_type(catalog: GraphCatalog, name: str) -> GraphCatalog:
    return catalog.changed(edges={t: None for t in catalog.edges if t[1] == name})


def delete_edges(catalog: GraphCatalog, triple: Triple, fraction: float, seed: str) -> GraphCatalog:
    """Delete the edges whose (src, dst, eid) hash lies below the fraction."""
    df = catalog.edges[triple]
    return catalog.changed(edges={triple: df.filter(unit_interval("_src", "_dst", "_eid", seed=seed) >= fraction)})


def insert_edges(catalog: GraphCatalog, triple: Triple, new: DataFrame) -> GraphCatalog:
    df = catalog.edges[triple]
    return catalog.changed(edges={triple: df.unionByName(new, allowMissingColumns=True)})


OPERATORS: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}


def evaluate(expression: str, counts: Mapping[str, float]) -> float:
    """Arithmetic over named counts: numbers, names, + - * / % and parentheses only."""

    def go(x):
        if isinstance(x, ast.Expression):
            return go(x.body)
        if isinstance(x, ast.Constant) and isinstance(x.value, (int, float)):
            return x.value
        if isinstance(x, ast.Name) and x.id in counts:
            return counts[x.id]
        if isinstance(x, ast.BinOp) and type(x.op) in OPERATORS:
            return OPERATORS[type(x.op)](go(x.left), go(x.right))
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub):
            return -go(x.operand)
        raise ValueError(f"{expression!r} is no count arithmetic")

    return go(ast.parse(expression, mode="eval"))


def migration_check(rule: str, value: float, counts: Mapping[str, float]) -> bool:
    """``positive``, ``zero``, ``nonnegative`` or ``== expression``."""
    if rule.startswith("=="):
        return value == evaluate(rule[2:].strip(), counts)
    return {"positive": value > 0, "zero": value == 0, "nonnegative": value >= 0}[rule]


def expected_diff_problems(changes: Iterable[tuple[str, str]], expected: Mapping, renames: Iterable[tuple[str, str]] = (), deltas: Mapping[str, int] | None = None) -> list[str]:
    """Where a schema difference falls short of what a migration announces; what it has beyond that is no problem.

    ``changes``: (atom, removed or added), as ``atom_diff`` gives; ``renames``: (atom before, atom after) that were proposed;
    ``deltas``: type -> change of its count. ``expected`` may have removed and added (atoms), retained (atoms), renames
    ([before, after]), counts (type -> decrease, increase or any) and unchanged (true: no change at all).
    """
    known = {"removed", "added", "retained", "renames", "counts", "unchanged"}
    found: dict[str, set[str]] = {"removed": set(), "added": set()}
    for atom, change in changes:
        found[change].add(atom)
    signs = {"decrease": lambda n: n < 0, "increase": lambda n: n > 0, "any": lambda n: n != 0}
    out = [f"unknown key {k}" for k in sorted(set(expected) - known)]
    out += [f"{change} {atom} is missing" for change in ("removed", "added") for atom in expected.get(change, ()) if atom not in found[change]]
    out += [f"{atom} should have stayed" for atom in expected.get("retained", ()) if atom in found["removed"] | found["added"]]
    out += [f"rename {a} to {b} was not found" for a, b in expected.get("renames", ()) if (a, b) not in set(renames)]
    out += [f"{way} of {t} was not seen" for t, way in expected.get("counts", {}).items() if not signs[way]((deltas or {}).get(t, 0))]
    if expected.get("unchanged") and (found["removed"] or found["added"]):
        out.append("no change was expected")
    return out
