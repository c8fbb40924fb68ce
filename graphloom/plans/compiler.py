"""From the syntax tree to DataFrames.

Every variable becomes a few flat columns: a node its id and the properties that the query uses, a
relationship its edge id and properties. A pattern is a chain of equi-joins of edge frames; node frames are
joined only where a property is needed. EXISTS and pattern predicates become semi and anti joins, OPTIONAL
MATCH a left join of the whole pattern with its WHERE as join condition, variable lengths unions of
self-joins that keep edge ids and grow from the starts that the pattern leaves. Where only the ends of a
variable length matter (DISTINCT, EXISTS) it is a search for what can be reached, one row a pair or a node; shortest
paths keep nodes and distances, and are searched from both sides where both are restricted. Percentiles are counted
values in range order, so that no group is one task. All else is left to Catalyst.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import Typed
from ..operators import ranks
from ..steps import written
from .catalog import GraphCatalog, Triple
from .lexer import CypherError
from .parser import parse
from .syntax import (
    Binary, Call, Case, Exists, HasLabel, Index, Item, ListOf, Literal, MapOf, Match, Node, NullTest, Parameter, Path, Projection, Property, Quantified,
    Query, Relationship, Single, Subquery, Unary, Unwind, Variable, walk,
)

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}
IDENTITY_ONLY = {"count", "id", "elementid", "labels", "type", "length", "startnode", "endnode", "nodes", "relationships"}
#: Rounds of an unbounded variable length; trails end by themselves, so this only stops what would never be done.
MAX_ROUNDS = 1000
KIND = {"string": "str", "bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts", "date": "date"}


@dataclass(frozen=True)
class Bound:
    """What a variable stands for, and its columns."""

    kind: str  # node, rel, rels, path, value
    columns: Mapping[str, str] = field(default_factory=dict)  # property -> column
    kinds: Mapping[str, str] = field(default_factory=dict)  # property -> kind
    id: str | None = None
    label: str | None = None  # of a node, or a relationship's type, if only one is possible
    label_column: str | None = None
    value_kind: str = "any"
    ends: tuple[str, str] | None = None
    length: Any = None  # of a path: (fixed hops, columns of edge id arrays)
    hops: tuple[str, ...] = ()  # of a path: columns of distances
    node_ids: tuple[str, ...] = ()

    def all_columns(self) -> list[str]:
        more = [*(self.length[1] if self.length else ()), *self.hops, *(self.ends or ()), *self.node_ids]
        return list(dict.fromkeys(c for c in (self.id, self.label_column, *self.columns.values(), *more) if c))


Scope = dict[str, Bound]


def conjuncts(where) -> list:
    if where is None:
        return []
    return [*conjuncts(where.left), *conjuncts(where.right)] if isinstance(where, Binary) and where.op == "AND" else [where]


def aggregates_in(of) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(of))


def repeats_vanish(clauses: tuple) -> bool:
    """Whether it makes no difference to the clauses that follow a MATCH how often it gives a row."""
    for clause in clauses:
        if isinstance(clause, Projection):
            calls = [x for i in clause.items or () for x in walk(i.of) if isinstance(x, Call) and x.name in AGGREGATES]
            return all(x.distinct or x.name in ("min", "max") for x in calls) if calls else clause.distinct
        if not isinstance(clause, (Match, Unwind)):
            return False
    return False


def uses(tree) -> dict[str, set[str]]:
    """Properties used of each variable name; ``*`` for all. WITH x AS y passes y's uses on to x."""
    found: dict[str, set[str]] = {}
    aliases: list[tuple[str, str]] = []

    def see(x, bare: bool) -> None:
        """``bare``: a variable itself would be shown, not only its identity."""
        if isinstance(x, Property) and isinstance(x.of, Variable):
            found.setdefault(x.of.name, set()).add(x.name)
        elif isinstance(x, Variable):
            if bare:
                found.setdefault(x.name, set()).add("*")
        elif isinstance(x, Projection):
            for item in x.items or ():
                if isinstance(item.of, Variable):
                    if x.final:
                        found.setdefault(item.of.name, set()).add("*")
                    aliases.append((item.of.name, item.name))
                else:
                    see(item.of, True)
            if x.items is None and x.final:
                found.setdefault("*", set()).add("*")
            see(x.order, False)
            see(x.where, False)
        elif isinstance(x, Call):
            see(x.args, x.name not in IDENTITY_ONLY)
        elif isinstance(x, (Binary, NullTest, Unary, HasLabel)):
            for name in x.__dataclass_fields__:
                see(getattr(x, name), False)
        elif isinstance(x, (tuple, list)):
            for y in x:
                see(y, bare)
        elif hasattr(x, "__dataclass_fields__"):
            for name in x.__dataclass_fields__:
                see(getattr(x, name), True)

    see(tree, False)
    for _ in range(len(aliases) + 1):
        for old, new in aliases:
            found.setdefault(old, set()).update(found.get(new, ()))
    return found


class Compiler:
    """Compiles queries over one catalog. ``strict``: unknown labels, types and properties are errors; else they match nothing and are null."""

    def __init__(self, spark: SparkSession, catalog: GraphCatalog, params: Mapping[str, Any] | None = None, strict: bool = False, max_hops: int | None = None):
        self.spark, self.catalog, self.params, self.strict, self.max_hops = spark, catalog, params or {}, strict, max_hops
        self.numbers = itertools.count()
        self.used: dict[str, set[str]] = {}
        self.hints: tuple = ()
        self.settled: list = []  # conditions that a pattern has already applied
        self.tree: Query | None = None

    def run(self, query: str | Query) -> DataFrame:
        tree = parse(query) if isinstance(query, str) else query
        self.tree, self.used = tree, uses(tree)
        parts = [self.single(p, None, {}) for p in tree.parts]
        out = parts[0]
        for part, keep in zip(parts[1:], tree.all, strict=True):
            if part.columns != out.columns:
                raise CypherError("the parts of a UNION need the same columns")
            out = out.unionByName(part)
            out = out if keep else out.distinct()
        return out

    def fresh(self, name: str) -> str:
        return f"{name}_{next(self.numbers)}"

    # -- clauses

    def single(self, part: Single, df: DataFrame | None, scope: Scope, carry: tuple[str, ...] = ()) -> DataFrame:
        for i, clause in enumerate(part.clauses):
            if isinstance(clause, Match):
                df, scope = self.match(clause, df, scope, repeats_vanish(part.clauses[i + 1 :]))
            elif isinstance(clause, Unwind):
                df, scope = self.unwind(clause, df, scope)
            elif isinstance(clause, Subquery):
                df, scope = self.subquery(clause, df, scope)
            elif isinstance(clause, Projection):
                df, scope = self.project(clause, df, scope, carry)
        return df

    def unit(self) -> DataFrame:
        return self.spark.range(1).select()

    def unwind(self, clause: Unwind, df: DataFrame | None, scope: Scope) -> tuple[DataFrame, Scope]:
        df = self.unit() if df is None else df
        value = self.value(clause.of, scope)
        column = self.fresh(clause.name)
        inner = value.kind.removeprefix("list:") if value.kind.startswith("list:") else "any"
        return df.withColumn(column, F.explode(value.column)), scope | {clause.name: Bound("value", {"": column}, value_kind=inner)}

    def subquery(self, clause: Subquery, df: DataFrame | None, scope: Scope) -> tuple[DataFrame, Scope]:
        """A read-only CALL: runs over the distinct imported rows, grouped by them, and is joined back."""
        part = clause.query.parts[0]
        names = [i.name for i in part.clauses[-1].items or ()]
        imported = {n: scope[n] for n in clause.imports}
        keys = [c for b in imported.values() for c in b.all_columns()]
        start = df.select(*keys).distinct() if keys else None
        copies = {c: self.fresh(c) for c in keys}
        if start is not None:
            start = start.select(*[F.col(c).alias(n) for c, n in copies.items()])
            imported = {n: self.renamed(b, copies) for n, b in imported.items()}
        inner = self.single(part, start, imported, tuple(copies.values()))
        columns = {n: self.fresh(n) for n in names}
        inner = inner.select(*[F.col(f"`{n}`").alias(c) for n, c in columns.items()], *copies.values())
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in copies.items()]) if keys else None
        df = inner if df is None else df.join(inner, on).drop(*copies.values()) if keys else df.crossJoin(inner)
        kinds = dict(inner.dtypes)
        return df, scope | {n: Bound("value", {"": c}, value_kind=kind_of(kinds[c])) for n, c in columns.items()}

    @staticmethod
    def renamed(b: Bound, names: Mapping[str, str]) -> Bound:
        new = lambda c: names.get(c, c)
        return replace(b, columns={p: new(c) for p, c in b.columns.items()}, id=new(b.id), label_column=new(b.label_column), ends=tuple(map(new, b.ends)) if b.ends else None)

    # -- patterns

    def match(self, clause: Match, df: DataFrame | None, scope: Scope, once: bool = False) -> tuple[DataFrame, Scope]:
        pattern, inner, shared = self.pattern(clause.paths, scope, joined=df is not None, hints=conjuncts(clause.where), once=once)
        where = [c for c in conjuncts(clause.where) if not any(c is x for x in self.settled)]
        if df is None:
            if clause.optional:
                kept = self.where(pattern, inner, *where)
                return self.unit().join(kept, F.lit(True), "left"), inner
            return self.where(pattern, inner, *where), inner
        both = {**inner, **scope}
        on = self.equal(shared)
        if clause.optional:
            plain = [c for c in where if not self.subpattern(c)]
            pattern = self.where(pattern, inner, *[c for c in where if self.subpattern(c)])
            on = reduce(lambda a, b: a & b, [self.value(c, both).column for c in plain], F.lit(True) if on is None else on)
            return df.join(pattern, on, "left").drop(*[b for _, b in shared]), both
        joined = df.crossJoin(pattern) if on is None else df.join(pattern, on).drop(*[b for _, b in shared])
        return self.where(joined, both, *where), both

    @staticmethod
    def equal(shared: list[tuple[str, str]]) -> Column | None:
        return reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in shared]) if shared else None

    def pattern(self, paths: tuple, scope: Scope, joined: bool = True, hints: Iterable = (), once: bool = False) -> tuple[DataFrame, Scope, list[tuple[str, str]]]:
        """The paths of one MATCH as one frame: its bindings of new variables, and (outer, inner) columns of shared ones.

        A path that starts or ends at a bound variable grows from there, edge by edge; another is built alone and joined.
        ``hints``: conditions of the MATCH, from which variable lengths take the starts they need. ``once``: repeated rows
        make no difference, so that variable lengths whose edges no other relationship could bind may be searches.
        """
        allowed = self.labels(paths, scope)
        edges: list[tuple[frozenset[Triple], str, bool]] = []  # what may repeat an edge: triples, column, whether an array
        mixed = len({t for p in paths for r in p.rels for t in self.triples(r)}) > 1
        rest = list(paths)
        self.hints = tuple(hints)
        rels = [r for p in paths for r in p.rels]
        self.searches = [r for r in rels if once and r.many and not any(o is not r and self.triples(o) & self.triples(r) for o in rels)]
        df, env = self.path(rest.pop(0), scope, allowed, edges, mixed)
        while rest:  # paths that share a variable first
            at = next((i for i, p in enumerate(rest) if any(n.name in env for n in p.nodes)), 0)
            path = rest.pop(at)
            if (anchored := self.anchored(path, env, allowed)) is not None:
                df, env = self.path(anchored, scope, allowed, edges, mixed, df, env)
                continue
            other, e = self.path(path, scope, allowed, edges, mixed)
            common = self.shared(env, e)
            on = self.equal(common)
            df = df.crossJoin(other) if on is None else df.join(other, on).drop(*[b for _, b in common])
            env = {**e, **env}
        for (ta, a, many_a), (tb, b, many_b) in itertools.combinations(edges, 2):
            if ta & tb:
                same = F.arrays_overlap(a, b) if many_a and many_b else F.array_contains(F.col(a), F.col(b)) if many_a else F.array_contains(F.col(b), F.col(a)) if many_b else F.col(a) == F.col(b)
                df = df.filter(~same)
        shared = self.shared(scope, env) if joined else []
        return df, {k: v for k, v in env.items() if k not in scope or not joined}, shared

    @staticmethod
    def anchored(path: Path, env: Scope, allowed: dict) -> Path | None:
        """The path so turned that its first node is bound, or None."""
        bound = lambda n: n.name in env and env[n.name].kind == "node"
        if not path.rels or bound(path.nodes[0]):
            return path if path.rels else None
        if not bound(path.nodes[-1]) or path.name or path.shortest or any(r.many for r in path.rels):
            return None
        turned = {"out": "in", "in": "out", "both": "both"}
        new = replace(path, nodes=path.nodes[::-1], rels=tuple(replace(r, direction=turned[r.direction]) for r in path.rels[::-1]))
        allowed |= {(id(new), j): allowed[id(path), len(path.rels) - j] for j in range(len(path.nodes))}
        allowed["kept"] = (*allowed.get("kept", ()), new)  # so that its identity stays its own
        return new

    def shared(self, outer: Scope, inner: Scope) -> list[tuple[str, str]]:
        found = []
        for name in inner:
            if name in outer:
                a, b = outer[name], inner[name]
                if a.kind != b.kind or a.kind not in ("node", "rel"):
                    raise CypherError(f"{name} is already bound")
                found.append((a.id, b.id))
                if a.label_column and b.label_column:
                    found.append((a.label_column, b.label_column))
        return found

    def triples(self, rel: Relationship) -> frozenset[Triple]:
        if self.strict:
            for t in rel.types:
                if not any(x[1] == t for x in self.catalog.edges):
                    raise CypherError(f"unknown relationship type {t}")
        return frozenset(t for t in self.catalog.edges if not rel.types or t[1] in rel.types)

    def oriented(self, rel: Relationship) -> list[tuple[Triple, bool]]:
        """(triple, whether it is walked backwards)."""
        ways = {"out": (False,), "in": (True,), "both": (False, True)}[rel.direction]
        return [(t, back) for t in sorted(self.triples(rel)) for back in ways]

    def labels(self, paths: tuple, scope: Scope) -> dict[int, frozenset[str]]:
        """Possible labels of each node of the patterns (by identity of the syntax node's place), narrowed until nothing changes."""
        everything = frozenset(self.catalog.nodes)
        by_name: dict[str, frozenset[str]] = {n: frozenset({b.label}) if b.label else everything for n, b in scope.items() if b.kind == "node"}
        places: dict[tuple[int, int], frozenset[str]] = {}

        def own(node: Node) -> frozenset[str]:
            out = everything
            for label in node.labels:
                if self.strict and not self.catalog.with_label(label):
                    raise CypherError(f"unknown label {label}")
                out &= self.catalog.with_label(label)
            return out

        for i, path in enumerate(paths):
            for j, node in enumerate(path.nodes):
                places[i, j] = own(node)
        for _ in range(6):
            before = dict(places)
            for i, path in enumerate(paths):
                for j, node in enumerate(path.nodes):
                    if node.name:
                        by_name[node.name] = by_name.get(node.name, everything) & places[i, j]
                        places[i, j] = by_name[node.name]
                for j, rel in enumerate(path.rels):
                    if rel.many:
                        starts, ends = {(t[2] if b else t[0]) for t, b in self.oriented(rel)}, {(t[0] if b else t[2]) for t, b in self.oriented(rel)}
                        if rel.low > 0:
                            places[i, j] &= starts
                            places[i, j + 1] &= ends
                        continue
                    fits = [(t[2], t[0]) if b else (t[0], t[2]) for t, b in self.oriented(rel)]
                    fits = [(a, b) for a, b in fits if a in places[i, j] and b in places[i, j + 1]]
                    places[i, j] &= {a for a, _ in fits}
                    places[i, j + 1] &= {b for _, b in fits}
            if places == before:
                break
        self.places = places
        return {(id(paths[i]), j): v for (i, j), v in places.items()}

    def edge_frame(self, rel: Relationship, left: frozenset[str], right: frozenset[str], name: str | None, mixed: bool) -> tuple[DataFrame, dict]:
        """Edges as walked: columns s, d, eid, labels where several are possible, and used properties; null if none fit."""
        fits = [(t, back) for t, back in self.oriented(rel) if (t[2] if back else t[0]) in left and (t[0] if back else t[2]) in right]
        wanted = self.wanted(name, rel.props)
        all_props = {p: KIND.get(k, "any") for t, _ in fits for p, k in self.catalog.edge_properties(t).items()}
        props = sorted(all_props if "*" in wanted else set(all_props) & wanted)
        cols = {x: self.fresh(x) for x in ("s", "d", "eid")} | {f"p:{p}": self.fresh(f"{name or 'r'}_{p}") for p in props}
        many_left, many_right, many_types = len(left) > 1, len(right) > 1, len({t[1] for t, _ in fits}) > 1
        for flag, x in ((many_left, "sl"), (many_right, "dl"), (many_types, "type")):
            if flag:
                cols[x] = self.fresh(x)
        parts = []
        for t, back in fits:
            df = self.catalog.edges[t]
            if back and rel.direction == "both" and t[0] == t[2]:
                df = df.filter("_src <> _dst")  # a loop is walked once
            s, d = ("_dst", "_src") if back else ("_src", "_dst")
            eid = F.xxhash64(F.lit("/".join(t)), "_eid") if mixed else F.col("_eid")
            out = [F.col(s).alias(cols["s"]), F.col(d).alias(cols["d"]), eid.alias(cols["eid"])]
            if many_left:
                out.append(F.lit(t[2] if back else t[0]).alias(cols["sl"]))
            if many_right:
                out.append(F.lit(t[0] if back else t[2]).alias(cols["dl"]))
            if many_types:
                out.append(F.lit(t[1]).alias(cols["type"]))
            have = self.catalog.edge_properties(t)
            out += [(F.col(f"`{p}`") if p in have else F.lit(None)).alias(cols[f"p:{p}"]) for p in props]
            parts.append(df.select(*out))
        if not parts:
            kinds = ", ".join(f"`{c}` {'string' if x in ('sl', 'dl', 'type') else 'bigint'}" for x, c in cols.items())
            parts = [self.spark.createDataFrame([], kinds)]
        df = reduce(lambda a, b: a.unionByName(b), parts)
        info = {"cols": cols, "props": {p: cols[f"p:{p}"] for p in props}, "kinds": {p: all_props[p] for p in props}, "triples": frozenset(t for t, _ in fits), "type": next(iter({t[1] for t, _ in fits}), None) if not many_types else None}
        return df, info

    def wanted(self, name: str | None, props: tuple) -> set[str]:
        shown = self.used.get(name, set()) if name else set()
        return set(shown) | {k for k, _ in props} | ({"*"} if name and "*" in self.used.get("*", ()) else set())

    def alone(self, node: Node) -> list:
        """The hints that use this node's variable and no other."""
        return [c for c in self.hints if node.name and {x.name for x in walk(c) if isinstance(x, Variable)} == {node.name} and not any(isinstance(x, Exists) for x in walk(c))]

    def starts(self, node: Node, labels: frozenset[str]) -> DataFrame | None:
        """(id, label) of the nodes that the node's properties and the hints on it alone leave; None if they say nothing."""
        alone = self.alone(node)
        if not labels or not (alone or node.props):
            return None
        found = [self.scan(node, frozenset({label}), {}) for label in sorted(labels)]
        parts = []
        for label, (df, env) in zip(sorted(labels), found, strict=True):
            for c in alone:
                df = df.filter(self.value(c, env).column)
            key = env[node.name].id if node.name else df.columns[0]
            parts.append(df.select(F.col(key).alias("#id"), F.lit(label).alias("#label")))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def path(self, path: Path, scope: Scope, allowed: dict, edges: list, mixed: bool, df: DataFrame | None = None, env: Scope | None = None) -> tuple[DataFrame, Scope]:
        """One path as a frame with its bindings; from ``df`` on if its first node is bound in ``env``."""
        own = lambda j: allowed[id(path), j]
        env = dict(env or {})
        if not path.rels:
            return self.scan(path.nodes[0], own(0), env)
        places: list[tuple[str, str | None]] = []  # (id column, label column) of each node
        if df is not None:
            first = env[path.nodes[0].name]
            places = [(first.id, first.label_column)]
        arrays: list[str] = []
        hops: list[str] = []
        fixed = 0
        gone = False  # whether the first node is not bound
        for j, rel in enumerate(path.rels):
            left, right = own(j), own(j + 1)
            if rel.many or path.shortest:
                if df is None:
                    starts = self.starts(path.nodes[0], left)
                else:
                    tag = F.col(places[-1][1]) if places[-1][1] else F.lit(next(iter(left))) if len(left) == 1 else None
                    starts = df.select(F.col(places[-1][0]).alias("#id"), *([] if tag is None else [tag.alias("#label")])).distinct()
                if path.shortest and not rel.name:
                    ends = self.starts(path.nodes[-1], right) if rel is path.rels[-1] else None
                    step, info = self.nearest(rel, left, right, starts, ends, scope)
                    hops.append(info["cols"]["hops"])
                elif self.is_search(path, rel):
                    first = df is None and self.forgotten(path.nodes[0], scope)
                    gone |= first
                    step, info = self.reach(rel, left, right, starts, first, scope)
                else:
                    step, info = self.many(rel, left, right, mixed, path.shortest, starts, scope)
                    arrays.append(info["cols"]["eids"])
                    edges.append((info["triples"], info["cols"]["eids"], True)) if not path.shortest else None
                if not (left and right):
                    step = step.filter(F.lit(False))
                if rel.name:
                    env[rel.name] = Bound("rels", {"": info["cols"]["eids"]}, value_kind="list:int")
            else:
                step, info = self.edge_frame(rel, left, right, rel.name, mixed)
                fixed += 1
                edges.append((info["triples"], info["cols"]["eid"], False))
                bound = Bound("rel", info["props"], info["kinds"], info["cols"]["eid"], info["type"], info["cols"].get("type"), ends=(info["cols"]["s"], info["cols"]["d"]))
                if rel.name:
                    env[rel.name] = bound
                for key, value in rel.props:
                    step = step.filter(self.is_equal(info["props"].get(key), info["kinds"].get(key), value, scope))
            c = info["cols"]
            if df is None:
                df = step
                places = [(c.get("s"), c.get("sl")), (c["d"], c.get("dl"))]
            else:
                on = F.col(places[-1][0]) == F.col(c["s"])
                if places[-1][1] and c.get("sl"):
                    on &= F.col(places[-1][1]) == F.col(c["sl"])
                if compared := self.compared(path, j, env, scope):
                    df = self.attach(df, path.nodes[j - 1], own(j - 1), places[j - 1], env, scope)
                    step = self.attach(step, path.nodes[j + 1], own(j + 1), (c["d"], c.get("dl")), env, scope)
                    df, step = self.narrowed(df, step, places[-1][0], c["s"], compared, path.nodes[j - 1].name, env)
                df = df.join(step, on)
                places.append((c["d"], c.get("dl")))
        for j, node in enumerate(path.nodes):
            if j or not gone:
                df = self.attach(df, node, own(j), places[j], env, scope)
        if path.name:
            env[path.name] = Bound("path", length=(fixed, tuple(arrays)), hops=tuple(hops), node_ids=tuple(p[0] for p in places))
        return df, env

    def compared(self, path: Path, j: int, env: Scope, scope: Scope) -> list[Binary]:
        """The hints that compare the two neighbours of node ``j`` by size, where edges of both point at it: it may have many of each, so their pairs are many more than rows."""
        if path.shortest or path.rels[j].many or path.rels[j - 1].many or (path.rels[j - 1].direction, path.rels[j].direction) != ("out", "in"):
            return []
        a, b = path.nodes[j - 1].name, path.nodes[j + 1].name
        names = [n.name for n in path.nodes]
        if not a or not b or names.count(a) > 1 or names.count(b) > 1 or any(x in env or x in scope for x in (a, b)):
            return []
        inside = lambda of: {x.name for x in walk(of) if isinstance(x, Variable)}
        sizes = [c for c in self.hints if isinstance(c, Binary) and c.op in ("<", "<=", ">", ">=") and not any(isinstance(x, Exists) for x in walk(c))]
        return [c for c in sizes if (inside(c.left), inside(c.right)) in (({a}, {b}), ({b}, {a}))]

    def narrowed(self, df: DataFrame, step: DataFrame, at: str, s: str, compared: list[Binary], left: str, env: Scope) -> tuple[DataFrame, DataFrame]:
        """The rows of both sides of a join (``at`` = ``s``) for which some row of the other side fits a comparison, by its least or greatest value under the key.

        ``left``: the variable of ``df``. Rows that go have no partner; the comparison itself is still made on the pairs.
        """
        for c in compared:
            x, y = self.value(c.left, env), self.value(c.right, env)
            if not {x.kind, y.kind} <= {"int", "float"}:
                continue
            ours, theirs = (x.column, y.column) if any(isinstance(v, Variable) and v.name == left for v in walk(c.left)) else (y.column, x.column)
            below = (c.op in ("<", "<=")) == (ours is x.column)  # whether ours is the lesser
            bound = lambda rows, key, value, of: rows.groupBy(F.col(key).alias(f"{key}#")).agg(of(value).alias(f"{key}#bound"))
            of_df, of_step = bound(df, at, ours, F.min if below else F.max), bound(step, s, theirs, F.max if below else F.min)
            edge = lambda key, value, less: value <= F.col(f"{key}#bound") if less else value >= F.col(f"{key}#bound")
            df = df.join(of_step, F.col(at) == F.col(f"{s}#")).filter(edge(s, ours, below)).drop(f"{s}#", f"{s}#bound")
            step = step.join(of_df, F.col(s) == F.col(f"{at}#")).filter(edge(at, theirs, not below)).drop(f"{at}#", f"{at}#bound")
        return df, step

    def attach(self, df: DataFrame, node: Node, labels: frozenset[str], place: tuple[str, str | None], env: Scope, scope: Scope) -> DataFrame:
        """Bind a node to its place in a path, and join its frame if properties are needed."""
        id_column, label_column = place
        if node.name in env:
            if env[node.name].id != id_column:
                df = df.filter(F.col(env[node.name].id) == F.col(id_column))
            if label_column and env[node.name].label_column not in (None, label_column):
                df = df.filter(F.col(env[node.name].label_column) == F.col(label_column))
            bound = env[node.name]
        else:
            bound = Bound("node", id=id_column, label=next(iter(labels)) if len(labels) == 1 else None, label_column=label_column)
        known = node.name in scope and not node.props  # its properties come with the outer binding
        missing = self.wanted(node.name, node.props) - set(bound.columns) if not known else set()
        all_props = {p: KIND.get(k, "any") for x in labels for p, k in self.catalog.node_properties(x).items()}
        props = sorted(all_props if "*" in missing else set(all_props) & missing)
        if props:
            cols = {p: self.fresh(f"{node.name or 'n'}_{p}") for p in props}
            key, tag = self.fresh("id"), self.fresh("label")
            frame = self.node_frame(labels, cols, key, tag if label_column else None)
            on = F.col(id_column) == F.col(key)
            if label_column:
                on &= F.col(label_column) == F.col(tag)
            df = df.join(frame, on).drop(key, tag)
            bound = replace(bound, columns={**bound.columns, **cols}, kinds={**bound.kinds, **{p: all_props[p] for p in props}})
        for k, v in node.props:
            df = df.filter(self.is_equal(bound.columns.get(k), bound.kinds.get(k), v, scope))
        if node.name:
            env[node.name] = bound
        return df

    def is_equal(self, column: str | None, kind: str | None, value, scope: Scope) -> Column:
        """An entry of a property map; a property that there isn't equals nothing."""
        return F.lit(False) if column is None else scalars.binary("=", Typed(F.col(column), kind or "any"), self.value(value, scope)).column

    def node_frame(self, labels: frozenset[str], cols: Mapping[str, str], key: str, tag: str | None) -> DataFrame:
        parts = []
        for label in sorted(labels):
            have = self.catalog.node_properties(label)
            out = [F.col("_id").alias(key), *[(F.col(f"`{p}`") if p in have else F.lit(None)).alias(c) for p, c in cols.items()]]
            parts.append(self.catalog.nodes[label].select(*out, *([F.lit(label).alias(tag)] if tag else [])))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def scan(self, node: Node, labels: frozenset[str], env: Scope) -> tuple[DataFrame, Scope]:
        key = self.fresh(f"{node.name or 'n'}_id")
        tag = self.fresh("label") if len(labels) > 1 else None
        wanted = self.wanted(node.name, node.props)
        all_props = {p: KIND.get(k, "any") for x in labels for p, k in self.catalog.node_properties(x).items()}
        props = sorted(all_props if "*" in wanted else set(all_props) & wanted)
        cols = {p: self.fresh(f"{node.name or 'n'}_{p}") for p in props}
        df = self.node_frame(labels, cols, key, tag) if labels else self.spark.createDataFrame([], f"`{key}` bigint")
        bound = Bound("node", cols, {p: all_props[p] for p in props}, key, next(iter(labels)) if len(labels) == 1 else None, tag)
        for k, v in node.props:
            df = df.filter(self.is_equal(cols.get(k), bound.kinds.get(k), v, {}))
        return df, env | ({node.name: bound} if node.name else {})

    def steps_of(self, rel: Relationship, left: frozenset[str], right: frozenset[str], mixed: bool, scope: Scope) -> tuple[DataFrame, dict, bool]:
        """The single hops of a variable length, and whether they carry labels."""
        touched = frozenset(x for t in self.triples(rel) for x in (t[0], t[2]))
        if rel.low == 0:  # nodes without any such edge reach themselves
            touched |= left | right
        step, info = self.edge_frame(replace(rel, low=None, high=None), touched, touched, None, mixed)
        for key, value in rel.props:
            step = step.filter(self.is_equal(info["props"].get(key), info["kinds"].get(key), value, scope))
        return step, info, len(touched) > 1

    def bounds(self, rel: Relationship) -> tuple[int, int | None]:
        low, high = (1, None) if rel.low is None else (rel.low, rel.high)
        return low, self.max_hops if high is None else high

    @staticmethod
    def kept_edges(step: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        """The edges written once with their ids, so that no round derives them anew."""
        return written(step.select(*dict.fromkeys(columns.values())), "edges")

    def many(self, rel: Relationship, left: frozenset[str], right: frozenset[str], mixed: bool, shortest: bool, starts: DataFrame | None, scope: Scope) -> tuple[DataFrame, dict]:
        """Variable length: columns s, d, eids (trails: no edge repeats). ``shortest``: one row for each pair at its least length.

        Trails grow from ``starts`` (all nodes if None). Without an upper bound, or a ``max_hops`` of the compiler, they grow until none
        can, each round written to the shared folder; as no edge repeats, that comes to an end.
        """
        low, high = self.bounds(rel)
        step, info, tagged = self.steps_of(rel, left, right, mixed, scope)
        c = info["cols"]
        if high is None:
            step = self.kept_edges(step, c)
        s, d, eids, sl, dl = (self.fresh(x) for x in ("s", "d", "eids", "sl", "dl"))
        one = [F.col(c["s"]).alias(s), F.col(c["d"]).alias(d), F.array(c["eid"]).alias(eids)] + ([F.col(c["sl"]).alias(sl), F.col(c["dl"]).alias(dl)] if tagged else [])
        frontier = step.select(*one)
        levels = []
        if low == 0:
            labels = sorted(left & right)
            selves = [self.catalog.nodes[x].select(F.col("_id").alias(s), F.col("_id").alias(d), F.array().cast("array<bigint>").alias(eids), *([F.lit(x).alias(sl), F.lit(x).alias(dl)] if tagged else [])) for x in labels]
            levels += [reduce(lambda a, b: a.unionByName(b), selves)] if selves else []
        if starts is not None:
            on = F.col(s) == F.col("#id")
            if tagged and "#label" in starts.columns:
                on &= F.col(sl) == F.col("#label")
            frontier = frontier.join(starts, on, "left_semi")
        keys = [s, d] + ([sl, dl] if tagged else [])
        if shortest:
            frontier = frontier.filter(F.col(s) != F.col(d)).dropDuplicates(keys)
        visited = frontier
        for n in range(1, (high or MAX_ROUNDS) + 1):
            if n > 1:
                on = F.col(d) == F.col(c["s"])
                if tagged:
                    on &= F.col(dl) == F.col(c["sl"])
                grown = frontier.join(step, on & ~F.array_contains(eids, F.col(c["eid"])))
                grown = grown.select(F.col(s), F.col(c["d"]).alias(d), F.concat(F.col(eids), F.array(c["eid"])).alias(eids), *([F.col(sl), F.col(c["dl"]).alias(dl)] if tagged else []))
                if shortest:
                    grown = grown.filter(F.col(s) != F.col(d)).dropDuplicates(keys).join(visited.select(*keys), keys, "left_anti")
                frontier = grown
            if high is None:
                frontier = written(frontier, "trails")
                if frontier.isEmpty():
                    break
            if n > 1 and shortest:
                visited = visited.unionByName(frontier)
            if n >= low and not shortest:
                levels.append(frontier)
        else:
            if high is None:
                raise CypherError(f"trails of more than {MAX_ROUNDS} hops")
        if not levels and not shortest:
            levels.append(frontier.filter(F.lit(False)))
        df = visited if shortest else reduce(lambda a, b: a.unionByName(b), levels)
        if tagged:
            df = df.filter(F.col(sl).isin(*left) & F.col(dl).isin(*right))
        return df, {"cols": {"s": s, "d": d, "eids": eids} | ({"sl": sl} if len(left) > 1 else {}) | ({"dl": dl} if len(right) > 1 else {}), "triples": info["triples"]}

    # -- searches

    def is_search(self, path: Path, rel: Relationship) -> bool:
        """Whether only the ends of a variable length matter, and a walk of at least ``low`` hops means a trail of as many.

        A shortest walk repeats no edge, so this holds from one hop on; but an undirected walk back to its start may be no trail.
        """
        low = 1 if rel.low is None else rel.low
        return not (path.shortest or path.name or rel.name) and any(r is rel for r in self.searches) and (low == 0 or low == 1 and rel.direction != "both")

    def forgotten(self, node: Node, scope: Scope) -> bool:
        """Whether nothing but conditions on it alone uses the first node of a path; these are then settled by its starts."""
        everything = list(walk(self.tree)) if self.tree is not None else []
        if node.name is None:
            return True
        if not everything or node.name in scope or any(isinstance(x, Subquery) or isinstance(x, Projection) and x.items is None for x in everything):
            return False
        alone = self.alone(node)
        if sum(isinstance(x, Variable) and x.name == node.name for x in everything) > sum(isinstance(x, Variable) for c in alone for x in walk(c)) or sum(isinstance(x, Node) and x.name == node.name for x in everything) > 1:
            return False
        self.settled += alone
        return True

    def selves(self, found: DataFrame | None, labels: frozenset[str], tagged: bool, names: Mapping[str, str]) -> DataFrame:
        """Each node of ``found`` (all nodes of the labels if None) under all of ``names`` (of ids, and of labels if ``tagged``)."""
        if found is None:
            parts = [self.catalog.nodes[x].select(F.col("_id").alias("#id"), F.lit(x).alias("#label")) for x in sorted(labels)]
            found = reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], "`#id` bigint, `#label` string")
        elif "#label" not in found.columns:
            found = found.withColumn("#label", F.lit(next(iter(labels), None)))
        kinds = {"id": "#id", "label": "#label"}
        return found.select(*[F.col(kinds[k]).alias(n) for n, k in names.items() if tagged or k == "id"]).distinct()

    def reach(self, rel: Relationship, left: frozenset[str], right: frozenset[str], starts: DataFrame | None, gone: bool, scope: Scope) -> tuple[DataFrame, dict]:
        """What can be reached: columns s, d, one row a pair; with ``gone`` only d, one row a node.

        Each round extends only what the one before found first and is written, so that the work grows with pairs or nodes and not with trails.
        """
        low, high = self.bounds(rel)
        step, info, tagged = self.steps_of(rel, left, right, False, scope)
        c = info["cols"]
        if high is None:
            step = self.kept_edges(step, c)
        s, d, sl, dl = (self.fresh(x) for x in ("s", "d", "sl", "dl"))
        kept = [] if gone else [s] + ([sl] if tagged else [])
        ends = [d] + ([dl] if tagged else [])
        named = {s: "s", d: "d", sl: "sl", dl: "dl"}
        if low == 0:
            found = self.selves(starts, left, tagged, {d: "id", dl: "label"} | ({} if gone else {s: "id", sl: "label"})).select(*kept, *ends)
        else:
            first = step
            if starts is not None:
                on = F.col(c["s"]) == F.col("#id")
                if tagged and "#label" in starts.columns:
                    on &= F.col(c["sl"]) == F.col("#label")
                first = first.join(starts, on, "left_semi")
            if tagged:
                first = first.filter(F.col(c["sl"]).isin(*left))
            found = first.select(*[F.col(c[named[x]]).alias(x) for x in kept + ends]).distinct()
        rounds = [written(found, "reached")]
        for _ in range(max(low, 1), MAX_ROUNDS if high is None else high + 1 - (low == 1)):
            if rounds[-1].isEmpty():
                break
            on = F.col(d) == F.col(c["s"])
            if tagged:
                on &= F.col(dl) == F.col(c["sl"])
            grown = rounds[-1].join(step, on).select(*kept, *[F.col(c[named[x]]).alias(f"{x}#") for x in ends]).withColumnsRenamed({f"{x}#": x for x in ends}).distinct()
            seen = reduce(lambda a, b: a.unionByName(b), rounds)
            rounds.append(written(grown.join(seen, kept + ends, "left_anti"), "reached"))
        else:
            if high is None and not rounds[-1].isEmpty():
                raise CypherError(f"paths of more than {MAX_ROUNDS} hops")
        df = reduce(lambda a, b: a.unionByName(b), rounds)
        if tagged:
            df = df.filter(F.col(dl).isin(*right) & (F.lit(True) if gone else F.col(sl).isin(*left)))
        cols = {"d": d} | ({"dl": dl} if tagged and len(right) > 1 else {})
        return df, {"cols": cols if gone else cols | {"s": s} | ({"sl": sl} if tagged and len(left) > 1 else {}), "triples": info["triples"]}

    def nearest(self, rel: Relationship, left: frozenset[str], right: frozenset[str], starts: DataFrame | None, ends: DataFrame | None, scope: Scope) -> tuple[DataFrame, dict]:
        """Shortest paths: columns s, d, hops, one row for each pair of different nodes at its least distance.

        A frontier has a node and the end it was reached from, nothing else, and is written. With ``ends`` (restricted, as ``starts``) the search goes on
        from the side with the smaller frontier: frontiers i hops from the starts and j hops from the ends meet in the
        pairs at distance i + j, as a shortest path has a node at every distance. It stops when all pairs are found.
        """
        high = self.bounds(rel)[1]
        step, info, tagged = self.steps_of(replace(rel, low=1), left, right, False, scope)
        c = info["cols"]
        s, d, sl, dl, hops = (self.fresh(x) for x in ("s", "d", "sl", "dl", "hops"))
        own, at = ["own"] + (["own_label"] if tagged else []), ["at"] + (["at_label"] if tagged else [])
        sides = [self.selves(starts, left, tagged, {"own": "id", "at": "id", "own_label": "label", "at_label": "label"})]
        ways = [(("s", "sl"), ("d", "dl")), (("d", "dl"), ("s", "sl"))]  # (from, to) of an edge, forwards and backwards
        if ends is not None:
            sides.append(self.selves(ends, right, tagged, {"own": "id", "at": "id", "own_label": "label", "at_label": "label"}))
        seen = [[written(x.select(*own, *at), "frontier")] for x in sides]
        sizes = [x[-1].count() for x in seen]
        least = sizes[0] * sizes[1] - seen[0][0].join(seen[1][0], own, "left_semi").count() if ends is not None else None
        found: list[DataFrame] = []
        pairs = [s, d] + ([sl, dl] if tagged else [])
        self.frontiers: list[tuple[int, int]] = []  # of each round: side and rows
        for n in range(1, (high or MAX_ROUNDS) + 1):
            side = 0 if ends is None or sizes[0] <= sizes[1] else 1
            if not sizes[side] or least == 0:
                break
            (origin, target), before = ways[side], seen[side]
            on = reduce(lambda a, b: a & b, [F.col(x) == F.col(c[y]) for x, y in zip(at, origin, strict=False)])
            grown = before[-1].join(step, on).select(*own, *[F.col(c[y]).alias(f"{x}#") for x, y in zip(at, target, strict=False)]).withColumnsRenamed({f"{x}#": x for x in at}).distinct()
            before.append(written(grown.join(reduce(lambda a, b: a.unionByName(b), before), own + at, "left_anti"), "frontier"))
            sizes[side] = before[-1].count()
            self.frontiers.append((side, sizes[side]))
            if ends is None:
                met = before[-1].select(*[F.col(x).alias(y) for x, y in zip(own + at, [s] + ([sl] if tagged else []) + [d] + ([dl] if tagged else []), strict=True)])
                found.append(met.withColumn(hops, F.lit(n)))
                continue
            one, two = (f[-1].select(*at, *[F.col(x).alias(y) for x, y in zip(own, names, strict=False)]) for f, names in zip(seen, ((s, sl), (d, dl)), strict=True))
            met = one.join(two, at).select(*pairs).distinct()
            same = F.col(s) == F.col(d)
            met = met.filter(~(same & (F.col(sl) == F.col(dl)) if tagged else same))
            if found:
                met = met.join(reduce(lambda a, b: a.unionByName(b), found), pairs, "left_anti")
            found.append(written(met.withColumn(hops, F.lit(n)), "met"))
            least -= found[-1].count()
        else:
            if high is None and sizes[0] and least != 0:
                raise CypherError(f"paths of more than {MAX_ROUNDS} hops")
        if not found:
            kinds = {s: "bigint", d: "bigint", sl: "string", dl: "string"}
            found = [self.spark.createDataFrame([], ", ".join(f"`{x}` {kinds[x]}" for x in pairs) + f", `{hops}` int")]
        df = reduce(lambda a, b: a.unionByName(b), found)
        if tagged:
            df = df.filter(F.col(sl).isin(*left) & F.col(dl).isin(*right))
        return df, {"cols": {"s": s, "d": d, "hops": hops} | ({"sl": sl} if tagged and len(left) > 1 else {}) | ({"dl": dl} if tagged and len(right) > 1 else {}), "triples": info["triples"]}

    # -- filters

    @staticmethod
    def subpattern(c) -> Exists | None:
        inner = c.of if isinstance(c, Unary) and c.op == "NOT" else c
        return inner if isinstance(inner, Exists) else None

    def where(self, df: DataFrame, scope: Scope, *conditions) -> DataFrame:
        for c in [x for w in conditions for x in conjuncts(w)]:
            if exists := self.subpattern(c):
                df = self.half_join(df, scope, exists, "left_anti" if isinstance(c, Unary) else "left_semi")
            elif any(isinstance(x, Exists) for x in walk(c)):
                df, replaced, extra = self.marked(df, scope, c)
                df = df.filter(self.value(replaced, scope | extra).column).drop(*[b.columns[""] for b in extra.values()])
            else:
                df = df.filter(self.value(c, scope).column)
        return df

    def half_join(self, df: DataFrame, scope: Scope, exists: Exists, how: str) -> DataFrame:
        pattern, inner, shared = self.pattern(exists.paths, scope, once=True)
        on = self.equal(shared)
        both = {**inner, **scope}
        plain = [x for x in conjuncts(exists.where) if not self.subpattern(x)]
        pattern = self.where(pattern, inner, *[x for x in conjuncts(exists.where) if self.subpattern(x)])
        for x in plain:
            column = self.value(x, both).column
            on = column if on is None else on & column
        return df.join(pattern, F.lit(True) if on is None else on, how)

    def marked(self, df: DataFrame, scope: Scope, tree) -> tuple[DataFrame, Any, Scope]:
        """EXISTS inside an expression: a boolean column by a left join on the shared ids, in place of each."""
        extra: Scope = {}
        for exists in {id(x): x for x in walk(tree) if isinstance(x, Exists)}.values():
            pattern, inner, shared = self.pattern(exists.paths, scope, once=True)
            free = {x.name for x in walk(exists.where)} & set(scope) if exists.where is not None else set()
            if any(isinstance(x, Variable) and x.name in free and x.name not in {n.name for p in exists.paths for n in p.nodes} for x in walk(exists.where) if isinstance(x, Variable)):
                raise CypherError("EXISTS inside an expression may use only its own and shared variables")
            names = {n: replace(scope[n], id=b) for n in scope for a, b in shared if scope[n].id == a}
            pattern = self.where(pattern, {**names, **inner}, exists.where)
            flag, name = self.fresh("exists"), f"#exists{next(self.numbers)}"
            keys = [b for _, b in shared]
            mark = pattern.select(*keys).distinct().withColumn(flag, F.lit(True)) if keys else pattern.limit(1).select(F.lit(True).alias(flag))
            df = df.join(mark, self.equal(shared) if keys else F.lit(True), "left").drop(*keys)
            df = df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
            extra[name] = Bound("value", {"": flag}, value_kind="bool")
            tree = substitute(tree, exists, Variable(name))
        return df, tree, extra

    # -- projections

    def project(self, clause: Projection, df: DataFrame | None, scope: Scope, carry: tuple[str, ...]) -> tuple[DataFrame, Scope]:
        df = self.unit() if df is None else df
        items = list(clause.items) if clause.items is not None else [Item(Variable(n), n) for n in sorted(scope) if not n.startswith("#")]
        if len({i.name for i in items}) < len(items):
            raise CypherError("two columns have the same name")
        for k, item in enumerate(items):
            if any(isinstance(x, Exists) for x in walk(item.of)):
                df, of, extra = self.marked(df, scope, item.of)
                items[k], scope = Item(of, item.name), scope | extra
        grouped = any(aggregates_in(i.of) for i in items)
        split = grouped and self.splits(items)
        out: Scope = {}
        keys: list[Column] = [F.col(c) for c in carry]
        computed: list[Column] = []
        self.before: list[tuple[str, Column]] = []
        shares: list[tuple[str, Column, Call]] = []
        last: list[Column] = []
        for item in items:
            whole = isinstance(item.of, Variable) and scope.get(item.of.name)
            if whole and whole.kind != "value":
                out[item.name] = whole
                keys += [F.col(c) for c in whole.all_columns()]
                continue
            if split and aggregates_in(item.of):  # its aggregates first, then the expression over them
                of, held = item.of, {}
                for call in {x: x for x in walk(of) if isinstance(x, Call) and x.name in AGGREGATES}:
                    name, column = f"#aggregate{next(self.numbers)}", self.fresh("aggregate")
                    percentile = self.share(call) is not None
                    value = self.value(call.args[0] if percentile else call, scope)
                    held[name] = Bound("value", {"": column}, value_kind="float" if call.name == "percentilecont" else value.kind)
                    shares.append((column, value.column, call)) if percentile else computed.append(value.column.alias(column))
                    of = substitute(of, call, Variable(name))
                value, column = self.value(of, held), self.fresh(item.name)
                out[item.name] = Bound("value", {"": column}, value_kind=value.kind)
                last.append(value.column.alias(column))
                continue
            value = self.value(item.of, scope)
            column = self.fresh(item.name)
            out[item.name] = Bound("value", {"": column}, value_kind=value.kind)
            (computed if aggregates_in(item.of) else keys).append(value.column.alias(column))
        keys = list({str(k): k for k in keys}.values())
        order = [(next((Variable(i.name) for i in items if i.of == e), e), down) for e, down in clause.order]
        if split:
            names = df.select(*keys).columns
            df = self.with_percentiles(df, keys, computed, shares).select(*names, *last)
            visible = out
        elif grouped:
            for name, column in self.before:
                df = df.withColumn(name, column)
            df = df.groupBy(*keys).agg(*computed)
            visible = out
        elif clause.distinct:
            df, visible = df.select(*keys), out
        else:
            new = [k for k in keys if " AS " in str(k)]
            old = list(dict.fromkeys([*df.columns]))
            df, visible = df.select(*[F.col(c) for c in old], *new) if old else df.select(*new), {**scope, **out}
        if clause.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*[(c.desc_nulls_first() if down else c.asc_nulls_last()) for e, down in order for c in [self.value(e, visible).column]])
        if clause.skip is not None:
            df = df.offset(self.constant(clause.skip))
        if clause.limit is not None:
            df = df.limit(self.constant(clause.limit))
        if clause.final:
            return df.select(*[self.shown(out[i.name], i.name) for i in items], *carry), out
        df = df.select(*dict.fromkeys([c for b in out.values() for c in b.all_columns()] + list(carry)))
        return self.where(df, out, clause.where), out

    def share(self, of) -> float | None:
        """The share of a percentile, if it is a constant."""
        if not isinstance(of, Call) or of.name not in ("percentilecont", "percentiledisc"):
            return None
        value = self.params.get(of.args[1].name) if isinstance(of.args[1], Parameter) else getattr(of.args[1], "value", None)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            if not 0 <= value <= 1:
                raise CypherError("a percentile needs a share from 0 to 1")
            return float(value)
        return None

    def splits(self, items: list[Item]) -> bool:
        """Whether some aggregate is a percentile, and beside aggregates there is nothing but constants in the expressions that have any."""
        trees = [i.of for i in items if aggregates_in(i.of)]
        if not any(self.share(x) is not None for t in trees for x in walk(t)):
            return False
        inside = lambda t: [x for y in walk(t) if isinstance(y, Call) and y.name in AGGREGATES for x in walk(y) if isinstance(x, Variable)]
        return all(sum(isinstance(x, Variable) for x in walk(t)) == len(inside(t)) for t in trees)

    def with_percentiles(self, df: DataFrame, keys: list[Column], computed: list[Column], shares: list[tuple[str, Column, Call]]) -> DataFrame:
        """The groups with their aggregates and percentiles: values are counted, then dealt by range over all groups, with the rows before each.

        Neither a large group nor a value that most rows have is one task; a group's percentiles are joined to its other aggregates.
        """
        names = df.select(*keys).columns
        out = df.groupBy(*keys).agg(*computed) if computed else df.select(*keys).distinct() if keys else self.unit()
        for values in {(str(v), call.distinct): (v, call.distinct) for _, v, call in shares}.values():
            rows = df.select(*keys, values[0].alias("_v")).filter("_v IS NOT NULL").groupBy(*names, "_v").agg((F.lit(1) if values[1] else F.count(F.lit(1))).cast("long").alias("n"))
            placed = ranks.value_places(rows, names, "_v")
            ends = F.col("before") + F.col("n")
            found = []
            for column, value, call in shares:
                if (str(value), call.distinct) != (str(values[0]), values[1]):
                    continue
                share = self.share(call)
                if call.name == "percentiledisc":
                    found.append(F.min(F.when(ends >= F.col("rows") * F.lit(share), F.col("_v"))).alias(column))
                    continue
                at = (F.col("rows") - 1) * F.lit(share)
                low, high = (F.max(F.when((F.col("before") <= x) & (x < ends), F.col("_v").cast("double"))) for x in (F.floor(at), F.ceil(at)))
                found.append((low + (high - low) * F.max(at - F.floor(at))).alias(column))
            out = ranks.join_groups(out, placed.groupBy(*names).agg(*found), names, "left")
        return out

    def shown(self, bound: Bound, name: str) -> Column:
        if bound.kind == "value":
            return F.col(bound.columns[""]).alias(name)
        return self.entity(bound).column.alias(name)

    def entity(self, bound: Bound) -> Typed:
        if bound.kind == "path":
            return Typed(F.array(*[F.col(c) for c in bound.node_ids]), "list:int")
        if bound.kind == "rels":
            return Typed(F.col(bound.columns[""]), "list:int")
        label = F.col(bound.label_column) if bound.label_column else F.lit(bound.label)
        fields = [F.col(bound.id).alias("id"), label.alias("label" if bound.kind == "node" else "type"), *[F.col(c).alias(p) for p, c in bound.columns.items()]]
        return Typed(F.when(F.col(bound.id).isNotNull(), F.struct(*fields)), bound.kind)

    def constant(self, of) -> int:
        value = self.params.get(of.name) if isinstance(of, Parameter) else of.value if isinstance(of, Literal) else None
        if not isinstance(value, int) or value < 0:
            raise CypherError("SKIP and LIMIT need a whole number")
        return value

    # -- expressions

    def value(self, of, scope: Scope) -> Typed:
        if isinstance(of, Literal):
            return scalars.literal(of.value)
        if isinstance(of, Parameter):
            if of.name not in self.params:
                raise CypherError(f"no value for ${of.name}")
            return scalars.literal(self.params[of.name])
        if isinstance(of, Variable):
            bound = self.bound(of.name, scope)
            if isinstance(bound, Held):
                return Typed(bound.column, bound.value_kind)
            return Typed(F.col(bound.columns[""]), bound.value_kind) if bound.kind == "value" else self.entity(bound)
        if isinstance(of, Property):
            return self.prop(of, scope)
        if isinstance(of, Unary):
            inner = self.value(of.of, scope)
            return Typed(~inner.column, "bool") if of.op == "NOT" else Typed(-inner.column, inner.kind)
        if isinstance(of, NullTest):
            column = self.identity(of.of, scope)
            column = self.value(of.of, scope).column if column is None else column
            return Typed(column.isNull() if of.null else column.isNotNull(), "bool")
        if isinstance(of, HasLabel):
            bound = self.bound(of.of.name, scope)
            wanted = frozenset.intersection(*[self.catalog.with_label(x) for x in of.labels])
            return Typed(F.col(bound.label_column).isin(*wanted) if bound.label_column else F.lit(bound.label in wanted), "bool")
        if isinstance(of, Binary):
            return self.binary(of, scope)
        if isinstance(of, ListOf):
            return scalars.list_of([self.value(x, scope) for x in of.items])
        if isinstance(of, MapOf):
            return Typed(F.struct(*[self.value(v, scope).column.alias(k) for k, v in of.items]), "map")
        if isinstance(of, Index):
            return scalars.index(self.value(of.of, scope), self.value(of.at, scope))
        if isinstance(of, Case):
            values = [self.value(v, scope) for _, v in of.whens]
            other = self.value(of.otherwise, scope)
            column = reduce(lambda c, wv: c.when(self.value(wv[0][0], scope).column, wv[1].column), zip(of.whens[1:], values[1:], strict=True), F.when(self.value(of.whens[0][0], scope).column, values[0].column))
            return Typed(column.otherwise(other.column), scalars.common([*values, other]))
        if isinstance(of, Quantified):
            return self.quantified(of, scope)
        if isinstance(of, Call):
            return self.aggregate(of, scope) if of.name in AGGREGATES else self.call(of, scope)
        raise CypherError(f"{type(of).__name__} can't be used here")

    def bound(self, name: str, scope: Scope) -> Bound:
        if name not in scope:
            raise CypherError(f"{name} is not defined")
        return scope[name]

    def prop(self, of: Property, scope: Scope) -> Typed:
        if isinstance(of.of, Variable) and (bound := self.bound(of.of.name, scope)).kind in ("node", "rel"):
            if of.name in bound.columns:
                return Typed(F.col(bound.columns[of.name]), bound.kinds.get(of.name, "any"))
            if self.strict:
                raise CypherError(f"unknown property {of.name} of {of.of.name}")
            return Typed(F.lit(None), "any")
        return scalars.field(self.value(of.of, scope), of.name)

    def identity(self, of, scope: Scope) -> Column | None:
        if isinstance(of, Variable) and of.name in scope and scope[of.name].kind in ("node", "rel"):
            return F.col(scope[of.name].id)
        return None

    def binary(self, of: Binary, scope: Scope) -> Typed:
        a, b = self.identity(of.left, scope), self.identity(of.right, scope)
        if a is not None and b is not None and of.op in ("=", "<>"):
            left, right = scope[of.left.name], scope[of.right.name]
            same = a == b
            if left.label and right.label and left.label != right.label:
                same = same & F.lit(False)
            elif left.label_column or right.label_column:
                tag = lambda x: F.col(x.label_column) if x.label_column else F.lit(x.label)
                same = same & (tag(left) == tag(right))
            return Typed(same if of.op == "=" else ~same, "bool")
        return scalars.binary(of.op, self.value(of.left, scope), self.value(of.right, scope))

    def quantified(self, of: Quantified, scope: Scope) -> Typed:
        values = self.value(of.of, scope)
        inner = values.kind.removeprefix("list:") if values.kind.startswith("list:") else "any"
        def apply(tree):
            def at(x: Column) -> Column:
                held = Held("value", value_kind=inner, column=x)
                return self.value(tree, scope | {of.name: held}).column

            return at

        column = values.column
        if of.kind == "map":
            column = F.filter(column, apply(of.where)) if of.where is not None else column
            kind = values.kind
            if of.value is not None:
                kinds: list[str] = []
                transform = lambda x: (lambda t: (kinds.append(t.kind), t.column)[1])(self.value(of.value, scope | {of.name: Held("value", value_kind=inner, column=x)}))
                column = F.transform(column, transform)
                kind = f"list:{kinds[0]}" if kinds else "list:any"
            return Typed(column, kind)
        test = {"any": lambda: F.exists(column, apply(of.where)), "all": lambda: F.forall(column, apply(of.where)), "none": lambda: ~F.exists(column, apply(of.where)), "single": lambda: F.size(F.filter(column, apply(of.where))) == 1}
        return Typed(test[of.kind](), "bool")

    def call(self, of: Call, scope: Scope) -> Typed:
        first = of.args[0] if of.args else None
        bound = scope.get(first.name) if isinstance(first, Variable) else None
        if of.name in ("id", "elementid") and bound is not None:
            return Typed(F.col(bound.id), "int")
        if of.name in ("labels", "type") and bound is not None and bound.kind in ("node", "rel"):
            label = F.col(bound.label_column) if bound.label_column else F.lit(bound.label)
            shown = F.when(F.col(bound.id).isNotNull(), F.array(label) if of.name == "labels" else label)
            return Typed(shown, "list:str" if of.name == "labels" else "str")
        if of.name == "properties" and bound is not None:
            return Typed(F.struct(*[F.col(c).alias(p) for p, c in bound.columns.items()]), "map")
        if of.name == "keys" and bound is not None:
            return scalars.list_of([scalars.literal(p) for p in sorted(bound.columns)])
        if of.name in ("startnode", "endnode") and bound is not None and bound.ends:
            return Typed(F.col(bound.ends[of.name == "endnode"]), "int")
        if of.name == "length" and bound is not None and bound.kind == "path":
            return Typed(reduce(lambda a, c: a + c, [*map(F.size, bound.length[1]), *map(F.col, bound.hops)], F.lit(bound.length[0])).cast("long"), "int")
        if of.name == "nodes" and bound is not None and bound.kind == "path":
            return self.entity(bound)
        if of.name == "size" and bound is not None and bound.kind == "rels":
            return Typed(F.size(bound.columns[""]).cast("long"), "int")
        if of.name == "duration" and isinstance(first, Literal):
            return Typed(scalars.duration(first.value), "dur")
        if of.name == "duration" and isinstance(first, MapOf):
            return Typed(scalars.duration_of({k: v.value for k, v in first.items}), "dur")
        return scalars.call(of.name, [self.value(x, scope) for x in of.args])

    def aggregate(self, of: Call, scope: Scope) -> Typed:
        if not of.args:
            return Typed(F.count(F.lit(1)), "int")
        identity = self.identity(of.args[0], scope)
        if of.name == "count" and identity is not None:
            bound = scope[of.args[0].name]
            if of.distinct:
                return Typed(F.count_distinct(identity, *([F.col(bound.label_column)] if bound.label_column else [])), "int")
            return Typed(F.count(identity), "int")
        values = [self.value(x, scope) for x in of.args]
        if of.name == "percentiledisc":
            column = self.fresh("arg")
            self.before.append((column, values[0].column))
            return Typed(F.expr(f"percentile_disc({of.args[1].value}) WITHIN GROUP (ORDER BY `{column}`)"), values[0].kind)
        return scalars.aggregate(of.name, values, of.distinct)


@dataclass(frozen=True)
class Held(Bound):
    """A lambda's variable: its column is given, not named."""

    column: Any = None


def kind_of(dtype: str) -> str:
    return f"list:{kind_of(dtype[6:-1])}" if dtype.startswith("array<") else KIND.get(dtype, "any")


def substitute(tree, old, new):
    if tree is old or tree == old:
        return new
    if isinstance(tree, tuple):
        return tuple(substitute(x, old, new) for x in tree)
    if hasattr(tree, "__dataclass_fields__"):
        return replace(tree, **{n: substitute(getattr(tree, n), old, new) for n in tree.__dataclass_fields__})
    return tree


def cypher(spark: SparkSession, catalog: GraphCatalog, query: str, params: Mapping[str, Any] | None = None, strict: bool = False) -> DataFrame:
    """Run Cypher text as a lazy DataFrame."""
    return Compiler(spark, catalog, params, strict).run(query)
