"""A read-only subset of a graph query language, compiled to DataFrames.

``MATCH`` patterns of nodes with label and property map and of directed relationships with type alternatives; ``WHERE`` with
``= <> < <= > >= CONTAINS IN IS [NOT] NULL NOT AND OR``, ``toLower`` and ``$parameters``; ``RETURN [DISTINCT]`` of properties,
``type(r)``, ``count(...)`` and ``*`` with aliases; ``ORDER BY``, ``LIMIT``; ``shortestPath((a)-[*]-(b))`` between two named nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.graph import shortest_path

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+(?:\.\d+)?)|(?P<param>\$\w+)|(?P<name>[A-Za-z_]\w*)|(?P<op><=|>=|<>|->|<-|[()\[\]{}:,.=<>*|\-]))")
_WRITES = frozenset("CREATE MERGE DELETE DETACH SET REMOVE DROP CALL LOAD FOREACH".split())


class QueryError(ValueError):
    """The text is no query of the subset."""


@dataclass
class Schema:
    """Vertex tables by label and edge tables by type: (DataFrame, source label, source key, target label, target key)."""

    nodes: dict[str, tuple[DataFrame, str]]
    edges: dict[str, tuple[DataFrame, str, str, str, str]]


@dataclass
class _Node:
    var: str
    label: str | None
    props: dict[str, object] = field(default_factory=dict)


@dataclass
class _Edge:
    var: str
    types: list[str]
    forward: bool


class _Parser:
    def __init__(self, text: str, params: dict):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise QueryError(f"unexpected text at {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at, self.params, self.fresh = 0, params, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, wanted: str | None = None) -> str:
        value = self.peek()
        if not value or (wanted is not None and value.upper() != wanted.upper()):
            raise QueryError(f"expected {wanted or 'more'} instead of {value or 'the end'}")
        self.at += 1
        return value

    def try_take(self, *words: str) -> bool:
        if all(self.peek(k).upper() == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise QueryError(f"expected a name instead of {self.peek() or 'the end'}")
        return self.take()

    def literal(self):
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "number":
            return float(value) if "." in value else int(value)
        if kind == "param":
            if value[1:] not in self.params:
                raise QueryError(f"no value for parameter {value}")
            return self.params[value[1:]]
        if value == "[":
            out = []
            while not self.try_take("]"):
                out.append(self.literal())
                self.try_take(",")
            return out
        if kind == "name" and value.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[value.lower()]
        raise QueryError(f"expected a value instead of {value or 'the end'}")

    def unnamed(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    def node(self) -> _Node:
        self.take("(")
        var = self.name() if self.tokens[self.at][0] == "name" else self.unnamed()
        label = self.name() if self.try_take(":") else None
        props: dict[str, object] = {}
        if self.try_take("{"):
            while not self.try_take("}"):
                key = self.name()
                self.take(":")
                props[key] = self.literal()
                self.try_take(",")
        self.take(")")
        return _Node(var, label, props)

    def edge(self) -> _Edge:
        back = self.try_take("<-")
        if not back:
            self.take("-")
        self.take("[")
        var = self.name() if self.tokens[self.at][0] == "name" else self.unnamed()
        types = []
        if self.try_take(":"):
            types.append(self.name())
            while self.try_take("|"):
                self.try_take(":")
                types.append(self.name())
        self.take("]")
        if back:
            self.take("-")
            return _Edge(var, types, False)
        self.take("->")
        return _Edge(var, types, True)

    def chain(self) -> list:
        out: list = [self.node()]
        while self.peek() in ("-", "<-"):
            out += [self.edge(), self.node()]
        return out


def guard(text: str) -> None:
    """Refuse anything but a reading query: it must begin with MATCH, hold RETURN and no writing clause outside strings."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text)
    words = re.findall(r"[A-Za-z_]+", bare.upper())
    if not words or words[0] != "MATCH":
        raise QueryError("a query begins with MATCH")
    if "RETURN" not in words:
        raise QueryError("a query needs RETURN")
    if bad := _WRITES.intersection(words):
        raise QueryError(f"only reading is allowed, not {', '.join(sorted(bad))}")


def compile_query(text: str, schema: Schema, **params) -> DataFrame:
    """The DataFrame of a query; nothing is executed but the search of a shortest path."""
    guard(text)
    p = _Parser(text, params)
    p.take("MATCH")
    if p.peek(1) == "=" and p.peek(2).lower() == "shortestpath" or p.word() == "SHORTESTPATH":
        return _path_query(p, schema)
    chains = [p.chain()]
    while p.try_take(","):
        chains.append(p.chain())
    c = _Compiler(schema)
    for chain in chains:
        c.add(chain)
    frame = c.frame()
    if p.try_take("WHERE"):
        frame = frame.filter(_disjunction(p, c))
    return _returned(p, c, frame)


def check_query(text: str, schema: Schema, **params) -> list[str]:
    """The columns a query would return, by analysis only."""
    return compile_query(text, schema, **params).columns


class _Compiler:
    def __init__(self, schema: Schema):
        self.schema, self.nodes, self.edges, self.steps = schema, {}, {}, []

    def add(self, chain: list) -> None:
        for k in range(0, len(chain), 2):
            node = chain[k]
            known = self.nodes.get(node.var)
            if known is None:
                self.nodes[node.var] = node
            else:
                known.label = known.label or node.label
                known.props.update(node.props)
        for k in range(1, len(chain), 2):
            left, edge, right = chain[k - 1], chain[k], chain[k + 1]
            source, target = (left, right) if edge.forward else (right, left)
            types = edge.types or list(self.schema.edges)
            for t in types:
                if t not in self.schema.edges:
                    raise QueryError(f"unknown relationship type {t}")
            first = self.schema.edges[types[0]]
            for node, label in ((source, first[1]), (target, first[3])):
                self.nodes[node.var].label = self.nodes[node.var].label or label
            self.edges[edge.var] = types
            self.steps.append((edge.var, types, source.var, target.var))

    def _vertex(self, var: str) -> DataFrame:
        node = self.nodes[var]
        if node.label is None and len(self.schema.nodes) == 1:
            node.label = next(iter(self.schema.nodes))
        if node.label not in self.schema.nodes:
            raise QueryError(f"unknown label {node.label} of {var}")
        table, key = self.schema.nodes[node.label]
        for name, value in node.props.items():
            if name not in table.columns:
                raise QueryError(f"{node.label} has no property {name}")
            table = table.filter(F.col(name) == F.lit(value))
        return table.select(F.col(key).alias(f"{var}.__id"), *[F.col(n).alias(f"{var}.{n}") for n in table.columns])

    def _edge(self, var: str, types: list[str]) -> DataFrame:
        out = None
        for t in types:
            table, _, s, _, o = self.schema.edges[t]
            rest = [n for n in table.columns if n not in (s, o)]
            part = table.select(F.col(s).alias(f"{var}.__s"), F.col(o).alias(f"{var}.__o"), F.lit(t).alias(f"{var}.__type"), *[F.col(n).alias(f"{var}.{n}") for n in rest])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def frame(self) -> DataFrame:
        """Joins along the pattern; two relationships of one pattern are never the same edge."""
        if not self.steps:
            frames = [self._vertex(v) for v in self.nodes]
            out = frames[0]
            for f in frames[1:]:
                out = out.crossJoin(f)
            return out
        out, joined, used = None, set(), []
        for var, types, s, o in self.steps:
            e = self._edge(var, types)
            if out is None:
                out = e
            else:
                at = [(f"{var}.__s", s), (f"{var}.__o", o)]
                on = [F.col(f"`{c}`") == F.col(f"`{v}.__id`") for c, v in at if v in joined]
                out = out.join(e, on) if on else out.crossJoin(e)
            for c, v in ((f"{var}.__s", s), (f"{var}.__o", o)):
                if v not in joined:
                    out = out.join(self._vertex(v), F.col(f"`{c}`") == F.col(f"`{v}.__id`"))
                    joined.add(v)
            for other in used:
                same = (F.col(f"`{var}.__s`") == F.col(f"`{other}.__s`")) & (F.col(f"`{var}.__o`") == F.col(f"`{other}.__o`")) & (F.col(f"`{var}.__type`") == F.col(f"`{other}.__type`"))
                out = out.filter(~same)
            used.append(var)
        for v in self.nodes:
            if v not in joined:
                out = out.crossJoin(self._vertex(v))
        return out


def _disjunction(p: _Parser, c: _Compiler) -> Column:
    out = _conjunction(p, c)
    while p.try_take("OR"):
        out = out | _conjunction(p, c)
    return out


def _conjunction(p: _Parser, c: _Compiler) -> Column:
    out = _condition(p, c)
    while p.try_take("AND"):
        out = out & _condition(p, c)
    return out


def _condition(p: _Parser, c: _Compiler) -> Column:
    if p.try_take("NOT"):
        return ~_condition(p, c)
    if p.peek() == "(":
        p.take("(")
        out = _disjunction(p, c)
        p.take(")")
        return out
    left = _operand(p, c)
    if p.try_take("IS", "NOT", "NULL"):
        return left.isNotNull()
    if p.try_take("IS", "NULL"):
        return left.isNull()
    if p.try_take("CONTAINS"):
        return F.contains(left, _operand(p, c))
    if p.try_take("IN"):
        return left.isin(list(p.literal()))
    op = p.take()
    right = _operand(p, c)
    try:
        return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    except KeyError:
        raise QueryError(f"unknown operator {op}") from None


def _operand(p: _Parser, c: _Compiler) -> Column:
    if p.tokens[p.at][0] == "name" and p.peek().lower() not in ("true", "false", "null"):
        if p.peek().lower() in ("tolower", "toupper") and p.peek(1) == "(":
            f = F.lower if p.take().lower() == "tolower" else F.upper
            p.take("(")
            out = f(_operand(p, c))
            p.take(")")
            return out
        return _property(p, c)[0]
    return F.lit(p.literal())


def _property(p: _Parser, c: _Compiler) -> tuple[Column, str]:
    if p.word() == "TYPE" and p.peek(1) == "(":
        p.take()
        p.take("(")
        var = p.name()
        p.take(")")
        return F.col(f"`{var}.__type`"), f"type({var})"
    var = p.name()
    if var not in c.nodes and var not in c.edges:
        raise QueryError(f"unknown name {var}")
    if p.try_take("."):
        name = p.name()
        return F.col(f"`{var}.{name}`"), f"{var}.{name}"
    return F.col(f"`{var}.__id`") if var in c.nodes else F.struct(f"`{var}.__s`", f"`{var}.__o`"), var


def _returned(p: _Parser, c: _Compiler, frame: DataFrame) -> DataFrame:
    p.take("RETURN")
    distinct = p.try_take("DISTINCT")
    columns: list[tuple[Column, str, bool]] = []
    if p.try_take("*"):
        columns = [(F.col(f"`{n}`"), n, False) for n in frame.columns if not n.split(".")[1].startswith("__") and not n.startswith("_")]
    else:
        while True:
            if p.word() == "COUNT" and p.peek(1) == "(":
                p.take()
                p.take("(")
                if p.try_take("*"):
                    column, name = F.count(F.lit(1)), "count(*)"
                else:
                    one = p.try_take("DISTINCT")
                    inner, text = _property(p, c)
                    column, name = (F.count_distinct(inner), f"count(DISTINCT {text})") if one else (F.count(inner), f"count({text})")
                p.take(")")
                counted = True
            else:
                (column, name), counted = _property(p, c), False
            if p.try_take("AS"):
                name = p.name()
            columns.append((column, name, counted))
            if not p.try_take(","):
                break
    if any(counted for _, _, counted in columns):
        keys = [col.alias(n) for col, n, counted in columns if not counted]
        counts = [col.alias(n) for col, n, counted in columns if counted]
        out = frame.groupBy(*keys).agg(*counts).select(*[f"`{n}`" for _, n, _ in columns])
    else:
        order_source = frame
        out = order_source.select(*[col.alias(n) for col, n, _ in columns])
    if distinct:
        out = out.distinct()
    if p.try_take("ORDER", "BY"):
        orders = []
        while True:
            parts = [p.name()]
            while p.try_take("."):
                parts.append(p.name())
            name = ".".join(parts)
            if name not in out.columns:
                match = [n for col, n, _ in columns if n.split(".")[-1] == parts[-1] or n == parts[-1]]
                if not match:
                    raise QueryError(f"{name} is not returned, so it can't order the result")
                name = match[0]
            orders.append(F.desc_nulls_first(f"`{name}`") if p.try_take("DESC") else (p.try_take("ASC"), F.asc_nulls_last(f"`{name}`"))[1])
            if not p.try_take(","):
                break
        out = out.orderBy(*orders)
    if p.try_take("LIMIT"):
        out = out.limit(int(p.literal()))
    if p.peek():
        raise QueryError(f"unexpected {p.peek()!r}")
    return out


def _path_query(p: _Parser, schema: Schema) -> DataFrame:
    if p.peek(1) == "=":
        p.name()
        p.take("=")
    p.name()
    p.take("(")
    first = p.node()
    for t in ("-", "[", "*", "]", "-"):
        p.take(t)
    second = p.node()
    p.take(")")
    edges = None
    for table, s_label, s, o_label, o in schema.edges.values():
        s_table, s_key = schema.nodes[s_label]
        o_table, o_key = schema.nodes[o_label]
        part = table.select(F.concat(F.lit(f"{s_label}:"), F.col(s).cast("string")).alias("src"), F.concat(F.lit(f"{o_label}:"), F.col(o).cast("string")).alias("dst"))
        edges = part if edges is None else edges.unionByName(part)
    ends = []
    for node in (first, second):
        if node.label not in schema.nodes:
            raise QueryError(f"unknown label {node.label}")
        table, key = schema.nodes[node.label]
        for name, value in node.props.items():
            table = table.filter(F.col(name) == F.lit(value))
        row = table.select(key).orderBy(key).first()
        if row is None:
            return edges.sparkSession.createDataFrame([], "length int, path array<string>")
        ends.append(f"{node.label}:{row[0]}")
    return shortest_path(edges, ends[0], ends[1])
