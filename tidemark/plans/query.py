"""Queries: typed predicates, ranges, and a strict reader of the SQL dialect."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FkEdge, SchemaGraph

OPS = ("=", "<", "<=", ">", ">=", "IN", "NOT IN", "IS NULL", "IS NOT NULL", "GROUP")


@dataclass(frozen=True)
class Predicate:
    table: str
    column: str
    op: str
    value: object = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"operator {self.op} is not supported")

    @property
    def name(self) -> str:
        return f"{self.table}__{self.column}"

    def test(self, c: Column) -> Column:
        v = self.value
        return {"=": lambda: c == v, "<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v, "IN": lambda: c.isin(list(v)), "NOT IN": lambda: ~c.isin(list(v)), "IS NULL": c.isNull, "IS NOT NULL": c.isNotNull}[self.op]()

    def sql(self) -> str:
        lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
        v = "" if self.op.startswith("IS") else " (" + ", ".join(map(lit, self.value)) + ")" if "IN" in self.op else " " + lit(self.value)
        return f"{self.table}.{self.column} {self.op}{v}"


@dataclass(frozen=True)
class Range:
    """What a conjunction allows of one column: an interval, or (values) a set, without excluded values; null only if null_only."""

    low: float = -math.inf
    high: float = math.inf
    low_in: bool = True
    high_in: bool = True
    values: frozenset | None = None
    excluded: frozenset = frozenset()
    null_only: bool = False
    not_null: bool = False
    grouped: bool = False  # each group brings its own values

    @property
    def empty(self) -> bool:
        """Whether nothing satisfies it; contradictions have probability 0."""
        if self.null_only:
            return self.not_null
        if self.values is not None:
            return not any(self.allows(v) for v in self.values)
        if self.low == -math.inf or self.high == math.inf:
            return False
        return self.low > self.high or (self.low == self.high and not (self.low_in and self.high_in))

    def allows(self, v: object) -> bool:
        if v is None:
            return self.null_only
        if self.null_only or v in self.excluded or (self.values is not None and v not in self.values):
            return False
        above = self.low == -math.inf or v > self.low or (v == self.low and self.low_in)
        return above and (self.high == math.inf or v < self.high or (v == self.high and self.high_in))

    def also(self, p: Predicate) -> Range:
        """The intersection with a predicate; a comparison is never true of null."""
        if p.op == "IS NULL":
            return replace(self, null_only=True)
        if p.op == "GROUP":
            return replace(self, grouped=True)
        r = replace(self, not_null=True)
        if p.op in ("=", "IN"):
            new = frozenset([p.value] if p.op == "=" else p.value)
            return replace(r, values=new if r.values is None else r.values & new)
        if p.op == "NOT IN":
            return replace(r, excluded=r.excluded | frozenset(p.value))
        if p.op in ("<", "<="):
            inside = p.op == "<="
            return replace(r, high=p.value, high_in=inside) if r.high == math.inf or p.value < r.high else replace(r, high_in=r.high_in and inside) if p.value == r.high else r
        if p.op in (">", ">="):
            inside = p.op == ">="
            return replace(r, low=p.value, low_in=inside) if r.low == -math.inf or p.value > r.low else replace(r, low_in=r.low_in and inside) if p.value == r.low else r
        return r


def ranges(predicates: list[Predicate]) -> dict[str, Range]:
    """The range of each column (table__column) under the conjunction."""
    out: dict[str, Range] = {}
    for p in predicates:
        out[p.name] = out.get(p.name, Range()).also(p)
    return out


@dataclass(frozen=True)
class Aggregate:
    """sign * op(product of factors): COUNT, SUM or AVG."""

    op: str
    factors: tuple[tuple[str, str], ...] = ()
    sign: int = 1


@dataclass
class QuerySpec:
    tables: list[str]
    edges: list[FkEdge] = field(default_factory=list)
    predicates: list[Predicate] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
    groups: list[tuple[str, str]] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    aliases: dict[tuple[str, str], str] = field(default_factory=dict)  # of groups
    value: str = "value"

    @property
    def group_names(self) -> list[str]:
        """The groups' columns in the answer: alias, column, or table_column where two roles share one."""
        plain = [c for _, c in self.groups]
        return [self.aliases.get((t, c)) or (c if plain.count(c) == 1 else f"{t}_{c}") for t, c in self.groups]

    def check(self, schema: SchemaGraph) -> QuerySpec:
        if self.edges or len(self.tables) > 1:
            schema.tree(self.edges, set(self.tables))
        ops = {a.op for a in self.aggregates}
        if len(ops) > 1:
            raise ValueError("aggregates of different kinds in one expression")
        if "COUNT" in ops and len(self.aggregates) > 1:
            raise ValueError("only a single COUNT")
        return self


_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|([A-Za-z_][\w.]*)|(<=|>=|<>|!=|[=<>(),*+\-;]))")


class Reader:
    """SELECT [groups,] aggregate FROM tables WHERE conjunction GROUP BY columns [ORDER BY ...] [LIMIT n]; all else is refused."""

    def __init__(self, schema: SchemaGraph, sql: str) -> None:
        self.schema, self.tokens, at = schema, [], 0
        text = sql.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append(m.group(0).strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def word(self, *expected: str) -> bool:
        """Takes the words if they come next."""
        if [t.upper() for t in self.tokens[self.at : self.at + len(expected)]] == list(expected):
            self.at += len(expected)
            return True
        return False

    def need(self, *expected: str) -> None:
        if not self.word(*expected):
            raise ValueError(f"expected {' '.join(expected)} at {self.peek()!r}")

    def name(self) -> str:
        t = self.peek()
        if not re.match(r"[A-Za-z_]", t):
            raise ValueError(f"expected a name at {t!r}")
        self.at += 1
        return t

    def literal(self) -> object:
        t = self.peek()
        self.at += 1
        if t.startswith("'"):
            return t[1:-1].replace("''", "'")
        if re.match(r"-?\d", t):
            return float(t) if re.search(r"[.eE]", t) else int(t)
        raise ValueError(f"expected a literal at {t!r}")

    def column(self, name: str, alias: dict[str, str]) -> tuple[str, str]:
        if "." in name:
            t, c = name.split(".", 1)
            if t not in alias:
                raise ValueError(f"unknown table {t}")
            return alias[t], c
        owners = [t for t in dict.fromkeys(alias.values()) if name in self.schema.tables[t].columns]
        if len(owners) != 1:
            raise ValueError(f"column {name} is in {len(owners)} of the tables")
        return owners[0], name

    def read(self) -> QuerySpec:
        self.need("SELECT")
        start, depth = self.at, 0
        while self.peek() and not (depth == 0 and self.peek().upper() == "FROM"):
            self.at += 1
        select_end = self.at
        self.need("FROM")
        alias: dict[str, str] = {}
        while True:
            table = self.name()
            if table not in self.schema.tables:
                raise ValueError(f"unknown table {table}")
            alias[table] = table
            self.word("AS")
            if re.match(r"[A-Za-z_]", self.peek()) and self.peek().upper() not in ("WHERE", "GROUP", "ORDER", "LIMIT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "ON"):
                alias[self.name()] = table
            if not self.word(","):
                break
        spec = QuerySpec(list(dict.fromkeys(alias.values())))
        if self.word("WHERE"):
            self.condition(spec, alias)
            while self.word("AND"):
                self.condition(spec, alias)
        if self.word("GROUP", "BY"):
            spec.groups.append(self.column(self.name(), alias))
            while self.word(","):
                spec.groups.append(self.column(self.name(), alias))
        if self.word("ORDER", "BY"):
            while True:
                c, down = self.name(), False
                if self.word("DESC"):
                    down = True
                else:
                    self.word("ASC")
                spec.order.append((c, down))
                if not self.word(","):
                    break
        if self.word("LIMIT"):
            spec.limit = int(self.literal())
        if self.peek():
            raise ValueError(f"not supported: {' '.join(self.tokens[self.at :])}")
        self.at = start
        self.select(spec, alias, select_end)
        spec.order = [(self.ordered(spec, alias, c), down) for c, down in spec.order]
        return spec.check(self.schema)

    def ordered(self, spec: QuerySpec, alias: dict[str, str], name: str) -> str:
        """The answer's column that ORDER BY names: an alias, the aggregate, or a group."""
        if name in (spec.value, *spec.group_names):
            return name
        try:
            return spec.group_names[spec.groups.index(self.column(name, alias))]
        except ValueError:
            raise ValueError(f"ORDER BY {name} is neither grouped nor the aggregate") from None

    def select(self, spec: QuerySpec, alias: dict[str, str], end: int) -> None:
        while self.at < end:
            if self.tokens[self.at + 1] == "(" if self.at + 1 < end else False:
                sign = 1
                while True:
                    op = self.name().upper()
                    if op not in ("COUNT", "SUM", "AVG"):
                        raise ValueError(f"unknown aggregate {op}")
                    self.need("(")
                    factors: list[tuple[str, str]] = []
                    if not self.word("*"):
                        factors.append(self.column(self.name(), alias))
                        while self.word("*"):
                            factors.append(self.column(self.name(), alias))
                    if self.peek() in "+-":
                        raise ValueError("only products inside an aggregate")
                    self.need(")")
                    spec.aggregates.append(Aggregate(op, tuple(factors), sign))
                    if self.at < end and self.peek() in ("+", "-"):
                        sign = 1 if self.peek() == "+" else -1
                        self.at += 1
                        continue
                    break
                if self.word("AS"):
                    spec.value = self.name()
            else:
                c = self.column(self.name(), alias)
                if c not in spec.groups:
                    raise ValueError(f"{c[1]} is neither grouped nor aggregated")
                if self.word("AS"):
                    spec.aliases[c] = self.name()
            if self.at < end and not self.word(","):
                raise ValueError(f"not supported in SELECT: {self.peek()!r}")

    def condition(self, spec: QuerySpec, alias: dict[str, str]) -> None:
        table, column = self.column(self.name(), alias)
        if self.word("IS", "NOT", "NULL"):
            spec.predicates.append(Predicate(table, column, "IS NOT NULL"))
            return
        if self.word("IS", "NULL"):
            spec.predicates.append(Predicate(table, column, "IS NULL"))
            return
        negated = self.word("NOT", "IN")
        if negated or self.word("IN"):
            self.need("(")
            values = [self.literal()]
            while self.word(","):
                values.append(self.literal())
            self.need(")")
            spec.predicates.append(Predicate(table, column, "NOT IN" if negated else "IN", tuple(values)))
            return
        if self.word("BETWEEN"):
            low = self.literal()
            self.need("AND")
            spec.predicates += [Predicate(table, column, ">=", low), Predicate(table, column, "<=", self.literal())]
            return
        op = self.peek()
        self.at += 1
        if op not in ("=", "<", "<=", ">", ">="):
            raise ValueError(f"operator {op!r} is not supported")
        if re.match(r"[A-Za-z_]", self.peek()):
            other = self.column(self.name(), alias)
            if op != "=":
                raise ValueError("only equal columns can be joined")
            spec.edges.append(self.schema.edge(table, column, *other))
        else:
            spec.predicates.append(Predicate(table, column, op, self.literal()))


def parse(schema: SchemaGraph, sql: str) -> QuerySpec:
    return Reader(schema, sql).read()


@dataclass(frozen=True)
class WhatIf:
    """Rows that meet the predicates count (1 + change) times."""

    predicates: tuple[Predicate, ...]
    change: float


def parse_what_if(schema: SchemaGraph, text: str) -> WhatIf:
    """WHAT IF condition [AND condition] INCREASE|DECREASE BY p%."""
    m = re.fullmatch(r"\s*WHAT\s+IF\s+(.*?)\s+(INCREASE|DECREASE)\s+BY\s+(\d+(?:\.\d+)?)\s*%\s*", text, re.I | re.S)
    if not m:
        raise ValueError("expected WHAT IF ... INCREASE|DECREASE BY p%")
    reader = Reader(schema, m[1])
    spec = QuerySpec([])
    alias = {t: t for t in schema.tables}
    reader.condition(spec, alias)
    while reader.word("AND"):
        reader.condition(spec, alias)
    if reader.peek() or spec.edges:
        raise ValueError("only a conjunction of predicates")
    return WhatIf(tuple(spec.predicates), float(m[3]) / 100 * (1 if m[2].upper() == "INCREASE" else -1))


def aggregate_column(spec: QuerySpec) -> Column:
    """The exact aggregate as a Column over qualified names."""
    out = None
    for a in spec.aggregates:
        x = F.lit(1)
        if a.factors:
            x = F.col("__".join(a.factors[0]))
            for f in a.factors[1:]:
                x = x * F.col("__".join(f))
        c = F.count(x) if a.op == "COUNT" else F.sum(x) if a.op == "SUM" else F.avg(x)
        c = c if a.sign > 0 else -c
        out = c if out is None else out + c
    return out if out is not None else F.count("*")
