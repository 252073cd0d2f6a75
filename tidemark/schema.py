"""The schema graph: tables, foreign keys, functional dependencies."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """A table (or a role of one: source names the file it is read from)."""

    name: str
    key: tuple[str, ...]
    columns: tuple[str, ...] = ()
    source: str = ""
    irrelevant: tuple[str, ...] = ()
    dependencies: tuple[tuple[str, str], ...] = ()  # (determining, determined)
    sample_rate: float = 1.0
    keep_keys: tuple[str, ...] = ()

    @property
    def file(self) -> str:
        return self.source or self.name


@dataclass(frozen=True)
class FkEdge:
    """child.fk refers to parent.pk."""

    child: str
    fk: str
    parent: str
    pk: str

    @property
    def id(self) -> str:
        return f"{self.child}.{self.fk} = {self.parent}.{self.pk}"

    @property
    def multiplier(self) -> str:
        """The column of the parent that counts its children along this edge."""
        return f"mul__{self.child}__{self.fk}"


@dataclass
class SchemaGraph:
    tables: dict[str, TableSpec] = field(default_factory=dict)
    edges: list[FkEdge] = field(default_factory=list)

    def add_table(self, spec: TableSpec) -> None:
        self.tables[spec.name] = spec

    def add_edge(self, child: str, fk: str, parent: str, pk: str) -> FkEdge:
        if child not in self.tables or parent not in self.tables:
            raise ValueError(f"unknown table in {child}.{fk} = {parent}.{pk}")
        if self.tables[parent].key != (pk,):
            raise ValueError(f"{parent}.{pk} is not a single-column key")
        self.edges.append(FkEdge(child, fk, parent, pk))
        return self.edges[-1]

    def find(self, table: str, incoming: bool) -> list[FkEdge]:
        """The edges into (as parent) or out of (as child) a table."""
        return [e for e in self.edges if (e.parent if incoming else e.child) == table]

    def edge(self, a: str, a_col: str, b: str, b_col: str) -> FkEdge:
        """The edge between two columns, in either direction."""
        for e in self.edges:
            if (e.child, e.fk, e.parent, e.pk) in ((a, a_col, b, b_col), (b, b_col, a, a_col)):
                return e
        raise ValueError(f"{a}.{a_col} = {b}.{b_col} is not a declared relationship")

    def tree(self, edges: list[FkEdge], tables: set[str] | None = None) -> list[FkEdge]:
        """The edges in an order in which each touches a table before it; an error unless they span a tree."""
        edges = list(dict.fromkeys(edges))
        names = {t for e in edges for t in (e.child, e.parent)} | (tables or set())
        if len(edges) != len(names) - 1:
            raise ValueError(f"not a tree: {sorted(names)} with {[e.id for e in edges]}")
        out, seen, left = [], {edges[0].child, edges[0].parent} if edges else set(names), edges[1:]
        out += edges[:1]
        while left:
            near = [e for e in left if e.child in seen or e.parent in seen]
            if not near:
                raise ValueError(f"not connected: {[e.id for e in left]}")
            # Many-to-one steps first: they don't multiply rows.
            step = next((e for e in near if e.child in seen), near[0])
            out.append(step)
            left.remove(step)
            seen |= {step.child, step.parent}
        return out

    def path(self, a: str, b: str) -> list[FkEdge]:
        """The shortest chain of edges between two tables."""
        queue: list[tuple[str, list[FkEdge]]] = [(a, [])]
        seen = {a}
        while queue:
            t, way = queue.pop(0)
            if t == b:
                return way
            for e in self.edges:
                for x, y in ((e.child, e.parent), (e.parent, e.child)):
                    if x == t and y not in seen:
                        seen.add(y)
                        queue.append((y, [*way, e]))
        raise ValueError(f"no path from {a} to {b}")


def star_schema() -> SchemaGraph:
    """The graph of the test tables; nation and region have a role for customers and one for suppliers."""
    g = SchemaGraph()
    for who in ("c", "s"):
        g.add_table(TableSpec(f"region_{who}", ("r_regionkey",), ("r_regionkey", "r_name"), "region"))
        g.add_table(TableSpec(f"nation_{who}", ("n_nationkey",), ("n_nationkey", "n_name", "n_regionkey"), "nation"))
    g.add_table(TableSpec("customer", ("c_custkey",), ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), irrelevant=("c_name",)))
    g.add_table(TableSpec("supplier", ("s_suppkey",), ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), irrelevant=("s_name",)))
    g.add_table(TableSpec("part", ("p_partkey",), ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), irrelevant=("p_name",)))
    g.add_table(TableSpec("orders", ("o_orderkey",), ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
    g.add_table(TableSpec("lineitem", ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")))
    g.add_table(TableSpec("events", ("event_id",), ("event_id", "ts", "user_id", "event_type", "value", "props"), irrelevant=("props",)))
    g.add_table(TableSpec("documents", ("doc_id",), ("doc_id", "text", "lang", "source", "n_chars"), irrelevant=("text",)))
    g.add_table(TableSpec("labels", (), ("doc_id", "quality", "toxic")))
    for who, owner in (("c", "customer"), ("s", "supplier")):
        g.add_edge(f"nation_{who}", "n_regionkey", f"region_{who}", "r_regionkey")
        g.add_edge(owner, f"{who}_nationkey", f"nation_{who}", "n_nationkey")
    g.add_edge("orders", "o_custkey", "customer", "c_custkey")
    g.add_edge("lineitem", "l_orderkey", "orders", "o_orderkey")
    g.add_edge("lineitem", "l_partkey", "part", "p_partkey")
    g.add_edge("lineitem", "l_suppkey", "supplier", "s_suppkey")
    g.add_edge("labels", "doc_id", "documents", "doc_id")
    return g
