"""Tree-shaped models: mixtures (sum nodes) of independent column groups (product nodes) over histograms (leaves).

The structure is learned from a bounded sample; weights and histograms are then counted over all rows in one
aggregation, so a model's probabilities are those of the whole table.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import exact_sample, hash_sample
from ..sources.tables import held
from .query import Range

#: Distinct numbers of a column from which on its values are binned, and the bins; distinct strings beyond which a column isn't modelled.
MAX_VALUES, BINS, MAX_STRINGS = 10_000, 10_000, 10_000


@dataclass
class Node:
    kind: str  # sum, product, leaf
    scope: tuple[str, ...]
    children: list[Node] = field(default_factory=list)
    centres: list[list[float]] = field(default_factory=list)  # of a sum node's children, over the numeric view of its scope
    id: int = -1
    total: float = 0.0
    # Leaves: values (numbers or strings) and their counts; null_count is apart.
    values: np.ndarray | None = None
    counts: np.ndarray | None = None
    null_count: float = 0.0

    def nodes(self) -> list[Node]:
        return [self, *(n for c in self.children for n in c.nodes())]


@dataclass
class Columns:
    """How the learner sees columns as numbers: offset and scale, codes of strings, bin widths, and what stands for null."""

    names: list[str]
    codes: dict[str, dict[str, int]]
    middle: dict[str, float]
    scale: dict[str, float]
    step: dict[str, float]
    kinds: dict[str, str] = field(default_factory=dict)  # the tables' types
    never_null: list[str] = field(default_factory=list)  # null only where a join has no row of the table

    @staticmethod
    def of(sample) -> Columns:
        names, codes, middle, scale = list(sample.columns), {}, {}, {}
        for c in names:
            col = sample[c].dropna()
            if col.dtype == object:
                codes[c] = {v: i + 1 for i, v in enumerate(sorted(col.unique()))}
                col = col.map(codes[c])
            col = col.astype(float)
            middle[c] = float(col.mean()) if len(col) else 0.0
            scale[c] = float(col.std(ddof=0)) or 1.0 if len(col) else 1.0
        return Columns(names, codes, middle, scale, {})

    def matrix(self, sample) -> np.ndarray:
        out = np.zeros((len(sample), len(self.names)))
        for j, c in enumerate(self.names):
            col = sample[c].map(self.codes[c]) if c in self.codes else sample[c]
            out[:, j] = ((col.astype(float).fillna(self.middle[c]) - self.middle[c]) / self.scale[c]).to_numpy()
        return out

    def number(self, c: str) -> Column:
        """The standardised number of a column, as in matrix(); unknown strings and nulls stand in the middle."""
        x = F.col(c)
        if c in self.codes:
            known = [y for v, k in self.codes[c].items() for y in (F.lit(v), F.lit(float(k)))]
            x = F.create_map(*known)[x] if known else F.lit(None).cast("double")
        return (F.coalesce(x.cast("double"), F.lit(self.middle[c])) - self.middle[c]) / self.scale[c]


def rdc(x: np.ndarray, y: np.ndarray, k: int = 10, s: float = 1 / 6, seed: int = 17) -> float:
    """Randomised dependence coefficient: largest canonical correlation of random sine features of the ranks."""
    rng = np.random.default_rng(seed)

    def lift(v: np.ndarray) -> np.ndarray:
        _, rank, n = np.unique(v, return_inverse=True, return_counts=True)
        cdf = (np.cumsum(n) / len(v))[rank]
        f = np.sin(np.stack([cdf, np.ones(len(v))], 1) @ rng.normal(size=(2, k)) * s)
        return f - f.mean(0)

    if len(x) < 3 or (x == x[0]).all() or (y == y[0]).all():
        return 0.0
    a, b = lift(x), lift(y)
    qa, ra = np.linalg.qr(a)
    qb, rb = np.linalg.qr(b)
    qa, qb = qa[:, np.abs(np.diag(ra)) > 1e-9 * np.abs(np.diag(ra)).max()], qb[:, np.abs(np.diag(rb)) > 1e-9 * np.abs(np.diag(rb)).max()]
    both = qa.T @ qb
    return float(min(1.0, np.linalg.svd(both, compute_uv=False)[0])) if both.size else 0.0


def rdc_matrix(m: np.ndarray, most: int = 5_000) -> np.ndarray:
    m = m[:: max(1, len(m) // most)]
    out = np.eye(m.shape[1])
    for i in range(m.shape[1]):
        for j in range(i):
            out[i, j] = out[j, i] = rdc(m[:, i], m[:, j])
    return out


def groups_of(matrix: np.ndarray, threshold: float) -> list[list[int]]:
    """Connected groups of columns that depend on each other at least by the threshold."""
    left, out = set(range(len(matrix))), []
    while left:
        todo, own = [min(left)], set()
        while todo:
            i = todo.pop()
            if i in own:
                continue
            own.add(i)
            todo += [j for j in left if matrix[i, j] >= threshold and j not in own]
        left -= own
        out.append(sorted(own))
    return out


def two_means(m: np.ndarray, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each row and both centres."""
    rng = np.random.default_rng(seed)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(3):
        c = m[rng.choice(len(m), 2, replace=False)].astype(float)
        for _ in range(20):
            which = (((m - c[0]) ** 2).sum(1) > ((m - c[1]) ** 2).sum(1)).astype(int)
            if which.min() == which.max():
                break
            c = np.stack([m[which == k].mean(0) for k in (0, 1)])
        cost = np.minimum(((m - c[0]) ** 2).sum(1), ((m - c[1]) ** 2).sum(1)).sum()
        if best is None or cost < best[0]:
            best = (cost, which, c)
    return best[1], best[2]


def two_gaussians(m: np.ndarray, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """As two_means, with the means of a mixture of two Gaussians of diagonal covariance."""
    _, c = two_means(m, seed)
    var, share = np.stack([m.var(0) + 1e-6] * 2), np.array([0.5, 0.5])
    for _ in range(30):
        far = np.stack([((m - c[k]) ** 2 / var[k] + np.log(var[k])).sum(1) / 2 - np.log(share[k]) for k in (0, 1)])
        w = np.exp(far.min(0) - far)
        w /= w.sum(0)
        total = np.maximum(w.sum(1), 1e-9)
        c = (w @ m) / total[:, None]
        var = np.stack([(w[k][:, None] * (m - c[k]) ** 2).sum(0) / total[k] for k in (0, 1)]) + 1e-6
        share = np.maximum(total / len(m), 1e-9)
    return (((m - c[0]) ** 2).sum(1) > ((m - c[1]) ** 2).sum(1)).astype(int), c


#: How rows are split in two.
SPLITTERS = {"kmeans": two_means, "gmm": two_gaussians}


def structure(m: np.ndarray, names: list[str], least: int, threshold: float = 0.3, first: bool = True, split_rows: bool = True, rows: str = "kmeans") -> Node:
    """One column: a leaf. Constant columns become leaves apart. Few rows: independent leaves. Else columns are split by
    dependence or rows by two means, rows first at the root."""
    scope = tuple(names)
    if len(names) == 1:
        return Node("leaf", scope)
    naive = lambda: Node("product", scope, [Node("leaf", (c,)) for c in names])
    constant = m.std(0) == 0
    if constant.all() or len(m) <= least:
        return naive()
    if constant.any():
        rest = [i for i in range(len(names)) if not constant[i]]
        kids = [Node("leaf", (names[i],)) for i in np.flatnonzero(constant)]
        return Node("product", scope, [*kids, structure(m[:, rest], [names[i] for i in rest], least, threshold, first, split_rows, rows)])
    if not first or not split_rows:
        parts = groups_of(rdc_matrix(m), threshold)
        if len(parts) > 1:
            return Node("product", scope, [structure(m[:, p], [names[i] for i in p], least, threshold, False, True, rows) for p in parts])
        if not split_rows:
            return naive()
    which, centres = SPLITTERS[rows](m)
    if which.min() == which.max():
        return structure(m, names, least, threshold, False, False, rows)
    kids = [structure(m[which == k], names, least, threshold, False, True, rows) for k in (0, 1)]
    return Node("sum", scope, kids, centres.tolist())


def prune(node: Node) -> Node:
    """Products with one child give way to it; a product's product children are merged into it."""
    node.children = [prune(c) for c in node.children]
    if node.kind == "product":
        node.children = [g for c in node.children for g in (c.children if c.kind == "product" else [c])]
    return node.children[0] if node.kind == "product" and len(node.children) == 1 else node


def check(node: Node) -> None:
    """A sum's children have its scope, a product's share it out; a sum's centres match its children."""
    for n in node.nodes():
        if n.kind == "sum":
            ok = all(set(c.scope) == set(n.scope) for c in n.children) and len(n.centres) == len(n.children) > 0
        elif n.kind == "product":
            ok = sorted(c for k in n.children for c in k.scope) == sorted(n.scope)
        else:
            ok = len(n.scope) == 1 and not n.children
        if not ok:
            raise ValueError(f"invalid {n.kind} node over {n.scope}")


def number_nodes(root: Node) -> Node:
    for i, n in enumerate(root.nodes()):
        n.id = i
    return root


@dataclass
class Model:
    """A tree over the columns of a table or join, with the size of what it stands for."""

    root: Node
    columns: Columns
    tables: frozenset[str] = frozenset()
    edges: tuple = ()
    size: float = 0.0
    sample_size: float = 0.0
    threshold: float = 0.3
    seconds: float = 0.0  # that learning took

    def scope(self) -> set[str]:
        return set(self.root.scope)


def route(root: Node, columns: Columns) -> dict[int, Column]:
    """For each node, whether a row reaches it: sums pass it to the nearest centre, products to all children."""
    out: dict[int, Column] = {}

    def walk(n: Node, here: Column) -> None:
        out[n.id] = here
        if n.kind != "sum":
            for c in n.children:
                walk(c, here)
            return
        far = []
        for centre in n.centres:
            d = F.lit(0.0)
            for c, x in zip(n.scope, centre, strict=True):
                d = d + (columns.number(c) - x) * (columns.number(c) - x)
            far.append(d)
        for k, c in enumerate(n.children):
            mine = F.lit(True)
            for j in range(len(far)):
                if j != k:
                    mine = mine & ((far[k] <= far[j]) if k < j else (far[k] < far[j]))
            walk(c, here & mine)

    walk(root, F.lit(True))
    return out


def flattened(df: DataFrame) -> DataFrame:
    """df with times and dates as seconds."""
    time = {f.name for f in df.schema if f.dataType.simpleString().startswith(("timestamp", "date"))}
    return df.select(*[F.unix_seconds(F.col(c).cast("timestamp")).cast("double").alias(c) if c in time else F.col(c) for c in df.columns])


def leaf_counts(df: DataFrame, model: Model) -> DataFrame:
    """(leaf, value, n): how often each leaf meets each value (as text; null is null). Mergeable: counts of disjoint rows add up.

    Rows are routed batch by batch in numpy: as Columns, trees of hundreds of nodes outgrow generated code.
    """
    columns, root = model.columns, model.root
    names = list(root.scope)

    def run(batches):
        import pandas as pd

        for frame in batches:
            if not len(frame):
                continue
            own = Columns(names, columns.codes, columns.middle, columns.scale, columns.step)
            m = own.matrix(frame)
            out: list[tuple[int, str | None, float]] = []

            def walk(n: Node, rows: np.ndarray) -> None:
                if not len(rows):
                    return
                if n.kind == "leaf":
                    c = n.scope[0]
                    col = frame[c].iloc[rows]
                    if c in columns.step:
                        col = (np.floor(col / columns.step[c]) + 0.5) * columns.step[c]
                    hist = col.value_counts(dropna=False)
                    out.extend((n.id, None if pd.isna(v) else str(v if c in columns.codes or isinstance(v, str) else float(v)), float(k)) for v, k in hist.items())
                elif n.kind == "product":
                    for c in n.children:
                        walk(c, rows)
                else:
                    at = [names.index(c) for c in n.scope]
                    far = np.stack([((m[np.ix_(rows, at)] - np.array(centre)) ** 2).sum(1) for centre in n.centres])
                    which = far.argmin(0)
                    for k, c in enumerate(n.children):
                        walk(c, rows[which == k])

            walk(root, np.arange(len(frame)))
            yield pd.DataFrame(out, columns=["leaf", "value", "n"])

    parts = df.select(*names).mapInPandas(run, "leaf int, value string, n double")
    return parts.groupBy("leaf", "value").agg(F.sum("n").alias("n"))


def absorb(model: Model, counts: list[tuple[int, str | None, float]], reset: bool = False) -> Model:
    """The counts added to the leaves, and weights following; negative counts take rows away again."""
    by = {n.id: n for n in model.root.nodes()}
    seen: dict[int, dict] = {}
    for n in by.values():
        if n.kind == "leaf":
            seen[n.id] = {} if reset or n.values is None else dict(zip(n.values.tolist(), n.counts.tolist(), strict=True))
            if reset:
                n.null_count = 0.0
    for leaf, value, n in counts:
        node = by[leaf]
        if value is None:
            node.null_count += n
        else:
            v = value if node.scope[0] in model.columns.codes else float(value)
            seen[leaf][v] = seen[leaf].get(v, 0.0) + n
    for i, hist in seen.items():
        keys = sorted(k for k, n in hist.items() if n > 0)
        by[i].values = np.array(keys, object if by[i].scope[0] in model.columns.codes else float)
        by[i].counts = np.array([hist[k] for k in keys], float)
        by[i].null_count = max(0.0, by[i].null_count)

    def total(n: Node) -> float:
        kids = [total(c) for c in n.children]
        n.total = float(n.counts.sum() + n.null_count) if n.kind == "leaf" else sum(kids) if n.kind == "sum" else max(kids)
        return n.total

    model.size = total(model.root)
    return model


def learn(df: DataFrame, names: list[str], key: list[str], sample_rows: int = 20_000, threshold: float = 0.3, least_share: float = 0.01, tables: frozenset[str] = frozenset(), edges: tuple = (), rows: str = "kmeans") -> Model:
    """A model of the chosen columns: structure from about `sample_rows` rows by hash of key, counts from all rows.

    df is evaluated once. Columns without values and strings of over MAX_STRINGS values are left out; numbers of over
    MAX_VALUES values are binned over their whole range.
    """
    began, typed = time.perf_counter(), df.select(*key, *[c for c in names if c not in key]) if key else df.select(*names)
    flat = held(flattened(typed))
    kinds = {c: typed.schema[c].dataType.simpleString() for c in names}
    strings = {c for c in names if kinds[c] == "string"}
    present = lambda c: F.col(f"{c.split('__')[0]}__nn") == 1 if f"{c.split('__')[0]}__nn" in flat.columns else F.lit(True)
    facts = flat.agg(F.count("*").alias("n"), *[x for i, c in enumerate(names) for x in (F.approx_count_distinct(c).alias(f"d{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), F.count_if(F.col(c).isNull() & present(c)).alias(f"z{i}"))]).first()
    n, seen = facts["n"], {c: (facts[f"d{i}"], facts[f"l{i}"], facts[f"h{i}"]) for i, c in enumerate(names)}
    names = [c for c in names if not n or (seen[c][1] is not None and not (c in strings and seen[c][0] > MAX_STRINGS))]
    part = hash_sample(flat, key or names, min(1.0, sample_rows / max(1, n)))
    sample = part.select(*names).toPandas()
    if n and not len(sample):
        sample = exact_sample(flat, key or names, min(n, sample_rows)).select(*names).toPandas()
    sample = sample.sort_values(names, ignore_index=True) if names else sample
    for c in names:
        if sample[c].dtype != object or c not in strings:
            sample[c] = sample[c].astype(float)
    columns = Columns.of(sample)
    columns.kinds, columns.never_null = {c: kinds[c] for c in names}, [c for i, c in enumerate(seen) if c in names and not facts[f"z{i}"]]
    columns.step = {c: (float(seen[c][2]) - float(seen[c][1])) / BINS for c in names if c not in strings and seen[c][0] > MAX_VALUES}
    root = number_nodes(prune(structure(columns.matrix(sample), names, max(2, int(least_share * len(sample))), threshold, rows=rows))) if len(sample) else number_nodes(Node("product", tuple(names), [Node("leaf", (c,)) for c in names]))
    check(root)
    model = Model(root, columns, tables, edges, threshold=threshold, sample_size=float(len(sample)))
    absorb(model, collected(leaf_counts(flat, model)), reset=True)
    flat.unpersist()
    model.seconds = time.perf_counter() - began
    return model


def collected(counts: DataFrame) -> list[tuple[int, str | None, float]]:
    """(leaf, value, n) on the driver: at most MAX_VALUES or MAX_STRINGS rows a leaf."""
    found = counts.toArrow()
    return list(zip(*(found.column(c).to_pylist() for c in ("leaf", "value", "n")), strict=True))


# --- inference -------------------------------------------------------------------------------------------------------


def _leaf(n: Node, r: Range | None, power: float | None) -> float:
    """E[1(value in r) * value**power] at a leaf; unconstrained and without power: 1."""
    if n.total <= 0:
        return 0.0
    if r is None and power is None:
        return 1.0
    if r is not None and r.empty:
        return 0.0
    if r is not None and r.null_only:
        return n.null_count / n.total if power is None else 0.0
    v, c = n.values, n.counts
    if r is not None and len(v):
        if v.dtype == object or r.values is not None or r.excluded:
            keep = np.fromiter((r.allows(x) for x in v.tolist()), bool, len(v))
            v, c = v[keep], c[keep]
        else:
            a, b = np.searchsorted(v, r.low, "left" if r.low_in else "right"), np.searchsorted(v, r.high, "right" if r.high_in else "left")
            v, c = v[a:b], c[a:b]
    if power is None:
        return float(c.sum()) / n.total
    with np.errstate(divide="ignore"):
        return float((c * np.power(v.astype(float), power)).sum()) / n.total if len(v) else 0.0


def expectation(n: Node, where: dict[str, Range], powers: dict[str, float] | None = None, functions: dict[str, Callable] | None = None) -> float:
    """E[1(where) * product of column**power]; columns in powers count only where they aren't null.

    functions: by kind of node, what to use instead: f(node, where, powers, of a child).
    """
    powers = powers or {}
    if functions and n.kind in functions:
        return functions[n.kind](n, where, powers, lambda c: expectation(c, where, powers, functions))
    if not any(c in where or c in powers for c in n.scope):
        return 1.0
    if n.kind == "leaf":
        return _leaf(n, where.get(n.scope[0]), powers.get(n.scope[0]))
    if n.kind == "product":
        out = 1.0
        for c in n.children:
            out *= expectation(c, where, powers, functions)
            if out == 0:
                return 0.0
        return out
    total = sum(c.total for c in n.children)
    return sum(c.total * expectation(c, where, powers, functions) for c in n.children) / total if total else 0.0


#: Of a grouped column: for each group which of the value sets it has, and the sets (None: null).
Keys = dict[str, tuple[np.ndarray, list[tuple]]]


def batch_expectation(n: Node, where: dict[str, Range], powers: dict[str, float], keys: Keys) -> np.ndarray | float:
    """expectation() of all groups at once: an array over groups, or one number where nothing depends on the group."""
    if not any(c in keys for c in n.scope):
        return expectation(n, where, powers)
    if n.kind == "leaf":
        (c,) = n.scope
        which, sets = keys[c]
        r, power = where.get(c), powers.get(c)
        held = dict(zip(n.values.tolist(), n.counts.tolist(), strict=True))

        def mass(v: object) -> float:
            if v is None:
                return n.null_count if power is None and (r is None or not r.not_null) else 0.0
            if v not in held or (r is not None and not r.allows(v)):
                return 0.0
            return held[v] if power is None else held[v] * float(v) ** power

        return np.array([sum(map(mass, s)) for s in sets])[which] / max(n.total, 1e-300)
    if n.kind == "product":
        out = 1.0
        for c in n.children:
            if any(k in where or k in powers or k in keys for k in c.scope):
                out = out * batch_expectation(c, where, powers, keys)
        return out
    total = sum(c.total for c in n.children)
    return sum(c.total * batch_expectation(c, where, powers, keys) for c in n.children) / total if total else 0.0


def batch_moments(m: Model, where: dict[str, Range], powers: dict[str, float], keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """moments() of all groups at once."""
    e, n = np.asarray(batch_expectation(m.root, where, powers, keys)), max(1.0, m.sample_size or m.size)
    if not powers:
        p = np.clip(e, 0, 1)
        return e, np.sqrt(p * (1 - p) / n)
    square = batch_expectation(m.root, where, {c: 2 * k for c, k in powers.items()}, keys)
    return e, np.sqrt(np.maximum(0.0, square - e * e) / n)


def moments(m: Model, where: dict[str, Range], powers: dict[str, float] | None = None) -> tuple[float, float]:
    """The expectation and its standard error for the model's sample."""
    e = expectation(m.root, where, powers)
    n = max(1.0, m.sample_size or m.size)
    if not powers:
        p = min(1.0, max(0.0, e))
        return e, math.sqrt(p * (1 - p) / n)
    square = expectation(m.root, where, {c: 2 * k for c, k in powers.items()})
    return e, math.sqrt(max(0.0, square - e * e) / n)


def distinct(n: Node, columns: list[str], where: dict[str, Range], most: int = 1_000_000) -> list[tuple]:
    """The value tuples of columns that the model holds under the conditions: products cross, sums unite."""
    own = [c for c in columns if c in n.scope]
    if expectation(n, {k: v for k, v in where.items() if k in n.scope}) == 0:
        return []
    if n.kind == "leaf":
        r = where.get(n.scope[0])
        values = [v for v in n.values.tolist() if r is None or r.allows(v)] + ([None] if n.null_count and (r is None or r.null_only) else [])
        return [(v,) for v in values]
    if n.kind == "sum":
        return list(dict.fromkeys(t for c in n.children for t in distinct(c, own, where, most)))
    out: list[dict] = [{}]
    for c in n.children:
        some = [k for k in own if k in c.scope]
        if some:
            part = distinct(c, some, where, most)
            if len(out) * len(part) > most:
                raise ValueError(f"over {most} groups: exact.run answers the query without holding them on the driver")
            out = [{**d, **dict(zip(some, t, strict=True))} for d in out for t in part]
        elif expectation(c, {k: v for k, v in where.items() if k in c.scope}) == 0:
            return []
    return [tuple(d[k] for k in own) for d in out]


def probability_column(n: Node, tests: dict[str, callable]) -> Column:
    """P of a conjunction as a Column over a frame of group values: tests map a model column to (leaf value -> Column test).

    For wide group-bys: one row a group, all compiled to one expression.
    """
    if not any(c in tests for c in n.scope):
        return F.lit(1.0)
    if n.kind == "leaf":
        out = F.lit(0.0)
        for v, c in zip(n.values.tolist(), n.counts.tolist(), strict=True):
            out = out + F.when(tests[n.scope[0]](v), F.lit(c / n.total)).otherwise(F.lit(0.0))
        return out
    if n.kind == "product":
        out = F.lit(1.0)
        for c in n.children:
            if any(k in tests for k in c.scope):
                out = out * probability_column(c, tests)
        return out
    total, out = sum(c.total for c in n.children), F.lit(0.0)
    for c in n.children:
        out = out + F.lit(c.total / total) * probability_column(c, tests)
    return out


def cumulative(n: Node) -> list[tuple[object, float]]:
    """A leaf's values with the share of rows up to each, of those that aren't null."""
    total = float(n.counts.sum())
    return [(v, float(c) / total) for v, c in zip(n.values.tolist(), np.cumsum(n.counts), strict=True)] if total else []


def leaf_moments(n: Node) -> dict[str, float]:
    """Means of x, x**2, 1/x and 1/x**2 over a numeric leaf's values that aren't null, inverses over those that aren't 0."""
    v, c = n.values.astype(float), n.counts
    real = v != 0
    mean = lambda x, w: float((x * w).sum() / w.sum()) if w.sum() else math.nan
    return {"mean": mean(v, c), "mean_square": mean(v * v, c), "mean_inverse": mean(1 / v[real], c[real]), "mean_inverse_square": mean(1 / v[real] ** 2, c[real])}


# --- storage ---------------------------------------------------------------------------------------------------------


def save(spark: SparkSession, models: list[Model], path: str) -> None:
    """Models as Parquet: nodes with their structure, and leaf histograms."""
    heads, rows = [], []
    for k, m in enumerate(models):
        parent = {c.id: n.id for n in m.root.nodes() for c in n.children}
        meta = {"columns": vars(m.columns), "tables": sorted(m.tables), "edges": [list(vars(e).values()) for e in m.edges], "size": m.size, "sample_size": m.sample_size, "threshold": m.threshold, "seconds": m.seconds}
        nodes = [{"id": n.id, "kind": n.kind, "scope": n.scope, "centres": n.centres, "parent": parent.get(n.id), "null_count": n.null_count} for n in m.root.nodes()]
        heads.append((k, json.dumps(meta), json.dumps(nodes)))
        rows += [(k, n.id, str(v), float(c)) for n in m.root.nodes() if n.kind == "leaf" for v, c in zip(n.values.tolist(), n.counts.tolist(), strict=True)]
    spark.createDataFrame(heads, "model int, meta string, nodes string").coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    spark.createDataFrame(rows, "model int, leaf int, value string, n double").write.mode("overwrite").parquet(f"{path}/leaves")


def load(spark: SparkSession, *paths: str) -> list[Model]:
    """The models of all paths, one after another."""
    from ..schema import FkEdge

    out = []
    for path in paths:
        leaves: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/leaves").toLocalIterator():
            leaves.setdefault(r["model"], []).append((r["leaf"], r["value"], r["n"]))
        for r in spark.read.parquet(f"{path}/models").orderBy("model").collect():
            meta, specs = json.loads(r["meta"]), json.loads(r["nodes"])
            nodes = {s["id"]: Node(s["kind"], tuple(s["scope"]), [], s["centres"], s["id"]) for s in specs}
            root = None
            for s in specs:
                if s["parent"] is None:
                    root = nodes[s["id"]]
                else:
                    nodes[s["parent"]].children.append(nodes[s["id"]])
            m = Model(root, Columns(**meta["columns"]), frozenset(meta["tables"]), tuple(FkEdge(*e) for e in meta["edges"]), threshold=meta["threshold"], sample_size=meta["sample_size"], seconds=meta["seconds"])
            nulls = [(s["id"], None, s["null_count"]) for s in specs if s["null_count"]]
            out.append(absorb(m, [*leaves.get(r["model"], []), *nulls], reset=True))
    return out


def statistics(spark: SparkSession, models: list[Model]) -> DataFrame:
    """One row a model: tables, columns, nodes, depth, sample."""
    depth = lambda n: 1 + max((depth(c) for c in n.children), default=0)
    rows = [(i, ",".join(sorted(m.tables)), len(m.root.scope), len(m.root.nodes()), sum(n.kind == "sum" for n in m.root.nodes()), sum(n.kind == "leaf" for n in m.root.nodes()), depth(m.root), m.sample_size, m.size, m.threshold, m.seconds) for i, m in enumerate(models)]
    return spark.createDataFrame(rows, "model int, tables string, n_columns int, n_nodes int, n_sums int, n_leaves int, depth int, sample_size double, size double, threshold double, seconds double")
