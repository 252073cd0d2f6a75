"""Joins along foreign keys, their sizes, and samples of them."""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FkEdge, SchemaGraph
from .prepare import multipliers


def qualified(df: DataFrame, table: str) -> DataFrame:
    """df with columns named table__column."""
    return df.select(*[F.col(c).alias(c if c.startswith("mul__") else f"{table}__{c}") for c in df.columns])


def tree_join(schema: SchemaGraph, tables: dict[str, DataFrame], edges: list[FkEdge], how: str = "inner") -> DataFrame:
    """The tables joined along a tree of edges; Catalyst chooses order and strategy."""
    steps = schema.tree(edges, set(tables) if not edges else None)
    first = steps[0].child if steps else next(iter(tables))
    out, seen = qualified(tables[first], first), {first}
    for e in steps:
        fresh = e.parent if e.child in seen else e.child
        out = out.join(qualified(tables[fresh], fresh), F.col(f"{e.child}__{e.fk}") == F.col(f"{e.parent}__{e.pk}"), how)
        seen.add(fresh)
    return out


def full_outer(schema: SchemaGraph, tables: dict[str, DataFrame], edges: list[FkEdge], outside: Iterable[FkEdge] | None = None) -> DataFrame:
    """The full outer join with presence flags and multipliers.

    <table>__nn is 1 where a row has a tuple of the table. Multipliers of edges inside the join count 0 as 1; those of
    edges that leave it (outside: with their children's tables in `tables`) stay as they are, 0 where missing.
    """
    names = {t for e in edges for t in (e.child, e.parent)} or set(list(tables)[:1])
    leaving = [e for e in (schema.edges if outside is None else outside) if e.parent in names and e not in edges and e.child in tables]
    ready = {}
    for t in names:
        into = [(e, tables[e.child], schema.tables[e.child].sample_rate) for e in [*edges, *leaving] if e.parent == t]
        ready[t] = multipliers(tables[t], into).withColumn("nn", F.lit(1))
    out = tree_join(schema, ready, edges, "full")
    for t in names:
        out = out.withColumn(f"{t}__nn", F.coalesce(f"{t}__nn", F.lit(0)))
    for e in edges:
        out = out.withColumn(e.multiplier, F.greatest(F.coalesce(e.multiplier, F.lit(1.0)), F.lit(1.0)))
    for e in leaving:
        out = out.withColumn(e.multiplier, F.coalesce(e.multiplier, F.lit(0.0)))
    return out


def size_estimate(schema: SchemaGraph, sizes: dict[str, float], means: dict[str, float], edges: list[FkEdge], start: str | None = None, unmatched: dict[str, float] | None = None) -> float:
    """The full join's size from table sizes and mean multipliers: each one-to-many step multiplies, each many-to-one keeps.

    unmatched: by edge, rows of the side that the step adds without a partner; they come on top.
    """
    steps = schema.tree(edges)
    start = start or (steps[0].child if steps else next(iter(sizes)))
    seen, size, left = {start}, sizes[start], list(steps)
    while left:
        e = next(e for e in left if e.child in seen or e.parent in seen)
        if e.parent in seen:
            size *= means[e.id]
        size += (unmatched or {}).get(e.id, 0.0)
        seen |= {e.child, e.parent}
        left.remove(e)
    return size


def start_table(schema: SchemaGraph, names: set[str], edges: list[FkEdge]) -> str:
    """Where to start a join sample: a sampled table first, else that with most edges into it."""
    sampled = [t for t in sorted(names) if schema.tables[t].sample_rate < 1]
    return sampled[0] if sampled else max(sorted(names), key=lambda t: sum(e.parent == t for e in edges))


def chosen(key: list[str], rate: float, seed: int = 17) -> Column:
    """Whether a row is in a sample of `rate`, by 63 bits of the hash of its key: rates of one in billions still hold."""
    return F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(min((1 << 63) - 1, int(rate * (1 << 63))))


def hash_sample(df: DataFrame, key: list[str], rate: float, seed: int = 17) -> DataFrame:
    """Rows by the hash of their key: the same rows however the table is partitioned."""
    return df if rate >= 1 else df.where(chosen(key, rate, seed))


def rounded(x: Column, key: list[str], seed: int = 17) -> Column:
    """x to the whole number below or above, above as often as its fraction says; the same for the same key."""
    return F.floor(x + F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("long")


def table_sample(df: DataFrame, percent: float, seed: int = 17) -> DataFrame:
    """TABLESAMPLE (percent) REPEATABLE (seed)."""
    return df.sample(False, percent / 100, seed)


def two_stage_sample(schema: SchemaGraph, tables: dict[str, DataFrame], edges: list[FkEdge], n: int, estimate: float, factor: float = 1.5, cap: int | None = None, seed: int = 17) -> DataFrame:
    """About n rows of the full outer join along edges: rows of the start table at `factor` times the rate that the estimated
    size asks for, joined, then exactly n rows (all, if fewer) of the least hashes. cap: rows of a step's result at most.

    Rows that no row of the start table leads to are left out, as are those that the rate drops.
    """
    start = start_table(schema, {t for e in edges for t in (e.child, e.parent)}, edges)
    own, rate = dict(tables), min(1.0, factor * n / max(1.0, estimate))
    own[start] = hash_sample(tables[start], list(schema.tables[start].key), rate, seed)
    out, seen, left = qualified(own[start], start), {start}, list(edges)
    while left:
        e = next(e for e in left if e.child in seen or e.parent in seen)
        fresh = e.parent if e.child in seen else e.child
        out = out.join(qualified(own[fresh], fresh), F.col(f"{e.child}__{e.fk}") == F.col(f"{e.parent}__{e.pk}"), "left")
        if cap is not None:
            out = out.orderBy(F.xxhash64(*out.columns, F.lit(seed))).limit(cap)
        seen.add(fresh)
        left.remove(e)
    return exact_sample(out, out.columns, n, seed)


def key_tables(edges: Iterable[FkEdge]) -> set[tuple[str, str]]:
    """The tables that each edge links."""
    return {(e.child, e.parent) for e in edges}


def pair_filter(df: DataFrame, columns: list[str]) -> DataFrame:
    """The combinations of values that occur: group tuples that a model crosses are kept by a left semi join with it."""
    return df.select(*columns).distinct()


def exact_sample(df: DataFrame, key: list[str], n: int, seed: int = 17) -> DataFrame:
    """Exactly n rows (all, if fewer), those of the least hashes of their key."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def join_sample(schema: SchemaGraph, tables: dict[str, DataFrame], edges: list[FkEdge], rate: float, seed: int = 17) -> DataFrame:
    """A sample of the full outer join. The join is built on full tables first: a sampled child would invent parents without children."""
    joined = full_outer(schema, tables, edges)
    keys = [c for c in joined.columns if not c.startswith("mul__") and not c.endswith("__nn")]
    return hash_sample(joined, keys, rate, seed)


def consistent_sample(sample: DataFrame, neighbour: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Rows of a table's sample with a partner in the neighbour's sample; each once."""
    return sample.join(neighbour.select(F.col(on[1]).alias(on[0])), on[0], "left_semi")


def split_by_share(df: DataFrame, key: list[str], share: float) -> tuple[DataFrame, DataFrame]:
    """A part to learn from and the later `share` of rows, by hash."""
    late = chosen(key, share, 29)
    return df.where(~late), df.where(late)


def split_by_condition(df: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """The rows for which the condition holds, and all others (unknown too)."""
    c = F.coalesce(F.expr(condition), F.lit(False))
    return df.where(c), df.where(~c)


def random_tree(schema: SchemaGraph, tables: int, seed: int) -> list[FkEdge]:
    """A random connected set of edges over so many tables."""
    rng = random.Random(seed)
    names, edges = {rng.choice(sorted(schema.tables))}, []
    while len(names) < tables:
        near = [e for e in schema.edges if (e.child in names) != (e.parent in names)]
        if not near:
            break
        edges.append(rng.choice(near))
        names |= {edges[-1].child, edges[-1].parent}
    return edges
