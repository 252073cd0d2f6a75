"""Exact answers: the same query model, executed by Catalyst over the tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import QuerySpec, WhatIf, aggregate_column
from ..schema import SchemaGraph
from .joins import tree_join


def joined(schema: SchemaGraph, tables: dict[str, DataFrame], spec: QuerySpec) -> DataFrame:
    """The tables' inner join under the predicates, which apply before the join and reach the scans."""
    own = {}
    for t in spec.tables:
        df = tables[t]
        for p in spec.predicates:
            if p.table == t:
                df = df.where(p.test(F.col(p.column)))
        own[t] = df
    return tree_join(schema, own, spec.edges)


def run(schema: SchemaGraph, tables: dict[str, DataFrame], spec: QuerySpec, name: str | None = None, scenario: WhatIf | None = None) -> DataFrame:
    """The groups and the aggregate (as `name`, else as the query names it); ORDER BY and LIMIT apply. With a scenario, counts and sums are reweighted."""
    rows, name = joined(schema, tables, spec), name or spec.value
    groups = [F.col(f"{t}__{c}").alias(n) for (t, c), n in zip(spec.groups, spec.group_names, strict=True)]
    if scenario is None:
        agg = aggregate_column(spec)
    else:
        hit = F.lit(True)
        for p in scenario.predicates:
            hit = hit & p.test(F.col(p.name))
        w = F.when(hit, F.lit(1.0 + scenario.change)).otherwise(F.lit(1.0))
        agg = None
        for a in spec.aggregates:
            x = F.lit(1.0)
            for f in a.factors if a.op != "COUNT" else ():
                x = x * F.col("__".join(f))
            if a.op == "COUNT" and a.factors:  # rows in which the product isn't null
                x = F.lit(1.0)
                for f in a.factors:
                    x = F.when(F.col("__".join(f)).isNotNull(), x)
            c = F.sum(x * w) if a.op != "AVG" else F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))
            agg = a.sign * c if agg is None else agg + a.sign * c
    rate = math.prod(schema.tables[t].sample_rate for t in spec.tables)
    if rate != 1 and not any(a.op == "AVG" for a in spec.aggregates):  # rows of samples stand for more
        agg = agg / F.lit(rate)
    out = rows.groupBy(*groups).agg(agg.alias(name)) if groups else rows.agg(agg.alias(name))
    if spec.order:
        shown = {spec.value: name}
        out = out.orderBy(*[F.desc(shown.get(c, c)) if down else F.asc(shown.get(c, c)) for c, down in spec.order])
    return out.limit(spec.limit) if spec.limit is not None else out


def with_spread(schema: SchemaGraph, tables: dict[str, DataFrame], spec: QuerySpec) -> DataFrame:
    """Per group: sum, mean, sample deviation and count of the aggregate's product, as truth for intervals."""
    x = F.lit(1.0)
    for f in spec.aggregates[0].factors:
        x = x * F.col("__".join(f))
    rows = joined(schema, tables, spec)
    return rows.groupBy(*[F.col(f"{t}__{c}").alias(c) for t, c in spec.groups]).agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
