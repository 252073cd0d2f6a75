"""Preparation of tables: profiles, codes, dependencies, multipliers, null partners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FkEdge, SchemaGraph


def profile(df: DataFrame) -> DataFrame:
    """(column, n, n_null, n_distinct, all_null) of every column, in one scan."""
    if not df.columns:
        raise ValueError("no columns")
    aggs = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.approx_count_distinct(c, 0.01).alias("n_distinct"), (F.count(c) == 0).alias("all_null")) for c in df.columns]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("p")).select("p.*")


def exact_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """As profile, with exact distinct counts, for chosen columns."""
    wide = df.agg(*[f(c) for c in columns for f in (lambda c: F.count_if(F.col(c).isNull()).alias(f"n_null__{c}"), lambda c: F.count_distinct(c).alias(f"n_distinct__{c}"))], F.count("*").alias("n"))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n"), F.col(f"n_null__{c}").alias("n_null"), F.col(f"n_distinct__{c}").alias("n_distinct")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def relevant(df: DataFrame, most: int = 10_000, dropped: tuple[str, ...] = ()) -> list[str]:
    """Columns worth modelling: not all null, not strings of over `most` values, not determined by another."""
    strings = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return [r["column"] for r in profile(df).collect() if not r["all_null"] and r["column"] not in dropped and not (r["column"] in strings and r["n_distinct"] > most)]


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct non-null values coded 1, 2, ... in their order; null has code 0 by convention."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    # Distinct values of one column: bounded by relevant(), so one ordered window over them is small.
    return values.select("value", F.dense_rank().over(Window.orderBy("value")).cast("long").alias("code"))


def encode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """df with <column>_code; unknown and null values get 0."""
    named = dictionary.select(F.col("value").alias(column), F.col("code").alias(f"{column}_code"))
    return df.join(named, column, "left").withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(0)))


def dependency(df: DataFrame, source: str, dest: str) -> DataFrame:
    """(dest, sources): for each determined value the sorted values that determine it."""
    return df.select(source, dest).where(F.col(dest).isNotNull() & F.col(source).isNotNull()).distinct().groupBy(dest).agg(F.sort_array(F.collect_set(source)).alias("sources"))


def holds(df: DataFrame, source: str, dest: str) -> bool:
    """Whether source determines dest."""
    return df.select(source, dest).distinct().groupBy(source).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def multipliers(parent: DataFrame, children: list[tuple[FkEdge, DataFrame, float]]) -> DataFrame:
    """parent with, for each edge into it, the number of its children over the child's sample rate; 0 without any.

    Children are counted by key before the join, so a key with many children is one row in it.
    """
    for edge, child, rate in children:
        n = child.where(F.col(edge.fk).isNotNull()).groupBy(F.col(edge.fk).alias(edge.pk)).agg((F.count("*") / F.lit(rate)).alias(edge.multiplier))
        parent = parent.join(n, edge.pk, "left").withColumn(edge.multiplier, F.coalesce(edge.multiplier, F.lit(0.0)))
    return parent


def mean_multiplier(parent: DataFrame, edge: FkEdge) -> DataFrame:
    """(edge, mean_mul_nn): the mean of the multiplier with 0 taken as 1."""
    return parent.agg(F.avg(F.greatest(edge.multiplier, F.lit(1.0))).alias("mean_mul_nn")).select(F.lit(edge.id).alias("edge"), "mean_mul_nn")


def null_keys(child: DataFrame, edges: list[FkEdge], rate: float = 1.0) -> DataFrame:
    """(edge, n_null): rows of the child without a partner by a null key, scaled by its sample rate."""
    wide = child.agg(*[(F.count_if(F.col(e.fk).isNull()) / F.lit(rate)).alias(f"n{i}") for i, e in enumerate(edges)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(e.id).alias("edge"), F.col(f"n{i}").alias("n_null")) for i, e in enumerate(edges)])).alias("p")).select("p.*")


def null_partners(parent: DataFrame, child: DataFrame, edge: FkEdge) -> DataFrame:
    """The parent's rows that no child refers to."""
    return parent.join(child.select(F.col(edge.fk).alias(edge.pk)), edge.pk, "left_anti")


def prepare_all(schema: SchemaGraph, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table with its multipliers and without its irrelevant columns."""
    out = {}
    for name, df in tables.items():
        into = [(e, tables[e.child], schema.tables[e.child].sample_rate) for e in schema.find(name, True) if e.child in tables]
        out[name] = multipliers(df.drop(*schema.tables[name].irrelevant), into)
    return out
