"""Evaluation loops: estimates of many queries against their exact answers, with errors and times."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact
from ..plans.ensemble import Ensemble
from ..plans.query import parse
from . import metrics


def truths(e: Ensemble, tables: dict[str, DataFrame], texts: Iterable[str]) -> list[tuple[int, str, float, float]]:
    """(query_no, query, cardinality_true, seconds) of counting queries, executed exactly."""
    out = []
    for i, text in enumerate(texts):
        began = time.perf_counter()
        value = exact.run(e.schema, tables, parse(e.schema, text), "value").first()["value"]
        out.append((i, text, float(value or 0), time.perf_counter() - began))
    return out


def cardinalities(spark: SparkSession, e: Ensemble, truth: Iterable[tuple[int, str, float, float]], variants: int = 1) -> DataFrame:
    """(query_no, query, estimate, truth, q_error, ms) of counting queries with known answers."""
    rows = []
    for i, text, true, _ in truth:
        spec = parse(e.schema, text)
        e.cache.clear()
        began = time.perf_counter()
        estimate = e.cardinality(spec, variants)
        rows.append((i, text, estimate, float(true), (time.perf_counter() - began) * 1000))
    df = spark.createDataFrame(rows, "query_no int, query string, estimate double, truth double, ms double")
    return df.withColumn("q_error", metrics.q_error(F.col("estimate"), F.col("truth")))


def aggregates(spark: SparkSession, e: Ensemble, tables: dict[str, DataFrame], texts: Iterable[str]) -> DataFrame:
    """(query_no, query, mean_error, max_error, completeness, false_share, precision, relative_length, ms) of queries with groups or without.

    precision and relative_length are those of the 90 % intervals of the groups found.
    """
    out = None
    for i, text in enumerate(texts):
        spec = parse(e.schema, text)
        spec.order, spec.limit = [], None
        e.cache.clear()
        began = time.perf_counter()
        estimate = e.answer(spec, spark)
        ms = (time.perf_counter() - began) * 1000
        truth, keys = exact.run(e.schema, tables, spec), spec.group_names
        one = metrics.group_metrics(truth, estimate, keys, spec.value)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
        named = estimate.select(*[F.col(k).alias(f"e_{k}") for k in keys], "low", "high")
        both = truth.withColumnRenamed(spec.value, "t").join(named, same) if keys else truth.withColumnRenamed(spec.value, "t").crossJoin(named)  # one row each
        one = one.crossJoin(metrics.interval_metrics(both, "low", "high", "t")).select(F.lit(i).alias("query_no"), F.lit(text).alias("query"), "*", F.lit(ms).alias("ms"))
        out = one if out is None else out.union(one)
    return out


def intervals(spark: SparkSession, e: Ensemble, tables: dict[str, DataFrame], texts: Iterable[str], total: dict[str, float]) -> DataFrame:
    """(query_no, kind, value, truth, low, high, theory_low, theory_high): intervals beside those of sampling theory, for one-table queries without groups.

    total: rows of each table; theory takes the model's sample for the sample.
    """
    out = None
    for i, text in enumerate(texts):
        spec = parse(e.schema, text)
        (table,), kind = spec.tables, spec.aggregates[0].op
        answer = e.answer(spec, spark)
        if kind == "COUNT":
            spread = exact.joined(e.schema, tables, spec).agg(F.count("*").cast("double").alias("truth"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sd"), F.count("*").cast("double").alias("n"))
        else:
            spread = exact.with_spread(e.schema, tables, spec).select((F.col("total") if kind == "SUM" else F.col("mean")).alias("truth"), "mean", "sd", F.col("n").cast("double").alias("n"))
        sample = next((m.sample_size for m in e.models if table in m.tables), total[table]) or total[table]
        up = total[table] / max(1.0, sample)  # what a sample's row stands for
        sd = metrics.theory_sd(kind, F.col("mean"), F.col("sd"), F.col("n") / F.lit(up), F.lit(sample)) * (F.lit(1.0) if kind == "AVG" else F.lit(up))
        low, high = metrics.interval(F.col("truth"), sd)
        one = answer.withColumnRenamed(spec.value, "value").crossJoin(spread).select(F.lit(i).alias("query_no"), F.lit(kind).alias("kind"), "value", "truth", "low", "high", low.alias("theory_low"), high.alias("theory_high"))
        out = one if out is None else out.union(one)
    return out
