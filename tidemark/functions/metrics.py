"""Accuracy metrics as Columns and small frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z90 = 1.6448536269514715


def q_error(estimate: Column, truth: Column) -> Column:
    """max(e/t, t/e), both at least 1."""
    e, t = F.greatest(estimate.cast("double"), F.lit(1.0)), F.greatest(truth.cast("double"), F.lit(1.0))
    return F.greatest(e / t, t / e)


def relative_error(estimate: Column, truth: Column) -> Column:
    return F.abs(truth - estimate) / F.abs(truth)


def q_error_summary(df: DataFrame, estimate: str, truth: str) -> DataFrame:
    q = df.select(q_error(F.col(estimate), F.col(truth)).alias("q"))
    return q.agg(*[F.percentile("q", p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)], F.avg("q").alias("mean"), F.max("q").alias("max"))


def group_metrics(truth: DataFrame, estimate: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and largest relative error over found groups, the share of true groups found, and of found groups that are false."""
    t = truth.select(*keys, F.col(value).alias("t"), F.lit(1).alias("in_t"))
    e = estimate.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col(value).alias("e"), F.lit(1).alias("in_e"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    err = relative_error(F.col("e"), F.col("t"))
    return t.join(e, same, "full").agg(
        F.avg(err).alias("mean_error"),
        F.max(err).alias("max_error"),
        (F.sum(F.when(F.col("in_t").isNotNull() & F.col("in_e").isNotNull(), 1.0).otherwise(0.0)) / F.count("in_t")).alias("completeness"),
        (F.sum(F.when(F.col("in_t").isNull(), 1.0).otherwise(0.0)) / F.count("in_e")).alias("false_share"),
    )


def interval_metrics(df: DataFrame, low: str, high: str, truth: str) -> DataFrame:
    """The share of intervals that hold the truth, and their mean length relative to it."""
    inside = F.when((F.col(truth) >= F.col(low)) & (F.col(truth) <= F.col(high)), 1.0).otherwise(0.0)
    return df.agg(F.avg(inside).alias("precision"), F.avg((F.col(high) - F.col(low)) / F.abs(truth)).alias("relative_length"))


def theory_sd(kind: str, mean: Column, sd: Column, n: Column, total: Column) -> Column:
    """The standard error that sampling theory gives: of a mean, a count among `total` rows, or a sum (their product)."""
    p = n / total
    of_mean, of_count = sd / F.sqrt(n), F.sqrt(total * p * (1 - p))
    if kind == "AVG":
        return of_mean
    if kind == "COUNT":
        return of_count
    return F.sqrt((of_mean * of_mean + mean * mean) * (of_count * of_count + n * n) - mean * mean * n * n)


def product_sd(means: list[Column], sds: list[Column]) -> Column:
    """The standard deviation of a product of independent factors."""
    a, b = F.lit(1.0), F.lit(1.0)
    for m, s in zip(means, sds, strict=True):
        a, b = a * (s * s + m * m), b * (m * m)
    return F.sqrt(F.greatest(a - b, F.lit(0.0)))


def interval(estimate: Column, sd: Column, z: float = Z90) -> tuple[Column, Column]:
    """A two-sided 90 % interval."""
    return estimate - F.lit(z) * sd, estimate + F.lit(z) * sd
