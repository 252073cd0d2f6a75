"""Readers and writers."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import TableSpec


def read_parquet(spark: SparkSession, sf_dir: str, spec: TableSpec | str) -> DataFrame:
    """A table of the test layout; only the columns that a plan uses are read."""
    name = spec if isinstance(spec, str) else spec.file
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(df: DataFrame) -> DataFrame:
    """df, evaluated once: as a table in the folder that the cluster names in spark.checkpoint.dir, else on the executors' disks."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{folder.rstrip('/')}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, spec: TableSpec, separator: str = ",") -> DataFrame:
    """A file without header, with quotes and backslash escapes; columns are named table.column, those declared irrelevant left out.

    What isn't a number in a numeric column is null.
    """
    df = spark.read.schema(schema).option("sep", separator).option("escape", "\\").option("quote", '"').option("header", False).option("mode", "PERMISSIVE").csv(path)
    return df.select(*[F.col(f"`{c}`").alias(f"{spec.name}.{c}") for c in df.columns if c not in spec.irrelevant])


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query of another database; partition: (column, lowest, highest, readers)."""
    reader = spark.read.format("jdbc").option("url", url)
    if partition:
        column, low, high, n = partition
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load()
    return reader.option("query", query).load()


def read_queries(path: str) -> list[str]:
    """One SQL text a line; empty lines are skipped."""
    return [line.strip().rstrip(";") for line in Path(path).read_text().splitlines() if line.strip()]


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).selectExpr("CAST(query_no AS INT) AS query_no", "query", "CAST(cardinality_true AS DOUBLE) AS cardinality_true")


def write_truth(spark: SparkSession, rows: list[tuple[int, str, float, float]], path: str) -> None:
    """Results of queries with the seconds they took: (query_no, query, cardinality_true, seconds)."""
    spark.createDataFrame(rows, "query_no int, query string, cardinality_true double, seconds double").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scores(spark: SparkSession, scores: dict[tuple[str, str], float], path: str) -> None:
    spark.createDataFrame([(a, b, float(x)) for (a, b), x in scores.items()], "col_a string, col_b string, rdc double").coalesce(1).write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """Dependence by pair of columns, in both orders."""
    return {k: r["rdc"] for r in spark.read.parquet(path).collect() for k in ((r["col_a"], r["col_b"]), (r["col_b"], r["col_a"]))}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_prepared(df: DataFrame, path: str, most: int | None = None, key: str | None = None) -> None:
    """A prepared table as Parquet; with `most`, so many rows at most, those of the least hashes of the key."""
    if most is not None:
        n = df.count()
        if n > most:
            df = df.orderBy(F.xxhash64(key or df.columns[0]), *df.columns[:1]).limit(most)
    df.write.mode("overwrite").parquet(path)


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
