"""Incremental models: new rows are routed down the fixed tree, and their counts merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import Model, absorb, collected, flattened, leaf_counts, load, save


def update(model: Model, rows: DataFrame, sign: int = 1) -> Model:
    """The model with the rows added (sign -1: taken away). Centres don't move, so one batch equals any order of rows."""
    counts = leaf_counts(flattened(rows.select(*model.root.scope)), model)
    return absorb(model, [(leaf, value, sign * n) for leaf, value, n in collected(counts)])


def stored(spark: SparkSession, store: str) -> tuple[Model | None, int]:
    """The last model that follow() stored, and its batch (none: -1). A model counts once its marker is written."""
    try:
        last = spark.read.parquet(f"{store}/done").agg({"batch": "max"}).first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None, -1
    return load(spark, f"{store}/batch-{last}")[0], int(last)


def follow(model: Model, stream: DataFrame, checkpoint: str, store: str, on_update: Callable[[Model, int], None] | None = None, **trigger) -> StreamingQuery:
    """Merges every micro-batch of a stream into the model, which is stored with the batch's number.

    After a restart, begin with the model of stored(): batches up to its number, which may come again, are left out.
    """
    spark = stream.sparkSession
    done = [stored(spark, store)[1]]

    def merge(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= done[0]:
            return
        update(model, batch)
        save(spark, [model], f"{store}/batch-{batch_id}")
        spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(f"{store}/done")
        done[0] = batch_id
        if on_update:
            on_update(model, batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
