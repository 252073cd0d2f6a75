"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, context_mixing, line_rules, packing, paragraph_dedup, rule_ensemble, simhash, suffix_dedup, toxicity
from .common import table

WORDS = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Scores from here on count as label 1.
CUT = 0.7
#: Rows that Spark hands to a Python worker at a time: what both sides hold follows it.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: they need not have it installed."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(context, "_tidemark_shipped", None) != context.applicationId:
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # Spark serves the file as long as the application runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{top.name}-{context.applicationId}", "zip", top.parent, top.name))
        context._tidemark_shipped = context.applicationId


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.summary(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (op1_nearest, op2_best_fit_packing, op3_suffix_dedup, op4_toxicity, op5_line_rules, op6_context_mixing, op7_paragraph_dedup, op8_byte_bpe, op9_rule_ensemble, op10_simhash, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query: Callable) -> Callable:
        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_rules": line_rules.SQL}
